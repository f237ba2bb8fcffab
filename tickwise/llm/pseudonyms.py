"""Format-preserving pseudonyms for personal numbers, dates and addresses."""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_left
from functools import lru_cache
from hashlib import sha256, shake_256
from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("card", "iban", "phone", "ip", "date", "email", "secret")


class Cipher:
    """A keyed permutation of 0..n-1 for any n: a Feistel network on two numbers, walked until it lands below n."""

    def __init__(self, key: bytes):
        self.key = sha256(key).digest()

    def _mix(self, label: str, step: int, value: int, size: int) -> int:
        keyed = shake_256(self.key + f"|{label}|{step}|{value:x}".encode())
        return int.from_bytes(keyed.digest(size.bit_length() // 8 + 17), "big") % size

    def _once(self, x: int, rows: int, columns: int, label: str, back: bool) -> int:
        left, right = divmod(x, columns)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if step % 2:
                right = (right + sign * self._mix(label, step, left, columns)) % columns
            else:
                left = (left + sign * self._mix(label, step, right, rows)) % rows
        return left * columns + right

    def permute(self, x: int, size: int, label: str, back: bool = False) -> int:
        if size < 2:
            return x
        columns = isqrt(size - 1) + 1
        rows = -(-size // columns)
        while True:
            x = self._once(x, rows, columns, label, back)
            if x < size:
                return x


def luhn_digit(digits: str) -> str:
    """The check digit that ``digits`` get at their end."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(cipher: Cipher, digits: str, label: str, back: bool) -> str:
    size = 10 ** len(digits)
    return f"{cipher.permute(int(digits or 0), size, label, back):0{len(digits)}d}" if digits else ""


def _mixed(cipher: Cipher, value: str, label: str, back: bool) -> str:
    """Permutes ASCII letters and digits, each within its class; other characters stay."""
    sets = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "" for c in (x if x.isascii() else "-" for x in value)]
    number, size = 0, 1
    for c, letters in zip(value, sets):
        if letters:
            number, size = number * len(letters) + letters.index(c), size * len(letters)
    number = cipher.permute(number, size, f"{label}{''.join('-' if not s else s[0] for s in sets)}", back)
    out = []
    for c, letters in zip(reversed(value), reversed(sets)):
        if letters:
            number, at = divmod(number, len(letters))
            c = letters[at]
        out.append(c)
    return "".join(reversed(out))


# --- kinds: what is found, whether it is valid, what it becomes -------------


def _card(cipher: Cipher, m: re.Match, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = _digits(cipher, digits[:-1], f"card{len(digits)}", back)
    return _refill(m[0], body + luhn_digit(body))


def _iban(cipher: Cipher, m: re.Match, back: bool) -> str | None:
    plain = m[0].replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or iban_check(country, rest) != check:
        return None
    fresh = _mixed(cipher, rest, f"iban{country}", back)
    it = iter(country + iban_check(country, fresh) + fresh)
    return "".join(c if c == " " else next(it) for c in m[0])


def _phone(cipher: Cipher, m: re.Match, back: bool) -> str | None:
    country, rest = m["country"] or "", m[0][len(m["country"] or "") :]
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 13:
        return None
    return country + _refill(rest, _digits(cipher, digits, f"phone{country or '+1'}{len(digits)}", back))


def _ip(cipher: Cipher, m: re.Match, back: bool) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255 or any(x != str(int(x)) for x in m[0].split(".")):
        return None
    x = cipher.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _form(day: dt.date) -> tuple[int, bool]:
    """What a date's ways of writing depend on: one or two digits, and whether the day could be a month. Permutations keep it."""
    return (0 if day.day < 10 else 1 if day.day <= 12 else 2), day.month < 10


FORMS: dict[tuple[int, bool], list[int]] = {}
for _day in range(FIRST_DAY, LAST_DAY + 1):
    FORMS.setdefault(_form(dt.date.fromordinal(_day)), []).append(_day)


def _date(cipher: Cipher, m: re.Match, back: bool) -> str | None:
    """Year-month-day, day.month.year, day-month-year and month/day/year, the other order of day and month where that
    isn't valid: days of 1900 to 2099 stay such days, the same in each way of writing."""
    if m["iy"]:
        mark, orders, parts = m["is"], ["ymd"], (m["iy"], m["im"], m["id"])
    else:
        mark, parts = m["s"], (m["a"], m["b"], m["y"])
        orders = ["mdy", "dmy"] if mark == "/" else ["dmy", "mdy"]
    for order in orders:
        value = dict(zip(order, map(int, parts)))
        try:
            day = dt.date(value["y"], value["m"], value["d"])
        except ValueError:
            continue
        alike = FORMS[_form(day)]
        kind = "date{}{:d}".format(*_form(day))
        moved = dt.date.fromordinal(alike[cipher.permute(bisect_left(alike, day.toordinal()), len(alike), kind, back)])
        fresh = {"y": moved.year, "m": moved.month, "d": moved.day}
        return mark.join(f"{fresh[x]:0{len(part)}d}" for x, part in zip(order, parts))
    return None


def _email(cipher: Cipher, m: re.Match, back: bool) -> str | None:
    """Each run of ASCII characters of the name is a value; letters with accents stay."""
    return ASCII_RUN.sub(lambda x: _mixed(cipher, x[0], "email", back), m["local"]) + f"@{m['domain']}"


def _secret(cipher: Cipher, m: re.Match, back: bool) -> str | None:
    """Runs of 32 to 128 hexadecimal digits, such as keys: permuted as a number of so many digits, in their case."""
    text = m[0]
    if not (re.search(r"\d", text) and re.search(r"[a-fA-F]", text)) or (text != text.lower() and text != text.upper()):
        return None
    moved = f"{cipher.permute(int(text, 16), 16 ** len(text), f'hex{len(text)}', back):0{len(text)}x}"
    return moved.upper() if text == text.upper() else moved


ASCII_RUN = re.compile("[A-Za-z0-9][A-Za-z0-9._%+-]*")
#: Tried in this order at each place; a match that isn't valid stays as it is.
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9\u00c0-\u024f._%+-])(?P<local>[A-Za-z0-9\u00c0-\u024f._%+-]{0,63}[A-Za-z0-9\u00c0-\u024f_%+-])@(?P<domain>(?:[\w-]+\.)+[A-Za-z]{2,}))"
    r"|(?P<secret>(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![0-9+])(?:(?P<country>\+[1-9][0-9]{0,2})(?:(?<=\+1)[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:(?! [0-9]{1,3}(?:\.[0-9]{1,3}){3}| [0-9]{13})[ .-]?[0-9]{2,4}){1,4})(?![0-9])"
    r"|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9])(?:(?P<iy>(?:19|20)[0-9]{2})(?P<is>[-/.])(?P<im>[0-9]{1,2})(?P=is)(?P<id>[0-9]{1,2})"
    r"|(?P<a>[0-9]{1,2})(?P<s>[-./])(?P<b>[0-9]{1,2})(?P=s)(?P<y>(?:19|20)[0-9]{2}))(?![0-9]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))"
)
#: Lines without any of these hold none of the kinds.
HINT = re.compile(r"[0-9@]")
CHANGE = {"card": _card, "iban": _iban, "phone": _phone, "ip": _ip, "date": _date, "email": _email, "secret": _secret}


class Pseudonymiser:
    def __init__(self, key: str | bytes):
        self.cipher = Cipher(key.encode() if isinstance(key, str) else key)

    def __call__(self, text: str | None, back: bool = False) -> tuple[str | None, dict[str, int]]:
        found = dict.fromkeys(KINDS, 0)
        if not text or not HINT.search(text):
            return text, found

        def change(m: re.Match) -> str:
            kind = next(k for k in KINDS if m[k] is not None)
            fresh = CHANGE[kind](self.cipher, m, back)
            if fresh is None:
                return m[0]
            found[kind] += 1
            return fresh

        lines = text.split("\n")
        return "\n".join(PATTERN.sub(change, x) if HINT.search(x) else x for x in lines), found


@lru_cache(maxsize=8)
def _for_key(key: bytes) -> Pseudonymiser:
    return Pseudonymiser(key)


def pseudonymise(text: Column, key: str | bytes, back: bool = False) -> Column:
    """A struct of the text with its personal values replaced, and how many of each kind were.

    Valid values are permuted under the key within their format: card numbers (Luhn)
    and IBANs (mod 97) stay valid, phone numbers keep their country code and punctuation, IPv4 addresses and dates stay
    such, email names and long hexadecimal keys keep length and character classes. Equal values get equal pseudonyms
    in every document, different ones different pseudonyms; ``back`` undoes it. Invalid look-alikes stay. Null
    stays null, the empty text empty.
    """
    secret = key.encode() if isinstance(key, str) else key

    @F.pandas_udf(", ".join(["text string", *(f"n_{k} long" for k in KINDS)]))
    def of(texts: pd.Series) -> pd.DataFrame:
        done = [_for_key(secret)(x, back) for x in texts]
        columns = {f"n_{k}": [found[k] for _, found in done] for k in KINDS}
        return pd.DataFrame({"text": pd.Series([x for x, _ in done], dtype=object), **columns})

    return of(text)
