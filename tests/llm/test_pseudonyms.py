import datetime as dt
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickwise.llm import pseudonyms, queries

FOLDER = "/root/testdata/sf0.001"
SWAP = pseudonyms.Pseudonymiser("a key")


def swapped(text):
    return SWAP(text)[0]


@given(st.integers(1, 5000), st.data())
def test_permutation(size, data):
    cipher = pseudonyms.Cipher(b"k")
    x = data.draw(st.integers(0, size - 1))
    y = cipher.permute(x, size, "t")
    assert 0 <= y < size and cipher.permute(y, size, "t", back=True) == x


def test_permutation_is_one_to_one():
    cipher = pseudonyms.Cipher(b"k")
    for size in (1, 2, 10, 97, 1000):
        assert sorted(cipher.permute(x, size, "t") for x in range(size)) == list(range(size))
    assert [cipher.permute(x, 1000, "t") for x in range(50)] != [pseudonyms.Cipher(b"l").permute(x, 1000, "t") for x in range(50)]


def test_formats_stay_valid():
    card = swapped("4111-1111 1111 1111")
    digits = re.sub(r"\D", "", card)
    assert card != "4111-1111 1111 1111" and re.fullmatch(r"\d{4}-\d{4} \d{4} \d{4}", card) and pseudonyms.luhn_digit(digits[:-1]) == digits[-1]
    iban = swapped("DE89 3704 0044 0532 0130 00").replace(" ", "")
    assert iban != "DE89370400440532013000" and iban[:2] == "DE" and pseudonyms.iban_check("DE", iban[4:]) == iban[2:4]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", swapped("+1 (212) 555-0147"))
    assert all(int(x) < 256 for x in swapped("10.0.0.1").split("."))
    for text, form in (("2024-02-29", "%Y-%m-%d"), ("31.12.1999", "%d.%m.%Y"), ("12/31/1999", "%m/%d/%Y")):
        assert swapped(text) != text and dt.datetime.strptime(swapped(text), form)
    assert re.fullmatch(r"[a-z]{3}\.\d{2}@mail\.example\.com", swapped("the.24@mail.example.com"))
    assert re.fullmatch(r"[0-9a-f]{40}", swapped("24be64439e3e49cf46b2d7c90f3602a3d0b907ff"))


def test_look_alikes_stay():
    for text in ("4111111111111112", "2023-02-30", "300.1.1.1", "DE00 3704 0044 0532 0130 00", "1.2.3.4.5", "version 2.0", "a1b2", "12345"):
        assert swapped(text) == text


def test_neighbours_do_not_hide_each_other():
    for text in ("+1 (826) 555-4081 190.137.223.20", "+1 843-555-7672 4111111111111111", "+49 30 901820 10.1.2.3", "1234567890123 4111111111111111", "4111 1111 1111 1111 5555555555554444"):
        found = SWAP(text)[1]
        assert sum(found.values()) == (1 if text.startswith("1234") else 2), (text, found)


def test_equal_values_stay_linked():
    a, b = swapped("x 4111 1111 1111 1111, 2024-01-05"), swapped("y 4111-1111-1111-1111; 05.01.2024")
    assert re.sub(r"\D", "", a[: a.index(",")]) == re.sub(r"\D", "", b[: b.index(";")])
    assert dt.date.fromisoformat(a[-10:]) == dt.datetime.strptime(b[-10:], "%d.%m.%Y").date()


def test_all_documents_round_trip(spark, docs):
    there = docs.select("doc_id", "text", pseudonyms.pseudonymise(F.col("text"), "a key").alias("p"))
    rows = there.select("*", pseudonyms.pseudonymise(F.col("p.text"), "a key", back=True)["text"].alias("back")).collect()
    found = 0
    for r in rows:
        assert r.back == r.text
        assert len(r.p.text) == len(r.text) or r.p.n_ip
        counts = SWAP(r.text)[1]
        assert {k: r.p[f"n_{k}"] for k in counts} == counts
        found += sum(counts.values())
        for m in pseudonyms.PATTERN.finditer(r.text):
            kind = next(k for k in pseudonyms.KINDS if m[k] is not None)
            if pseudonyms.CHANGE[kind](SWAP.cipher, m, False) is not None:
                assert m[0] not in r.p.text
    assert found > 20


def test_query(spark, docs):
    rows = {r.doc_id: r for r in queries.feistel(spark, FOLDER).collect()}
    swap = pseudonyms.Pseudonymiser(queries.PSEUDONYM_KEY)
    assert {r.doc_id: swap(r.text)[0] for r in docs.collect()} == {i: r.text for i, r in rows.items()}


def test_long_lines_take_linear_time():
    for text in ("a" * 200_000 + "1", "1 " * 100_000, "1" * 200_000, "a.b@" * 50_000, "+1 " * 60_000, "AB12 " * 40_000):
        SWAP(text)


def test_odd_rows(odd, none):
    rows = odd.select("doc_id", "text", pseudonyms.pseudonymise(F.col("text"), "k").alias("p")).collect()
    assert [r.p.text is None for r in rows] == [r.text is None for r in rows]
    assert all(r.p.n_phone == 1 for r in rows if r.text and r.text.startswith("call"))
    assert none.select(pseudonyms.pseudonymise(F.col("text"), "k")).count() == 0


def test_planted_values_are_found():
    """Values by themselves and beside letters of any script, none of them taken from the pattern."""
    planted = {
        "email": ["john@example.com", "_john@example.com", "-john@example.com", "...john@example.com", "éric@example.com", "josé.garcia@example.com"],
        "phone": ["+8613800138000", "+1 (212) 555-0147", "(212) 555-0147", "212-555-0147", "212.555.0147"],
        "date": ["25/12/2020", "12/25/2020", "25-12-2020", "12-25-2020", "5/3/2020", "5/12/2020", "31.1.1999", "2020-5-3", "1/10/2020", "05/3/2020"],
    }
    for kind, values in planted.items():
        for value in values:
            for before, after in (("", ""), ("邮箱", "好"), ("почта", " и"), ("(", ")"), ("x" * 3 + " ", "."), ("字" * 100, "")):
                text = before + value + after
                fresh, found = SWAP(text)
                assert found == dict.fromkeys(pseudonyms.KINDS, 0) | {kind: 1}, (text, found)
                assert fresh != text and value not in fresh and SWAP(fresh, back=True)[0] == text
    assert swapped("邮箱john@example.com") == "邮箱" + swapped("john@example.com")
    assert swapped("(212) 555-0147") == swapped("+1 (212) 555-0147")[3:]


def test_dates_are_equal_in_each_way_of_writing():
    day = dt.date.fromisoformat(swapped("2020-12-25"))
    assert swapped("25/12/2020") == swapped("25-12-2020").replace("-", "/") == f"{day:%d/%m/%Y}" and swapped("12/25/2020") == f"{day:%m/%d/%Y}"
    day = dt.date.fromisoformat(swapped("2020-05-03"))
    assert swapped("5/3/2020") == f"{day.month}/{day.day}/{day.year}" and swapped("3.5.2020") == f"{day.day}.{day.month}.{day.year}"
    for text in ("31/02/2020", "13/13/2020", "0/5/2020", "30-2-2020", "29/2/2021"):
        assert swapped(text) == text
