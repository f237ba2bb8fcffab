"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tickwise.llm.sharding import PRIME, shard_constants

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _hash28(value: str, seed: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || coalesce({value}::VARCHAR, chr(0))), 1, 7))::BIGINT"


WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages
), b AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM p
), o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to, 1 AS n_requests, 1 AS n_metadata
FROM o
"""


def _score(shard: int) -> str:
    a, b = shard_constants(shard)
    first = f"((x * {a} + {b}) % {PRIME})"
    again = f"(({first} * ((y + {first}) % {PRIME}) + {b}) % {PRIME})"
    return f"(({again} * ((x + {again}) % {PRIME}) + y) % {PRIME})"


def _shards(count: int) -> str:
    scores = f"[{', '.join(_score(s) for s in range(count))}]"
    return f"list_position({scores}, list_max({scores})) - 1"


CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS tab"""


def _crc32(text: str) -> str:
    return f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"""


SHARDS = f"""
WITH t AS ({CRC_TABLE}), s AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, {_hash28('doc_id', 'a0')} AS x, {_hash28('doc_id', 'b0')} AS y,
    {_crc32("coalesce(text, '')")} AS text_crc32
  FROM documents, t
), r AS (SELECT doc_id, size, text_crc32, y, {_shards(40)} AS shard, {_shards(41)} AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY y, doc_id) - 1 AS slot, grown_shard
FROM r
"""

MIX = f"""
WITH s AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
t AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM s GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS whole, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k FROM t
), l AS (
  SELECT *, whole - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
  FROM o
), f AS (SELECT min(k) AS first_level FROM l WHERE 3 * source_size * weight > rest * w),
g AS (
  SELECT source, source_size, CASE WHEN k < coalesce(first_level, 1000000000) THEN (3 * source_size)::DOUBLE
    ELSE (SELECT rest FROM l WHERE k = first_level)::DOUBLE * w / (SELECT weight FROM l WHERE k = first_level) END AS target
  FROM l, f
), c AS (
  SELECT doc_id, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY {_hash28('doc_id', '7')}, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (size * len(list_filter([0, 1, 2], lambda c: source_size > 0 AND (c * source_size + before) * 2 + size <= target * 2)))::BIGINT AS taken
FROM c
"""

#: The body of the quality rules: rows ``d`` (all columns of documents) to ``judged`` with the measures, base_failed and kept.
RULES = r"""
w AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)
), twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT x) AS n FROM (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM w)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT w.* EXCLUDE (w), len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
r AS (
  SELECT lang, source, unnest(['word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words']) AS ratio,
    unnest([word_chars, n_symbols, n_dup_lines, n_repeat_words]) * 1000 // n_words AS v
  FROM b WHERE NOT base_failed
), e AS (SELECT lang, source, ratio, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS edge FROM r),
own AS (
  SELECT lang, source, ratio, count(*) AS rows, quantile_disc(edge, 0.25) AS q25, quantile_disc(edge, 0.5) AS q50, quantile_disc(edge, 0.75) AS q75
  FROM e GROUP BY ALL
), of_lang AS (
  SELECT lang, ratio, count(*) AS rows, quantile_disc(edge, 0.25) AS q25, quantile_disc(edge, 0.5) AS q50, quantile_disc(edge, 0.75) AS q75
  FROM e GROUP BY ALL
), of_all AS (
  SELECT ratio, quantile_disc(edge, 0.25) AS q25, quantile_disc(edge, 0.5) AS q50, quantile_disc(edge, 0.75) AS q75 FROM e GROUP BY ALL
), q AS (
  SELECT own.lang, own.source, own.ratio,
    CASE WHEN own.rows >= 50 THEN [own.q25, own.q50, own.q75] WHEN of_lang.rows >= 50 THEN [of_lang.q25, of_lang.q50, of_lang.q75]
      ELSE [of_all.q25, of_all.q50, of_all.q75] END AS q,
    CASE own.ratio WHEN 'word_chars' THEN 300 WHEN 'n_symbols' THEN 20 WHEN 'n_dup_lines' THEN 10 ELSE 50 END AS least
  FROM own JOIN of_lang ON own.lang IS NOT DISTINCT FROM of_lang.lang AND own.ratio = of_lang.ratio JOIN of_all ON own.ratio = of_all.ratio
), limits AS (
  SELECT lang, source, ratio, q[2] - 6 * greatest(q[3] - q[2], q[2] - q[1], least) AS low, q[2] + 6 * greatest(q[3] - q[2], q[2] - q[1], least) AS high FROM q
), bad AS (
  SELECT DISTINCT rid FROM (
    SELECT rid, lang, source, unnest(['word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words']) AS ratio,
      unnest([word_chars, n_symbols, n_dup_lines, n_repeat_words]) * 1000 // n_words AS v
    FROM b WHERE NOT base_failed
  ) x JOIN limits ON x.lang IS NOT DISTINCT FROM limits.lang AND x.source IS NOT DISTINCT FROM limits.source AND x.ratio = limits.ratio
  WHERE v > high OR (x.ratio = 'word_chars' AND v < low)
), judged AS (SELECT b.*, NOT base_failed AND b.rid NOT IN (SELECT rid FROM bad) AS kept FROM b)
"""

QUALITY = f"""
WITH d AS (SELECT *, row_number() OVER () AS rid FROM documents), {RULES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, rid, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), '{{UPPER}}', '{{LOWER}}') AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common USING (key) GROUP BY rid
""".replace("{UPPER}", UPPER).replace("{LOWER}", LOWER)

TRIE = f"""
WITH t AS ({CRC_TABLE}),
o AS (SELECT conv_id AS conv, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s,
    strlen(coalesce(text, '')) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, s, bytes) - 1 AS pos FROM o),
c AS (SELECT conv, n, conv - conv % 5 AS base, {_crc32("conv::VARCHAR")} % 9 AS h FROM (SELECT conv, count(*) AS n FROM r GROUP BY conv), t),
p AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS len FROM c LEFT JOIN c b ON b.conv = c.base),
x AS (
  SELECT p.conv, r.pos, s, bytes FROM p JOIN r ON r.conv = p.base AND r.pos < p.taken
  UNION ALL SELECT p.conv, r.pos - p.h + p.taken, s, bytes FROM p JOIN r ON r.conv = p.conv AND r.pos >= p.h
), k AS (
  SELECT conv, pos + 1 AS depth, md5(string_agg(s, '') OVER (PARTITION BY conv ORDER BY pos)) AS node, bytes FROM x
  UNION ALL SELECT conv, 0, 'root', 0 FROM p
), m AS (
  SELECT k.*, p.len, lag(node) OVER (PARTITION BY k.conv ORDER BY depth) AS parent FROM k JOIN p ON p.conv = k.conv
), n AS (
  SELECT node, any_value(parent) AS parent, min(conv) AS conv, any_value(depth) AS depth, count(*) AS n, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE len = depth), '')) AS ends
  FROM m GROUP BY node
), f AS (SELECT parent AS node, count(*) AS children FROM n WHERE parent IS NOT NULL GROUP BY parent),
a AS (
  SELECT m.node, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (WHERE n.node NOT IN (SELECT node FROM f)) AS leaves
  FROM n JOIN m ON m.conv = n.conv AND m.depth <= n.depth GROUP BY m.node
)
SELECT n.conv AS conv_id, n.depth::BIGINT AS depth, u.conv AS parent_conv_id, n.n AS n_convs, coalesce(f.children, 0) AS n_children,
  leaves AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN a ON a.node = n.node LEFT JOIN f ON f.node = n.node LEFT JOIN n u ON u.node = n.parent
"""

COLLOCATIONS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, rid, unnest(p) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, size, phrase, a, w, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT cuts.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.first JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covers AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
most AS (SELECT lang, phrase, max(a) AS most FROM covers GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN most ON b.lang = most.lang AND b.phrase = most.phrase WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
""".replace("{UPPER}", UPPER).replace("{LOWER}", LOWER)

STATEMENTS = {
    "op1_warc_transactions": WARC,
    "op3_rendezvous_shards": SHARDS,
    "op7_mixture": MIX,
    "op10_adaptive_rules": QUALITY,
    "op11_prefix_trie": TRIE,
    "op12_collocations": COLLOCATIONS,
    "op13_line_dedup": LINES,
}
