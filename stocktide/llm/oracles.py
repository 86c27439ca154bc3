"""SQL oracles of the numbered queries that SQL can express."""

from __future__ import annotations

#: 50-byte windows are read off the hexadecimal form, in chunks, since reading a part of a text takes time in proportion to where it lies.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
c AS (SELECT doc_id, n, k * 500 AS base, substring(h, k * 1000 + 1, 1098) AS part FROM (SELECT *, unnest(range(n // 500 + 1)) AS k FROM b)),
w AS (SELECT doc_id, base + i AS pos, substring(part, 2 * i + 1, 100) AS win FROM (SELECT *, unnest(range(least(500, n - base - 49))) AS i FROM c)),
o AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win),
hit AS (SELECT doc_id, pos FROM w JOIN o USING (win) WHERE doc_id > least),
cut AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS opens FROM hit),
run AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM cut),
span AS (SELECT doc_id, r, min(pos) AS a, max(pos) + 50 AS z FROM run GROUP BY doc_id, r),
total AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS tail FROM span GROUP BY doc_id),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS g, a FROM span),
piece AS (SELECT doc_id, g, substring(h, 2 * g + 1, 2 * (a - g)) AS p FROM gap JOIN b USING (doc_id)
  UNION ALL SELECT b.doc_id, coalesce(tail, 0), substring(h, 2 * coalesce(tail, 0) + 1) FROM b LEFT JOIN total t ON b.doc_id = t.doc_id),
kept AS (SELECT doc_id, string_agg(p, '' ORDER BY g) AS h FROM piece GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(kept.h)) AS kept_sha256
FROM b JOIN kept ON b.doc_id = kept.doc_id LEFT JOIN total t ON b.doc_id = t.doc_id"""

#: Links of full sets; a component is what recursion reaches.
NEAR_GROUPS = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a),
g AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT g.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, g.doc_id = component_id AS kept FROM g LEFT JOIN n ON g.doc_id = n.doc_id"""

#: The order of records is known (the text's digest, then the id), so running totals give the shards without any ranges.
SHARDING = """
WITH step AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) AS r(i))),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, length(h) // 2 + 8 AS size, CAST('0x' || substring(md5(text), 1, 15) AS BIGINT) AS key,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, step),
r AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
p AS (SELECT *, CAST(least(23, (upto - size) * 24 // total) AS INTEGER) AS shard FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM d"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All kept terms of a language are laid out for each of its groups.
DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, term, count(*) AS n FROM (SELECT i, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY 1, 2, 3),
c AS (SELECT lang, source, term, CAST(coalesce(n, 0) AS HUGEINT) AS n FROM g JOIN k USING (lang) LEFT JOIN s USING (lang, source, term)),
p AS (SELECT *, 1 + 1000000000 * (n + 5) // (sum(n) OVER w + 5 * count(*) OVER w) AS p FROM c WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 5) // (sum(n) OVER w + 5 * count(*) OVER w) AS q FROM l WINDOW w AS (PARTITION BY lang)),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(y.p - z.p)) FROM p y JOIN p z ON y.lang = z.lang AND y.term = z.term WHERE y.lang = a.lang AND y.source = a.source AND z.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

#: A word's CRC-32 is worked out once, byte by byte.
RESAMPLING = rf"""
WITH step AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) AS r(i))),
d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
n AS (SELECT i, word, count(*) AS n FROM (SELECT i, unnest(w) AS word FROM d) GROUP BY 1, 2),
v AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM n UNION SELECT word FROM b), step),
s AS (SELECT bucket, sum(n) AS s FROM n JOIN v USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT i, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM n JOIN v USING (word) JOIN gain USING (bucket) GROUP BY 1),
f AS (SELECT i, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (i)),
r AS (SELECT i, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS whole FROM f WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * whole // 100 THEN rank END AS rank FROM f LEFT JOIN r USING (i)"""

ORACLES = {"op1_suffix_dedup": SUFFIX_DEDUP, "op5_minhash": NEAR_GROUPS, "op8_sharding": SHARDING, "op11_exact_dedup": EXACT_DEDUP, "op12_divergence": DIVERGENCE, "op13_resampling": RESAMPLING}
