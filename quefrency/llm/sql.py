"""DuckDB SQL for the rows of those registered queries that SQL can express, over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item, size, list_slice(w, k, k + size - 1) AS gram FROM iw),
dw AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM g)),
h AS (SELECT rid, k, dw.size, item FROM dw JOIN g ON dw.size = g.size AND list_slice(w, k, k + dw.size - 1) = gram),
c AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(k, k + size)) AS i FROM h) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)"""

# Bytes as hexadecimal digits, two each; windows of long texts are taken from stretches that start 1024 bytes apart. Covered stretches are those between starts at most a window apart.
SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
q AS (SELECT rid, base, substr(x, 2 * base + 1, 2 * (1024 + 399)) AS y FROM (SELECT rid, x, unnest(range(0, len(x) // 2, 1024)) AS base FROM d)),
w AS (SELECT rid, base, unnest(range(1, len(y) // 2 - 398)) AS i, y FROM q WHERE len(y) >= 800),
h AS (SELECT rid, base + i AS k, md5_number(substr(y, 2 * i - 1, 800)) AS m FROM w),
r AS (SELECT rid, k FROM h WHERE m IN (SELECT m FROM h GROUP BY m HAVING count(*) > 1)),
o AS (SELECT rid, k, CASE WHEN k <= lag(k) OVER (PARTITION BY rid ORDER BY k) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
s AS (SELECT rid, min(k) AS a, max(k) + 399 AS b FROM (SELECT rid, k, sum(fresh) OVER (PARTITION BY rid ORDER BY k) AS span FROM o) GROUP BY rid, span),
p AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) + 1 AS a, a - 1 AS b FROM s UNION ALL SELECT rid, max(b) + 1, NULL FROM s GROUP BY rid),
t AS (SELECT p.rid, string_agg(substr(x, 2 * a - 1, 2 * (coalesce(b, len(x) // 2) - a + 1)), '' ORDER BY a) AS kept FROM p JOIN d USING (rid) WHERE a <= coalesce(b, len(x) // 2) GROUP BY p.rid),
n AS (SELECT rid, CAST(sum(b - a + 1) AS BIGINT) AS removed, count(*) AS spans FROM s GROUP BY rid)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN x ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)"""

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, min(c.b)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id GROUP BY d.doc_id"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
h AS (SELECT rid, k, array_to_string(list_slice(w, k, k + 34), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
r AS (SELECT rid, k FROM h WHERE g IN (SELECT g FROM h GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT rid, unnest(range(k, k + 35)) AS i FROM r),
v AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM v ANTI JOIN c USING (rid, i) GROUP BY rid),
n AS (SELECT rid, count(*) AS removed FROM c GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)"""

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nw FROM n),
q AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS w FROM benchmark),
a AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM q) GROUP BY ALL),
f AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000.0 * ln((2.0 * nd + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, nd),
m AS (SELECT rid, doc_id, 100 - 75 + (75 * n * nd) // nw AS m FROM n, g),
s AS (SELECT q, item_id, doc_id, rid, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM a JOIN t USING (term) JOIN f USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""

ORACLE = {"op3_decontamination": DECONTAMINATION, "op5_suffix_dedup": SUFFIX_DEDUP, "op9_ngram_jaccard": NGRAM_JACCARD, "op10_substring_dedup": SUBSTRING_DEDUP, "op12_ranked_search": RANKED}
