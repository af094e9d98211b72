"""SQL twins of the numbered queries, where SQL can express them on whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op4_quality_rules"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, text,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t),
s AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]) AS c FROM s),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(text, '[A-Z]{4}'))::BIGINT AS n_shouts,
         len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)),
b AS (
  SELECT *, ((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    | (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    | (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END)
    | (CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
    | (CASE WHEN 10 * word_chars < 20 * n_words THEN 16 ELSE 0 END)
    | (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
    | (CASE WHEN 100 * n_shouts > 30 * n_words THEN 64 ELSE 0 END))::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""

ORACLES["op8_decontamination"] = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS rid, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (
  SELECT rid, doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM lowered),
b AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i+k-1], ' ') AS g
  FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
        FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT rid, k, i, array_to_string(ws[i:i+k-1], ' ') AS g
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
h AS (SELECT rid, i, k, item_id FROM dw JOIN bw USING (k, g)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
o AS (SELECT rid, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN o USING (rid)
"""

ORACLES["op3_jaccard_join"] = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT rid, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM t WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS MATERIALIZED (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rid AS u, rid AS v FROM t UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM t LEFT JOIN n ON n.rid = t.rid JOIN r ON r.u = t.rid JOIN t o ON o.rid = r.v
GROUP BY t.rid, t.doc_id, n.n
"""


def _rounds(rounds: int) -> str:
    """CTEs that assign every vector to the nearest centroid and replace the centroids, ``rounds`` times."""
    out = []
    for r in range(rounds):
        out.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT v.rid, m.c, list_sum(list_transform(list_zip(v.v, m.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM v, m{r} m) GROUP BY rid),
s{r} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (
    SELECT best.c AS c, unnest(v.v) AS x, unnest(range(1, 65)) AS i FROM v JOIN a{r} USING (rid)) GROUP BY c, i),
m{r + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(t.m, m.m) AS m FROM m{r} m LEFT JOIN (
    SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY c) t USING (c)),""")
    return "".join(out)


ORACLES["op11_centroids"] = rf"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS c, v AS m
  FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),
{_rounds(3)}
f AS MATERIALIZED (
  SELECT rid, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT v.rid, m.c, list_sum(list_transform(list_zip(v.v, m.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM v, m3 m) GROUP BY rid),
i AS (SELECT best.c AS c, sum(best.d)::BIGINT AS s, count(*) AS n FROM f GROUP BY 1)
SELECT v.vec_id, f.best.c AS cluster, f.best.d AS distance, i.s AS cluster_inertia,
       (SELECT sum(s)::BIGINT FROM i) AS inertia, sha256(array_to_string(m3.m, ',')) AS centroid_sha256, i.n AS n_cluster
FROM v JOIN f USING (rid) JOIN i ON i.c = f.best.c JOIN m3 ON m3.c = i.c
"""

ORACLES["op12_superminhash"] = (
    ORACLES["op3_jaccard_join"]
    .replace("ws[i:i+4]", "ws[i:i+3]")
    .replace("greatest(len(ws) - 4, 1)", "greatest(len(ws) - 3, 1)")
    .replace("min(o.doc_id) AS component_id", "min(o.doc_id) AS component_id, t.doc_id = min(o.doc_id) AS kept")
)
