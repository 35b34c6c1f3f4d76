"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS key
  FROM documents
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * sum(size) AS cap,
         [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM docs GROUP BY source
), prices AS (
  SELECT 0 AS i, 0.0::DOUBLE AS price
  UNION ALL
  SELECT i + 1, coalesce((SELECT greatest(0.0, (SELECT sum(source_size) FROM ranked) - coalesce(sum(CASE WHEN prices.price * weight > cap THEN cap END), 0)) / sum(CASE WHEN prices.price * weight <= cap THEN weight END) FROM ranked), price)
  FROM prices WHERE i < 60
), sources AS (
  SELECT source, source_size, least((SELECT max(price) FROM prices) * weight, cap) AS target FROM ranked
), rests AS (
  SELECT *, greatest(0.0, target - epochs * source_size) AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM sources)
), units AS (
  SELECT source, key, unit, sum(unit) OVER (PARTITION BY source ORDER BY key) AS ends
  FROM (SELECT source, key, sum(size) AS unit FROM docs GROUP BY source, key)
), cut AS (
  SELECT u.source, u.key, r.source_size, r.target, r.epochs, r.rest > 0 OR r.epochs = 0 AS again, u.ends <= r.rest AS whole,
         CASE WHEN u.ends > r.rest AND u.ends - u.unit <= r.rest AND u.unit > 0 THEN (r.rest - u.ends + u.unit) / u.unit ELSE 0 END AS part
  FROM units u JOIN rests r ON u.source IS NOT DISTINCT FROM r.source
), taken AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, d.source, CAST(c.epochs + CASE WHEN c.again AND c.whole THEN 1 ELSE 0 END AS INT) AS copies, CASE WHEN c.again THEN c.part ELSE 0 END AS part
  FROM docs d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source AND d.key = c.key
)
SELECT doc_id, size, source_size, target, CAST(copies * size + round(part * size) AS BIGINT) AS taken, source, copies FROM taken
"""

_CONTROL = r"<\||</?s>|\[/?INST\]"

CHAT_FORMAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)
), sized AS (
  SELECT *, length(role) + length(text) + length(role || text) - length(replace(role || text, '\', ''))
         + len(regexp_extract_all(replace(role, '\', '\\'), '{_CONTROL}')) + len(regexp_extract_all(replace(text, '\', '\\'), '{_CONTROL}')) + length('<|turn|><|say|><|end|>') AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS least_id FROM reached GROUP BY a) r ON r.a = d.doc_id
"""


def _rounds(rounds: int) -> str:
    """Lloyd's rounds over v (row, number, component), from centroids c0 (cluster, number, component)."""
    out = []
    for r in range(rounds + 1):
        far = f"d{r} AS (SELECT v.r, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{r} AS c USING (i) GROUP BY 1, 2)"
        near = f"a{r} AS (SELECT r, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{r} GROUP BY 1)"
        out += [far, near]
        if r < rounds:
            mean = f"m{r} AS (SELECT a.cluster, v.i, sum(v.x) AS s, count(*) AS n FROM v JOIN a{r} AS a USING (r) GROUP BY 1, 2)"
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            out += [mean, f"c{r + 1} AS (SELECT c.cluster, c.i, coalesce({floor}, c.x) AS x FROM c{r} AS c LEFT JOIN m{r} USING (cluster, i))"]
    return ", ".join(f"{x[: x.index(' AS ')]} AS MATERIALIZED {x[x.index(' AS ') + 4 :]}" for x in out)


DUAL_TREE = f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
v AS MATERIALIZED (SELECT r, vec_id, unnest(range(64)) AS i, CAST(floor(64 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM kept),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < 16),
c0 AS MATERIALIZED (SELECT cluster, i, x FROM v JOIN f USING (r)), {_rounds(3)},
names AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY 1)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN kept USING (r) JOIN names USING (cluster)"""
