"""DuckDB SQL of the registered queries that SQL can express."""

SPACE = r"\x20\x09-\x0D"
MARKS = r"\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def _rounds(n: int) -> str:
    """Of the centroid clustering: assignments a0, a1, ... and the centroids c1, c2, ... that follow from them."""
    parts = []
    for i in range(n + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, (m).c AS cluster, (m).d AS distance FROM (
    SELECT r, vec_id, v.v, min(struct_pack(d := list_sum([(v.v[j] - c.v[j]) * (v.v[j] - c.v[j]) for j in range(1, 65)]), c := c.c)) AS m
    FROM kept v, c{i} c GROUP BY ALL))""")
        if i < n:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(s.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT cluster, list(floor_div ORDER BY j) AS v FROM (
      SELECT cluster, j, (sum(v[j])::HUGEINT - (((sum(v[j])::HUGEINT % count(*)) + count(*)) % count(*))) // count(*) AS floor_div
      FROM a{i}, range(1, 65) t(j) GROUP BY cluster, j) GROUP BY cluster) s ON s.cluster = c.c)""")
    return ",\n".join(parts)


ORACLE = {
    "op6_mix_sources": rf"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS size,
         -ln(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '_mix'), 1, 13))::BIGINT::DOUBLE
             / 4503599627370496.0 + pow(2.0, -53))
         / (1.0 / (1.0 + 10.0 * length(regexp_replace(coalesce(text, ''),
              '[\p{{L}}\p{{N}}{SPACE}.,;:!?''"()-]+', '', 'g')) / greatest(length(coalesce(text, '')), 1))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::BIGINT
        - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
        / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size,
        coalesce((max(CASE WHEN level < ratio THEN level END) OVER ()) * weight, 3.0::DOUBLE * source_size)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds FROM t),
o AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.rounds,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2.0 AS middle
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (rounds + CASE WHEN middle <= target - rounds * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o""",
    "op10_exact_dedup": rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[{SPACE}]+', '', 'g') AS body FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(body) AS text_sha256
FROM d""",
    "op2_minhash_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^{SPACE}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
      FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents
      UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op5_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, line, body, list_sort(list_distinct(regexp_extract_all(body, '[^{SPACE}]+'))) AS words FROM l),
c AS (SELECT words, len(words) AS n, min((doc_id, line)) AS first FROM k WHERE len(words) >= 1 GROUP BY words),
t AS (SELECT first, n, unnest(words) AS word FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY f, word) AS pos
      FROM (SELECT *, count(*) OVER (PARTITION BY word) AS f FROM t)),
x AS (SELECT first, word FROM o WHERE pos <= n - (80 * n + 99) // 100 + 1),
p AS (SELECT DISTINCT a.first AS earlier, b.first AS later FROM x a JOIN x b ON a.word = b.word AND a.first < b.first),
q AS (SELECT DISTINCT later FROM p JOIN c a ON a.first = earlier JOIN c b ON b.first = later
      WHERE 100 * len(list_intersect(a.words, b.words))
            >= 80 * (a.n + b.n - len(list_intersect(a.words, b.words)))),
g AS (SELECT k.doc_id, k.line, k.body,
             c.first IS NOT NULL AND (c.first <> (k.doc_id, k.line) OR q.later IS NOT NULL) AS gone
      FROM k LEFT JOIN c ON c.words = k.words LEFT JOIN q ON q.later = c.first),
r AS (SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_removed,
             coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text
      FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(r.text, '')) AS text_sha256
FROM documents d LEFT JOIN r USING (doc_id)""",
    "op7_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings
      UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.x = e.vec_id""",
    "op11_lexical_search": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS length FROM t WHERE len(w) > 0),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY ALL),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
o AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY ALL),
x AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
m AS (SELECT r, 100 - 25 + ((25 * len(w) * n_docs) // length) AS m FROM t, c WHERE len(w) > 0),
s AS (SELECT o.q, f.r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM o JOIN f USING (term) JOIN x USING (term) JOIN m ON m.r = f.r GROUP BY ALL),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
      FROM s JOIN t ON t.r = s.r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 20""",
    "op12_centroids": rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept
  QUALIFY c < 16),
{_rounds(3)},
s AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a3 GROUP BY cluster)
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance::BIGINT AS distance, s.cluster_inertia,
       (SELECT sum(distance)::BIGINT FROM a3) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 a JOIN s USING (cluster) JOIN c3 c ON c.c = a.cluster""",
    "op13_quality_rules": rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w,
         [('0x' || left(md5(t), 8))::BIGINT for t in
            regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+|[{MARKS}]+')] AS h
  FROM documents),
b AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             len([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^{SPACE}]')])
             - len(list_distinct([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^{SPACE}]')])) AS n_dup_lines FROM d),
g AS (SELECT r, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS three,
             unnest(range(1, len(w) - 1)) AS i FROM d),
e AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM (
        SELECT r, unnest([i, i + 1, i + 2]) AS place FROM (
          SELECT r, i, count(*) OVER (PARTITION BY r, three) AS times FROM g) WHERE times > 1) GROUP BY r),
u AS MATERIALIZED (SELECT r, bucket, count(*) AS n FROM (
        SELECT r, unnest(h) % 32768 AS bucket FROM d
        UNION ALL SELECT r, unnest([(h[i] * 1000003 + h[i + 1]) % 32768 for i in range(1, len(h))]) FROM d) GROUP BY ALL),
k AS (SELECT r FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
t AS (SELECT bucket, sum(n) AS t FROM u WHERE r IN (FROM k) GROUP BY bucket),
a AS (SELECT bucket, sum(n) AS a FROM u GROUP BY bucket),
z AS (SELECT coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all, (SELECT sum(a) FROM a)::DOUBLE AS a_all),
l AS (SELECT bucket, a, coalesce(t, 0) AS t,
             round(1e6 * ((ln(coalesce(t, 0) + 1.0::DOUBLE) - ln(t_all + 32768)) - (ln(a + 1.0::DOUBLE) - ln(a_all + 32768))))::BIGINT AS llr
      FROM a LEFT JOIN t USING (bucket), z),
s AS (SELECT r, sum(n * llr)::DOUBLE / sum(n)::DOUBLE / 1e6 AS score FROM u JOIN l USING (bucket) GROUP BY r),
n AS (SELECT r, sum(n) AS size FROM u WHERE r IN (FROM k) GROUP BY r),
o AS (SELECT r, any_value(size)::HUGEINT * 1000000 AS under, 1000 * sum(n * round(1e6 * ((ln(t - n + 1.0::DOUBLE) - ln(t_all - size + 32768))
                 - (ln(a + 1.0::DOUBLE) - ln(a_all + 32768))))::BIGINT)::HUGEINT AS over
      FROM u JOIN n USING (r) JOIN l USING (bucket), z GROUP BY r),
p AS (SELECT step, sum(count(*)) OVER (ORDER BY step) AS seen, sum(count(*)) OVER () AS total
      FROM (SELECT (over - ((over % under) + under) % under) // under AS step FROM o) GROUP BY step),
q AS (SELECT min(step) FILTER (WHERE 4 * seen >= total) AS low, min(step) FILTER (WHERE 4 * seen >= 3 * total) AS high FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
       NOT base_failed AND coalesce(score, 0) >= coalesce((low - 3 * (high - low))::DOUBLE / 1000, '-inf'::DOUBLE) AS kept,
       coalesce(score, 0) AS score
FROM b LEFT JOIN e USING (r) LEFT JOIN s USING (r), q""",
}
