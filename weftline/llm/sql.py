"""DuckDB SQL of the queries that SQL can express."""

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '{WORD}+') AS w FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(3)) AS v(k) GROUP BY r),
li AS (SELECT r, host, line FROM d, unnest(string_split(t, chr(10))) AS u(line) WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM li GROUP BY r),
norm AS (SELECT r, host, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}+', ' ', 'g')) AS l,
         len(regexp_extract_all(line, '{WORD}+')) AS n FROM li),
often AS (SELECT host, l FROM norm GROUP BY host, l HAVING count(DISTINCT r) > 50),
lost AS (SELECT r, sum(norm.n) AS n FROM norm JOIN often ON norm.l = often.l AND norm.host IS NOT DISTINCT FROM often.host GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 50 AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM b
"""

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}+')) AS n,
    CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
m AS MATERIALIZED (SELECT *, CAST(h >> 50 AS INT) AS block, CAST((h >> 40) & 1023 AS INT) AS sub, h & 1099511627775 AS low FROM d),
s AS MATERIALIZED (SELECT source, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY source HAVING sum(n) > 0),
g AS MATERIALIZED (SELECT sum(n) AS total, count(*) AS k FROM s),
ent AS (SELECT 0 AS lo, 1048577 AS hi UNION ALL
  SELECT CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END FROM (SELECT lo, hi, (lo + hi) // 2 AS mid,
    (SELECT ln(sum(r)) - sum(r * ln(r)) / sum(r) >= 0.95 * ln(any_value(k)) FROM (SELECT pow(n / total, ((lo + hi) // 2) / 1048576.0) AS r, k FROM s, g)) AS good
    FROM ent WHERE hi - lo > 1)),
rep AS (SELECT -1 AS lo, 1048576 AS hi UNION ALL
  SELECT CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END FROM (SELECT lo, hi, (lo + hi) // 2 AS mid,
    (SELECT max(r / share) / sum(r) > 4 FROM (SELECT n / total AS share, pow(n / total, ((lo + hi) // 2) / 1048576.0) AS r FROM s, g)) AS over
    FROM rep WHERE hi - lo > 1)),
al AS (SELECT greatest((SELECT max(lo) FROM ent), (SELECT min(hi) FROM rep)) / 1048576.0 AS a),
raw AS (SELECT source, n, pow(n / total, a) AS r, total FROM s, g, al),
pl AS MATERIALIZED (SELECT source, n, b AS budget, CAST(b // n AS INT) AS epochs, b % n AS rest FROM
  (SELECT source, n, CAST(floor(r / (SELECT sum(r) FROM raw) * total + CAST(0.000001 AS DOUBLE)) AS BIGINT) AS b FROM raw)),
bl AS MATERIALIZED (SELECT source, block, CAST(sum(n) AS BIGINT) AS t FROM m GROUP BY ALL),
ps AS (SELECT bl.source, block, t, n, budget, epochs, rest, epoch, md5('42|' || coalesce(bl.source, 'null') || '|' || epoch || '|' || block) AS o
  FROM bl JOIN pl ON bl.source IS NOT DISTINCT FROM pl.source, unnest(range(epochs + 1)) AS u(epoch)),
rk AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS rank, sum(t) OVER (PARTITION BY source, epoch ORDER BY o, block ROWS UNBOUNDED PRECEDING) AS upto
  FROM ps WINDOW w AS (PARTITION BY source, epoch ORDER BY o, block)),
doc AS (SELECT m.*, epoch, epochs, rest, rank, upto - t AS before, upto, budget, rk.n AS tokens,
    md5('42|' || coalesce(m.source, 'null') || '|' || epoch || '|' || m.block || '|' || sub) AS so
  FROM m JOIN rk ON m.source IS NOT DISTINCT FROM rk.source AND m.block = rk.block),
inside AS (SELECT *, before + sum(n) OVER (PARTITION BY source, epoch, block ORDER BY so, sub, low RANGE UNBOUNDED PRECEDING) AS end_
  FROM doc WHERE epoch = epochs AND upto > rest AND before <= rest),
subs AS (SELECT *, max(end_) OVER (PARTITION BY source, sub) AS sub_end FROM inside)
SELECT doc_id, source, n AS n_tokens, CAST(epoch AS INT) AS epoch, block, CAST(rank AS INT) AS block_rank,
  ((epoch * 1024 + rank) * tokens) / (budget * CAST(1024 AS DOUBLE)) AS position
FROM (SELECT * EXCLUDE (end_, sub_end) FROM subs WHERE end_ <= rest
  UNION ALL SELECT * FROM doc WHERE epoch < epochs OR upto <= rest)
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS kept FROM p WHERE strlen(h) >= 1000 AND page_id IS NOT NULL GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON p.h = k.h AND page_id IS NOT NULL
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT id, min(root) AS c FROM r GROUP BY id)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

SQL = {"op1_mix_sources": OP1, "op6_quality_rules": OP6, "op7_embedding_dedup": OP7, "op8_warc": OP8}
