"""Registered queries of retrieval, sessions and metrics, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph as g
from weftline.operators import retrieval as r
from weftline.operators import sessions as s
from weftline.sources import tables as t
from weftline.storage import small

QUERY = "these others that shines"
WORDS = r.keywords(QUERY)


def _vector_of(spark: SparkSession, d: str, vec: int = 0) -> list[float]:
    return t.table(spark, d, "embeddings").filter(F.col("vec_id") == vec).first()["embedding"]


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return r.vector_topk(t.table(spark, d, "embeddings"), _vector_of(spark, d), k=20)


def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return r.keyword_topk(t.table(spark, d, "documents"), QUERY, k=20)


def _lists(spark: SparkSession, d: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("doc/"), F.col(c).cast("string")).alias("file_path")
    v = vector_topk(spark, d).select(F.lit("vector").alias("source"), path("vec_id"), F.col("score").alias("relevance_score"))
    k = keyword_topk(spark, d).select(F.lit("keyword").alias("source"), path("doc_id"), F.col("score").alias("relevance_score"))
    return v.unionByName(k).unionByName(_graph_list(spark, d).select(F.lit("graph").alias("source"), path("doc_id"), "relevance_score"))


def _graph_list(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, relevance_score: documents up to three steps from the first one in the graph in which each cites five others, a fifth less for each step."""
    docs = t.table(spark, d, "documents").select("doc_id")
    cites = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select(F.concat(F.lit("D:"), "doc_id").alias("source_id"), F.concat(F.lit("D:"), F.col("doc_id") * 3 + F.col("k")).alias("target_id"))
    found = g.nearest(cites, spark.createDataFrame([("D:0",)], "id string"), 3).filter("depth > 0")
    return found.select(F.substring("id", 3, 20).cast("long").alias("doc_id"), (F.lit(1.0) - F.col("depth") / 5).alias("relevance_score"))


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return r.reciprocal_rank_fusion(_lists(spark, d))


def _meta(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.round(F.col("doc_id") % 10 / 10, 1).alias("hotspot"), (F.col("doc_id") % 4).cast("int").alias("distance"), r.token_estimate(F.length("text")).alias("tokens"))


def context_query(spark: SparkSession, d: str) -> DataFrame:
    return r.context(_lists(spark, d), _meta(spark, d), budget=4000, min_relevance=0.4)


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").select("doc_id", r.token_estimate(F.length("text")).alias("tokens"), r.token_estimate(F.length(r.first_lines(F.col("text"), 3))).alias("head_tokens"))


def budget_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents").select("doc_id", "source", r.token_estimate(F.length("text")).alias("tokens"))
    return r.within_budget(docs, 3000, by=["source"], order=[F.desc("tokens"), F.col("doc_id")])


def heuristic_rerank(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.split(F.lit("ts,sh,py,js"), ","), (F.col("doc_id") % 4 + 1).cast("int"))
    c = t.table(spark, d, "documents").select(F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("file_path"), (F.col("doc_id") % 7 / 10).alias("relevance_score"), F.when(F.col("doc_id") % 3 != 0, 1_700_000_000 - F.col("doc_id") * 9000).alias("mtime"), (F.col("doc_id") % 5 == 0).alias("hotspot"))
    return c.select("file_path", r.heuristic_score(1_700_000_000).alias("rerank_score"))


def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """How well the first three words of a passage, in a row, find the documents that hold it."""
    items = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("head"))
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.col("text").alias("body"))
    # every three words that follow one another are looked up among the heads
    # (the words are bound once, else they would be split anew for each place)
    three = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    found = F.element_at(F.transform(F.array(F.split("body", " ")), lambda w: F.when(F.size(w) >= 3, F.array_distinct(three(w)))), 1)
    places = docs.select("item", F.explode(found).alias("head")).join(small(items.select("head").distinct()), "head")
    hits = places.join(docs, "item").join(small(items), "head")
    found = hits.select("query", "item", F.expr("row_number() over (partition by query order by instr(body, head), item)").alias("rank"))
    return r.retrieval_metrics(found, hits.filter(F.col("body").contains(F.col("text"))).select("query", "item"))


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    return r.nearest_rank(t.table(spark, d, "events"), "value")


def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    cols = "name string, mrr_at_10 double, recall_at_10 double, p95_latency_ms double"
    base = spark.createDataFrame([("base", 0.60, 0.70, 1200.0)], cols)
    now = spark.createDataFrame([("equal", 0.60, 0.70, 1200.0), ("worse", 0.40, 0.50, 1800.0), ("slow", 0.60, 0.70, 1400.0)], cols)
    return now.select("name").join(_gate_rows(base, now), "name")


def _gate_rows(base: DataFrame, now: DataFrame) -> DataFrame:
    out = None
    for name in ("equal", "worse", "slow"):
        row = r.regression_gate(base, now.filter(F.col("name") == name)).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    return s.last_turns(t.table(spark, d, "conversations"), 2).select("conv_id", "turn", "role")


def session_focus(spark: SparkSession, d: str) -> DataFrame:
    return s.accumulated_focus(t.table(spark, d, "conversations"), window=3, most=5)


def focus_boosts(spark: SparkSession, d: str) -> DataFrame:
    """The words of all conversations, by the share of turns that have them, raised by one conversation's focus."""
    everything = t.table(spark, d, "conversations")
    turns, n = everything.filter("conv_id = 1"), everything.select("conv_id", "turn").distinct().agg(F.count("*").alias("n"))
    c = s.focus_symbols(everything).groupBy("symbol").agg(F.count("*").alias("c")).join(F.broadcast(n)).select("symbol", F.round(F.col("c") / F.col("n"), 4).alias("relevance_score"))
    return s.focus_boosts(c, s.focus_symbols(turns), s.focus_symbols(s.last_turns(turns, 3)), s.focus_symbols(s.last_turns(turns, 1)))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    e = s.sessionised(t.table(spark, d, "events"), "6 hours")
    return e.select("user_id", F.unix_timestamp("session_start").alias("start_s"), "n")


QUERIES = {f.__name__: f for f in (vector_topk, keyword_topk, rank_fusion, context_query, token_estimates, budget_by_source, heuristic_rerank, retrieval_quality, latency_p95, regression_gate, last_turns, session_focus, focus_boosts, sessions)}

_V = """v AS (SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
vt AS (SELECT * FROM v WHERE score >= 0.3 ORDER BY score DESC, vec_id LIMIT 20)"""
_HITS = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in WORDS)
_K = f"""k AS (SELECT doc_id, CAST({_HITS} AS INT) AS hits FROM documents), kt AS (SELECT * FROM k WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 20),
kr AS (SELECT doc_id, hits, CAST(row_number() OVER (ORDER BY hits DESC, doc_id) AS INT) AS position FROM kt), ks AS (SELECT *, round(greatest(0.0, 1 - (position - 1) * CAST(0.1 AS DOUBLE)), 6) AS score FROM kr)"""
_L = f"""RECURSIVE w(id, depth) AS (SELECT 0, 0 UNION SELECT id * 3 + k, depth + 1 FROM w JOIN documents ON doc_id = id, unnest(range(1, 6)) AS u(k) WHERE depth < 3),
{_V}, {_K}, l AS (SELECT 'vector' AS source, 'doc/' || vec_id AS file_path, score AS relevance_score FROM vt UNION ALL SELECT 'keyword', 'doc/' || doc_id, score FROM ks
UNION ALL SELECT 'graph', 'doc/' || id, CAST(1 AS DOUBLE) - min(depth) / 5 FROM w WHERE depth > 0 GROUP BY id),
rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY relevance_score DESC, file_path) AS rank FROM l),
f AS (SELECT file_path, round(sum(CAST(CASE source WHEN 'keyword' THEN 0.3 WHEN 'vector' THEN 0.5 ELSE 0.2 END AS DOUBLE) / (60 + rank)), 9) AS fusion_score,
  coalesce(max(relevance_score) FILTER (source = 'graph'), max(relevance_score) FILTER (source = 'vector'), max(relevance_score) FILTER (source = 'keyword')) AS relevance_score,
  string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM rk GROUP BY 1)"""
_TOK = "CAST(CASE WHEN {n} <= 0 THEN 0 ELSE greatest({n} // 4 + ({n} // 4) // 10, 1) END AS BIGINT)"
_FOCUS = "SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '([a-z]{3,})', 1)) AS symbol FROM "
SQL = {
    "vector_topk": f"WITH {_V} SELECT * FROM vt",
    "keyword_topk": f"WITH {_K} SELECT * FROM ks",
    "rank_fusion": f"WITH {_L} SELECT * FROM f",
    "context_query": f"""WITH {_L}, m AS (SELECT 'doc/' || doc_id AS file_path, round(doc_id % 10 / 10, 1) AS hotspot, CAST(doc_id % 4 AS INT) AS distance, {_TOK.format(n='length(text)')} AS tokens FROM documents),
c AS (SELECT f.file_path, fusion_score, relevance_score, sources, hotspot, distance, coalesce(tokens, 1) AS tokens, round(CAST(0.4 AS DOUBLE) * relevance_score + CAST(0.3 AS DOUBLE) * coalesce(hotspot, 0) + CAST(0.3 AS DOUBLE) * (1.0 / greatest(coalesce(distance, 1), 1)), 4) AS priority
  FROM f LEFT JOIN m USING (file_path) WHERE relevance_score >= 0.4),
u AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY priority DESC, file_path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM c WHERE tokens <= 4000) SELECT * FROM u WHERE used <= 4000""",
    "token_estimates": f"SELECT doc_id, {_TOK.format(n='length(text)')} AS tokens, {_TOK.format(n='h')} AS head_tokens FROM (SELECT doc_id, text, length(array_to_string(string_split(text, chr(10))[1:3], chr(10))) AS h FROM documents)",
    "budget_by_source": f"WITH d AS (SELECT doc_id, source, {_TOK.format(n='length(text)')} AS tokens FROM documents), u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY tokens DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM d WHERE tokens <= 3000) SELECT * FROM u WHERE used <= 3000",
    "heuristic_rerank": """WITH c AS (SELECT doc_id, ['ts', 'sh', 'py', 'js'][doc_id % 4 + 1] AS ext, doc_id % 7 / 10 AS base, CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 9000) // 86400 END AS days FROM documents)
SELECT 'src/f' || doc_id || '.' || ext AS file_path, round(base + CAST(CASE WHEN ext IN ('ts', 'js') THEN 0.3 WHEN ext = 'sh' THEN 0.1 ELSE 0 END AS DOUBLE) + CASE WHEN days IS NULL THEN CAST(0 AS DOUBLE) ELSE round(CAST(0.3 AS DOUBLE) / (1 + days), 3) END + CAST(CASE WHEN doc_id % 5 = 0 THEN 0.4 ELSE 0 END AS DOUBLE), 3) AS rerank_score FROM c""",
    "retrieval_quality": """WITH i AS (SELECT item_id AS query, text, array_to_string(string_split(text, ' ')[1:3], ' ') AS head FROM benchmark),
h AS (SELECT query, doc_id AS item, contains(d.text, i.text) AS good, row_number() OVER (PARTITION BY query ORDER BY instr(d.text, head), doc_id) AS rank FROM documents d JOIN i ON contains(' ' || d.text || ' ', ' ' || head || ' ')),
w AS (SELECT query, count(*) AS wanted FROM h WHERE good GROUP BY 1), x AS (SELECT query, min(rank) FILTER (good) AS first, count(*) FILTER (good) AS hits, count(*) AS got FROM h WHERE rank <= 10 GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(hits / wanted), 6) AS recall, round(avg(hits / got), 6) AS precision FROM w JOIN x USING (query)""",
    "latency_p95": "SELECT quantile_disc(value, 0.95) AS p FROM events",
    "regression_gate": "SELECT * FROM (VALUES ('equal', true, true, true, true), ('worse', false, false, false, false), ('slow', true, true, false, false)) AS t(name, mrr_ok, recall_ok, latency_ok, passed)",
    "last_turns": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
    "session_focus": f"""WITH c AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3), f AS ({_FOCUS} c), n AS (SELECT conv_id, symbol, count(*) AS n FROM f GROUP BY ALL)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, symbol) <= 5""",
    "focus_boosts": f"""WITH f AS ({_FOCUS} conversations), c AS (SELECT symbol, round(count(*) / (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations)), 4) AS s FROM f GROUP BY 1),
o AS (SELECT *, dense_rank() OVER (ORDER BY turn DESC) AS back FROM (SELECT f.symbol, f.turn FROM f WHERE conv_id = 1 UNION ALL SELECT NULL, turn FROM conversations WHERE conv_id = 1)),
b AS (SELECT symbol, s, least(CAST(CASE WHEN symbol IN (SELECT symbol FROM o WHERE symbol IS NOT NULL) THEN 0.2 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN symbol IN (SELECT symbol FROM o WHERE back <= 3 AND symbol IS NOT NULL) THEN 0.3 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN symbol IN (SELECT symbol FROM o WHERE back = 1 AND symbol IS NOT NULL) THEN 0.5 ELSE 0 END AS DOUBLE), s * 0.5) AS x FROM c)
SELECT symbol, round(s + x, 6) AS relevance_score, round(x, 6) AS boost FROM b""",
    "sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, g""",
}
