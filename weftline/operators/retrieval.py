"""Retrieval: vector and keyword top-k, rank fusion, priorities, reranking, budgets, the context query and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.storage import cut, small

#: Fusion weights and constant, and priority weights (defaults).
FUSION = {"keyword": 0.3, "vector": 0.5, "graph": 0.2}
FUSION_K = 60
PRIORITY = (0.4, 0.3, 0.3)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter one's length, 6 decimals; 0 if a norm is 0, null if either is null."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, F.lit(1), n), lambda e: e.cast("double")) for v in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(a.isNull() | b.isNull(), None).when(n == 0, 0.0).otherwise(F.round(F.when(norm == 0, 0.0).otherwise(dot(x, y) / norm), 6))


def vector_topk(vectors: DataFrame, query: list[float], k: int = 5, threshold: float = 0.3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows most like the query, at or above the threshold: key, score. Ties go to the smaller key."""
    score = cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return vectors.select(F.col(key), score.alias("score")).filter(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(k)


def keywords(query: str, most: int = 5) -> list[str]:
    """The first words of at least three letters of a query, in small letters."""
    import re

    return list(dict.fromkeys(re.findall(r"[a-z]{3,}", query.lower())))[:most]


def keyword_topk(docs: DataFrame, query: str, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k rows that contain most of the query's keywords: key, hits, position, score = 1 - 0.1 (position - 1), 0 at least."""
    lowered = F.lower(F.col(text))
    hits = sum((F.coalesce(lowered.contains(w), F.lit(False)).cast("int") for w in keywords(query)), F.lit(0))
    top = docs.select(F.col(key), hits.alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), key).limit(k)
    # k rows at most, so that one task ranks them
    ranked = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("hits"), key)))
    return ranked.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - (F.col("position") - 1) * 0.1), 6))


def rank_lists(lists: DataFrame, by: str = "source", score: str = "relevance_score", key: str = "file_path") -> DataFrame:
    """Add rank, the 1-based position within each list, best score first."""
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key)))


def reciprocal_rank_fusion(lists: DataFrame, weights: dict[str, float] | None = None, k: int = FUSION_K) -> DataFrame:
    """Fuse ranked lists (source, file_path, relevance_score): file_path, fusion_score, relevance_score, sources.

    fusion_score sums weight / (k + rank) over the lists that have a file. relevance_score is that of the graph list, else the
    vector list, else the keyword list.
    """
    weights = weights or FUSION
    weight = F.coalesce(*(F.when(F.col("source") == s, F.lit(w)) for s, w in weights.items()), F.lit(0.0))
    ranked = rank_lists(lists)
    of = lambda s: F.max(F.when(F.col("source") == s, F.col("relevance_score")))
    out = ranked.groupBy("file_path").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("fusion_score"), F.coalesce(of("graph"), of("vector"), of("keyword")).alias("relevance_score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return out.withColumn("relevance_score", F.coalesce("relevance_score", "fusion_score"))


def priority(weights: tuple[float, float, float] = PRIORITY) -> Column:
    """Weighted sum of relevance_score, hotspot and nearness (1 / distance, 1 at most), 4 decimals; missing ones are 0, 0 and 1."""
    near = 1 / F.greatest(F.coalesce(F.col("distance"), F.lit(1)), F.lit(1))
    return F.round(weights[0] * F.coalesce(F.col("relevance_score"), F.lit(0.0)) + weights[1] * F.coalesce(F.col("hotspot"), F.lit(0.0)) + weights[2] * near, 4)


def token_estimate(chars: Column) -> Column:
    """Tokens of so many characters: a quarter and a tenth of that, in whole numbers; 1 at least unless there are none."""
    quarter = F.floor(chars / 4)
    return F.when(chars <= 0, F.lit(0)).otherwise(F.greatest(quarter + F.floor(quarter / 10), F.lit(1))).cast("long")


def first_lines(text: Column, n: int = 50) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def within_budget(candidates: DataFrame, budget: int, by: list[str] | None = None, order: list | None = None, tokens: str = "tokens") -> DataFrame:
    """Candidates in order while they fit the budget (per group of `by`): an item over the whole budget is passed over; the first
    that no longer fits ends the list. Adds used, the running total. A negative budget is 0."""
    by, order = by or [], order or [F.desc("priority"), F.col("file_path")]
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fitting = candidates.filter(F.col(tokens) <= max(budget, 0))
    return fitting.withColumn("used", F.sum(tokens).over(w)).filter(F.col("used") <= max(budget, 0))


def top_within_budget(candidates: DataFrame, budget: int, least_tokens: int = 1, **options) -> DataFrame:
    """within_budget() without groups, for candidates of at least `least_tokens` each: no more than budget / least_tokens of them can
    be taken, so only so many are ranked."""
    top = candidates.filter(F.col(options.get("tokens", "tokens")) <= max(budget, 0)).orderBy(F.desc("priority"), "file_path").limit(max(1, budget // least_tokens))
    return within_budget(top, budget, **options)


def rerank_by_name(candidates: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Name matches first, then short paths, then new files: adds rerank, 1 to limit. Needs file_path and mtime."""
    name = F.lower(F.element_at(F.split("file_path", "/"), -1))
    match = F.greatest(F.lit(0), *(name.contains(w).cast("int") for w in keywords(query))) if keywords(query) else F.lit(0)
    order = [F.desc("_match"), F.col("_depth"), F.desc("mtime"), F.col("file_path")]
    top = candidates.withColumn("_match", match).withColumn("_depth", F.size(F.split("file_path", "/"))).orderBy(*order).limit(limit)
    return top.withColumn("rerank", F.row_number().over(Window.orderBy(*order))).drop("_match", "_depth")


def heuristic_score(now: int) -> Column:
    """Base score plus extension, age and hotspot bonus, 3 decimals. Needs relevance_score, file_path, mtime (seconds), hotspot (boolean)."""
    ext = F.lower(F.element_at(F.split("file_path", r"\."), -1))
    bonus = F.when(ext.isin("ts", "tsx", "js", "jsx"), 0.30).when(ext == "sh", 0.10).otherwise(0.0)
    recent = F.when(F.col("mtime").isNotNull(), F.round(0.30 / (1 + F.floor((F.lit(now) - F.col("mtime")) / 86400)), 3)).otherwise(0.0)
    return F.round(F.coalesce("relevance_score", F.lit(0.0)) + bonus + recent + F.when(F.col("hotspot"), 0.40).otherwise(0.0), 3)


def apply_scores(candidates: DataFrame, scores: DataFrame, limit: int = 10) -> DataFrame:
    """Order candidates (position from 0) by scores (index, score) that a reranker gave; unknown positions are dropped, the others
    come after the scored ones in their order."""
    out = candidates.filter(F.col("position") < limit).join(small(cut(scores, "scores")), F.col("position") == F.col("index"), "left")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "position"))).drop("index")


def mock_scores(candidates: DataFrame) -> DataFrame:
    """A deterministic stand-in for a reranker: 10 less the position."""
    return candidates.select(F.col("position").alias("index"), (F.lit(10.0) - F.col("position")).alias("score"))


def context(lists: DataFrame, meta: DataFrame, budget: int = 8000, min_relevance: float = 0.0, is_library: Column | None = None) -> DataFrame:
    """The context query: fuse, filter, prioritise and cut to a budget. meta: file_path, hotspot, distance, tokens."""
    fused = reciprocal_rank_fusion(lists).join(meta, "file_path", "left")
    if is_library is not None:
        fused = fused.filter(~is_library)
    if min_relevance > 0:
        fused = fused.filter(F.col("relevance_score") >= min_relevance)
    fused = fused.withColumn("priority", priority()).withColumn("tokens", F.coalesce("tokens", F.lit(1)).cast("long"))
    return top_within_budget(fused, budget)


def retrieval_metrics(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """One row over all queries with an expectation: n_queries, mrr, hit_rate, recall, precision (of the k best results).

    results: query, item, rank. expected: query, item. Queries without a hit count as 0.
    """
    top = results.filter(F.col("rank") <= k).select("query", "item", "rank").distinct()
    want = expected.select("query", "item").distinct()
    hits = top.join(want, ["query", "item"]).groupBy("query").agg(F.min("rank").alias("first"), F.count("*").alias("hits"))
    n = want.groupBy("query").agg(F.count("*").alias("wanted")).join(hits, "query", "left").join(top.groupBy("query").agg(F.count("*").alias("got")), "query", "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return n.agg(F.count("*").alias("n_queries"), mean(1 / F.col("first")).alias("mrr"), mean((F.col("hits") > 0).cast("double")).alias("hit_rate"), mean(F.col("hits") / F.col("wanted")).alias("recall"), mean(F.col("hits") / F.col("got")).alias("precision"))


def nearest_rank(rows: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """One row: the nearest-rank percentile of a column."""
    return rows.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})").alias("p"))


def regression_gate(baseline: DataFrame, current: DataFrame, least: float = 0.95, most: float = 1.10) -> DataFrame:
    """Whether quality and latency hold against a baseline: mrr_ok, recall_ok, latency_ok, passed. One-row inputs."""
    b = baseline.select(*(F.col(c).alias(f"_{c}") for c in ("mrr_at_10", "recall_at_10", "p95_latency_ms")))
    out = current.join(b).select((F.col("mrr_at_10") >= F.col("_mrr_at_10") * least).alias("mrr_ok"), (F.col("recall_at_10") >= F.col("_recall_at_10") * least).alias("recall_ok"), (F.col("p95_latency_ms") <= F.col("_p95_latency_ms") * most).alias("latency_ok"))
    return out.withColumn("passed", F.col("mrr_ok") & F.col("recall_ok") & F.col("latency_ok"))
