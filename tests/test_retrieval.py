import pytest
from pyspark.sql import functions as F

from weftline.operators import retrieval as r
from weftline.operators import sessions as s


def tuples(df, *cols):
    return [tuple(x[c] for c in cols) for x in df.collect()]


LIST = "source string, file_path string, relevance_score double"
MOCK = [("keyword", "auth.ts", 0.5), ("keyword", "user.ts", 0.4), ("vector", "auth.ts", 0.8), ("vector", "user.ts", 0.6), ("graph", "graph.ts", 0.9)]


def test_fusion(spark):
    got = {x["file_path"]: x for x in r.reciprocal_rank_fusion(spark.createDataFrame(MOCK, LIST)).collect()}
    assert [round(got[f]["fusion_score"], 6) for f in ("auth.ts", "user.ts", "graph.ts")] == [0.013115, 0.012903, 0.003279]
    assert got["auth.ts"]["relevance_score"] == 0.8 and got["graph.ts"]["relevance_score"] == 0.9 and got["auth.ts"]["sources"] == "keyword,vector"
    heavy = r.reciprocal_rank_fusion(spark.createDataFrame(MOCK, LIST), {"keyword": 0.1, "vector": 0.1, "graph": 0.8})
    assert heavy.orderBy(F.desc("fusion_score")).first()["file_path"] == "graph.ts"


@pytest.mark.parametrize(("relevance", "hot", "distance", "want"), [(0.8, 0.6, 2, 0.65), (0.6, 0.4, 3, 0.46), (0.5, 0.5, 0, 0.65), (None, None, None, 0.3)])
def test_priority(spark, relevance, hot, distance, want):
    row = spark.createDataFrame([(relevance, hot, distance)], "relevance_score double, hotspot double, distance int")
    assert row.select(r.priority().alias("p")).first()["p"] == want


def test_budget(spark):
    c = spark.createDataFrame([("A", 0.9, 1000), ("B", 0.7, 100), ("C", 0.6, 450), ("D", 0.5, 10)], "file_path string, priority double, tokens long")
    assert tuples(r.within_budget(c, 500), "file_path") == [("B",)]  # A is over the budget, C overflows and ends the list
    assert r.within_budget(c, 0).count() == r.within_budget(c, -5).count() == 0
    assert tuples(r.top_within_budget(c, 2000), "file_path", "used") == [("A", 1000), ("B", 1100), ("C", 1550), ("D", 1560)]


def test_tokens(spark):
    got = spark.createDataFrame([(1000,), (3,), (0,)], "n int").select(r.token_estimate(F.col("n")).alias("t"))
    assert tuples(got, "t") == [(275,), (1,), (0,)]
    assert spark.range(1).select(r.first_lines(F.lit("a\nb\nc"), 2).alias("t")).first()["t"] == "a\nb"


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0, 9.0])], "vec_id int, embedding array<float>")
    assert tuples(r.vector_topk(v, [1.0, 0.0], k=9), "vec_id", "score") == [(1, 1.0), (5, 1.0), (2, 0.707107)]
    assert tuples(r.vector_topk(v, [1.0, 0.0], k=1), "vec_id") == [(1,)]


def test_keywords(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "Alpha"), (3, None), (4, "none")], "doc_id int, text string")
    assert tuples(r.keyword_topk(d, "Alpha, beta of it", 5), "doc_id", "hits", "score") == [(1, 2, 1.0), (2, 1, 0.9)]
    assert r.keyword_topk(d, "of it").count() == 0


def test_reranks(spark):
    c = spark.createDataFrame([("src/a/user.ts", 5), ("src/user.ts", 1), ("x.ts", 9), ("y.ts", 9)], "file_path string, mtime long")
    assert [x[0] for x in tuples(r.rerank_by_name(c, "the user").orderBy("rerank"), "file_path")] == ["src/user.ts", "src/a/user.ts", "x.ts", "y.ts"]
    h = spark.createDataFrame([("a.ts", 0.5, 1000, True), ("b.sh", 0.5, None, False)], "file_path string, relevance_score double, mtime long, hotspot boolean")
    assert tuples(h.select(r.heuristic_score(1000 + 2 * 86400).alias("s")), "s") == [(1.3,), (0.6,)]
    p = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position int, file_path string")
    scores = spark.createDataFrame([(2, 9.0), (7, 8.0), (0, 1.0)], "index int, score double")
    assert tuples(r.apply_scores(p, scores).orderBy("rank"), "file_path") == [("c",), ("a",), ("b",)]
    assert tuples(r.apply_scores(p, r.mock_scores(p)).orderBy("rank"), "file_path") == [("a",), ("b",), ("c",)]


def test_metrics_and_gate(spark):
    results = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 1), ("q2", "c", 1), ("q2", "d", 11)], "query string, item string, rank int")
    expected = spark.createDataFrame([("q1", "a"), ("q1", "z"), ("q2", "d")], "query string, item string")
    m = r.retrieval_metrics(results, expected).first()
    assert (m["n_queries"], m["mrr"], m["hit_rate"], m["recall"], m["precision"]) == (2, 0.25, 0.5, 0.25, 0.25)
    n = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    assert r.nearest_rank(n, "v").first()["p"] == 19.0
    cols = "mrr_at_10 double, recall_at_10 double, p95_latency_ms double"
    base = spark.createDataFrame([(0.6, 0.7, 1200.0)], cols)
    assert r.regression_gate(base, base).first()["passed"]
    assert not r.regression_gate(base, spark.createDataFrame([(0.4, 0.5, 1800.0)], cols)).first()["passed"]


def test_context_drops_libraries(spark):
    from weftline.functions.text import is_library

    meta = spark.createDataFrame([("auth.ts", 0.1, 1, 100), ("vendor/x.go", 0.9, 1, 5)], "file_path string, hotspot double, distance int, tokens long")
    lists = spark.createDataFrame([*MOCK, ("graph", "vendor/x.go", 0.99)], LIST)
    got = r.context(lists, meta, budget=1000, min_relevance=0.5, is_library=is_library(F.col("file_path")))
    assert {x["file_path"] for x in got.collect()} == {"auth.ts", "user.ts", "graph.ts"}


def test_sessions(spark):
    t = spark.createDataFrame([(1, k, "user", f"word{chr(97 + k)} common") for k in range(12)], "conv_id long, turn int, role string, text string")
    assert s.last_turns(t, 10).agg(F.min("turn")).first()[0] == 2
    f = s.accumulated_focus(t, 10, 2)
    assert tuples(f.orderBy("symbol"), "symbol", "n") == [("common", 10), ("wordc", 1)]
    c = spark.createDataFrame([("x", 0.8), ("y", 0.8), ("z", 0.8)], "symbol string, relevance_score double")
    sym = lambda *v: spark.createDataFrame([(x,) for x in v], "symbol string")
    got = dict(tuples(s.focus_boosts(c, sym("x", "y"), sym("y"), sym("y")), "symbol", "relevance_score"))
    assert got == {"x": 1.0, "y": 1.2, "z": 0.8}
