import duckdb
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from weftline.llm.mixing import GRID, mix_sources, search_exponent
from weftline.llm.sql import SQL


def corpus(documents):
    return documents(*((k, "w " * (k % 7 + 1), "big" if k % 3 else f"s{k % 5}") for k in range(400)), (1000, None, "big"), (1001, "x y", None))


def test_budget_is_met_by_whole_passes_and_a_part(documents):
    docs = corpus(documents)
    got = mix_sources(docs, budget=2.5, target_entropy=0.9).select("doc_id", "source", "_draw.*")
    total = sum(r["text"].count("w") + r["text"].count("x") + r["text"].count("y") for r in docs.collect() if r["text"])
    spent = got.agg(F.sum("n_tokens")).first()[0]
    assert 2.5 * total - 60 <= spent <= 2.5 * total
    passes = got.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("epoch").alias("e")).collect()
    assert all(r["n"] == r["e"] + 1 for r in passes)  # no pass but the last leaves a document out
    assert got.filter("position < 0 or position > 1").count() == 0


def test_cover_keeps_all_and_limits_repetition(documents):
    docs = corpus(documents)
    got = mix_sources(docs, budget=None, target_entropy=1.0, max_repetition=2.0)
    n = got.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert tuple(n) == (1, 2, 402) or tuple(n) == (1, 3, 402)
    assert got.columns == [*docs.columns, "_draw"]


def test_exponent_search_equals_bisection(spark):
    import math

    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, n long")

    def share(alpha):
        r = [(n / 1110) ** alpha for n in (1000, 100, 10)]
        return [x / sum(r) for x in r]

    k = search_exponent(totals, None, 0.8, None)
    entropy = lambda j: -sum(p * math.log(p) for p in share(j / GRID)) / math.log(3)
    assert entropy(k) >= 0.8 > entropy(k + 1)
    k = search_exponent(totals, 1110, None, 5.0)
    most = lambda j: max(p * 1110 / n for p, n in zip(share(j / GRID), (1000, 100, 10), strict=True))
    assert most(k) <= 5.0 < most(k - 1)


def test_equals_sql_with_uneven_sources(spark, documents):
    docs = corpus(documents).filter("source is not null")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = mix_sources(docs.select("doc_id", "source", "text"), budget=1.0, target_entropy=0.95, max_repetition=4.0).select("doc_id", "source", "_draw.*")
    cols = sorted(got.columns)
    res = con.execute(SQL["op1_mix_sources"])
    names = [c[0] for c in res.description]
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == want and max(r[cols.index("epoch")] for r in want) >= 1


@pytest.mark.parametrize("budget", [1.0, None])
def test_odd_rows(documents, budget):
    docs = documents(*ODD).withColumn("_draw", F.lit("clash")).withColumn("epoch", F.lit(7))
    got = mix_sources(docs, budget=budget, max_repetition=3.0)
    assert got.columns == [*(c for c in docs.columns if c != "_draw"), "_draw"] and got.count() > 0
    assert mix_sources(docs.limit(0), budget=budget, target_entropy=0.9).count() == 0
    assert mix_sources(documents((1, None), (2, "")), budget=budget).count() == 0
