import pytest
from pyspark.sql import functions as F

from weftline.operators import assist as a


def tuples(df, *cols):
    return sorted(tuple(x[c] for c in cols) for x in df.collect())


def test_error_mentions(spark):
    e = spark.createDataFrame([(1, "TypeError at src/a.ts:12 in getUser via load_all and 'x' at src/a.ts:12"), (2, None)], "id int, text string")
    assert tuples(a.error_mentions(e).withColumn("line", F.coalesce("line", F.lit(0))), "id", "kind", "name", "line") == [(1, "file", "src/a.ts", 12), (1, "symbol", "TypeError", 0), (1, "symbol", "getUser", 0), (1, "symbol", "load_all", 0), (1, "symbol", "x", 0)]


def test_prompts_and_plans(spark):
    row = spark.createDataFrame([("Fix it", "a.ts", True, None), ("hello", None, None, "f")], "t string, f string, h boolean, fn string")
    got = [[(s["type"], s["weight"]) for s in r[0]] for r in row.select(a.prompt_signals(F.col("t"), F.col("f"), F.col("h"), F.col("fn"))).collect()]
    assert got == [[("explicit", 0.8), ("implicit", 0.6), ("historical", 0.6)], [("code", 0.7)]]
    assert [t["tool"] for t in a.tool_plan(0)] == ["index_status"] and len(a.tool_plan(1)) == 3


def test_files_and_modes(spark):
    impact = spark.createDataFrame([("b",), ("a",), ("a",)], "file_path string")
    assert tuple(a.affected_files(impact, 1).first()) == (3, ["a"])
    files = spark.createDataFrame([("src/a.ts", "import x from 'lodash/fp'"), ("other/b.ts", "import y from 'lodash'")], "file string, text string")
    parts, deps = a.code_components(files)
    assert tuples(parts, "path", "module") == [("src/a.ts", "src")] and tuples(deps, "target") == [("lodash/fp",)]
    assert tuples(a.package_usage(files, "lodash"), "file") == [("other/b.ts",), ("src/a.ts",)]
    mode = lambda *v: spark.range(1).select(a.update_mode(*map(F.lit, v)).alias("m")).first()["m"]
    assert [mode(False, True, "1", "1", 1), mode(True, False, "1", "1", 1), mode(True, True, "1", "2", 1), mode(True, True, "1", "1", 11), mode(True, True, "1", "1", 3)] == ["FALLBACK", "FULL_REBUILD", "FULL_REBUILD", "FULL_REBUILD", "INCREMENTAL"]
    assert [a.index_report(None, impact), a.index_report(impact, impact.limit(0)), a.index_report(impact, impact)] == ["no_index", "up_to_date", "updated"]


def test_counts(spark):
    r = spark.createDataFrame([("Accepted",), ("accepted 2024",), (None,)], "status string")
    assert tuples(a.record_status_counts(r), "status", "n") == [("accepted", 2), ("unknown", 1)]
    c = spark.createDataFrame([("x",)] * 3 + [("y",)] * 2 + [("dist/z",)] * 9, "file string")
    assert tuples(a.hot_files(c), "file", "freq") == [("x", 3)]
    h = spark.createDataFrame([("a", 4.0), ("b", 1.0)], "file string, score double")
    assert tuples(a.normalised_scores(h), "file", "share") == [("a", 1.0), ("b", 0.25)]


def test_supervisor():
    class Query:
        def __init__(self, fail):
            self.fail = fail

        def awaitTermination(self):
            if self.fail:
                raise RuntimeError

    runs = []

    def start():
        runs.append(1)
        return Query(len(runs) < 3)

    assert a.supervise(start) == "STOPPED" and len(runs) == 3
    assert a.supervise(lambda: Query(True), 1) == "FAILED"


def test_tool_runners_come_from_variables(monkeypatch):
    from weftline import config, providers

    assert providers.tool_runner("rerank", {}) is providers.rerank
    monkeypatch.setenv("WEFTLINE_RUNNER_RERANK", "weftline.config:budget")
    assert providers.tool_runner("rerank") is config.budget
    with pytest.raises(KeyError):
        providers.tool_runner("absent", {})
