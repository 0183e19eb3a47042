import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import graph as g
from weftline.plans.graph_queries import QUERIES

EDGE = "source_id string, target_id string, edge_type string"


def edges(spark, text, kind="CALLS"):
    rows = [(*e.split(">"), kind) if "/" not in e else (*e.split("/")[0].split(">"), e.split("/")[1]) for e in text.split()]
    return spark.createDataFrame(rows, EDGE)


def nodes(spark, names, path=lambda n: f"src/{n}.ts"):
    return spark.createDataFrame([(n, n, "function", path(n)) for n in names], "id string, symbol string, kind string, file_path string")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_impact_of_a_chain(spark):
    got = g.impact(nodes(spark, "ABCD"), edges(spark, "A>B B>C C>D"), seeds(spark, "A"), max_depth=3)
    assert rows(got, "id", "confidence") == [("B", 0.8), ("C", 0.64), ("D", 0.512)]


def test_impact_of_five_hops_and_threshold(spark):
    e = edges(spark, "S>A A>B B>C C>D D>E")
    got = g.impact(nodes(spark, "SABCDE"), e, seeds(spark, "S"))
    assert [c for _, c in rows(got, "id", "confidence")] == [0.8, 0.64, 0.512, 0.41, 0.328]
    assert rows(g.impact(nodes(spark, "SABCDE"), e, seeds(spark, "S"), threshold=0.6), "id") == [("A",), ("B",)]


def test_impact_in_a_cycle_visits_once(spark):
    got = g.impact(nodes(spark, "ABCDE"), edges(spark, "A>B B>C C>A C>D D>E"), seeds(spark, "A"))
    assert rows(got, "id", "confidence") == [("B", 0.8), ("C", 0.64), ("D", 0.512), ("E", 0.41)]


def test_file_impact_counts_the_nearest_symbol(spark):
    n = nodes(spark, ["main", "api", "service", "h1", "h2"], lambda x: "src/utils.ts" if x.startswith("h") else f"src/{x}.ts")
    got = g.file_impact(n, edges(spark, "main>h1 api>h1 api>h2 service>main"), "src/utils.ts", max_depth=2)
    assert rows(got, "id", "confidence") == [("api", 0.8), ("main", 0.8), ("service", 0.64)]


def test_impact_rejects_bad_arguments(spark):
    with pytest.raises(ValueError):
        g.impact(nodes(spark, "A"), edges(spark, "A>B"), seeds(spark, "A"), decay=1.5)


def test_shortest_path(spark):
    e = edges(spark, "A>B B>C C>D")
    assert g.shortest_path(e, "A", "D", max_depth=2).count() == 0
    got = g.shortest_path(e, "A", "C").first()
    assert (got["path"], got["length"], got["edge_types"]) == (["A", "B", "C"], 2, ["CALLS", "CALLS"])
    assert g.shortest_path(edges(spark, "A>B/CALLS B>C/IMPORTS"), "A", "C", types=["CALLS"]).count() == 0


def test_shortest_path_takes_the_first_of_equals(spark):
    assert g.shortest_path(edges(spark, "A>C A>B B>D C>D"), "A", "D").first()["path"] == ["A", "B", "D"]


def test_cycles(spark):
    assert [r["cycle"] for r in g.cycles(edges(spark, "A>B B>A")).collect()] == [["A", "B", "A"]]
    assert g.cycles(edges(spark, "A>B B>C C>D D>A")).count() == 1
    assert g.cycles(edges(spark, "A>B B>A"), whitelist=["^B$"]).count() == 0
    assert [r["cycle"] for r in g.cycles(edges(spark, "A>A")).collect()] == [["A", "A"]]


@settings(max_examples=4, deadline=None)
@given(st.sets(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde")), min_size=1, max_size=9))
def test_closure_and_cycles_by_brute_force(spark, pairs):
    e = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], EDGE)
    far, step = {}, set(pairs)
    for depth in range(1, 6):
        for p in step:
            far.setdefault(p, depth)
        step = {(a, d) for a, b in step for c, d in pairs if b == c}
    assert {(r[0], r[1]): r[2] for r in g.closure(e).collect()} == far
    want = set()
    for n in range(1, 6):
        for p in itertools.permutations("abcde", n):
            if p[0] == min(p) and all((a, b) in pairs for a, b in zip(p, (*p[1:], p[0]))):
                want.add((*p, p[0]))
    assert {tuple(r["cycle"]) for r in g.cycles(e).collect()} == want


def test_extend_closure_equals_recomputing(spark):
    e = edges(spark, "A>B C>D D>E")
    got = g.extend_closure(g.closure(e), "B", "C")
    assert rows(got, "source_id", "target_id", "depth") == rows(g.closure(e.unionByName(edges(spark, "B>C"))), "source_id", "target_id", "depth")


def test_strong_components(spark):
    got = g.strong_components(edges(spark, "A>B B>A B>C C>D D>C"))
    assert rows(got, "id", "component") == [("A", "A"), ("B", "A"), ("C", "C"), ("D", "C")]


def test_cycles_of_more_than_64_nodes(spark):
    ring = edges(spark, " ".join(f"{k:02}>{(k + 1) % 66:02}" for k in range(66)))
    names = [f"{k:02}" for k in range(66)]
    assert rows(g.cycle_nodes(ring), "id", "length") == [(n, 66) for n in names]
    assert rows(g.strong_components(ring), "id", "component") == [(n, "00") for n in names]


def test_orphans_and_dangling(spark):
    n, e = nodes(spark, "ABC"), edges(spark, "A>B B>X Y>Z")
    assert rows(g.orphans(n, e), "id") == [("A",), ("C",)]
    assert rows(g.orphans(n, e, exclude="C.ts"), "id") == [("A",)]
    assert rows(g.dangling(n, e), "source_id", "missing") == [("B", "target"), ("Y", "both")]


def test_call_chain(spark):
    e = edges(spark, "A>B B>C C>A X>A")
    got = rows(g.call_chain(e, "A", depth=3), "direction", "depth", "caller", "callee", "cycle")
    assert got == [("callees", 1, "A", "B", False), ("callees", 2, "B", "C", False), ("callees", 3, "C", "A", True), ("callers", 1, "C", "A", False), ("callers", 1, "X", "A", False)]


def test_last_call_path(spark):
    calls = spark.createDataFrame([("entry", "norm", 1), ("entry", "sink", 2), ("sink", "s1", 1), ("s1", "start", 1), ("start", "input", 3), ("loop", "loop2", 1), ("loop2", "loop", 1)], "caller string, callee string, position int")
    assert [r["symbol"] for r in g.last_call_path(calls, "entry").orderBy("step").collect()] == ["entry", "sink", "s1", "start", "input"]
    assert g.last_call_path(calls, "loop").first()["outcome"] == "cycle"
    assert g.last_call_path(calls, "entry", 2).first()["outcome"] == "truncated"


def test_module_and_file_graph_and_diagrams(spark):
    n = nodes(spark, ["a", "b", "c"], lambda x: {"a": "ui/x.ts", "b": "db/y.ts", "c": "ui/z.ts"}[x])
    e = edges(spark, "a>b a>c c>b")
    m = g.module_graph(n, e)
    assert rows(m, "source_module", "target_module", "n") == [("ui", "db", 2)]
    assert rows(g.file_graph(n, e, "ui/"), "source_file", "target_file") == [("ui/x.ts", "ui/z.ts")]
    assert g.mermaid(m).first()[0] == "graph TD\n  ui --> db"
    assert g.d3(n, e, "source_id", "target_id").first()[0].startswith('{"nodes":["a","b","c"],"links":[{"source":"a"')


def test_expand_imports_and_subgraph_and_trace(spark):
    imports = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")], "source string, target string")
    anchors = spark.createDataFrame([("a", 1), ("b", 2)], "file_path string, rank int")
    assert rows(g.expand_imports(anchors, imports, most=1), "file_path") == [("x",), ("z",)]
    c = spark.createDataFrame([("s", ["p"], ["q", "r"])], "symbol_id string, callers array<string>, callees array<string>")
    assert rows(g.subgraph(c), "source", "target") == [("p", "s"), ("s", "q"), ("s", "r")]
    got = g.dependency_trace(edges(spark, "root>a a>pkg root>b b>a"), seeds(spark, "root"), "pkg")
    assert sorted(r["path"] for r in got.collect()) == [["root", "a", "pkg"], ["root", "b", "a", "pkg"]]


def test_stats_counts_every_type(spark):
    got = g.stats(nodes(spark, "AB"), edges(spark, "A>B/CALLS B>A/IMPORTS")).first()
    assert (got["nodes"], got["edges"], got["calls"], got["imports"], got["extends"]) == (2, 2, 1, 1, 0)


def test_empty_graph(spark):
    e = spark.createDataFrame([], EDGE)
    assert g.closure(e).count() == g.cycles(e).count() == g.shortest_path(e, "A", "B").count() == 0
    assert g.impact(nodes(spark, "A"), e, seeds(spark, "A")).count() == 0
    assert g.orphans(nodes(spark, "A"), e).select(F.col("id")).first()[0] == "A"


@pytest.mark.parametrize("name", ["closure_cyclic", "cycle_nodes", "strong_components", "call_chain"])
def test_queries_read_all_users(spark, tmp_path, name):
    events = [(1, 1, "view"), (2, 1, "click"), (3, 12, "click"), (4, 12, "view")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").withColumn("ts", F.col("event_id").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    want = {
        "closure_cyclic": [("click", "click"), ("click", "view"), ("view", "click"), ("view", "view")],
        "cycle_nodes": [("click", 2), ("view", 2)],
        "strong_components": [("click", "click"), ("view", "click")],
        "call_chain": [("click", "view"), ("click", "view"), ("view", "click")],
    }
    columns = {"closure_cyclic": ("source_id", "target_id"), "cycle_nodes": ("id", "length"), "strong_components": ("id", "component"), "call_chain": ("caller", "callee")}
    assert rows(got, *columns[name]) == want[name]


def test_strong_components_by_colouring(spark):
    """The distributed rounds give what one task gives: rings joined by bridges, a loop, a chain, and a ring within a ring."""
    e = edges(spark, "A>B B>C C>A C>D D>E E>D E>F F>F F>G G>H X>A Y>X K>L L>M M>K M>L H>N")
    want = rows(g.strong_components(e), "id", "component")
    assert want == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "D"), ("E", "D"), ("F", "F"), ("K", "K"), ("L", "K"), ("M", "K")]
    assert rows(g.strong_components(e, one_task=0), "id", "component") == want
    assert g.strong_components(e.limit(0), one_task=0).count() == 0


def test_cycles_of_any_length(spark):
    names = [f"{k:02}" for k in range(12)]
    ring = edges(spark, " ".join(f"{a}>{b}" for a, b in zip(names, names[1:] + names[:1], strict=True)))
    assert g.cycles(ring).count() == 0
    assert [r["length"] for r in g.cycles(ring, None).collect()] == [12]
