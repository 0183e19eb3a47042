import json

import pytest
from pyspark.sql import functions as F

from weftline import config, providers
from weftline.operators import caching
from weftline.sources import files as f
from weftline.sources import sinks


def tuples(df, *cols):
    return sorted(tuple(x[c] for c in cols) for x in df.collect())


def test_tree_and_changes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "docs" / "adr").mkdir(parents=True)
    (tmp_path / "src" / "a.ts").write_text("const a = 1")
    (tmp_path / "docs" / "adr" / "1.md").write_text("# 1. x")
    (tmp_path / "big.txt").write_text("x" * 2000)
    tree = f.read_tree(spark, f"file://{tmp_path}", most_bytes=1000)
    assert tuples(tree, "file", "size") == [("big.txt", 2000), ("docs/adr/1.md", 6), ("src/a.ts", 11)]
    assert tree.filter("text is null").first()["file"] == "big.txt"
    assert f.record_folder(tree) == "docs/adr" and f.record_folder(tree.filter("size < 0")) is None
    assert f.changed_files(tree, "2999-01-01").count() == 0 and f.changed_files(tree, None, first=2).count() == 2
    known = spark.createDataFrame([("src/a.ts",)], "file string")
    assert f.changed_files(tree, "2999-01-01", known).count() == 2
    assert f.is_fresh(tree, "2999-01-01") and not f.is_fresh(tree, "2000-01-01")
    assert f.with_extensions(tree, ["ts"]).count() == 1


def test_symbol_index(spark, tmp_path):
    doc = {"documents": [{"relativePath": "a.ts", "symbols": [{"symbol": "pkg A#", "displayName": "A", "relationships": [{"symbol": "pkg B#", "isImplementation": True}, {"symbol": "pkg C#", "isReference": True}]}], "occurrences": [{"range": [3, 0], "symbol": "pkg A#", "symbolRoles": 1}, {"range": [5, 0], "symbol": "pkg D#"}, {"range": [6, 0], "symbol": "pkg D#", "symbolRoles": 6}]}]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    nodes, edges = f.read_symbol_index(spark, f"file://{tmp_path}/i.json")
    assert tuples(nodes, "id", "kind") == [("file:a.ts", "file"), ("pkg A#", "class")]
    assert tuples(edges, "source_id", "target_id", "edge_type") == [("file:a.ts", "pkg A#", "DEFINES"), ("file:a.ts", "pkg D#", "CALLS"), ("file:a.ts", "pkg D#", "IMPORTS"), ("pkg A#", "pkg B#", "IMPLEMENTS"), ("pkg A#", "pkg C#", "CALLS")]
    s = f.symbol_index_stats(nodes, edges).first()
    assert (s["documents"], s["symbols"], s["edges"], s["calls"]) == (1, 1, 5, 2)


def test_commit_log(spark, tmp_path):
    (tmp_path / "log").write_text("abcdef1|100|fix: a | b\n\nsrc/a.ts\nsrc/b.ts\n\nabcdef2|90|feat\nsrc/a.ts\n")
    log = f.commit_log(spark.read.text(f"file://{tmp_path}/log"))
    assert tuples(log, "sha", "ts", "subject", "file") == [("abcdef1", 100, "fix: a | b", "src/a.ts"), ("abcdef1", 100, "fix: a | b", "src/b.ts"), ("abcdef2", 90, "feat", "src/a.ts")]


def test_contracts_and_query_set(spark, tmp_path):
    tree = spark.createDataFrame([("api/u.proto", "message Q {}"), ("openapi.json", '{"paths": {"/x": {"get": {}}}}'), ("a.txt", "")], "file string, text string")
    row = f.contracts(tree, "svc").first()
    assert [(c["path"], c["type"], c["symbols"]) for c in row["contracts"]] == [("api/u.proto", "proto", ["Q"]), ("openapi.json", "openapi", ["GET /x"])]
    index = f.contracts(tree, "svc")
    assert f.update_index(index, index).count() == 1
    (tmp_path / "q.jsonl").write_text('{"query": "a", "expected": ["x"]}\n{"other": 1}\n')
    assert f.query_set(spark, f"file://{tmp_path}/q.jsonl").count() == 1


def test_definitions(spark):
    files = spark.createDataFrame([("a.ts", "export function f() {\n}\nclass B {}\nconst c = 1\n")], "file string, text string")
    tree = f.definitions(files)
    assert tuples(tree.filter("name is not null"), "type", "name", "start_line", "end_line") == [("class", "B", 3, 3), ("function", "f", 1, 2), ("variable", "c", 4, 5)]
    assert tree.filter("type = 'program'").first()["child_count"] == 3 and f.tree_nodes(tree).count() == 3


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/fb"
    row = spark.createDataFrame([("a.ts", 1, "var_use", "accepted")], "file string, line_no int, rule string, verdict string")
    sinks.record_feedback(row, path)
    sinks.record_feedback(row, path)
    assert spark.read.json(path).count() == 2
    with pytest.raises(ValueError):
        sinks.record_feedback(row.withColumn("verdict", F.lit("maybe")), path)
    sig = lambda *r: spark.createDataFrame(list(r), "symbol_id string, timestamp long")
    assert tuples(sinks.record_actions(sig(("a", 0), ("b", 100 * 86400)), sig(("c", 101 * 86400)), 101 * 86400), "symbol_id") == [("b",), ("c",)]
    turns = lambda *r: spark.createDataFrame(list(r), "conv_id long, turn long, text string")
    got = sinks.save_turns(turns((1, 1, "x"), (1, 2, "y")), turns((1, 2, "z"), (1, 3, "w")), 2)
    assert tuples(got, "turn", "text") == [(2, "z"), (3, "w")]
    imports = spark.createDataFrame([("a/x", "a/y"), ("a/x", "b/z")], "source string, target string")
    s = sinks.snapshot(imports, imports.limit(0), imports.limit(0), imports, "1", "t").first()
    assert (s["modules"], s["total_coupling"], s["boundary_clarity"]) == (1, 2, 0.5)
    assert tuples(sinks.module_metrics(imports), "module", "coupling_out", "coupling_in") == [("a", 1, 0), ("b", 0, 1)]
    assert sinks.to_json(imports, ["target"]) == '[{"source":"a/x","target":"a/y"},{"source":"a/x","target":"b/z"}]'
    assert sinks.to_markdown(imports, ["target"], 1) == "| source | target |\n| --- | --- |\n| a/x | a/y |"
    assert sinks.to_text(imports, ["target"], 1) == "source: a/x, target: a/y"


def test_vectors_and_search(spark):
    files = spark.createDataFrame([("a", "alpha beta"), ("b", "alpha beta"), ("c", "gamma")], "file string, text string")
    index = sinks.build_vectors(files, providers.hashed_embedding)
    assert index.count() == 3 and index.select("hash").distinct().count() == 2
    calls = []

    def counting(rows):
        calls.append(rows.count())
        return providers.hashed_embedding(rows)

    changed = spark.createDataFrame([("a", "alpha beta"), ("d", "delta")], "file string, text string")
    assert tuples(sinks.update_vectors(index, changed, counting), "file") == [("a",), ("d",)] and calls == [1]
    got = providers.semantic_search(files, index, "alpha beta")
    assert tuples(got, "file", "score", "source") == [("a", 1.0, "vector"), ("b", 1.0, "vector")]
    assert providers.semantic_search(files, None, "gamma").first()["source"] == "keyword"


def test_rerank_falls_back(spark):
    c = spark.createDataFrame([("src/user.ts", 1, 0), ("b.ts", 2, 1)], "file_path string, mtime long, position int")
    assert providers.rerank("user", c, "mock")[1] == "mock" and providers.rerank("user", c)[1] == "heuristic: disabled"
    providers.register_reranker("broken", lambda q, d: 1 / 0)
    got, how = providers.rerank("user", c, "broken")
    assert how == "heuristic: ZeroDivisionError" and got.orderBy("rank").first()["file_path"] == "src/user.ts"
    assert providers.pick(["x", "mock"], providers.RERANKERS) == "mock"


def test_config():
    c = config.Config.of("features:\n  search: true\n  graph:\n    enabled: false\nsmart_pruning:\n  priority_weights:\n    relevance: 0.5\n    hotspot: 0.25\n    distance: 0.25\nlist:\n  - a\n  - 2\ninline: [x, 1.5]\n")
    assert c.enabled("search") and not c.enabled("graph") and c.enabled("other") and c.get("list") == ["a", 2] and c.get("inline") == ["x", 1.5]
    assert c.priority_weights() == (0.5, 0.25, 0.25) and c.fusion_weights()["vector"] == 0.5
    with pytest.raises(ValueError):
        config.Config({"hybrid_retrieval": {"weights": {"vector": 0.9}}}).fusion_weights()
    assert [config.budget(x) for x in ("x", -3, "12")] == [8000, 0, 12]


def test_caching(spark, tmp_path):
    e = spark.createDataFrame([("s", f"k{i}", i, i, 10) for i in range(10)], "space string, key string, created long, used long, size long")
    assert tuples(caching.evicted(e, 10), "key") == [("k0",), ("k1",)] and caching.evicted(e, 11).count() == 0
    assert tuples(caching.evicted_by_size(e, 50), "key") == [(f"k{i}",) for i in range(6)] and caching.evicted_by_size(e, 100).count() == 0
    assert caching.alive(e, 5, ttl=2).count() == 7
    r = spark.createDataFrame([(True,), (True,), (False,)], "hit boolean")
    s = caching.cache_stats(e, r).first()
    assert (s["entries"], s["bytes"], s["hit_rate"]) == (10, 100, 0.67)
    memo = caching.Memo(spark, f"file://{tmp_path}/memo")
    make = lambda: e.groupBy("space").count()
    memo.get("n", [e], make)
    memo.get("n", [e.orderBy("key", ascending=False)], make)
    assert (memo.hits, memo.misses) == (1, 1)
    assert memo.warm_up({"a": ([e], make), "b": ([e], make)}) == ["a", "b"] and memo.warm_up({"c": ([e], make)}, 0) == []


def test_messages_round_trip_and_foreign_fields(spark):
    from weftline.sources import wire

    doc = {"relativePath": "a/ü.ts", "text": "", "symbols": [{"symbol": "s", "displayName": "S", "relationships": [{"symbol": "t", "isReference": False, "isImplementation": True, "isTypeDefinition": False, "isDefinition": False}]}], "occurrences": [{"range": [300, 1, 70_000], "symbol": "s", "symbolRoles": 9}]}
    data = wire.encode({"documents": [doc]}, "Index")
    assert wire.decode(data, "Index") == {"documents": [doc]}
    foreign = wire.write_varint(99 << 3 | 5) + b"abcd" + wire.write_varint(98 << 3 | 1) + b"12345678" + wire.write_varint(1 << 3 | 2) + b"\x00"
    assert wire.decode(foreign + data, "Index") == {"documents": [doc]}
    assert wire.decode(wire.write_varint(1 << 3) + b"\x07" + wire.write_varint(1 << 3) + b"\x08", "Occurrence")["range"] == [7, 8]
    with pytest.raises(ValueError, match="ends early"):
        wire.decode(data[:-1], "Index")


def test_binary_index_files(spark, tmp_path):
    from weftline.sources import wire

    doc = lambda k: {"relativePath": f"f{k}.ts", "symbols": [{"symbol": f"s{k}#"}], "occurrences": [{"range": [k], "symbol": "s0#", "symbolRoles": 1}]}
    (tmp_path / "index.scip").write_bytes(wire.encode({"documents": [doc(k) for k in range(3)]}, "Index"))
    nodes, edges = f.read_symbol_index(spark, f"file://{tmp_path}/index.scip")
    assert nodes.filter("kind = 'class'").count() == 3 and nodes.filter("kind = 'file'").count() == 3
    assert sorted((r["source_id"], r["line"]) for r in edges.filter("edge_type = 'DEFINES'").collect()) == [(f"file:f{k}.ts", k) for k in range(3)]
