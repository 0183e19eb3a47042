import json

import pytest

from weftline.operators import store as s

NODE = "id string, symbol string, kind string, file_path string"
EDGE = "source_id string, target_id string, edge_type string"


def test_store_keeps_and_deletes(spark, tmp_path):
    db = s.Store(spark, f"file://{tmp_path}/db")
    db.init()
    db.init()
    db.put(spark.createDataFrame([("A", "a", "function", "a.ts"), ("B", "b", "function", "b.ts")], NODE), spark.createDataFrame([("A", "B", "CALLS"), ("A", "B", "CALLS"), ("B", "A", "IMPORTS")], EDGE))
    assert (db.nodes.count(), db.edges.count()) == (2, 2)
    db.put(spark.createDataFrame([("A", "renamed", "function", "a.ts")], NODE))
    assert db.node("A").first()["symbol"] == "renamed"
    db.delete_edge(db.edges.filter("edge_type = 'IMPORTS'").first()["id"])
    assert db.edges.count() == 1
    db.delete_node("B")
    assert (db.nodes.count(), db.edges.count()) == (1, 0)


def test_bad_rows_change_nothing(spark, tmp_path):
    db = s.Store(spark, f"file://{tmp_path}/db")
    db.init()
    with pytest.raises(ValueError):
        db.put(edges=spark.createDataFrame([("A", "B", "CONTAINS")], EDGE))
    with pytest.raises(ValueError):
        db.put(spark.createDataFrame([("A", "", "function", "a.ts")], NODE))
    assert db.nodes.count() == db.edges.count() == 0


def test_import_document(spark, tmp_path):
    doc = {"nodes": [{"id": "A", "symbol": "a", "kind": "function", "file_path": "a.ts"}, {"id": "A", "symbol": "later", "kind": "function", "file_path": "a.ts"}], "edges": [{"source_id": "A", "target_id": "Z", "edge_type": "CALLS"}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    db = s.Store(spark, f"file://{tmp_path}/db")
    db.init()
    db.load(f"file://{tmp_path}/d.json")
    assert [r["symbol"] for r in db.nodes.collect()] == ["later"] and db.edges.count() == 1
    doc["edges"][0]["target_id"] = "null"
    (tmp_path / "bad.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError):
        db.load(f"file://{tmp_path}/bad.json")


def test_migration_of_both_old_layouts(spark):
    old = spark.createDataFrame([("A", "a", "function", "a.ts", 3, 1, 7)], "id string, symbol string, kind string, file string, line int, col int, created_at long")
    older = spark.createDataFrame([("A", "a", "function", "a.ts")], "id string, name string, type string, file_path string")
    edges = spark.createDataFrame([("1", "A", "B", "CALLS")], "id string, source_id string, target_id string, edge_type string")
    for nodes in (old, older):
        n, e = s.migrate(nodes, edges)
        r = n.first()
        assert (r["symbol"], r["kind"], r["file_path"]) == ("a", "function", "a.ts") and e.count() == 1


def test_checksum_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    assert s.checksum(a) == s.checksum(a.orderBy("a", ascending=False)) != s.checksum(a.limit(1))


def test_passthrough_runs_queries_only(spark):
    assert s.select_only(spark, "SELECT :x + 1 AS y", x=2).first()[0] == 3
    for text in ("DROP TABLE nodes", "INSERT INTO nodes VALUES (1)", ""):
        with pytest.raises(ValueError):
            s.select_only(spark, text)


def test_checksum_counts_repeated_rows(spark):
    of = lambda *r: s.checksum(spark.createDataFrame(list(r), "a int, b string"))
    assert len({of((1, "x"), (1, "x")), of((2, "y"), (2, "y")), of((1, "x")), of((None, "x"), (1, "x"))}) == 4
    assert s.checksum(spark.createDataFrame([(None, "x")], "a string, b string")) != s.checksum(spark.createDataFrame([("x", None)], "a string, b string"))


def test_passthrough_writes_nothing_however_it_begins(spark):
    spark.range(2).createOrReplaceTempView("passthrough_source")
    spark.sql("CREATE TABLE IF NOT EXISTS passthrough_target (id BIGINT) USING parquet")
    try:
        for text in ("FROM passthrough_source INSERT INTO passthrough_target SELECT id", "WITH x AS (SELECT 1 AS id) INSERT INTO passthrough_target SELECT id FROM x", "WITH x AS (SELECT 1 AS id) FROM x INSERT INTO passthrough_target SELECT id", "SELECT TRANSFORM(id) USING 'cat' FROM passthrough_source", "SET a = b", "EXPLAIN SELECT 1", "CREATE VIEW v AS SELECT 1"):
            with pytest.raises(ValueError):
                s.select_only(spark, text)
        assert spark.table("passthrough_target").count() == 0
    finally:
        spark.sql("DROP TABLE passthrough_target")
    assert s.select_only(spark, "FROM passthrough_source SELECT max(id) AS m").first()["m"] == 1
    assert s.select_only(spark, "(SELECT 1 AS a) UNION ALL SELECT a FROM (SELECT 2 AS a) WHERE a IN (SELECT 2)").count() == 2


def test_a_change_rewrites_the_parts_it_touches(spark, tmp_path):
    db = s.Store(spark, f"file://{tmp_path}/db")
    db.init()
    db.put(spark.range(500).selectExpr("concat('N', id) AS id", "concat('s', id) AS symbol", "'function' AS kind", "'a.ts' AS file_path"), spark.range(499).selectExpr("concat('N', id) AS source_id", "concat('N', id + 1) AS target_id", "'CALLS' AS edge_type"))
    before = db._state()
    db.put(spark.createDataFrame([("N7", "renamed", "function", "a.ts")], NODE))
    after = db._state()
    assert len(before["nodes"]) > 30 and after["edges"] == before["edges"]
    assert sum(before["nodes"][k] != v for k, v in after["nodes"].items()) == 1
    assert db.nodes.count() == 500 and db.node("N7").first()["symbol"] == "renamed" and db.node("N8").first()["symbol"] == "s8"
    db.delete_node("N7")
    assert (db.nodes.count(), db.edges.count()) == (499, 497)


def test_of_two_writers_one_fails(spark, tmp_path):
    db = s.Store(spark, f"file://{tmp_path}/db")
    db.init()
    old = db._state()
    db.put(spark.createDataFrame([("A", "a", "function", "a.ts")], NODE))
    with pytest.raises(RuntimeError, match="another writer"):
        db._replace(old, old)
    assert db.nodes.count() == 1
    (tmp_path / "db" / "LOCK").touch()
    with pytest.raises(RuntimeError, match="another writer"):
        db.put(spark.createDataFrame([("B", "b", "function", "a.ts")], NODE))
    (tmp_path / "db" / "LOCK").unlink()
    assert db.nodes.count() == 1
