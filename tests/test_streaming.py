import json
from datetime import datetime

import pytest

from weftline.streaming import jobs


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_debounce_and_dispatch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    at = lambda s: f"2026-01-01T00:00:{s:02d}Z"
    write(inbox, "1.json", [{"path": "a", "action": "modify", "ts": at(0)}, {"path": "b", "action": "modify", "ts": at(1)}, {"path": "a", "action": "modify", "ts": at(10)}])
    seen = []
    q = jobs.start(jobs.debounced(jobs.file_changes(spark, f"file://{inbox}"), late="0 seconds"), lambda df, i: seen.extend(df.collect()), f"file://{tmp_path}/cp")
    q.awaitTermination(60)
    write(inbox, "2.json", [{"path": "z", "action": "modify", "ts": at(40)}])
    q = jobs.start(jobs.debounced(jobs.file_changes(spark, f"file://{inbox}"), late="0 seconds"), lambda df, i: seen.extend(df.collect()), f"file://{tmp_path}/cp")
    q.awaitTermination(60)
    assert ["a", "b"] in [r["paths"] for r in seen]
    calls = []
    batch = lambda n: spark.createDataFrame([([f"p{k}" for k in range(n)],)], "paths array<string>")
    run = lambda n: jobs.dispatch(batch(n), lambda p: calls.append(p.count()), lambda: calls.append("full"))
    assert [run(0), run(3), run(20)] == ["SKIP", "INCREMENTAL", "FULL_REBUILD"] and calls == [3, "full"]


def test_cache_answers():
    e = {}
    ask = lambda op, k, v, now: jobs.answer(e, op, k, v, now, 5, 1000, 0.2)
    for i in range(5):
        assert ask("set", f"k{i}", str(i), i) == (False, str(i))
    assert ask("get", "k0", None, 10) == (True, "0")
    ask("set", "k5", "5", 11)  # k1 was used least recently
    assert ask("get", "k1", None, 12) == (False, None) and len(e) == 5
    ask("set", "k0", "new", 13)
    assert e["k0"][1] == 0  # creation stays
    assert ask("get", "k0", None, 1001) == (False, None)  # older than the TTL


@pytest.mark.parametrize("job", ["cache", "latest", "turns"])
def test_stateful_streams(spark, tmp_path, job):
    pytest.importorskip("pandas")
    inbox = tmp_path / "in"
    inbox.mkdir()
    if job == "cache":
        write(inbox, "1.json", [{"space": "s", "key": "k", "op": "get", "ts_ms": 1}, {"space": "s", "key": "k", "op": "set", "value": "v", "ts_ms": 2}, {"space": "s", "key": "k", "op": "get", "ts_ms": 3}])
        stream = jobs.cache(spark.readStream.schema("space string, key string, op string, value string, ts_ms long").json(f"file://{inbox}"))
        mode, want = "append", [("get", False), ("set", False), ("get", True)]
        pick = lambda r: (r["op"], r["hit"])
    elif job == "latest":
        write(inbox, "1.json", [{"slot": "a", "id": "1", "action": "x", "ts_ms": 1}, {"slot": "a", "id": "2", "action": "x", "ts_ms": 2}])
        stream = jobs.latest_requests(spark.readStream.schema("slot string, id string, action string, ts_ms long").json(f"file://{inbox}"))
        mode, want = "append", [("1", "started"), ("1", "cancelled"), ("2", "started")]
        pick = lambda r: (r["id"], r["status"])
    else:
        write(inbox, "1.json", [{"conv_id": 1, "turn": k, "text": "x"} for k in range(12)])
        stream = jobs.conversation_state(spark.readStream.schema("conv_id long, turn int, text string").json(f"file://{inbox}"))
        mode, want = "update", [(10, 2, 11)]
        pick = lambda r: (r["n_turns"], r["first_turn"], r["last_turn"])
    seen = []
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [pick(r) for r in seen] == want


def test_windows_equal_batch(spark, tmp_path):
    rows = [{"path": "a", "action": "m", "ts": f"2026-01-01T0{h}:10:00Z"} for h in (0, 0, 1)]
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "1.json", rows)
    stream = jobs.file_changes(spark, f"file://{tmp_path}/in")
    seen = []
    q = jobs.windowed_counts(stream, "path").writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["start"], r["n"]) for r in seen) == [(datetime(2026, 1, 1, 0), 2), (datetime(2026, 1, 1, 1), 1)]
    signals = spark.createDataFrame([(100 * 86400,), (1,)], "timestamp long")
    assert jobs.retained(signals, lambda: 100 * 86400).count() == 1


def test_a_full_queue_is_busy_across_batches(spark, tmp_path):
    """One is served, one waits, the next is refused; state goes over from one run of the stream to the next."""
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()
    for k, rows in enumerate([[("1", 0), ("2", 10), ("3", 20)], [("4", 100), ("5", 250)]]):
        write(inbox, f"{k}.json", [{"slot": "a", "id": i, "ts_ms": t, "cost_ms": 100} for i, t in rows])
        stream = spark.readStream.schema("slot string, id string, ts_ms long, cost_ms long").json(f"file://{inbox}")
        q = jobs.bounded_requests(stream, waiting=1).writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r["id"], r["status"], r["start_ms"]) for r in seen] == [("1", "accepted", 0), ("2", "accepted", 100), ("3", "busy", None), ("4", "accepted", 200), ("5", "accepted", 300)]


def test_cache_requests_are_in_order_over_batches(spark, tmp_path):
    """A space's requests come in several Arrow batches, the earliest of them last."""
    inbox, seen, most = tmp_path / "in", [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    inbox.mkdir()
    rows = [{"space": "s", "key": "k", "op": "set" if i % 3 == 0 else "get", "value": str(i) if i % 3 == 0 else None, "ts_ms": i} for i in range(30)]
    write(inbox, "1.json", rows[::-1])
    was = spark.conf.get(most)
    spark.conf.set(most, "4")
    try:
        stream = spark.readStream.schema("space string, key string, op string, value string, ts_ms long").json(f"file://{inbox}")
        q = jobs.cache(stream).writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set(most, was)
    assert [(r["op"], r["hit"], r["value"]) for r in seen] == [(x["op"], i > 0, str(i - i % 3)) for i, x in enumerate(rows)]
