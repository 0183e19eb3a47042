"""Structured Streaming forms: file changes, debounce, dispatch, retention, decayed scores, cached state, request slots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = T.StructType().add("path", "string").add("action", "string").add("ts", "timestamp")


def file_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of file changes (path, action, ts) from JSON files as they arrive."""
    return spark.readStream.schema(CHANGES).json(folder)


def debounced(changes: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds", by: str | None = None) -> DataFrame:
    """One row for each burst of changes that ended with a quiet time: start, end, paths, n_changes. Changes later than `late` drop out."""
    # a session window needs a key besides, and no literal; without one all changes share the empty text
    out = changes.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), (F.col(by) if by else F.substring("path", 1, 0)).alias(by or "_all")).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("n_changes"))
    return out.select(*([by] if by else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n_changes")


def windowed_counts(events: DataFrame, key: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, key, n over tumbling or sliding windows of event time."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), key, "n")


def retained(signals: DataFrame, now: Callable[[], int] | int, days: int = 90) -> DataFrame:
    """Signals (timestamp in seconds) no older than so many days."""
    at = now() if callable(now) else now
    return signals.filter(F.col("timestamp") >= at - days * 86400)


def dispatch(batch: DataFrame, incremental: Callable[[DataFrame], None], full: Callable[[], None], most: int = 10) -> str:
    """For foreachBatch: nothing for an empty batch, a full rebuild beyond `most` paths, else an incremental step. Says which."""
    paths = batch.select(F.explode("paths").alias("path")).distinct()
    n = paths.limit(most + 1).count()
    if n == 0:
        return "SKIP"
    if n > most:
        full()
        return "FULL_REBUILD"
    incremental(paths)
    return "INCREMENTAL"


def start(out: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Run a stream into a function of (batch, id): everything there is and then stop, or at an interval (the rate limit)."""
    writer = out.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


#: What a cached key's state holds: its keys in the order of their last use, with value, creation and last use in ms.
CACHE_STATE = "keys array<string>, vals array<string>, created array<long>, used array<long>"
CACHE_OUT = "space string, key string, op string, hit boolean, value string"
#: Answers that are given on at once.
OUT_ROWS = 10_000


def cache(requests: DataFrame, capacity: int = 50, ttl_ms: int = 30 * 86_400_000, evict: float = 0.2) -> DataFrame:
    """A stream of cache requests (space, key, op get or set, value, ts_ms) answered from state: space, key, op, hit, value.

    Requests are answered in order of ts_ms over all that a micro-batch has of a space, which one task holds for the sort. Every space
    has its own state of at most `capacity` keys. A request first drops what is older than the TTL; a get marks its key
    as used; a set beyond capacity first drops the least recently used fifth. Setting a known key keeps its creation time.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries: dict[str, list] = {}
        if state.exists:
            k, v, c, u = state.get
            entries = {a: [b, x, y] for a, b, x, y in zip(k, v, c, u, strict=True)}
        # a space's requests come in several batches, whose times overlap
        rows = pd.concat([pdf[["key", "op", "value", "ts_ms"]] for pdf in batches], ignore_index=True).sort_values("ts_ms", kind="stable")
        for at in range(0, len(rows), OUT_ROWS):
            out = []
            for row in rows.iloc[at : at + OUT_ROWS].itertuples():
                out.append((key[0], row.key, row.op, *answer(entries, row.op, row.key, row.value, row.ts_ms, capacity, ttl_ms, evict)))
            yield pd.DataFrame(out, columns=["space", "key", "op", "hit", "value"])
        state.update(([*entries], [x[0] for x in entries.values()], [int(x[1]) for x in entries.values()], [int(x[2]) for x in entries.values()]))

    return requests.groupBy("space").applyInPandasWithState(run, CACHE_OUT, CACHE_STATE, "append", GroupStateTimeout.NoTimeout)


def answer(entries: dict[str, list], op: str, key: str, value: str | None, now: int, capacity: int, ttl_ms: int, evict: float) -> tuple[bool, str | None]:
    """Serve one request from entries (key to [value, created, used]), changing them: (hit, value)."""
    for k in [k for k, x in entries.items() if now - x[1] > ttl_ms]:
        del entries[k]
    if op == "get":
        hit = entries.get(key)
        if hit:
            hit[2] = now
        return hit is not None, hit[0] if hit else None
    known = entries.get(key)
    if known is None and len(entries) >= capacity:
        gone = sorted(entries, key=lambda k: (entries[k][2], entries[k][1], k))[: max(1, -int(-capacity * evict // 1))]
        for k in gone:
            del entries[k]
    entries[key] = [value, known[1] if known else now, now]
    return known is not None, value


def latest_requests(requests: DataFrame) -> DataFrame:
    """A stream of requests (slot, id, action, ts_ms) as a single-slot mailbox per slot: the newest one runs and the others are cancelled."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "id"])
        out = []
        for row in rows.itertuples():
            if held is not None:
                out.append((key[0], held[0], "cancelled"))
            held = (row.id, int(row.ts_ms))
            out.append((key[0], row.id, "started"))
        state.update(held)
        yield pd.DataFrame(out, columns=["slot", "id", "status"])

    return requests.groupBy("slot").applyInPandasWithState(run, "slot string, id string, status string", "id string, ts_ms long", "append", GroupStateTimeout.NoTimeout)


def bounded_requests(requests: DataFrame, waiting: int = 10) -> DataFrame:
    """A stream of requests (slot, id, ts_ms, cost_ms) for slots that serve one at a time: slot, id, status, start_ms.

    A request waits for those before it, and is refused as busy (with no start) when `waiting` others wait already.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ends = [int(t) for t in state.get[0]] if state.exists else []  # of the one that is served, and of those that wait
        rows, out = pd.concat(list(batches)).sort_values(["ts_ms", "id"]), []
        for row in rows.itertuples():
            ends = [t for t in ends if t > row.ts_ms]
            if len(ends) > waiting:
                out.append((key[0], row.id, "busy", None))
                continue
            begin = max([row.ts_ms, *ends])
            ends.append(int(begin + row.cost_ms))
            out.append((key[0], row.id, "accepted", int(begin)))
        state.update((ends,))
        yield pd.DataFrame(out, columns=["slot", "id", "status", "start_ms"]).astype({"start_ms": "Int64"})

    return requests.groupBy("slot").applyInPandasWithState(run, "slot string, id string, status string, start_ms long", "ends array<long>", "append", GroupStateTimeout.NoTimeout)


def conversation_state(turns: DataFrame, window: int = 10) -> DataFrame:
    """A stream of turns (conv_id, turn, text) as the last turns of each conversation: conv_id, n_turns, first_turn, last_turn."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held = sorted({*held, *(int(t) for pdf in batches for t in pdf["turn"])})[-window:]
        state.update((held,))
        yield pd.DataFrame([(key[0], len(held), held[0], held[-1])], columns=["conv_id", "n_turns", "first_turn", "last_turn"])

    return turns.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, n_turns int, first_turn long, last_turn long", "turns array<long>", "update", GroupStateTimeout.NoTimeout)
