"""Registered queries of the streaming forms: each writes a table's rows as files, streams them until there are no more, and reads
what the stream wrote; with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import assist
from weftline.sources import tables
from weftline.storage import shared_root
from weftline.streaming import jobs

DAY_MS = 86_400_000


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows as a stream of JSON files."""
    path = _folder(spark, "stream-input")
    rows.write.json(path)
    return spark.readStream.schema(rows.schema).json(path)


def _drained(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its input is used up."""
    path, marks = _folder(spark, "stream-output"), _folder(spark, "stream-checkpoint")
    sink = lambda batch, n: batch.write.mode("append").parquet(path)
    query = out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """User events as file changes: path, action, ts."""
    return tables.table(spark, d, "events").select(F.concat(F.lit("src/f"), F.col("user_id") % 40, F.lit(".ts")).alias("path"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("ts"))


def _events_ms(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").select(F.concat(F.lit("s"), F.col("user_id") % 7).alias("slot"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("id"), F.col("event_type").alias("action"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts_ms"), F.col("event_id").alias("k"))


def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of changes of a path that ended with a quiet hour, as far as the stream's time has passed them."""
    path = _folder(spark, "stream-input")
    _changes(spark, d).write.json(path)
    out = jobs.debounced(jobs.file_changes(spark, path), "1 hour", "10 minutes", by="path")
    return _drained(spark, out).select("path", F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), "n_changes")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Actions by day of event time, as far as the stream's time has passed it."""
    out = jobs.windowed_counts(_stream(spark, _changes(spark, d)), "action", "1 day", None, "1 hour")
    return _drained(spark, out).select(F.unix_timestamp("start").alias("start_s"), "action", "n")


def stream_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """What a step does with none, a few and many changed paths, and which paths it gets."""
    changes, seen, said = _changes(spark, d), [], []
    for most in (0, 5, 40):
        paths = changes.select("path").distinct().filter(F.regexp_extract("path", r"(\d+)", 1).cast("int") < most)
        batch = paths.agg(F.collect_list("path").alias("paths"))
        said.append((most, jobs.dispatch(batch, lambda p: seen.extend(r[0] for r in p.collect()), lambda: None), len(seen)))
    return spark.createDataFrame(said, "most int, step string, incremental long")


def stream_retention(spark: SparkSession, d: str) -> DataFrame:
    """Signals no older than 20 days before the newest."""
    s = tables.signals(spark, d)
    now = s.agg(F.max("timestamp")).first()[0]
    kept = _drained(spark, jobs.retained(_stream(spark, s), lambda: now, 20))
    return kept.groupBy("symbol_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"))


def stream_cache(spark: SparkSession, d: str) -> DataFrame:
    """Gets and sets of a cache in state, a space for each seventh of the users: hits and misses by operation."""
    e = _events_ms(spark, d)
    op = F.when(F.col("k") % 3 == 0, "set").otherwise("get")
    requests = e.select(F.col("slot").alias("space"), F.concat(F.lit("k"), F.col("k") % 20).alias("key"), op.alias("op"), F.when(op == "set", F.col("id")).alias("value"), "ts_ms", "id")
    # a request's time is unique, so that the order is
    requests = requests.withColumn("ts_ms", F.col("id").cast("long")).drop("id")
    out = _drained(spark, jobs.cache(_stream(spark, requests), capacity=50, ttl_ms=365 * DAY_MS))
    return out.groupBy("space", "op", "hit").agg(F.count("*").alias("n"), F.max("value").alias("last"))


def stream_mailbox(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a single slot each, the newest of which cancels the one before."""
    out = _drained(spark, jobs.latest_requests(_stream(spark, _events_ms(spark, d).drop("k"))))
    return out.groupBy("slot", "status").agg(F.count("*").alias("n"), F.max("id").alias("last"))


def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """Requests of slots with a bounded queue: those that start, and those that find it full."""
    requests = _events_ms(spark, d).select("slot", "id", "ts_ms", (F.col("k") % 50 * 100_000).alias("cost_ms"))
    return _drained(spark, jobs.bounded_requests(_stream(spark, requests), 3))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The last turns of each conversation in state."""
    turns = tables.table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    return _drained(spark, jobs.conversation_state(_stream(spark, turns), 3), "update")


def stream_supervision(spark: SparkSession, d: str) -> DataFrame:
    """A stream that fails twice and is started again, at an interval, until it has used up its input; and one that never starts."""
    rows, path, marks, tries = _stream(spark, _changes(spark, d)), _folder(spark, "stream-output"), _folder(spark, "stream-checkpoint"), []

    def start():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("down")
        return jobs.start(rows, lambda batch, n: batch.write.mode("append").parquet(path), marks)

    def never():
        raise ConnectionError("down")

    said = assist.supervise(start, most=3)
    n = spark.read.parquet(path).count()
    return spark.createDataFrame([("mended", said, len(tries), n), ("down", assist.supervise(never, most=2), 3, 0)], "stream string, state string, tries int, n long")


QUERIES = {f.__name__: f for f in (stream_debounce, stream_windows, stream_dispatch, stream_retention, stream_cache, stream_mailbox, stream_queue, stream_sessions, stream_supervision)}

_MS = "ev AS (SELECT 's' || (user_id % 7) AS slot, lpad(CAST(event_id AS VARCHAR), 9, '0') AS id, epoch_us(ts) // 1000 AS ts_ms, event_id AS k FROM events)"
SQL = {
    "stream_debounce": """WITH c AS (SELECT 'src/f' || (user_id % 40) || '.ts' AS path, ts FROM events), m AS (SELECT max(ts) AS m FROM events),
b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM c), s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM b),
w AS (SELECT path, min(ts) AS a, max(ts) + INTERVAL 1 HOUR AS z, count(*) AS n FROM s GROUP BY path, g)
SELECT path, CAST(floor(epoch(a)) AS BIGINT) AS start_s, CAST(floor(epoch(z)) AS BIGINT) AS end_s, n AS n_changes FROM w, m WHERE z <= m - INTERVAL 10 MINUTE""",
    "stream_windows": "WITH w AS (SELECT date_trunc('day', ts) AS a, event_type AS action, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(epoch(a) AS BIGINT) AS start_s, action, n FROM w WHERE a + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "stream_dispatch": "WITH p AS (SELECT DISTINCT user_id % 40 AS u FROM events), c AS (SELECT most, (SELECT count(*) FROM p WHERE u < most) AS n FROM (VALUES (0), (5), (40)) v(most)), s AS (SELECT CAST(most AS INT) AS most, CASE WHEN n = 0 THEN 'SKIP' WHEN n > 10 THEN 'FULL_REBUILD' ELSE 'INCREMENTAL' END AS step, n FROM c) SELECT most, step, CAST(sum(CASE WHEN step = 'INCREMENTAL' THEN n ELSE 0 END) OVER (ORDER BY most) AS BIGINT) AS incremental FROM s",
    "stream_retention": f"WITH s AS ({tables.SIGNALS_SQL}) SELECT symbol_id, count(*) AS n, min(timestamp) AS first FROM s WHERE timestamp >= (SELECT max(timestamp) FROM s) - 20 * 86400 GROUP BY 1",
    "stream_cache": f"""WITH {_MS}, q AS (SELECT slot AS space, 'k' || (k % 20) AS key, CASE WHEN k % 3 = 0 THEN 'set' ELSE 'get' END AS op, id, k FROM ev),
h AS (SELECT space, op, id, max(CASE WHEN op = 'set' THEN id END) OVER (PARTITION BY space, key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM q)
SELECT space, op, prior IS NOT NULL AS hit, count(*) AS n, max(CASE WHEN op = 'set' THEN id ELSE prior END) AS last FROM h GROUP BY ALL""",
    "stream_mailbox": f"WITH {_MS}, n AS (SELECT slot, id, row_number() OVER (PARTITION BY slot ORDER BY ts_ms DESC, id DESC) AS r FROM ev) SELECT slot, 'started' AS status, count(*) AS n, max(id) AS last FROM n GROUP BY slot UNION ALL SELECT slot, 'cancelled', count(*), max(id) FROM n WHERE r > 1 GROUP BY slot",
    "stream_queue": f"""WITH RECURSIVE {_MS}, q AS MATERIALIZED (SELECT slot, id, ts_ms, k % 50 * 100000 AS cost, row_number() OVER (PARTITION BY slot ORDER BY ts_ms, id) AS n FROM ev),
w(slot, n, ends, id, status, start_ms) AS (SELECT DISTINCT slot, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), '', '', CAST(NULL AS BIGINT) FROM q
UNION ALL SELECT slot, n, CASE WHEN len(live) > 3 THEN live ELSE list_append(live, begin + cost) END, id, CASE WHEN len(live) > 3 THEN 'busy' ELSE 'accepted' END, CASE WHEN len(live) <= 3 THEN begin END
FROM (SELECT *, greatest(ts_ms, coalesce(list_max(live), ts_ms)) AS begin FROM (SELECT q.slot, q.n, q.id, q.ts_ms, q.cost, list_filter(w.ends, lambda x: x > q.ts_ms) AS live FROM w JOIN q ON q.slot = w.slot AND q.n = w.n + 1)))
SELECT slot, id, status, start_ms FROM w WHERE n > 0""",
    "stream_sessions": "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations QUALIFY dense_rank() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) SELECT conv_id, CAST(count(*) AS INT) AS n_turns, CAST(min(turn) AS BIGINT) AS first_turn, CAST(max(turn) AS BIGINT) AS last_turn FROM t GROUP BY 1",
    "stream_supervision": "SELECT 'mended' AS stream, 'STOPPED' AS state, CAST(3 AS INT) AS tries, count(*) AS n FROM events UNION ALL SELECT 'down', 'FAILED', CAST(3 AS INT), 0",
}
