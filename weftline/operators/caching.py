"""Cache tables: expiry, eviction order, statistics, and results kept by the content they came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def alive(entries: DataFrame, now: int, ttl: int = 30 * 86400) -> DataFrame:
    """Entries (key, created, used, size) that aren't older than the TTL, in seconds."""
    return entries.filter(F.col("created") >= now - ttl)


def evicted(entries: DataFrame, capacity: int, share: float = 0.2) -> DataFrame:
    """What goes when a cache is at capacity: the least recently used share of it, rounded up; nothing below capacity.

    The count bounds how many are ranked, so that a limit does it.
    """
    if entries.count() < capacity:
        return entries.limit(0)
    return entries.orderBy("used", "created", "key").limit(-int(-capacity * share // 1))


def evicted_by_size(entries: DataFrame, most_bytes: int, share: float = 0.8, groups: str = "space") -> DataFrame:
    """Per group: the least recently used entries beyond `share` of the allowed bytes, if the group has more than allowed."""
    w = Window.partitionBy(groups)
    newest = w.orderBy(F.desc("used"), F.desc("created"), "key").rowsBetween(Window.unboundedPreceding, 0)
    sized = entries.withColumn("_all", F.sum("size").over(w)).withColumn("_upto", F.sum("size").over(newest))
    return sized.filter((F.col("_all") > most_bytes) & (F.col("_upto") > most_bytes * share)).drop("_all", "_upto")


def cache_stats(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: entries, bytes, hits, misses, hit_rate (2 decimals), first_used, last_used. requests: hit (boolean)."""
    e = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min("used").alias("first_used"), F.max("used").alias("last_used"))
    r = requests.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return e.join(r).withColumn("hit_rate", F.round(F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0), 2))


def cache_key(*parts):
    """The md5 of a path, its content's hash and a query."""
    return F.md5(F.concat_ws(":", *parts))


class Memo:
    """Results of queries by the text of the query and the content that it read, as tables below a folder.

    The folder is stamped with a version; one with another stamp is emptied when it is opened.
    """

    def __init__(self, spark: SparkSession, path: str, version: str = "1"):
        self.spark, self.path, self.hits, self.misses = spark, path.rstrip("/"), 0, 0
        stamp = self._at("VERSION")
        if self._fs.exists(stamp) and spark.read.text(f"{self.path}/VERSION").first()[0] != version:
            self.clear()
        out = self._fs.create(stamp, True)
        out.write(bytearray(version.encode()))
        out.close()

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> DataFrame:
        """key, created (seconds), size of every kept result."""
        found = []
        for x in self._fs.listStatus(self._at("")):  # a row for each result
            if x.isDirectory():
                size = self._fs.getContentSummary(x.getPath()).getLength()
                found.append((x.getPath().getName(), x.getModificationTime() // 1000, size))
        return self.spark.createDataFrame(found, "key string, created long, size long")

    def clear(self) -> int:
        """Drop all results; how many there were."""
        return self.prune(None)

    def prune(self, now: int | None, ttl: int = 86400) -> int:
        """Drop the results older than ttl seconds (all if now is None); how many."""
        e = self.entries()
        old = [r["key"] for r in (e if now is None else e.join(alive(e, now, ttl).select("key"), "key", "left_anti")).collect()]
        for key in old:
            self._fs.delete(self._at(key), True)
        return len(old)

    def get(self, name: str, inputs: list[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
        """The kept result for inputs of the same rows, else what make() gives, kept."""
        import hashlib

        from weftline.operators.store import checksum

        key = hashlib.md5(repr((name, [(sorted(d.dtypes), checksum(d)) for d in inputs])).encode()).hexdigest()
        at = f"{self.path}/{key}"
        if self._fs.exists(self._at(f"{key}/_SUCCESS")):
            self.hits += 1
        else:
            self.misses += 1
            make().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def warm_up(self, queries: dict[str, tuple[list[DataFrame], Callable[[], DataFrame]]], seconds: float = 30.0) -> list[str]:
        """Run queries until the time is up; the names of those that ran."""
        import time

        end, done = time.time() + seconds, []
        for name, (inputs, make) in queries.items():
            if time.time() >= end:
                break
            self.get(name, inputs, make)
            done.append(name)
        return done
