"""Tables cut to the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a lookup side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset, on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _OWN[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a short lineage that outlives executors."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}.parquet"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of what cut() gave, when nothing is read from it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Operators that only pass rows on, by their class names (fixed values of the planner).
_NARROW = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LocalLimit", "SubqueryAlias"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df for a loop that reads it many times: as it is if it only scans files, filters and projects, else cut once."""
    left, plan = [], df._jdf.queryExecution().optimizedPlan()
    left.append(plan)
    while left:
        node = left.pop()
        if node.getClass().getSimpleName() not in _NARROW:
            return cut(df, name)
        below = node.children()
        left += [below.apply(i) for i in range(below.size())]
    return df


def rows_upto(df: DataFrame, limit: int = BROADCAST_ROWS) -> int:
    """The number of df's rows, or limit + 1 if there are more."""
    return len(df.limit(limit + 1).select(F.lit(1)).collect())


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else df as it is (a shuffled join).

    The rows are counted first, so that df is worth cutting if it takes long to make.
    """
    return F.broadcast(df) if rows_upto(df, limit) <= limit else df


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).select(F.lit(1)).collect()
