"""What the operators share when one key may hold a large part of all rows."""

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups up to this many rows are handled inside one row or one task.
GROUP_ROWS = 2048
#: A side is hinted for broadcast only when its counted size stays below this.
BROADCAST_BYTES = 64 << 20
#: Rows a task sorts, about 200 bytes each, where a session has too few shuffle partitions for its input.
TASK_ROWS = 1 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder all executors share; a local session without one,
    as in tests, gets a temporary folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="plateflow-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet files in a new shared folder, for what is read in several passes but costs shuffles to make."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys: Sequence[str], rows: int, limit: int = TASK_ROWS) -> DataFrame:
    """``df`` of ``rows`` rows dealt by ``keys`` so that a task sorts about ``limit`` of them. As it is, where the session's
    shuffle partitions are as many as that takes."""
    parts = -(-rows // limit)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shipped(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """A side of distinct keys for a join with a larger one: sent to all tasks while its counted size is below
    ``BROADCAST_BYTES``, else hashed by partition, so that the larger side is never sorted."""
    return F.broadcast(df) if df.count() * row_bytes < BROADCAST_BYTES else df.hint("shuffle_hash")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so later rounds survive a lost executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. The rank filter becomes a per-task group limit, so at most ``n``
    rows per key and task are shuffled however large the group is."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def heavy_keys(df: DataFrame, keys: Sequence[str], limit: int = GROUP_ROWS) -> DataFrame:
    """Keys with more than ``limit`` rows. Only partial counts are shuffled."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)


def split_heavy(df: DataFrame, keys: Sequence[str], limit: int = GROUP_ROWS):
    """``(light, heavy, heavy_keys)``; the last two are None when no group exceeds ``limit``.

    Costs one pass that reads the key columns only. Without heavy groups, which is the normal
    case, the plan that follows is left exactly as it was.
    """
    hot = heavy_keys(df, keys, limit)
    if hot.isEmpty():
        return df, None, None
    hot = cut_lineage(hot)
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi"), hot
