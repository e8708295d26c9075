"""Structured Streaming over job events. Each stream has a batch twin with the same answer."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plateflow import dims
from plateflow.operators.results import image_jobs
from plateflow.operators.skew import cut_lineage, top_per_key
from plateflow.sources.ingest import has_suffix

EVENT_SCHEMA = (
    "job_id bigint, image_id bigint, status string, provider string, model string, error_message string, "
    "attempts bigint, lease_token bigint, created_at timestamp, lease_expires_at timestamp"
)


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_new_images(spark: SparkSession, folder: str, target: str, checkpoint: str,
                      suffixes: Sequence[str] = dims.IMAGE_SUFFIXES) -> StreamingQuery:
    """Ingest the listing of new image files once; a restarted run goes on where it stopped.

    Files seen before are remembered in the checkpoint, so running twice adds nothing.
    """
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
        .load(folder).filter(has_suffix("path", suffixes)).select("path", "length", F.col("modificationTime").alias("modified_at"))
    )
    return (
        files.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_current_job(events: DataFrame) -> DataFrame:
    """Latest job and latest completed job per image, kept up to date (output mode update or
    complete). It is the batch aggregation itself: two maxima per image as state, combined in each
    task before the shuffle, so a very busy image costs no more than a quiet one."""
    return image_jobs(events)


# ---- publication ---------------------------------------------------------------------------


def fenced(results: DataFrame, leases: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Results that may be published: successful ones that quote the current token of a lease that had not
    expired when they finished. A lease is good for one publication, so of several results of a job the
    first one finished counts, and none once the job is in ``done``.

    ``results`` has job_id, image_id, lease_token, status, finished_at and payload columns;
    ``leases`` has job_id, status, lease_token and lease_expires_at.
    """
    current = leases.filter(F.col("status") == "processing").select(
        "job_id", F.col("lease_token").alias("_token"), F.col("lease_expires_at").alias("_until")
    )
    valid = (
        results.filter(F.col("status") == "completed").join(current, "job_id")
        .filter((F.col("lease_token") == F.col("_token")) & (F.col("_until") > F.col("finished_at")))
        .drop("_token", "_until")
    )
    if done is not None:
        valid = valid.join(done.select("job_id").distinct(), "job_id", "left_anti")
    rest = [F.col(name).asc() for name in sorted(valid.columns) if name not in ("job_id", "finished_at")]
    return top_per_key(valid, ["job_id"], [F.col("finished_at").asc(), *rest])


def valid_publications(results: DataFrame, leases: DataFrame) -> DataFrame:
    """The result each image may be replaced with: of those :func:`fenced` lets pass, the one finished last."""
    return published(fenced(results, leases))


#: Buckets of images and of used leases, and epochs after which used leases are written together.
BUCKETS, COMPACT_EVERY = 256, 32


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _manifests(spark: SparkSession, target: str, before: int) -> list[dict[int, int]]:
    """Of the epochs before one, newest first: which version of each bucket of images is in force. At most
    ``BUCKETS`` rows of the last few epochs; older manifests are removed."""
    if not _exists(spark, f"{target}/manifest"):
        return []
    held: dict[int, dict[int, int]] = {}
    for row in spark.read.schema("bucket int, version int, epoch int").parquet(f"{target}/manifest").filter(F.col("epoch") < before).collect():
        held.setdefault(row["epoch"], {})[row["bucket"]] = row["version"]
    return [{b: v for b, v in held[e].items() if b >= 0} for e in sorted(held, reverse=True)]


def _versions(spark: SparkSession, target: str, wanted: dict[int, int]) -> DataFrame:
    """Results of some buckets of images, each in one version. Only their folders are listed and read."""
    schema = spark.read.parquet(f"{target}/layout").schema
    if not wanted:
        return spark.createDataFrame([], schema)
    paths = [f"{target}/current/epoch={v}/bucket={b}" for b, v in sorted(wanted.items())]
    return spark.read.schema(schema).parquet(*paths)


def publish_batch(batch: DataFrame, epoch: int, leases: DataFrame, target: str, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY) -> None:
    """Publish one batch. What is written follows the batch: the leases it uses up, the buckets of images
    it replaces results in, and a manifest of at most ``buckets`` rows that says which version of each bucket is in force.

    Results in force are read from the touched buckets alone, used leases from the touched buckets of jobs. The epoch
    is in force once its manifest is written, so a batch that breaks off or is repeated starts from the epoch
    before, overwrites its own folders and changes nothing else. Versions that neither this epoch nor the one
    before refers to are removed. Every ``compact_every`` epochs the used leases are written together.
    """
    spark = batch.sparkSession
    earlier = _manifests(spark, target, epoch)
    now = earlier[0] if earlier else {}
    batch.limit(0).write.mode("overwrite").parquet(f"{target}/layout")
    done = None
    if _exists(spark, f"{target}/used"):
        jobs = [row["b"] for row in batch.select(_bucket("job_id", buckets).alias("b")).distinct().collect()]
        used = spark.read.schema("job_id bigint, epoch int, bucket int").parquet(f"{target}/used")
        done = used.filter((F.col("epoch") < epoch) & F.col("bucket").isin(jobs))
    fresh = cut_lineage(fenced(batch, leases, done).select(*batch.columns))
    ids = fresh.select("job_id", _bucket("job_id", buckets).alias("bucket"))
    ids.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/used/epoch={epoch}")
    touched = [row["b"] for row in fresh.select(_bucket("image_id", buckets).alias("b")).distinct().collect()]
    old = _versions(spark, target, {b: now[b] for b in touched if b in now})
    merged = published(old.unionByName(fresh)).withColumn("bucket", _bucket("image_id", buckets))
    merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/current/epoch={epoch}")
    rows = [(-1, epoch), *({**now, **dict.fromkeys(touched, epoch)}).items()]
    spark.createDataFrame(rows, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/epoch={epoch}")
    # Readers of the epoch before may still be at work; what only older ones refer to can go.
    for stale in earlier[1:]:
        for b, v in stale.items():
            if now.get(b) != v:
                _remove(spark, f"{target}/current/epoch={v}/bucket={b}")
    if epoch and epoch % compact_every == 0:
        _compact(spark, target, epoch, compact_every)
    for row in spark.read.schema("epoch int").parquet(f"{target}/manifest").select("epoch").distinct().filter(F.col("epoch") < epoch - 2).collect():
        _remove(spark, f"{target}/manifest/epoch={row['epoch']}")


def _compact(spark: SparkSession, target: str, epoch: int, compact_every: int) -> None:
    """Leases used before this epoch in the folder of the epoch before, the rest removed. Doubles that an
    interrupted run leaves behind do no harm: a used lease is used however often it is listed."""
    used = spark.read.schema("job_id bigint, epoch int, bucket int").parquet(f"{target}/used").filter(F.col("epoch") < epoch)
    whole = cut_lineage(used.select("job_id", "bucket", "epoch").dropDuplicates(["job_id", "bucket"]))
    epochs = [row["epoch"] for row in used.select("epoch").distinct().collect()]
    whole.select("job_id", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/used/epoch={epoch - 1}")
    for old in epochs:
        if old < epoch - 1:
            _remove(spark, f"{target}/used/epoch={old}")


def stream_publish(results: DataFrame, leases_path: str, target: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Publish results batch by batch (see :func:`publish_batch`); a repeated batch, or a result that arrives again in a
    later one, changes nothing. :func:`current_results` reads the answer."""

    def publish(batch: DataFrame, epoch: int) -> None:
        publish_batch(batch, epoch, batch.sparkSession.read.parquet(leases_path), target, buckets)

    return (
        results.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def published(publications: DataFrame) -> DataFrame:
    """The result in force per image: the newest publication."""
    return top_per_key(publications, ["image_id"], [F.col("finished_at").desc(), F.col("job_id").desc()])


def current_results(spark: SparkSession, target: str) -> DataFrame:
    """What :func:`stream_publish` has in force, one row per image: the versions that the newest manifest names."""
    held = _manifests(spark, target, (1 << 31) - 1)
    return _versions(spark, target, held[0] if held else {})


# ---- deadlines -----------------------------------------------------------------------------

def job_deadlines(started: DataFrame, finished: DataFrame, seconds: int = 300, max_attempts: int = 3,
                  lateness: str = "0 seconds", until: Column | None = None) -> DataFrame:
    """Jobs that fail by themselves: started with no attempts left, or started and not finished
    within ``seconds``. ``started`` has job_id, started_at and attempts; ``finished`` has job_id and
    ended_at.

    The same code serves tables and streams. As a stream it is an outer join with a time range: a
    start stays in state until the watermark passes its deadline and then comes out unmatched.
    ``until`` stands in for the watermark when the inputs are tables.
    """
    limit = F.expr(f"INTERVAL {seconds} SECOND")
    exhausted = F.col("attempts") >= max_attempts
    opened = started.filter(~exhausted).select("job_id", "started_at").withWatermark("started_at", lateness)
    closed = finished.select(F.col("job_id").alias("_ended_job"), "ended_at").withWatermark("ended_at", lateness)
    in_time = (
        (F.col("job_id") == F.col("_ended_job"))
        & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + limit)
    )
    late = opened.join(closed, in_time, "left_outer").filter(F.col("_ended_job").isNull())
    if until is not None:
        late = late.filter(F.col("started_at") + limit <= until)

    def failure(df: DataFrame, message: str, moment: Column) -> DataFrame:
        return df.select(
            "job_id", F.lit("failed").alias("status"), F.lit(message).alias("error_message"), moment.alias("failed_at")
        )

    return failure(late, dims.DEADLINE_EXCEEDED, F.col("started_at") + limit).unionByName(
        failure(started.filter(exhausted), dims.RECOVERY_LIMIT, F.col("started_at"))
    )
