"""Streams over the event table, run to completion. Results go through files in the shared folder,
never through the driver; the check SQL is the batch answer on the same events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow import dims, providers
from plateflow.fixtures import VIEWS
from plateflow.operators.skew import shared_folder, top_per_key
from plateflow.plans.registry import query
from plateflow.streaming import jobs as op


def _event_stream(fx) -> DataFrame:
    """The job view over the event table read as a stream."""
    raw = fx.spark.readStream.schema(fx.events.schema).parquet(f"{fx.sf_dir}/events.parquet*")
    raw.createOrReplaceTempView("event_stream")
    return fx.spark.sql(VIEWS["v_job"].replace("FROM events", "FROM event_stream"))


def _run(stream: DataFrame, fx, name: str, mode: str) -> DataFrame:
    """Run ``stream`` until its source is drained and return what the last state of the sink is:
    everything appended, or the newest row per image."""
    folder = shared_folder(fx.spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    running = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    out = fx.spark.read.parquet(f"{folder}/out")
    if mode == "update":
        # Each batch has the images it changed; the newest epoch of an image is its state.
        out = top_per_key(out, ["image_id"], [F.col("epoch").desc()])
    return out.drop("epoch")


@query(
    "stream_current_job",
    """WITH l AS (SELECT * FROM v_job QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC, job_id DESC) = 1),
    d AS (SELECT * FROM v_job WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC, job_id DESC) = 1)
    SELECT l.image_id, l.status, l.job_id AS latest_job_id, l.error_message, d.job_id AS result_job_id, d.provider, d.model AS recognition_model
    FROM l LEFT JOIN d ON d.image_id = l.image_id""",
)
def _(fx):
    return _run(op.stream_current_job(_event_stream(fx)), fx, "current-job", "update")


@query("stream_new_images")
def _(fx):
    """The files of the test tables, ingested by two runs of the stream; the second finds nothing new."""
    folder = shared_folder(fx.spark, "new-images")
    for _ in range(2):
        op.stream_new_images(fx.spark, fx.sf_dir, f"{folder}/out", f"{folder}/checkpoint", (".PARQUET",)).awaitTermination()
    return fx.spark.read.parquet(f"{folder}/out").select("path", "length")


# A result arrives up to ten minutes after its job was created and quotes a lease token that is
# sometimes an old one; leases run for six minutes.
RESULTS = """SELECT job_id, image_id, CASE WHEN job_id % 8 = 0 THEN lease_token + 1 ELSE lease_token END AS lease_token,
    CASE WHEN job_id % 9 = 0 THEN 'failed' ELSE 'completed' END AS status, created_at + {delay} AS finished_at, job_id * 10 AS payload FROM {table}"""
SPARK_DELAY = "make_dt_interval(0, 0, 0, (job_id * 37) % 600)"
DUCK_DELAY = "to_seconds((job_id * 37) % 600)"


@query(
    "stream_publish",
    f"""SELECT r.image_id, r.job_id, r.payload FROM ({RESULTS.format(delay=DUCK_DELAY, table='v_job')}) r
    JOIN v_job j ON j.job_id = r.job_id AND j.status = 'processing' AND j.lease_token = r.lease_token AND j.lease_expires_at > r.finished_at
    WHERE r.status = 'completed' QUALIFY row_number() OVER (PARTITION BY r.image_id ORDER BY r.finished_at DESC, r.job_id DESC) = 1""",
)
def _(fx):
    folder = shared_folder(fx.spark, "publish")
    fx.v_job.select("job_id", "status", "lease_token", "lease_expires_at").write.parquet(f"{folder}/leases")
    _event_stream(fx).createOrReplaceTempView("job_stream")
    results = fx.spark.sql(RESULTS.format(delay=SPARK_DELAY, table="job_stream"))
    # The same events once more: every result arrives again, later and with another payload.
    again = results.withColumns({"finished_at": F.col("finished_at") + F.expr("INTERVAL 1 SECOND"), "payload": F.col("payload") + 1})
    op.stream_publish(results.unionByName(again), f"{folder}/leases", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return op.current_results(fx.spark, f"{folder}/out").select("image_id", "job_id", "payload")


DEADLINES = f"""WITH f AS (
        SELECT job_id, attempts, created_at AS started_at, CASE WHEN status IN ('completed', 'failed') THEN created_at + {DUCK_DELAY} END AS ended_at FROM v_job
    ), u AS (SELECT least(max(started_at) FILTER (WHERE attempts < 3), max(ended_at)) AS until FROM f)
    SELECT job_id, 'failed' AS status, CASE WHEN attempts >= 3 THEN '{dims.RECOVERY_LIMIT}' ELSE '{dims.DEADLINE_EXCEEDED}' END AS error_message
    FROM f, u WHERE attempts >= 3 OR (started_at + INTERVAL 300 SECOND <= until AND (ended_at IS NULL OR ended_at > started_at + INTERVAL 300 SECOND))"""


def _starts_and_ends(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    started = jobs.select("job_id", "attempts", F.col("created_at").cast("timestamp").alias("started_at"))
    ended = (F.col("created_at") + F.expr(SPARK_DELAY)).cast("timestamp").alias("ended_at")
    return started, jobs.filter(F.col("status").isin("completed", "failed")).select("job_id", ended)


@query("batch_deadlines", DEADLINES)
def _(fx):
    started, finished = _starts_and_ends(fx.v_job)
    seen = started.filter("attempts < 3").agg(F.max("started_at")).scalar()
    ended = finished.agg(F.max("ended_at")).scalar()
    return op.job_deadlines(started, finished, until=F.least(seen, ended)).select("job_id", "status", "error_message")


@query("stream_deadlines", DEADLINES)
def _(fx):
    stream = op.job_deadlines(*_starts_and_ends(_event_stream(fx)))
    return _run(stream, fx, "deadlines", "append").select("job_id", "status", "error_message")


@query(
    "recognise",
    """SELECT concat('doc', cast(doc_id AS string)) AS path, CASE WHEN contains(text, 'zz') THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN contains(text, 'zz') THEN 'Processing failed (ValueError)' END AS error_message,
        CASE WHEN NOT contains(text, 'zz') THEN '[{"size": ' || strlen(text) || '}]' END AS detections, false AS is_mock FROM documents""",
)
def _(fx):
    def build():
        def measure(content: bytes, path: str) -> list[dict]:
            if b"zz" in content:
                raise ValueError(path)
            return [{"size": len(content)}]

        return measure

    images = fx.documents.select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    found = providers.recognise(images, "text-size", build)
    return found.select("path", "status", "error_message", "detections", "is_mock")


@query("recognise_mock", "SELECT count(*) AS images, count(*) AS mock, 0 AS failed FROM documents")
def _(fx):
    images = fx.documents.select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    found = providers.recognise(images, "mock")
    return found.agg(
        F.count(F.lit(1)).alias("images"), F.count_if("is_mock").alias("mock"), F.count_if(F.col("status") == "failed").cast("int").alias("failed")
    )
