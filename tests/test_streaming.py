"""Streams: run twice, stale workers, and plans that must stay the way they are."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plateflow import plans
from plateflow.operators import skew
from plateflow.streaming import jobs
from tests.conftest import SF

NOON = datetime(2024, 1, 1, 12)
RESULT = "job_id bigint, image_id bigint, lease_token bigint, status string, finished_at timestamp, payload string"
LEASE = "job_id bigint, status string, lease_token bigint, lease_expires_at timestamp"


def test_new_images_are_ingested_once(spark, tmp_path):
    folder, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    (folder / "a.JPG").write_bytes(b"1")
    jobs.stream_new_images(spark, str(folder), target, checkpoint).awaitTermination()
    (folder / "b.Png").write_bytes(b"22")
    (folder / "c.txt").write_bytes(b"3")
    for _ in range(2):
        jobs.stream_new_images(spark, str(folder), target, checkpoint).awaitTermination()
    assert sorted(row.length for row in spark.read.parquet(target).collect()) == [1, 2]


def test_stale_worker_cannot_publish(spark, tmp_path):
    leases = spark.createDataFrame([(1, "processing", 7, NOON), (2, "processing", 3, NOON), (3, "completed", 5, NOON), (4, "processing", 4, NOON)], LEASE)
    before, after = NOON - timedelta(minutes=1), NOON + timedelta(minutes=1)
    first = [(1, 10, 6, "completed", before, "stale token"), (1, 10, 7, "completed", before, "good"), (2, 20, 3, "completed", after, "expired")]
    second = [(3, 10, 5, "completed", before, "job no longer processing"), (4, 10, 4, "failed", before, "failed"), (1, 10, 7, "completed", NOON - timedelta(seconds=5), "a second result")]
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    leases.write.parquet(str(tmp_path / "leases"))
    for batch in (first, second):
        spark.createDataFrame(batch, RESULT).coalesce(1).write.mode("append").parquet(inbox)
        jobs.stream_publish(jobs.read_events(spark, inbox, RESULT), str(tmp_path / "leases"), out, str(tmp_path / "cp")).awaitTermination()
        assert [(row.image_id, row.payload) for row in jobs.current_results(spark, out).collect()] == [(10, "good")]


def test_published_bytes_follow_the_batch(spark, tmp_path):
    """A small batch rewrites only its buckets, a retried one changes nothing, old versions and epochs go."""
    out = str(tmp_path / "out")
    leases = spark.createDataFrame([(i, "processing", 1, NOON) for i in range(700)], LEASE)
    when = NOON - timedelta(hours=1)
    first = spark.createDataFrame([(i, i % 500, 1, "completed", when, f"p{i}") for i in range(600)], RESULT)
    jobs.publish_batch(first, 0, leases, out, buckets=16)
    want = {i: f"p{i + 500}" if i < 100 else f"p{i}" for i in range(500)}
    seen = lambda: {row.image_id: row.payload for row in jobs.current_results(spark, out).collect()}
    assert seen() == want
    size = lambda epoch: sum(f.stat().st_size for f in (tmp_path / "out" / "current" / f"epoch={epoch}").rglob("*.parquet"))
    for epoch in range(1, 9):
        one = spark.createDataFrame([(600 + epoch, 7, 1, "completed", when + timedelta(minutes=epoch), f"n{epoch}"), (3, 3, 1, "completed", NOON - timedelta(seconds=1), "a second result")], RESULT)
        for _ in range(2):
            jobs.publish_batch(one, epoch, leases, out, buckets=16, compact_every=4)
            assert seen() == {**want, 7: f"n{epoch}"}
        assert len(list((tmp_path / "out" / "current" / f"epoch={epoch}").glob("bucket=*"))) == 1 and size(epoch) < size(0) / 4
    kept = lambda name: sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out" / name).glob("epoch=*") if any(p.rglob("*.parquet")))
    assert kept("manifest") == [6, 7, 8] and kept("used") == [7, 8] and 3 not in kept("current") and kept("current")[-2:] == [7, 8]
    used = spark.read.parquet(f"{out}/used")
    assert used.count() == used.distinct().count() == 608


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    text = plan(plans.queries()["suppress_vehicles"](spark, SF))
    assert "l_comment" not in text and "l_discount" not in text and "l_tax" not in text
    text = plan(plans.queries()["scan_text_for_plates"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text


def test_no_cross_joins(spark):
    names = ("assign_plates", "suppress_plates", "decide_plate", "image_results", "match_brands", "review_stats", "export_flat", "model_vs_truth", "apply_corrections")
    for name in names:
        text = plan(plans.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_assignment_shuffles_each_side_once(spark):
    text = plan(plans.queries()["assign_plates"](spark, SF))
    # One exchange per order for renumbering the lines, none for the join's own aggregate.
    assert text.count("Exchange hashpartitioning(image_id") + text.count("Exchange hashpartitioning(l_orderkey") <= 4, text


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    text = plan(skew.top_per_key(df, ["k"], [F.col("id").desc()], 2))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    light, heavy, hot = skew.split_heavy(df.filter("k > 0 OR id < 30"), ["k"], 100)
    assert (light.count(), heavy.count(), hot.count()) == (10, 666, 2)
    assert skew.split_heavy(df, ["k"], 1000)[1] is None
