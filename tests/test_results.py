"""Stored results, corrections, ingest and parsing."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plateflow import providers
from plateflow.operators import quality, results
from plateflow.sources import ingest, sinks
from tests.conftest import SF

DET = ("detection_id bigint, image_id bigint, vehicle_type string, manufacturer string, license_plate string, plate_readable boolean, confidence double, "
       "bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, plate_text_raw string, plate_status string, plate_ocr_confidence double, vehicle_type_source string")


def det(i, image=1, plate=None, raw=None, **more):
    base = {"vehicle_type": "truck", "manufacturer": None, "source": "detector", **more}
    return (i, image, base["vehicle_type"], base["manufacturer"], plate, plate is not None, 0.5, 0.1, 0.1, 0.5, 0.5, raw, "x", 0.9, base["source"])


IMAGE = "image_id bigint, original_filename string, width int, height int, annotated_filename string"
JOB = "job_id bigint, image_id bigint, status string, provider string, model string, error_message string, created_at bigint"


def test_failed_rerun_keeps_the_old_result(spark):
    images = spark.createDataFrame([(1, "a.jpg", 10, 10, None), (2, "b.jpg", 10, 10, "x")], IMAGE)
    jobs = spark.createDataFrame([(1, 1, "completed", "mock", "m", None, 1), (2, 1, "failed", "local", "l", "broken", 2)], JOB)
    rows = {row.image_id: row for row in results.image_results(images, jobs).collect()}
    assert (rows[1].status, rows[1].latest_job_id, rows[1].result_job_id, rows[1].is_mock) == ("failed", 2, 1, True)
    assert (rows[2].status, rows[2].annotated_available, rows[2].is_mock) == ("not_processed", True, False)


def test_large_image_is_exported_in_parts(spark):
    images = spark.createDataFrame([(1, "a.jpg", 10, 10, None), (2, "b.jpg", 10, 10, None), (3, "c.jpg", 10, 10, None)], IMAGE)
    dets = spark.createDataFrame([det(i) for i in range(57)] + [det(100, 2)], DET)
    out = results.export_nested(images, spark.createDataFrame([], JOB), dets, record_rows=10).collect()
    found = [d.detection_id for row in out if row.image_id == 1 for d in row.detections]
    assert sorted(found) == list(range(57))
    parts = {row.part: [d.detection_id for d in row.detections] for row in out if row.image_id == 1}
    assert [x for part in sorted(parts) for x in parts[part]] == list(range(57)) and {len(parts[p]) for p in range(5)} == {10}
    assert [(row.part, len(row.detections)) for row in out if row.image_id == 3] == [(0, 0)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_outlying_and_null_ids_of_a_hot_image(spark):
    """Ids far away, equal ids and null ids keep their places; at the limit both ways give the same parts."""
    images = spark.createDataFrame([(1, "a.jpg", 10, 10, None), (2, "b.jpg", 10, 10, None)], IMAGE)
    ids = [-(10**17), None, *range(500, 700), 10**18]
    dets = spark.createDataFrame([det(i) for i in ids] + [det(i, 2) for i in range(10)], DET)
    out = results.export_nested(images, spark.createDataFrame([], JOB), dets, record_rows=10)
    parts = {row.part: [d.detection_id for d in row.detections] for row in out.collect() if row.image_id == 1}
    assert [x for part in sorted(parts) for x in parts[part]] == [None, -(10**17), *range(500, 700), 10**18]
    assert sorted(map(len, parts.values())) == [3] + [10] * 20
    slices = results.place_in_image(dets.filter("image_id = 1"), 10)
    places = {row.detection_id: row._place for row in slices.collect()}
    assert places[None] == 0 and places[-(10**17)] == 1 and places[10**18] == 202 and sorted(places.values()) == list(range(203))
    two = [[d.detection_id for d in row.detections] for row in out.collect() if row.image_id == 2]
    assert two == [list(range(10))]


def test_a_hot_image_is_spread_over_tasks(spark):
    """Slices are balanced however the ids lie, and no window stands on rows dealt by image alone."""
    dets = spark.range(20_000).select(F.lit(1).cast("bigint").alias("image_id"), (F.col("id") * F.when(F.col("id") > 19_990, 10**12).otherwise(1)).alias("detection_id"))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {name: spark.conf.get(name) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        placed = results.place_in_image(dets, 100)
        text = plan_of(placed)
        rows = [row["count"] for row in placed.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert len(rows) == 4 and max(rows) < 10_000
    lines = [line.strip(" :+-*()0123456789") for line in text.splitlines()]
    for i, line in enumerate(lines):
        if line.startswith("Window "):
            dealt = next(x for x in lines[i:] if x.startswith("Exchange"))
            assert "_slice" in dealt
    assert placed.filter("_place % 1000 = 0").count() == 20


def test_spanning_search_in_a_hot_image(spark):
    images = spark.createDataFrame([(1, "front.jpg", 10, 10, None), (2, "back.jpg", 10, 10, None)], IMAGE)
    dets = spark.createDataFrame(
        [det(i, manufacturer=f"m{i}") for i in range(3000)] + [det(10**18, manufacturer="last"), det(None, manufacturer="none")] + [det(i, 2, manufacturer=f"m{i}") for i in range(5)], DET
    )
    shown = results.image_results(images, spark.createDataFrame([], JOB))
    found = lambda needle: sorted(row.image_id for row in results.review_search(shown, dets, needle).collect())
    assert found("m0 truck m1 truck") == [1, 2] and found("m2999 truck last") == [1] and found("m999 truck m1000") == [1]
    assert found("front.jpg truck none truck m0") == [1] and found("back.jpg truck m0") == [2] and found("front.jpg truck m0") == [] and found("m4 truck m6") == []


def test_formula_text_is_defused_and_numbers_are_not(spark, tmp_path):
    images = spark.createDataFrame([(1, " =1+1.jpg", 10, 10, None)], IMAGE)
    flat = results.export_flat(images, spark.createDataFrame([], JOB), spark.createDataFrame([det(-1, manufacturer="@x")], DET))
    row = flat.first()
    assert (row.filename, row.manufacturer, row.detection_id) == ("' =1+1.jpg", "'@x", -1) and len(flat.columns) == 41
    sinks.write_results_csv(flat, str(tmp_path / "csv"), single_file=True)
    part = next((tmp_path / "csv").glob("part-*.csv"))
    sinks.csv_for_spreadsheets(str(part), str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes().startswith(b"\xef\xbb\xbfimage_id,filename")


def test_page_limits(spark):
    ids = spark.range(30)
    assert results.page(ids, [F.col("id")], limit=50, offset=25, maximum=20).count() == 5
    assert results.page(ids, [F.col("id")], limit=50, maximum=20).count() == 20
    with pytest.raises(ValueError):
        results.page(ids, [F.col("id")], maximum=20)


def test_deep_pages_equal_sorted_rows(spark):
    """Random orders with nulls, ties and both directions, at all offsets."""
    rng = random.Random(6)
    data = [(i, rng.choice([None, 1, 2, 2, 3]), rng.choice([None, "a", "b", "B"]), rng.random() if rng.random() > 0.1 else None) for i in range(3000)]
    df = spark.createDataFrame(data, "id bigint, k int, s string, x double").repartition(5).cache()
    for order in (["k", ("s", True), ("id", False)], [("x", True), ("id", True)], [("s", False), "x", "id"]):
        want = df.orderBy(*[F.col(k).desc() if d else F.col(k) for k, d in ((o, False) if isinstance(o, str) else o for o in order)]).collect()
        for offset in (0, 17, 1500, 2950, 2999, 3000, 9000):
            assert results.page(df, order, limit=60, offset=offset, shallow=100).collect() == want[offset : offset + 60]
        assert results.next_page(df, order, want[1234], 20).collect() == want[1235:1255]
    same = spark.range(5000).select(F.lit(7).alias("k"))
    assert results.page(same, ["k"], limit=10, offset=4995, shallow=100).count() == 5


def test_a_page_at_ten_million(spark):
    """Only a small range is sorted."""
    df = spark.range(12_000_000, numPartitions=8).select(F.pmod(F.col("id") * 7_919, F.lit(12_000_000)).alias("key"))
    part, skip = results.narrow_to_page(df, ["key"], 10_000_000, 50)
    assert part.count() < 100_000 and skip < 100_000
    assert [r.key for r in results.page(df, ["key"], limit=50, offset=10_000_000).collect()] == list(range(10_000_000, 10_000_050))
    assert [r.key for r in results.next_page(df, ["key"], {"key": 10_000_049}, 3).collect()] == [10_000_050, 10_000_051, 10_000_052]


def patch(spark, **values):
    dets = spark.createDataFrame([det(1, plate="123 ABC 10", raw="123ABC10")], DET)
    columns = ["detection_id bigint"]
    data = [1]
    for name, (kind, value) in values.items():
        columns += [f"set_{name} boolean", f"{name} {kind}"]
        data += [True, value]
    corrected, rejected = results.apply_corrections(dets, spark.createDataFrame([tuple(data)], ", ".join(columns)))
    return corrected.first(), rejected.first()


def test_text_correction(spark):
    row, bad = patch(spark, license_plate=("string", " 456  xyz 02 "))
    assert bad is None and (row.license_plate, row.plate_readable, row.plate_status, row.plate_ocr_confidence) == ("456 XYZ 02", True, "manually_corrected", None)
    assert json.loads(row.extra) == {"manually_corrected": True} and row.vehicle_confidence == 0.5
    row, bad = patch(spark, plate_readable=("boolean", False))
    assert (row.license_plate, row.plate_readable) == (None, False)


def test_bad_patches_are_rejected_whole(spark):
    for values, reason in (
        ({"vehicle_type": ("string", None)}, "vehicle_type cannot be null"),
        ({"vehicle_type": ("string", "loader"), "plate_readable": ("boolean", True), "license_plate": ("string", " ")}, "readable plate requires text"),
        ({"confidence": ("double", 1.5)}, "confidence out of range"),
        ({"vehicle_type": ("string", "\t")}, "vehicle_type cannot be empty"),
    ):
        row, bad = patch(spark, **values)
        assert bad.reason == reason and (row.vehicle_type, row.license_plate, row.extra) == ("truck", "123 ABC 10", None)


def test_extra_keeps_its_types_and_patches_do_not_double_rows(spark):
    dets = spark.createDataFrame([(*det(i), '{"a":[1,4],"e":[{"t":"x","n":null}],"manually_corrected":false}') for i in (1, 2, 3)], DET + ", extra string")
    dets = dets.withColumn("bbox_x2", F.when(F.col("detection_id") == 3, 0.05).otherwise(F.col("bbox_x2")))
    patches = spark.createDataFrame([(1, True, "a"), (2, True, "b"), (2, True, "c"), (3, True, "d")], "detection_id bigint, set_model boolean, model string")
    corrected, rejected = results.apply_corrections(dets, patches)
    rows = {row.detection_id: row for row in corrected.collect()}
    assert len(rows) == corrected.count() == 3 and rows[2].model is None
    assert json.loads(rows[1].extra) == {"a": [1, 4], "e": [{"t": "x", "n": None}], "manually_corrected": True}
    assert {row.detection_id: row.reason for row in rejected.collect()} == {2: "several patches for one detection", 3: "corrected row is not valid"}


def test_type_correction_is_manual(spark):
    row, _ = patch(spark, vehicle_type=("string", " loader "))
    assert (row.vehicle_type, row.vehicle_type_source, row.license_plate) == ("loader", "manual", "123 ABC 10")


def test_plate_box_correction(spark):
    dets = spark.createDataFrame([det(1, raw="x"), det(2, raw="x")], DET)
    ddl = "detection_id bigint, set_plate_bbox boolean, plate_bbox_x1 double, plate_bbox_y1 double, plate_bbox_x2 double, plate_bbox_y2 double"
    patches = spark.createDataFrame([(1, True, 0.1, 0.1, 0.2, 0.2), (2, True, None, None, None, None)], ddl)
    rows = {row.detection_id: row for row in results.apply_corrections(dets, patches)[0].collect()}
    assert (rows[1].plate_status, rows[1].plate_bbox_x2, rows[1].plate_quad) == ("manually_set", 0.2, None)
    assert (rows[2].plate_status, rows[2].plate_bbox_x2) == ("manually_cleared", None)


def test_uploads(spark):
    ddl = "image_id bigint, batch_id bigint, mime_type string, file_size bigint, actual_type string, width int, height int, frames int"
    good = ("image/jpeg", 10, "image/jpeg", 10, 10, 1)
    cases = [good, ("image/gif", *good[1:]), ("image/jpeg", 0, *good[2:]), ("image/jpeg", 10, None, 10, 10, 1), ("image/jpeg", 10, "image/png", 10, 10, 1),
             (*good[:3], 90_000, 90_000, 1), (*good[:5], 2), ("IMAGE/JPEG; q=1", *good[1:])]
    uploads = spark.createDataFrame([(i, i // 7, *case) for i, case in enumerate(cases)], ddl)
    checked = ingest.validate_uploads(uploads)
    assert [row.code for row in checked.orderBy("image_id").collect()] == [None, 415, 400, 400, 415, 413, 415, None]
    images, jobs = ingest.admit_batch(checked)
    assert [row.image_id for row in images.collect()] == [7] and jobs.first().status == "pending"


def answer(content, finish="stop"):
    return json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content}}]})


BODY = {"detections": [{"vehicle_type": "truck", "confidence": 0.5, "bbox": {"x1": 0, "y1": 0, "x2": 1, "y2": 1}}]}


PLATE = {"bbox": {"x1": 0.1, "y1": 0.1, "x2": 0.2, "y2": 0.2}, "detection_confidence": 0.5, "text": " a1 ", "alternatives": [{"text": "A1", "score": 0.5}]}


def broken(**changes):
    return json.dumps({"detections": [{**BODY["detections"][0], **changes}]})


@pytest.mark.parametrize(("raw", "problem"), [
    (answer(json.dumps(BODY)), None), (answer("```json\n" + json.dumps(BODY) + "\n```"), None), (answer([{"text": json.dumps(BODY)[:9]}, {"text": json.dumps(BODY)[9:]}]), None),
    (answer(json.dumps({"detections": []})), None), (answer(json.dumps(BODY), "length"), "truncated_or_filtered"), ("{", "not_json"), ("{}", "no_content"),
    (answer("[]"), "not_an_object"), (answer("sorry"), "not_an_object"), (answer("{}"), "schema"), (answer(json.dumps({**BODY, "x": 1})), "schema"),
    (answer(broken(colour="red")), "schema"), (answer(broken(confidence=2)), "schema"), (answer(broken(plate_readable=True)), "schema"),
    (answer(broken(bbox={"x1": 0.5, "y1": 0, "x2": 0.5, "y2": 1})), "schema"), (answer(broken(vehicle_type="")), "schema"),
    (answer(broken(bbox={"x1": 0, "y1": 0, "x2": 1, "y2": 1, "z": 1})), "schema"), (answer(broken(plate={**PLATE, "shade": 1})), "schema"),
    (answer(broken(plate={k: v for k, v in PLATE.items() if k != "bbox"})), "schema"), (answer(broken(plate={**PLATE, "bbox": {"x1": 0.5, "y1": 0, "x2": 0.4, "y2": 1}})), "schema"),
    (answer(broken(plate={**PLATE, "detection_confidence": 7})), "schema"), (answer(broken(manufacturer="m" * 121)), "schema"), (answer(broken(notes="n" * 1001)), "schema"),
    (answer(broken(plate={**PLATE, "alternatives": [{}] * 13})), "schema"), (answer(broken(vehicle_type=" \t\u00a0 ")), "schema"), (answer(broken(extra_plates=[{**PLATE, "detection_confidence": 7}])), "schema"),
    (answer(broken(plate=PLATE, extra_plates=[PLATE], evidence=[{"text": "K"}])), None), (answer(broken(confidence="x")), "schema"), (answer(broken(plate=None, notes=None)), None),
])
def test_answers(spark, raw, problem):
    row = ingest.parse_recognition_json(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row.problem == problem and (row.detections is None) == (problem is not None)


def test_accepted_answers_are_normalised(spark):
    body = broken(license_plate=" x 1 ", plate=PLATE, extra_plates=[{**PLATE, "readable": True}])
    found = ingest.parse_recognition_json(spark.createDataFrame([(answer(body),)], "raw string")).select("problem", "detections", F.col("detections")[0]["plate"]["alternatives"][0]["text"].alias("alt"))
    d = found.select("problem", "alt", *[F.col("detections")[0][n].alias(n) for n in ("license_plate", "vehicle_confidence")], F.col("detections")[0]["plate"]["text"].alias("text"),
                     F.col("detections")[0]["extra_plates"][0]["text"].alias("other")).first()
    assert (d.problem, d.license_plate, d.vehicle_confidence, d.text, d.other, d.alt) == (None, None, 0.5, None, "a1", "A1")


def test_listing_labels_and_resume(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.JPG", "a.png", "notes.txt", "sub/c.webp"):
        (tmp_path / name).write_bytes(b"x")
    flat = ingest.scan_image_listing(spark, str(tmp_path))
    assert sorted(row.name for row in flat.collect()) == ["a.png", "b.JPG"]
    deep = ingest.scan_image_listing(spark, str(tmp_path), recursive=True)
    assert sorted(row.name for row in deep.collect()) == ["a.png", "b.JPG", "c.webp"]
    recorded = spark.createDataFrame([("a.png", "x")], "source string, api string")
    files = deep.select(F.col("name").alias("source"))
    assert ingest.pending_sources(files, recorded, {"api": "x"}).count() == 2
    with pytest.raises(ValueError):
        ingest.pending_sources(files, recorded, {"api": "y"})


def test_provider_failures_are_failed_rows(spark):
    images = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")

    def build():
        def run(content, path):
            if path == "b":
                raise RuntimeError("secret")
            return []

        return run

    rows = {row.path: row for row in providers.recognise(images, "mine", build).collect()}
    assert (rows["a"].status, rows["a"].detections, rows["a"].is_mock) == ("completed", "[]", False)
    assert rows["b"].status == "failed" and "secret" not in rows["b"].error_message and rows["b"].detections is None
    assert all(row.is_mock for row in providers.recognise(images).collect())
    with pytest.raises(ValueError):
        providers.recognise(images, "nobody")


def test_globs():
    import re

    for pattern, path, hit in (("**/.env", ".env", True), ("**/.env", "a/b/.env", True), ("**/*.pem", "a.pem", True), ("photos/**/*", "photos/a/b.jpg", True),
                               ("photos/**/*", "photos/a.jpg", True), ("annotated/*", "annotated/x/y", False), ("**/id_rsa*", "k/id_rsa.pub", True)):
        assert bool(re.match(quality.glob_to_regex(pattern), path)) is hit, (pattern, path)


def test_spanning_search_equals_joined_text(spark):
    from plateflow.fixtures import Fixtures

    fx = Fixtures(spark, SF)
    shown = results.image_results(fx.v_image, fx.v_job)
    whole = fx.v_detection.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("detection_id", F.concat_ws(
        " ", "license_plate", "plate_text_raw", "vehicle_type", "manufacturer").alias("t")))).alias("d"))
    text = F.lower(F.concat_ws(" ", "filename", F.array_join(F.transform("d", lambda d: d["t"]), " ")))
    joined = shown.join(whole, "image_id", "left").select("image_id", text.alias("text")).cache()
    for needle in ("kamaz truck", "maz car", "g a00", ".jpg b"):
        want = {row.image_id for row in joined.filter(F.col("text").contains(needle)).collect()}
        assert {row.image_id for row in results.review_search(shown, fx.v_detection, needle).collect()} == want


def test_indexed_search_equals_the_scan(spark, tmp_path):
    """Needles cut out of texts at random, of one letter and more, over the end of a text, with doubled letters and blanks."""
    images = spark.createDataFrame([(i, f"IMG_{i}aaa.jpg" if i % 3 else None, 10, 10, None) for i in range(40)], IMAGE)
    rng = random.Random(8)
    words = ["KAMAZ", "aaaa", "ab", "x%_", "Ünal", "", None]
    dets = spark.createDataFrame([det(i, i % 40, manufacturer=rng.choice(words), raw=rng.choice(["123ABC", None, "a"])) for i in range(150)] + [det(None, 3, manufacturer="odd")] + [det(999, 5, manufacturer="mazo kam")] * 3, DET)
    shown = results.image_results(images, spark.createDataFrame([], JOB)).cache()
    results.write_search_postings(shown, dets, str(tmp_path / "postings"))
    postings = spark.read.parquet(str(tmp_path / "postings"))
    for needle in ("a", "AA", "aaa", "aaaa", "aaaaa", "maz", "KAMAZ", "kamazz", "x%_", "ünal", "nal", "3abc", "img_1", "g", "odd", "abc truck", "jpg", ""):
        got, want = (sorted(r.image_id for r in found.collect()) for found in (results.review_search_indexed(shown, dets, postings, needle), results.review_search(shown, dets, needle)))
        assert got == want, needle
    text = postings.filter(F.col("gram").isin("maz"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in text or "EqualTo(gram" in text


def test_postings_are_dealt_as_texts(spark, tmp_path, monkeypatch):
    """Every file is sorted by gram, all grams are there, and none of them was shuffled."""
    monkeypatch.setattr(results, "TASK_GRAMS", 300)
    shown = spark.createDataFrame([(i, f"IMG_{i}.jpg") for i in range(30)], "image_id bigint, filename string")
    dets = spark.createDataFrame([det(i, i % 30, raw=f"{i}ABC") for i in range(100)], DET)
    folder = tmp_path / "postings"
    results.write_search_postings(shown, dets, str(folder))
    files = sorted(folder.glob("*.parquet"))
    assert len(files) > 3
    grams = [[r.gram for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert all(g == sorted(g) for g in grams)
    # A file ranges over the whole alphabet: it holds the grams of its own texts, not a range of all grams.
    assert all("".join(g).count("g") for g in grams)
    want = sorted(r.gram for r in results.search_postings(shown, dets).collect())
    assert sorted(x for g in grams for x in g) == want


def _times_read(spark, monkeypatch, name):
    """How often the query makes the view of the detections."""
    from plateflow import plans
    from plateflow.fixtures import Fixtures

    made = []
    plain = Fixtures.__getattr__
    monkeypatch.setattr(Fixtures, "__getattr__", lambda self, view: made.append(view) or plain(self, view))
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    return made.count("v_detection"), plan


@pytest.mark.parametrize("name", ["page_deep", "review_search_indexed", "review_search_spanning"])
def test_passes_read_stored_columns(spark, monkeypatch, name):
    times, plan = _times_read(spark, monkeypatch, name)
    assert times == 1 and "l_orderkey" not in plan and "o_orderkey" not in plan


def test_fence_is_taken_off_without_patterns(spark):
    tick = "`" * 3
    texts = [f"{tick}json\n{{}}\n{tick}", f"{tick}JSON{{}}{tick}", "{}", f"{tick} {{}}  \t{tick}\n", tick, tick * 2, f"{tick}json{tick}", f"{{}} {tick}\r\n", f"x {tick} {tick} ", "``", "`" * 4, f"{tick}jso", f"{tick}\n\n", "", None]
    rows = spark.createDataFrame([(text,) for text in texts], "c string").repartition(2)
    want = F.regexp_replace(F.regexp_replace("c", r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    assert rows.filter(~ingest._unfenced(F.col("c")).eqNullSafe(want)).count() == 0


def test_recognition_reads_one_image_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(providers, "OUT_ROWS", 2)
    images = spark.createDataFrame([(str(i), b"x" * i) for i in range(5)], "path string, content binary").coalesce(1)
    found = providers.recognise(images, "mine", lambda: lambda content, path: [{"size": len(content), "kind": type(content).__name__}])
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.path, r.detections) for r in found.collect()) == [(str(i), f'[{{"size": {i}, "kind": "bytes"}}]') for i in range(5)]


def test_cascade_delete_sorts_no_detections(spark, monkeypatch):
    """Deleted keys are hashed, sent whole or by partition, and the result is the same."""
    ids = spark.range(100).withColumnRenamed("id", "image_id")
    jobs = ids.selectExpr("image_id * 3 AS job_id", "image_id")
    dets = ids.selectExpr("image_id * 10 AS detection_id", "image_id", "image_id * 3 AS job_id")
    out = []
    for limit in (64 << 20, 0):
        monkeypatch.setattr("plateflow.operators.skew.BROADCAST_BYTES", limit)
        kept = results.cascade_delete(ids, jobs, dets, ids.filter("image_id % 10 = 0"), jobs.filter("image_id % 7 = 0"))
        plan = kept[2]._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and ("ShuffledHashJoin" in plan) == (limit == 0)
        out.append([sorted(map(tuple, t.collect()), key=str) for t in kept])
    assert out[0] == out[1]
    assert [len(t) for t in out[0]] == [90, 77, 90] and sum(r["job_id"] is None for r in kept[2].collect()) == 13
