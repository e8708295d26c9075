"""Stored results: exports, search, review, corrections and deletes."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow.functions import expr
from plateflow.operators import results as op
from plateflow.operators.skew import shared_folder, stored
from plateflow.plans import parts as p
from plateflow.plans.registry import query

JOBS = """latest AS (SELECT * FROM v_job QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC, job_id DESC) = 1),
    done AS (SELECT * FROM v_job WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC, job_id DESC) = 1),
    res AS (
        SELECT i.image_id, i.original_filename AS filename, i.width, i.height, coalesce(i.annotated_filename <> '', false) AS annotated_available,
               coalesce(l.status, 'not_processed') AS status, l.job_id AS latest_job_id, l.error_message, d.job_id AS result_job_id,
               d.provider, d.model AS recognition_model, coalesce(d.provider = 'mock', false) AS is_mock
        FROM v_image i LEFT JOIN latest l ON l.image_id = i.image_id LEFT JOIN done d ON d.image_id = i.image_id
    )"""


def _results(fx):
    return op.image_results(fx.v_image, fx.v_job)


@query(
    "latest_per_key",
    "SELECT job_id, image_id, status FROM v_job QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC, job_id DESC) = 1",
)
def _(fx):
    return op.latest_per_key(fx.v_job, "image_id").select("job_id", "image_id", "status")


@query("image_results", f"WITH {JOBS} SELECT * FROM res")
def _(fx):
    return _results(fx)


PLATED = "(d.plate_text_raw IS NOT NULL)"


@query(
    "export_nested",
    f"""WITH {JOBS} SELECT r.image_id, any_value(r.status) AS status, 0 AS part, count(d.detection_id) AS detections,
        coalesce(string_agg(d.detection_id || '/' || d.vehicle_type || '/' || CASE WHEN {PLATED} THEN
            coalesce(CASE WHEN d.plate_readable THEN d.license_plate END, '-') || '/' || d.plate_text_raw || '/' || d.plate_status ELSE 'none' END,
            ' ' ORDER BY d.detection_id), '') AS listed
    FROM res r LEFT JOIN v_detection d ON d.image_id = r.image_id GROUP BY r.image_id""",
)
def _(fx):
    def show(d):
        plate = d["plate"]
        seen = F.concat_ws("/", F.coalesce(plate["text"], F.lit("-")), plate["text_raw"], plate["status"])
        return F.concat_ws("/", d["detection_id"].cast("string"), d["vehicle_type"], F.when(plate.isNotNull(), seen).otherwise("none"))

    nested = op.export_nested(fx.v_image, fx.v_job, fx.v_detection)
    return nested.select(
        "image_id", "status", "part", F.size("detections").cast("bigint").alias("detections"),
        F.array_join(F.transform("detections", show), " ").alias("listed"),
    )


def _safe(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^\\s*[=+\\-@]') OR regexp_matches({c}, '^[\\t\\r\\n]') THEN '''' || {c} ELSE {c} END"


FLAT = ("image_id", "filename", "status", "result_job_id", "is_mock", "error_message", "detection_id", "vehicle_type", "manufacturer",
        "license_plate", "plate_readable", "confidence", "vehicle_type_source", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2",
        "plate_ocr_confidence", "plate_text_raw", "plate_status")


@query(
    "export_flat",
    f"""WITH {JOBS} SELECT r.image_id, {_safe('r.filename')} AS filename, r.status, r.result_job_id, r.is_mock, {_safe('r.error_message')} AS error_message,
        d.detection_id, {_safe('d.vehicle_type')} AS vehicle_type, {_safe('d.manufacturer')} AS manufacturer, {_safe('d.license_plate')} AS license_plate,
        d.plate_readable, d.confidence, d.vehicle_type_source, d.bbox_x1, d.bbox_y1, d.bbox_x2, d.bbox_y2,
        CASE WHEN {PLATED} THEN d.plate_ocr_confidence END AS plate_ocr_confidence, {_safe('d.plate_text_raw')} AS plate_text_raw,
        CASE WHEN {PLATED} THEN d.plate_status END AS plate_status
    FROM res r LEFT JOIN v_detection d ON d.image_id = r.image_id""",
)
def _(fx):
    return op.export_flat(fx.v_image, fx.v_job, fx.v_detection).select(*FLAT)


@query(
    "merge_exports",
    f"WITH {JOBS} SELECT r.image_id, r.status, d.detection_id FROM res r LEFT JOIN v_detection d ON d.image_id = r.image_id",
)
def _(fx):
    from plateflow.sources.sinks import merge_exports

    # A page is chosen before anything is joined, so each image is exported once.
    shares = ("image_id % 3 = 0", "image_id % 3 > 0")
    pages = [op.export_flat(*[table.filter(share) for table in (fx.v_image, fx.v_job, fx.v_detection)]) for share in shares]
    return merge_exports(pages).select("image_id", "status", "detection_id")


@query(
    "page",
    "SELECT image_id, original_filename FROM v_image ORDER BY created_at, image_id LIMIT 200 OFFSET 100",
)
def _(fx):
    return op.page(fx.v_image, ["created_at", "image_id"], limit=200, offset=100).select("image_id", "original_filename")


@query(
    "page_deep",
    """SELECT detection_id, image_id, confidence FROM v_detection ORDER BY confidence DESC, detection_id LIMIT 100
    OFFSET (SELECT count(*) // 2 FROM v_detection)""",
)
def _(fx):
    order = [("confidence", True), "detection_id"]
    # The passes of a deep page read stored columns; the view behind them is made once.
    dets = stored(fx.v_detection.select("detection_id", "image_id", "confidence"), "detections")
    return op.page(dets, order, limit=100, offset=dets.count() // 2, shallow=50)


@query(
    "page_after",
    """SELECT job_id, created_at FROM v_job ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 50""",
)
def _(fx):
    newest = [("created_at", True), ("job_id", True)]
    last = op.page(fx.v_job, newest, limit=50).tail(1)[0]
    return op.next_page(fx.v_job, newest, last, 50).select("job_id", "created_at")


@query(
    "page_bodies",
    f"""WITH {JOBS}, ids AS (SELECT image_id, row_number() OVER (ORDER BY created_at DESC, image_id DESC) AS position FROM v_image
        ORDER BY position LIMIT 200)
    SELECT ids.position, r.image_id, r.filename, r.status FROM ids JOIN res r ON r.image_id = ids.image_id WHERE r.annotated_available""",
)
def _(fx):
    newest = [("created_at", True), ("image_id", True)]
    # The page is at most 200 rows, so numbering it needs no partitioning.
    ids = op.page(fx.v_image, newest, limit=200).select("image_id", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("image_id"))).cast("bigint").alias("position"))
    bodies = _results(fx).filter("annotated_available").select("image_id", "filename", "status")
    return op.page_bodies(ids, bodies).select("position", "image_id", "filename", "status")


@query(
    "search_detections",
    """SELECT detection_id, image_id, vehicle_type, manufacturer FROM v_detection
    WHERE contains(lower(vehicle_type), 'uc') AND contains(lower(manufacturer), 'ma')""",
)
def _(fx):
    found = op.search_detections(fx.v_detection, vehicle_type="UC", manufacturer="mA", plate="")
    return found.select("detection_id", "image_id", "vehicle_type", "manufacturer")


@query(
    "search_detections_literal",
    "SELECT count(*) AS total FROM v_detection WHERE contains(lower(license_plate), '%1')",
)
def _(fx):
    return op.search_detections(fx.v_detection, plate="%1").agg(F.count(F.lit(1)).alias("total"))


@query(
    "search_page",
    """SELECT detection_id, image_id, license_plate, count(*) OVER () AS total FROM v_detection WHERE contains(lower(license_plate), 'a0')
    ORDER BY image_id DESC, detection_id DESC LIMIT 50 OFFSET 10""",
)
def _(fx):
    found = op.search_detections(fx.v_detection, plate="A0")
    listed = op.page(found, [("image_id", True), ("detection_id", True)], limit=50, offset=10)
    total = found.agg(F.count(F.lit(1)).alias("total")).scalar()
    return listed.select("detection_id", "image_id", "license_plate", total.alias("total"))


@query("list_jobs", "SELECT job_id, image_id, status FROM v_job WHERE status = 'failed' ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 20")
def _(fx):
    failed = op.list_jobs(fx.v_job, status="failed").select("job_id", "image_id", "status", "created_at")
    return op.page(failed, [("created_at", True), ("job_id", True)], limit=50, offset=20).drop("created_at")


@query("list_images", "SELECT image_id, original_filename FROM v_image ORDER BY created_at DESC, image_id DESC LIMIT 50")
def _(fx):
    return op.page(fx.v_image, [("created_at", True), ("image_id", True)], limit=50).select("image_id", "original_filename")


REVIEW = f"""WITH {JOBS}, f AS (
        SELECT image_id, bool_or(plate_readable) AS read, bool_or(NOT plate_readable AND coalesce(plate_text_raw, '') <> '') AS rejected,
               bool_or(plate_text_raw IS NOT NULL) AS plate, bool_or(coalesce(vehicle_type_source = 'detector', false)) AS guess
        FROM v_detection GROUP BY image_id
    ), all_lists AS (
        SELECT r.image_id, unnest(['read', 'rejected', 'noplate', 'guess', 'failed']) AS kind,
               unnest([coalesce(f.read, false), coalesce(f.rejected, false), NOT coalesce(f.plate, false), coalesce(f.guess, false), r.status = 'failed']) AS hit
        FROM res r LEFT JOIN f ON f.image_id = r.image_id
    )"""


@query("review_lists", f"{REVIEW} SELECT kind, image_id FROM all_lists WHERE hit")
def _(fx):
    return op.review_lists(_results(fx), fx.v_detection)


@query("review_filter", f"{REVIEW} SELECT kind, image_id FROM all_lists WHERE hit AND kind IN ('rejected', 'noplate')")
def _(fx):
    rejected = op.review_filter(_results(fx), fx.v_detection, "rejected").select(F.lit("rejected").alias("kind"), "image_id")
    none = op.review_filter(_results(fx), fx.v_detection, "noplate").select(F.lit("noplate").alias("kind"), "image_id")
    return rejected.unionByName(none)


HAYSTACK = f"""WITH {JOBS}, hay AS (
        SELECT r.image_id, any_value(r.filename) || coalesce(' ' || string_agg(concat_ws(' ', nullif(license_plate, ''), nullif(plate_text_raw, ''), vehicle_type,
               nullif(manufacturer, '')), ' ' ORDER BY d.detection_id), '') AS text
        FROM res r LEFT JOIN v_detection d ON d.image_id = r.image_id GROUP BY r.image_id
    )"""


def _searched(fx):
    """What a search reads of the results and the detections, stored: it goes over both several times."""
    shown = stored(_results(fx).select("image_id", "filename"), "shown")
    return shown, stored(fx.v_detection.select("image_id", "detection_id", "license_plate", "plate_text_raw", "vehicle_type", "manufacturer"), "searched")


@query("review_search", f"{HAYSTACK} SELECT image_id FROM hay WHERE contains(lower(text), 'amaz')")
def _(fx):
    return op.review_search(_results(fx), fx.v_detection, "AMAZ").select("image_id")


@query("review_search_indexed", f"{HAYSTACK} SELECT image_id FROM hay WHERE contains(lower(text), 'amaz') OR contains(lower(text), 'q7')")
def _(fx):
    shown, dets = _searched(fx)
    folder = shared_folder(fx.spark, "postings")
    op.write_search_postings(shown, dets, folder)
    postings = fx.spark.read.parquet(folder)
    found = [op.review_search_indexed(shown, dets, postings, needle).select("image_id") for needle in ("AMAZ", "q7")]
    return found[0].unionByName(found[1]).distinct()


@query("review_search_spanning", f"{HAYSTACK} SELECT image_id FROM hay WHERE contains(lower(text), '.jpg a1') OR contains(lower(text), 'maz t')")
def _(fx):
    shown, dets = _searched(fx)
    return op.review_search(shown, dets, ".jpg A1").unionByName(op.review_search(shown, dets, "MAZ t")).select("image_id").distinct()


@query(
    "review_stats",
    f"""WITH {JOBS} SELECT (SELECT count(*) FROM res) AS images, (SELECT count(*) FROM res WHERE status = 'failed') AS failed, count(*) AS detections,
        count(*) FILTER (WHERE plate_readable) AS read, count(*) FILTER (WHERE NOT plate_readable AND coalesce(plate_text_raw, '') <> '') AS rejected,
        count(*) FILTER (WHERE vehicle_type_source = 'detector') AS guessed FROM v_detection""",
)
def _(fx):
    return op.review_stats(_results(fx), fx.v_detection)


@query(
    "run_summary",
    f"""WITH {JOBS} SELECT (SELECT count(*) FROM res) AS images, (SELECT count(*) FROM res WHERE status = 'completed') AS completed,
        (SELECT count(*) FROM res WHERE status = 'failed') AS failed, (SELECT count(*) FROM res WHERE is_mock) AS mock_images,
        count(*) AS detections, count(*) FILTER (WHERE plate_text_raw IS NOT NULL) AS plates_detected,
        count(*) FILTER (WHERE plate_readable) AS plates_read,
        count(*) FILTER (WHERE plate_text_raw IS NOT NULL AND box_idx <= 2) AS plate_crops_saved FROM v_detection""",
)
def _(fx):
    crop = F.when(F.col("box_idx") <= 2, F.concat(F.lit("c"), F.col("detection_id").cast("string"), F.lit(".jpg")))
    return op.run_summary(_results(fx), fx.v_detection.withColumn("plate_crop_filename", crop))


GOOD = "(plate_readable AND coalesce(license_plate, '') <> '')"
RAW = "(coalesce(plate_text_raw, '') <> '')"


@query(
    "plate_display",
    f"""SELECT detection_id, CASE WHEN {GOOD} THEN license_plate WHEN {RAW} THEN plate_text_raw END AS shown,
        CASE WHEN {GOOD} THEN true WHEN {RAW} THEN false END AS accepted,
        CASE WHEN NOT {GOOD} AND {RAW} THEN coalesce(plate_status, 'rejected') END AS reason,
        concat_ws(' | ', CASE WHEN vehicle_type_source = 'reference_gallery' THEN '~' || vehicle_type ELSE vehicle_type END, manufacturer, license_plate)
            || '  ' || format('{{:.1f}}', {p.fixed('confidence', 1)}) || '0' AS label,
        CASE WHEN {GOOD} AND plate_ocr_confidence IS NOT NULL THEN license_plate || '  ocr ' || format('{{:.1f}}', {p.fixed('plate_ocr_confidence', 1)}) || '0'
             WHEN {GOOD} THEN license_plate WHEN {RAW} THEN 'unreadable (' || plate_text_raw || ')' ELSE 'unreadable' END AS caption
    FROM v_detection""",
)
def _(fx):
    # One decimal, because engines round the third one differently when they print two.
    tenths = {name: expr.fixed(name, 1) for name in ("confidence", "plate_ocr_confidence")}
    return op.plate_display(fx.v_detection.withColumns(tenths))


#: Detections with scores that are partly missing and extra content of several kinds.
STORED = """SELECT * {but}, CASE WHEN box_idx % 5 = 1 THEN NULL ELSE confidence END AS confidence, CASE WHEN box_idx % 3 = 0 THEN confidence / 2 END AS vehicle_confidence,
    CASE box_idx % 4 WHEN 1 THEN '{{"notes":"seen","plate_ocr_disagreement_positions":[1,4]}}' WHEN 2 THEN '{{"manually_corrected":true,"evidence":[{{"text":"K","score":3}}]}}'
         WHEN 3 THEN '{{}}' END AS extra FROM v_detection"""
#: One detection in eleven is patched twice.
TWICE = """SELECT * FROM v_patch UNION ALL SELECT * FROM v_patch WHERE detection_id % 11 = 0"""
PATCHED = f"""p AS MATERIALIZED (
        SELECT d.*, q.set_vehicle_type AS st, trim(q.vehicle_type) AS pt, q.set_license_plate AS sl, nullif(trim(q.license_plate), '') AS pl,
               q.set_plate_readable AS sr, q.plate_readable AS pr, q.set_vehicle_type OR q.set_license_plate OR q.set_plate_readable AS touched
        FROM ({STORED.format(but="EXCLUDE (confidence)")}) d JOIN v_patch q ON q.detection_id = d.detection_id
    ), m AS (
        SELECT *, CASE WHEN sl AND NOT sr THEN pl IS NOT NULL WHEN sr THEN pr ELSE plate_readable END AS want,
               upper(regexp_replace(CASE WHEN sl THEN pl ELSE license_plate END, '\\s+', ' ', 'g')) AS txt FROM p
    ), v AS (
        SELECT *, CASE WHEN NOT touched THEN NULL WHEN detection_id % 11 = 0 THEN 'several patches for one detection' WHEN st AND pt IS NULL THEN 'vehicle_type cannot be null'
                       WHEN want AND txt IS NULL THEN 'readable plate requires text' END AS reject FROM m
    )"""


def _corrected(fx):
    return op.apply_corrections(fx.sql(STORED.format(but="EXCEPT (confidence)")), fx.sql(TWICE))


@query(
    "apply_corrections",
    f"""WITH {PATCHED}, go AS (SELECT *, touched AND reject IS NULL AS ok FROM v)
    SELECT detection_id, CASE WHEN ok AND st THEN pt ELSE vehicle_type END AS vehicle_type,
        CASE WHEN ok THEN CASE WHEN want THEN txt END ELSE license_plate END AS license_plate,
        CASE WHEN ok THEN want ELSE plate_readable END AS plate_readable,
        CASE WHEN ok AND (sl OR sr) THEN 'manually_corrected' ELSE plate_status END AS plate_status,
        CASE WHEN ok AND (sl OR sr) THEN NULL ELSE plate_ocr_confidence END AS plate_ocr_confidence,
        CASE WHEN ok AND st THEN 'manual' ELSE vehicle_type_source END AS vehicle_type_source,
        CASE WHEN ok THEN coalesce(confidence, vehicle_confidence) ELSE confidence END AS confidence,
        CASE WHEN ok THEN coalesce(vehicle_confidence, confidence) ELSE vehicle_confidence END AS vehicle_confidence,
        extra IS NULL AS bare, CASE WHEN ok THEN true ELSE coalesce(extra LIKE '%"manually_corrected":true%', false) END AS flagged,
        coalesce(json_extract_string(extra, '$.notes'), '') AS notes, coalesce(CAST(json_extract(extra, '$.plate_ocr_disagreement_positions[1]') AS integer), 0) AS second_position,
        coalesce(CAST(json_extract(extra, '$.evidence[0].score') AS integer), 0) AS evidence_score
    FROM (SELECT * REPLACE (CASE WHEN ok THEN json_merge_patch(coalesce(extra, '{{}}'), '{{"manually_corrected":true}}') ELSE extra END AS extra) FROM go) g""",
)
def _(fx):
    corrected, _rejected = _corrected(fx)
    return corrected.select(
        "detection_id", "vehicle_type", "license_plate", "plate_readable", "plate_status", "plate_ocr_confidence", "vehicle_type_source", "confidence", "vehicle_confidence",
        F.col("extra").isNull().alias("bare"), F.coalesce(F.col("extra").contains('"manually_corrected":true'), F.lit(False)).alias("flagged"),
        F.coalesce(F.get_json_object("extra", "$.notes"), F.lit("")).alias("notes"),
        F.coalesce(F.get_json_object("extra", "$.plate_ocr_disagreement_positions[1]").cast("int"), F.lit(0)).alias("second_position"),
        F.coalesce(F.get_json_object("extra", "$.evidence[0].score").cast("int"), F.lit(0)).alias("evidence_score"),
    )


@query("rejected_corrections", f"WITH {PATCHED} SELECT detection_id, reject AS reason FROM v WHERE reject IS NOT NULL")
def _(fx):
    return _corrected(fx)[1]


NOTED = """SELECT detection_id, CASE WHEN box_idx % 2 = 0 THEN 'seen twice' WHEN box_idx % 3 = 0 THEN '' END AS notes,
    CASE WHEN box_idx % 3 = 1 THEN {three} ELSE {empty} END AS plate_ocr_disagreement_positions FROM v_detection"""


@query(
    "build_extra",
    """SELECT detection_id, nullif('{' || concat_ws(',', CASE WHEN box_idx % 2 = 0 THEN '"notes":"seen twice"' END,
        CASE WHEN box_idx % 3 = 1 THEN '"plate_ocr_disagreement_positions":[1,4]' END) || '}', '{}') AS extra FROM v_detection""",
)
def _(fx):
    noted = fx.sql(NOTED.format(three="array(1, 4)", empty="cast(array() AS array<int>)"))
    return op.build_extra(noted).select("detection_id", "extra")


#: Nested results per image, as a provider returns them.
NESTED = """SELECT image_id, collect_list(named_struct('vehicle_type', vehicle_type, 'manufacturer', manufacturer, 'model', cast(NULL AS string),
    'license_plate', license_plate, 'plate_readable', plate_readable, 'confidence', confidence, 'vehicle_confidence', cast(NULL AS double),
    'manufacturer_confidence', cast(NULL AS double), 'source_label', concat('c', cast(box_idx AS string)), 'vehicle_type_source', vehicle_type_source,
    'vehicle_type_confidence', cast(NULL AS double), 'bbox', named_struct('x1', bbox_x1, 'y1', bbox_y1, 'x2', bbox_x2, 'y2', bbox_y2),
    'plate', CASE WHEN plate_text_raw IS NOT NULL THEN named_struct('bbox', named_struct('x1', bbox_x1, 'y1', bbox_y1, 'x2', bbox_x2, 'y2', bbox_y2),
        'detection_confidence', confidence, 'ocr_confidence', plate_ocr_confidence, 'text_raw', plate_text_raw, 'plate_format', cast(NULL AS string),
        'region', cast(NULL AS string), 'ocr_engine', 'ppocr', 'ocr_variant', 'raw', 'rectified', false, 'perspective_skew', cast(NULL AS double),
        'status', plate_status) END)) AS detections FROM v_detection GROUP BY image_id"""


@query(
    "flatten_recognition",
    """SELECT image_id, 'c' || box_idx AS source_label, vehicle_type, license_plate, plate_readable, confidence, bbox_x1,
        CASE WHEN plate_text_raw IS NOT NULL THEN bbox_y2 END AS plate_bbox_y2, plate_text_raw,
        CASE WHEN plate_text_raw IS NOT NULL THEN plate_ocr_confidence END AS plate_ocr_confidence,
        CASE WHEN plate_text_raw IS NOT NULL THEN 'ppocr' END AS plate_ocr_engine,
        CASE WHEN plate_text_raw IS NOT NULL THEN plate_status END AS plate_status FROM v_detection""",
)
def _(fx):
    return op.flatten_recognition(fx.sql(NESTED)).select(
        "image_id", "source_label", "vehicle_type", "license_plate", "plate_readable", "confidence", "bbox_x1", "plate_bbox_y2",
        "plate_text_raw", "plate_ocr_confidence", "plate_ocr_engine", "plate_status",
    )


MIRROR = """SELECT detection_id, plate_readable OR box_idx = 4 AS plate_readable, concat(' ', lower(license_plate), '  x ') AS license_plate,
    CASE WHEN box_idx % 2 = 0 THEN confidence END AS confidence, CASE WHEN box_idx % 3 = 0 THEN confidence / 2 END AS vehicle_confidence FROM v_detection"""


@query(
    "mirror_confidence",
    f"""SELECT detection_id, plate_readable, CASE WHEN plate_readable THEN regexp_replace(trim(upper(license_plate)), '\\s+', ' ', 'g') END AS license_plate,
        coalesce(confidence, vehicle_confidence) AS confidence, coalesce(vehicle_confidence, confidence) AS vehicle_confidence,
        NOT (plate_readable AND license_plate IS NULL) AS valid
    FROM (SELECT detection_id, plate_readable, CASE WHEN license_plate IS NOT NULL THEN license_plate END AS license_plate, confidence, vehicle_confidence
          FROM ({MIRROR.replace("concat(' ', lower(license_plate), '  x ')", "' ' || lower(license_plate) || '  x '")}) t) u""",
)
def _(fx):
    return op.mirror_confidence(fx.sql(MIRROR))


@query("idle_images", "SELECT image_id FROM v_image WHERE image_id NOT IN (SELECT image_id FROM v_job WHERE status IN ('pending', 'processing'))")
def _(fx):
    return op.idle_images(fx.v_image, fx.v_job).select("image_id")


@query("active_conflicts", "SELECT image_id FROM v_image WHERE image_id IN (SELECT image_id FROM v_job WHERE status IN ('pending', 'processing'))")
def _(fx):
    return op.active_conflicts(fx.v_image, fx.v_job).select("image_id")


@query(
    "cascade_delete",
    """WITH gone AS (SELECT image_id FROM v_image WHERE mime_type = 'image/gif')
    SELECT 'image' AS kind, image_id AS id, NULL::bigint AS job_id FROM v_image WHERE image_id NOT IN (FROM gone)
    UNION ALL SELECT 'job', job_id, job_id FROM v_job WHERE image_id NOT IN (FROM gone) AND status <> 'failed'
    UNION ALL SELECT 'detection', d.detection_id, CASE WHEN j.status = 'failed' THEN NULL ELSE d.image_id * 3 END
    FROM v_detection d LEFT JOIN v_job j ON j.job_id = d.image_id * 3 WHERE d.image_id NOT IN (FROM gone)""",
)
def _(fx):
    dets = fx.v_detection.withColumn("job_id", F.col("image_id") * 3)
    images, jobs, dets = op.cascade_delete(
        fx.v_image, fx.v_job, dets, fx.v_image.filter("mime_type = 'image/gif'"), fx.v_job.filter("status = 'failed'")
    )
    return (
        images.select(F.lit("image").alias("kind"), F.col("image_id").alias("id"), F.lit(None).cast("bigint").alias("job_id"))
        .unionByName(jobs.select(F.lit("job").alias("kind"), F.col("job_id").alias("id"), "job_id"))
        .unionByName(dets.select(F.lit("detection").alias("kind"), F.col("detection_id").alias("id"), "job_id"))
    )
