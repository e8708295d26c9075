"""Audits, backfills, reports and what comes in."""

from pyspark.sql import functions as F

from plateflow import dims
from plateflow.functions import expr
from plateflow.operators import quality as op
from plateflow.plans import parts as p
from plateflow.plans.registry import query
from plateflow.sources import ingest

NOW = "TIMESTAMP '2024-01-15 00:00:00'"


def _now():
    return F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")


# ---- audits --------------------------------------------------------------------------------

DIRTY = """SELECT detection_id, CASE WHEN detection_id % 101 = 0 THEN -1 ELSE image_id END AS image_id, CASE WHEN box_idx % 3 = 0 THEN NULL ELSE image_id * 3 END AS job_id, vehicle_type, license_plate,
    CASE WHEN detection_id % 31 = 0 THEN NOT plate_readable ELSE plate_readable END AS plate_readable,
    CASE WHEN detection_id % 17 = 0 THEN confidence + 1 ELSE confidence END AS confidence,
    bbox_x1, bbox_y1, CASE WHEN detection_id % 13 = 0 THEN bbox_x1 ELSE bbox_x2 END AS bbox_x2, bbox_y2,
    CASE WHEN detection_id % 7 = 0 THEN bbox_x1 END AS plate_bbox_x1, CASE WHEN detection_id % 7 = 0 THEN bbox_y1 END AS plate_bbox_y1,
    CASE WHEN detection_id % 14 = 0 THEN bbox_x2 END AS plate_bbox_x2, CASE WHEN detection_id % 14 = 0 THEN bbox_y2 END AS plate_bbox_y2,
    CASE WHEN detection_id % 19 = 0 THEN -confidence - 0.1 END AS plate_ocr_confidence,
    CASE WHEN detection_id % 23 = 0 THEN 1.5 ELSE confidence END AS vehicle_type_confidence FROM v_detection"""
RULES = {
    "bbox": "bbox_x1 >= 0 AND bbox_y1 >= 0 AND bbox_x2 <= 1 AND bbox_y2 <= 1 AND bbox_x2 > bbox_x1 AND bbox_y2 > bbox_y1",
    "confidence": "confidence IS NULL OR confidence BETWEEN 0 AND 1",
    "plate": "(plate_readable AND license_plate IS NOT NULL) OR (NOT plate_readable AND license_plate IS NULL)",
    "plate_bbox": "(plate_bbox_x1 IS NULL AND plate_bbox_y1 IS NULL AND plate_bbox_x2 IS NULL AND plate_bbox_y2 IS NULL) OR (plate_bbox_x1 >= 0 "
    "AND plate_bbox_y1 >= 0 AND plate_bbox_x2 <= 1 AND plate_bbox_y2 <= 1 AND plate_bbox_x2 > plate_bbox_x1 AND plate_bbox_y2 > plate_bbox_y1)",
    "stage_confidences": "plate_ocr_confidence IS NULL OR plate_ocr_confidence BETWEEN 0 AND 1",
    "vehicle_type_confidence": "vehicle_type_confidence IS NULL OR vehicle_type_confidence BETWEEN 0 AND 1",
}


@query(
    "audit_constraints",
    f"WITH d AS ({DIRTY}) " + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS violations, min(detection_id) AS sample FROM d WHERE NOT coalesce({rule}, true)" for name, rule in RULES.items()
    ) + """ UNION ALL SELECT 'dangling_image', count(*), min(detection_id) FROM d WHERE image_id NOT IN (SELECT image_id FROM v_image)
    UNION ALL SELECT 'dangling_job', count(*), min(detection_id) FROM d WHERE job_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_job j WHERE j.job_id = d.job_id)
    UNION ALL SELECT 'one_active_job', count(*), min(image_id) FROM (
        SELECT image_id FROM v_job WHERE status IN ('pending', 'processing') GROUP BY image_id HAVING count(*) > 1) a""",
)
def _(fx):
    return op.audit_constraints(fx.sql(DIRTY), fx.v_image, fx.v_job)


@query(
    "backfill_plate_flags",
    """WITH d AS (SELECT detection_id, license_plate, plate_readable FROM ({src}) t),
    c AS (SELECT detection_id, CASE WHEN NOT plate_readable OR trim(license_plate) = '' THEN NULL ELSE license_plate END AS license_plate, plate_readable FROM d)
    SELECT detection_id, license_plate, CASE WHEN license_plate IS NULL THEN false ELSE plate_readable END AS plate_readable FROM c""".replace(
        "{src}", "SELECT detection_id, CASE WHEN box_idx % 4 = 3 THEN '  ' ELSE license_plate END AS license_plate, plate_readable OR box_idx % 2 = 1 AS plate_readable FROM v_detection"),
)
def _(fx):
    rows = fx.sql("""SELECT detection_id, CASE WHEN box_idx % 4 = 3 THEN '  ' ELSE license_plate END AS license_plate,
        plate_readable OR box_idx % 2 = 1 AS plate_readable FROM v_detection""")
    return op.backfill_plate_flags(rows)


LEGACY = """SELECT detection_id, confidence, CASE WHEN box_idx % 2 = 0 THEN confidence / 2 END AS vehicle_confidence,
    CASE WHEN box_idx % 3 = 0 THEN 'badge_text' END AS vehicle_type_source, CASE WHEN box_idx % 3 = 0 THEN confidence / 4 END AS vehicle_type_confidence
    FROM v_detection"""


@query(
    "backfill_confidence",
    f"SELECT detection_id, coalesce(vehicle_confidence, confidence) AS vehicle_confidence FROM ({LEGACY}) t",
)
def _(fx):
    return op.backfill_confidence(fx.sql(LEGACY)).select("detection_id", "vehicle_confidence")


@query(
    "backfill_type_source",
    f"""SELECT detection_id, coalesce(vehicle_type_source, 'detector') AS vehicle_type_source,
        CASE WHEN vehicle_type_source IS NULL THEN vehicle_confidence ELSE vehicle_type_confidence END AS vehicle_type_confidence FROM ({LEGACY}) t""",
)
def _(fx):
    return op.backfill_type_source(fx.sql(LEGACY)).select("detection_id", "vehicle_type_source", "vehicle_type_confidence")


@query(
    "resolve_duplicate_jobs",
    f"""WITH r AS (SELECT * REPLACE (CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status) FROM v_job),
    n AS (SELECT *, CASE WHEN status = 'pending' THEN row_number() OVER (PARTITION BY image_id, status ORDER BY created_at DESC, job_id DESC) END AS k FROM r)
    SELECT job_id, image_id, CASE WHEN k > 1 THEN 'failed' ELSE status END AS status,
           CASE WHEN k > 1 THEN '{dims.SUPERSEDED}' ELSE error_message END AS error_message FROM n""",
)
def _(fx):
    return op.resolve_duplicate_jobs(fx.v_job).select("job_id", "image_id", "status", "error_message")


CLAIM = f"(status = 'pending' OR (status = 'processing' AND lease_expires_at < {NOW}))"


@query(
    "job_health",
    f"""SELECT status, count(*) AS jobs, count(*) FILTER (WHERE {CLAIM}) AS claimable, count(*) FILTER (WHERE {CLAIM} AND attempts >= 3) AS exhausted,
        first(job_id ORDER BY created_at, job_id) FILTER (WHERE {CLAIM}) AS oldest_job_id FROM v_job GROUP BY status""",
)
def _(fx):
    return op.job_health(fx.v_job, _now())


@query(
    "next_jobs",
    f"SELECT job_id, image_id, attempts >= 3 AS would_fail FROM v_job WHERE {CLAIM} ORDER BY created_at, job_id LIMIT 25",
)
def _(fx):
    return op.next_jobs(fx.v_job, _now(), 25).select("job_id", "image_id", "would_fail")


#: Every image, those of one type under a name that no stored file has.
STORED = """SELECT image_id, concat(CASE WHEN mime_type = 'image/gif' THEN 'moved' ELSE 'a' END, cast(image_id AS string), '.jpg') AS stored_filename,
    CASE WHEN mime_type = 'image/gif' THEN concat('moved', annotated_filename) ELSE annotated_filename END AS annotated_filename FROM v_image"""
CROPPED = """SELECT detection_id, CASE WHEN box_idx = 1 AND image_id % 5 <> 0 THEN concat('a', cast(image_id AS string), '.jpg') END AS plate_crop_filename FROM v_detection"""


@query(
    "orphan_files",
    f"""WITH s AS ({STORED}), used AS (
        SELECT 'uploads' AS folder, stored_filename AS filename FROM s UNION SELECT 'thumbs', stored_filename FROM s
        UNION SELECT 'annotated', annotated_filename FROM s WHERE annotated_filename IS NOT NULL
        UNION SELECT 'plates', plate_crop_filename FROM ({CROPPED}) c WHERE plate_crop_filename IS NOT NULL)
    SELECT f.folder, f.filename FROM v_stored_file f WHERE f.modified_at < {NOW.replace('2024-01-15', '1997-01-15')} - INTERVAL 86400 SECOND
      AND NOT EXISTS (SELECT 1 FROM used u WHERE u.folder = f.folder AND u.filename = f.filename)""",
)
def _(fx):
    now = F.lit("1997-01-15 00:00:00").cast("timestamp_ntz")
    return op.orphan_files(fx.v_stored_file, fx.sql(STORED), fx.sql(CROPPED), now).select("folder", "filename")


@query(
    "scan_text_for_plates",
    r"""SELECT doc_id, source, len(regexp_extract_all(text, '\b\d{3}\s?[A-Z]{3}\s?\d{2}\b')) AS hits FROM v_doc_text
    WHERE regexp_matches(text, '\b\d{3}\s?[A-Z]{3}\s?\d{2}\b')""",
)
def _(fx):
    return op.scan_text_for_plates(fx.v_doc_text).select("doc_id", "source", "hits")


PATHS = """SELECT concat(CASE folder WHEN 'uploads' THEN 'incoming/day1/' WHEN 'annotated' THEN 'drawn/' WHEN 'plates' THEN 'out/crops/' ELSE 'pages/' END,
    CASE WHEN length(filename) % 5 = 0 THEN concat('vault/', filename) WHEN filename LIKE '%7.jpg' THEN 'table.csv' WHEN filename LIKE '%9.jpg' THEN 'token_old'
         ELSE filename END) AS path, length(filename) * 100 AS bytes FROM v_stored_file"""
#: Rules about the paths made above; the first that matches counts.
RULES_OF_RELEASE = (
    dims.PathRule("**/token_*", "secret", "a credential"),
    dims.PathRule("**/vault/*", "secret", "kept under lock"),
    dims.PathRule("incoming/**/*", "sensitive", "unreviewed frames"),
    dims.PathRule("**/crops/*", "sensitive", "cut from frames"),
    dims.PathRule("**/table.*", "sensitive", "results as text"),
)
KIND = """CASE WHEN regexp_matches(path, '(^|/)token_[^/]*$') OR regexp_matches(path, '(^|/)vault/[^/]*$') THEN 'secret'
    WHEN starts_with(path, 'incoming/') OR regexp_matches(path, '(^|/)crops/[^/]*$') OR regexp_matches(path, '(^|/)table\\.[^/]*$') THEN 'sensitive'
    ELSE 'publishable' END"""


@query(
    "classify_release_paths",
    f"SELECT {KIND} AS kind, count(*) AS files, cast(sum(bytes) AS bigint) AS bytes FROM ({PATHS}) t GROUP BY 1",
)
def _(fx):
    summary = op.release_summary(op.classify_release_paths(fx.sql(PATHS), RULES_OF_RELEASE))
    return summary.groupBy("kind").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


CANDIDATES = """SELECT page_id AS position, {host} AS term, concat('<b>', CASE page_id % 5 WHEN 0 THEN 'CC BY 4.0' WHEN 1 THEN 'cc0' WHEN 2 THEN 'GFDL'
    WHEN 3 THEN 'CC BY-SA 3.0' ELSE 'Fair use' END, '</b> ') AS licence, CASE WHEN page_id % 4 = 0 THEN 'image/svg+xml' ELSE 'image/jpeg' END AS mime FROM pages"""
DUCK_HOST = r"regexp_extract(url, '\.([a-z]+\.[a-z]+)/', 1)"
SPARK_HOST = r"regexp_extract(url, '\\.([a-z]+\\.[a-z]+)/', 1)"


@query(
    "filter_licensed",
    f"""SELECT position, term, trim(regexp_replace(licence, '<[^>]+>', '', 'g')) AS licence FROM ({CANDIDATES.format(host=DUCK_HOST)}) c
    WHERE regexp_matches(lower(trim(regexp_replace(licence, '<[^>]+>', '', 'g'))), '{dims.ALLOWED_LICENCES}') AND mime IN ('image/jpeg', 'image/png')
    QUALIFY row_number() OVER (PARTITION BY term ORDER BY position) <= 4""",
)
def _(fx):
    return op.filter_licensed(fx.sql(CANDIDATES.format(host=SPARK_HOST))).select("position", "term", "licence")


@query("digest_manifest", "SELECT concat('doc', cast(doc_id AS string)) AS path, sha256(text) AS sha256 FROM documents")
def _(fx):
    return op.digest_manifest(fx.documents.select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.col("text").alias("content")))


#: Every document, some under a path that is not there, which leaves their own unpinned.
PINNED = """SELECT concat(CASE WHEN doc_id % 12 = 5 THEN 'gone' ELSE 'doc' END, cast(doc_id AS string)) AS path, CASE doc_id % 10 WHEN 1 THEN '' WHEN 2 THEN sha{a}(upper(text){b}) ELSE sha{a}(text{b}) END AS sha256
    FROM documents"""


@query(
    "audit_manifest",
    f"""WITH e AS ({PINNED.format(a='256', b='')}), a AS (SELECT concat('doc', cast(doc_id AS string)) AS path, sha256(text) AS sha256 FROM documents)
    SELECT coalesce(e.path, a.path) AS path, CASE WHEN e.path IS NULL THEN 'unpinned' WHEN a.path IS NULL THEN 'missing'
        WHEN e.sha256 = '' OR e.sha256 = a.sha256 THEN 'ok' ELSE 'mismatch' END AS state FROM e FULL JOIN a ON a.path = e.path""",
)
def _(fx):
    actual = op.digest_manifest(fx.documents.select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.col("text").alias("content")))
    return op.audit_manifest(fx.sql(PINNED.format(a="2", b=", 256")), actual).select("path", "state")


@query(
    "manifest_problems",
    f"""WITH e AS ({PINNED.format(a='256', b='')}), a AS (SELECT concat('doc', cast(doc_id AS string)) AS path, sha256(text) AS sha256 FROM documents),
    s AS (SELECT CASE WHEN e.path IS NULL THEN 'unpinned' WHEN a.path IS NULL THEN 'missing' WHEN e.sha256 = '' OR e.sha256 = a.sha256 THEN 'ok' ELSE 'mismatch' END AS state
          FROM e FULL JOIN a ON a.path = e.path)
    SELECT state, count(*) AS files, count(*) FILTER (WHERE state IN ('missing', 'mismatch')) AS problems FROM s GROUP BY state""",
)
def _(fx):
    actual = op.digest_manifest(fx.documents.select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.col("text").alias("content")))
    return op.manifest_problems(op.audit_manifest(fx.sql(PINNED.format(a="2", b=", 256")), actual))


@query(
    "duplicate_content",
    """SELECT sha256(text) AS sha256, count(*) AS copies, min('doc' || doc_id) AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def _(fx):
    return op.duplicate_content(op.digest_manifest(fx.documents.select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.col("text").alias("content"))))


# ---- what comes in -------------------------------------------------------------------------


@query("scan_image_listing")
def _(fx):
    """The files of the test tables themselves; SQL over the tables cannot see them."""
    listed = ingest.scan_image_listing(fx.spark, fx.sf_dir, recursive=True, suffixes=(".PARQUET",))
    return listed.select("name", "length")

UPLOADS = """SELECT image_id, cast(floor(image_id / 10) AS bigint) AS batch_id, CASE WHEN image_id % 13 = 0 THEN concat(mime_type, '; q=1') ELSE mime_type END AS mime_type,
    CASE WHEN image_id % 70 = 0 THEN 0 ELSE file_size END AS file_size,
    CASE WHEN image_id % 60 = 0 THEN NULL WHEN image_id % 45 = 0 THEN 'image/webp' ELSE mime_type END AS actual_type,
    CASE WHEN image_id % 80 = 0 THEN 30000 ELSE width END AS width, height, CASE WHEN image_id % 90 = 1 THEN 12 ELSE 1 END AS frames FROM v_image"""
VERDICT = """CASE WHEN split_part(lower(mime_type), ';', 1) NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 415 WHEN file_size > 20971520 THEN 413
    WHEN file_size = 0 THEN 400 WHEN actual_type IS NULL THEN 400 WHEN actual_type <> split_part(lower(mime_type), ';', 1) THEN 415
    WHEN width * height > 40000000 THEN 413 WHEN frames <> 1 THEN 415 END"""


@query("validate_uploads", f"SELECT image_id, cast({VERDICT} AS integer) AS code FROM ({UPLOADS}) u")
def _(fx):
    return ingest.validate_uploads(fx.sql(UPLOADS)).select("image_id", "code")


@query(
    "admit_batch",
    f"""WITH v AS (SELECT image_id, batch_id, {VERDICT} AS code FROM ({UPLOADS}) u)
    SELECT image_id, 'pending' AS status, 0::bigint AS attempts FROM v WHERE batch_id NOT IN (SELECT batch_id FROM v WHERE code IS NOT NULL)""",
)
def _(fx):
    return ingest.admit_batch(ingest.validate_uploads(fx.sql(UPLOADS)))[1]


MESSY = r"""SELECT image_id, concat('s', cast(image_id AS string), '.jpg') AS stored_filename,
    CASE image_id % 6 WHEN 0 THEN concat('C:{bs}photos{bs}', original_filename) WHEN 1 THEN concat('a/b/', original_filename) WHEN 2 THEN concat(' x', chr(7), chr(9), original_filename, ' ')
        WHEN 3 THEN NULL WHEN 4 THEN concat('dir/', chr(1), ' ') ELSE concat(repeat('long', 80), original_filename) END AS original_filename FROM v_image"""


@query(
    "clean_filenames",
    f"""SELECT image_id, coalesce(nullif(substr(trim(regexp_replace(list_last(string_split(replace(coalesce(original_filename, stored_filename), '\\', '/'), '/')),
        '[\\x00-\\x1f\\x7f]', '', 'g')), 1, 255), ''), stored_filename) AS clean_filename FROM ({MESSY.format(bs=chr(92))}) m""",
)
def _(fx):
    return ingest.clean_filenames(fx.sql(MESSY.format(bs=chr(92) * 2))).select("image_id", "clean_filename")


#: One label file per hundred images, written the way label files are.
LABEL_FILES = """SELECT concat('{"frames":{', concat_ws(',', collect_list(concat('"', cast(image_id AS string), '":{"category":"', category,
        '","plate":"', plate, '","manufacturer":', CASE WHEN manufacturer IS NULL THEN 'null' ELSE concat('"', manufacturer, '"') END, '}'))), '}}') AS value
    FROM v_plate_truth GROUP BY floor(image_id / 100)"""


@query("read_labels", "SELECT cast(image_id AS varchar) AS frame, category, plate, manufacturer FROM v_plate_truth")
def _(fx):
    return ingest.read_labels(fx.sql(LABEL_FILES)).select("frame", "category", "plate", "manufacturer")


@query(
    "read_label_groups",
    "SELECT cast(floor(image_id / 100) AS bigint) AS file_id, cast(floor((image_id % 100) / 2) AS integer) AS group_no, cast(image_id AS varchar) AS frame FROM v_plate_truth",
)
def _(fx):
    pairs = fx.sql("""SELECT cast(floor(image_id / 100) AS bigint) AS file_id, cast(floor((image_id % 100) / 2) AS int) AS group_no, collect_list(cast(image_id AS string)) AS members
        FROM v_plate_truth GROUP BY 1, 2""")
    files = pairs.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("group_no", "members"))).alias("g")).select(
        F.to_json(F.struct(F.transform("g", lambda g: g["members"]).alias("same_machine_groups"))).alias("value")
    )
    listed = ingest.read_label_groups(files)
    number = F.col("frame").cast("bigint")
    return listed.select(
        F.floor(number / 100).alias("file_id"), F.floor((number % 100) / 2).cast("int").alias("group_no"), "frame"
    )


MANIFEST = "SELECT concat('in/', original_filename) AS source, 'in' AS directory FROM v_image WHERE annotated_filename IS NULL"


@query("pending_sources", "SELECT concat('in/', original_filename) AS source FROM v_image WHERE annotated_filename IS NOT NULL")
def _(fx):
    files = fx.sql("SELECT concat('in/', original_filename) AS source FROM v_image")
    return ingest.pending_sources(files, fx.sql(MANIFEST), {"directory": "in"})


#: Raw answers made from detections, some of them broken in a known way.
ANSWERS = r"""SELECT detection_id, concat('{"choices":[{"finish_reason":"', CASE WHEN detection_id % 23 = 0 THEN 'length' ELSE 'stop' END, '","message":{"content":',
    CASE WHEN detection_id % 3 = 0 THEN to_json(array(named_struct('type', 'text', 'text', body))) ELSE concat('"', replace(replace(body, '"', '\\"'), chr(10), '\\n'), '"') END,
    '}}]', CASE WHEN detection_id % 29 = 0 THEN '' ELSE '}' END) AS raw
    FROM (SELECT detection_id, concat(CASE WHEN detection_id % 2 = 0 THEN concat('```json', chr(10)) ELSE '' END,
        CASE WHEN detection_id % 31 = 0 THEN '[1]' ELSE concat('{"detections":[{"vehicle_type":"', vehicle_type, '","confidence":', cast(confidence AS string),
            ',"plate_readable":', CASE WHEN detection_id % 37 = 0 THEN 'true' ELSE 'false' END, CASE WHEN detection_id % 41 = 0 THEN ',"colour":"red"' ELSE '' END,
            ',"bbox":{"x1":', cast(bbox_x1 AS string), ',"y1":', cast(bbox_y1 AS string), ',"x2":', CASE WHEN detection_id % 43 = 0 THEN '1.5' ELSE cast(bbox_x2 AS string) END,
            ',"y2":', cast(bbox_y2 AS string), '}', CASE WHEN plate_text_raw IS NULL THEN '' ELSE concat(',"plate":{"detection_confidence":', CASE WHEN detection_id % 47 = 0 THEN '7' ELSE '0.5' END,
            ',"text":"', plate_text_raw, '","text_raw":"', plate_text_raw, '","readable":', CASE WHEN detection_id % 5 = 0 THEN 'true' ELSE 'false' END, CASE WHEN detection_id % 53 = 0 THEN ',"shade":1' ELSE '' END,
            ',"alternatives":[{"text":"', plate_text_raw, '"}],"bbox":{"x1":0.1,"y1":0.1,"x2":', CASE WHEN detection_id % 59 = 0 THEN '0.05' ELSE '0.2' END, ',"y2":0.2}}') END, '}]}') END, CASE WHEN detection_id % 2 = 0 THEN concat(chr(10), '```') ELSE '' END) AS body FROM v_detection) t"""


BAD_PLATE = "(plate_text_raw IS NOT NULL AND (detection_id % 47 = 0 OR detection_id % 53 = 0 OR detection_id % 59 = 0))"


@query(
    "parse_recognition_json",
    f"""WITH j AS (SELECT *, CASE WHEN detection_id % 29 = 0 THEN 'not_json' WHEN detection_id % 23 = 0 THEN 'truncated_or_filtered' WHEN detection_id % 31 = 0 THEN 'not_an_object'
        WHEN detection_id % 37 = 0 OR detection_id % 41 = 0 OR detection_id % 43 = 0 OR {BAD_PLATE} THEN 'schema' END AS problem FROM v_detection)
    SELECT detection_id, problem, CASE WHEN problem IS NULL THEN vehicle_type END AS vehicle_type, CASE WHEN problem IS NULL THEN confidence END AS vehicle_confidence,
        CASE WHEN problem IS NULL AND detection_id % 5 = 0 THEN plate_text_raw END AS plate_text, CASE WHEN problem IS NULL THEN plate_text_raw END AS alternative FROM j""",
)
def _(fx):
    first = F.get("detections", 0)
    return ingest.parse_recognition_json(fx.sql(ANSWERS)).select(
        "detection_id", "problem", first["vehicle_type"].alias("vehicle_type"), first["vehicle_confidence"].alias("vehicle_confidence"), first["plate"]["text"].alias("plate_text"),
        F.get(first["plate"]["alternatives"], 0)["text"].alias("alternative"),
    )
