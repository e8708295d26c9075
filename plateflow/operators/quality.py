"""Audits, backfills and clean-up reports."""

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateflow import dims
from plateflow.functions import expr
from plateflow.operators.results import BOX_COLUMNS, PLATE_BOX_COLUMNS, complete_detections
from plateflow.operators.skew import top_per_key


def constraint_rules() -> dict[str, Column]:
    """The row checks of the detection table. As in SQL, a check that is null passes."""

    def share(name: str) -> Column:
        return F.col(name).isNull() | ((F.col(name) >= 0) & (F.col(name) <= 1))

    plate_box = [F.col(name) for name in PLATE_BOX_COLUMNS]
    no_plate_box = plate_box[0].isNull() & plate_box[1].isNull() & plate_box[2].isNull() & plate_box[3].isNull()
    text = F.col("license_plate")
    return {
        "bbox": expr.valid_box(*[F.col(name) for name in BOX_COLUMNS]),
        "confidence": share("confidence"),
        "plate": (F.col("plate_readable") & text.isNotNull()) | (~F.col("plate_readable") & text.isNull()),
        "plate_bbox": no_plate_box | expr.valid_box(*plate_box),
        "stage_confidences": share("plate_detection_confidence") & share("plate_ocr_confidence") & share("vehicle_confidence"),
        "vehicle_type_confidence": share("vehicle_type_confidence"),
    }


def audit_constraints(detections: DataFrame, images: DataFrame | None = None, jobs: DataFrame | None = None) -> DataFrame:
    """Violations per rule with the lowest offending id: the six row checks in one pass, dangling
    image and job keys, and images with more than one active job."""
    dets = complete_detections(detections)
    found = []
    rules = constraint_rules()
    broken = F.array(*[
        F.struct(F.lit(name).alias("rule"), (~F.coalesce(rule, F.lit(True))).alias("bad")) for name, rule in rules.items()
    ])
    checks = dets.select("detection_id", F.inline(broken))
    found.append(checks.groupBy("rule").agg(
        F.count_if("bad").alias("violations"), F.min(F.when(F.col("bad"), F.col("detection_id"))).alias("sample")
    ))
    whole = F.lit(1)
    if images is not None:
        dangling = dets.join(images.select("image_id"), "image_id", "left_anti")
        found.append(dangling.agg(F.count(whole).alias("violations"), F.min("detection_id").alias("sample")).select(
            F.lit("dangling_image").alias("rule"), "violations", "sample"))
    if jobs is not None and "job_id" in dets.columns:
        lost = dets.filter(F.col("job_id").isNotNull()).join(jobs.select("job_id"), "job_id", "left_anti")
        found.append(lost.agg(F.count(whole).alias("violations"), F.min("detection_id").alias("sample")).select(
            F.lit("dangling_job").alias("rule"), "violations", "sample"))
    if jobs is not None:
        active = jobs.filter(F.col("status").isin(*dims.ACTIVE_STATUSES)).groupBy("image_id").agg(F.count(whole).alias("n"))
        found.append(active.filter("n > 1").agg(F.count(whole).alias("violations"), F.min("image_id").alias("sample")).select(
            F.lit("one_active_job").alias("rule"), "violations", "sample"))
    report = found[0]
    for part in found[1:]:
        report = report.unionByName(part)
    return report


def resolve_duplicate_jobs(jobs: DataFrame) -> DataFrame:
    """Interrupted jobs go back to pending; then only the newest pending job of an image stays and
    the others fail. The newest is found by partial maxima and joined back, so a long job history
    is never sorted as one group."""
    reset = jobs.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))
    newest = (
        reset.filter(F.col("status") == "pending").groupBy("image_id")
        .agg(F.max(F.struct("created_at", "job_id")).alias("_newest"))
        .select("image_id", F.col("_newest.job_id").alias("_keep"))
    )
    superseded = (F.col("status") == "pending") & (F.col("job_id") != F.col("_keep"))
    return (
        reset.join(newest, "image_id", "left")
        .withColumn("error_message", F.when(superseded, dims.SUPERSEDED).otherwise(F.col("error_message")))
        .withColumn("status", F.when(superseded, "failed").otherwise(F.col("status")))
        .drop("_keep")
        .select(*jobs.columns)
    )


def backfill_plate_flags(detections: DataFrame) -> DataFrame:
    """No text for an unreadable or blank plate, and no readable flag without text."""
    blank = F.coalesce(F.trim("license_plate") == "", F.lit(False))
    cleared = detections.withColumn("license_plate", F.when(F.col("plate_readable") & ~blank, F.col("license_plate")))
    return cleared.withColumn("plate_readable", F.col("plate_readable") & F.col("license_plate").isNotNull())


def backfill_confidence(detections: DataFrame) -> DataFrame:
    return complete_detections(detections).withColumn("vehicle_confidence", F.coalesce("vehicle_confidence", "confidence"))


def backfill_type_source(detections: DataFrame) -> DataFrame:
    """Rows without a stated source were typed by the detector, with the detector's confidence."""
    dets = complete_detections(detections)
    unknown = F.col("vehicle_type_source").isNull()
    return dets.withColumns({
        "vehicle_type_source": F.coalesce("vehicle_type_source", F.lit("detector")),
        "vehicle_type_confidence": F.when(unknown, F.col("vehicle_confidence")).otherwise(F.col("vehicle_type_confidence")),
    })


def job_health(jobs: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    """Jobs per status: how many could be claimed now, how many of those are out of attempts, and
    the oldest one waiting."""
    lapsed = (F.col("status") == "processing") & (F.col("lease_expires_at") < now)
    claimable = (F.col("status") == "pending") | F.coalesce(lapsed, F.lit(False))
    exhausted = claimable & (F.col("attempts") >= max_attempts)
    oldest = F.min(F.when(claimable, F.struct("created_at", "job_id")))
    return jobs.groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(claimable).alias("claimable"),
        F.count_if(exhausted).alias("exhausted"),
        oldest["job_id"].alias("oldest_job_id"),
    )


def next_jobs(jobs: DataFrame, now: Column, limit: int, max_attempts: int = 3) -> DataFrame:
    """The jobs a worker would take next, oldest first; a report that claims nothing."""
    lapsed = (F.col("status") == "processing") & (F.col("lease_expires_at") < now)
    waiting = jobs.filter((F.col("status") == "pending") | lapsed)
    marked = waiting.withColumn("would_fail", F.col("attempts") >= max_attempts)
    return marked.orderBy("created_at", "job_id").limit(limit)


def orphan_files(files: DataFrame, images: DataFrame, detections: DataFrame, now: Column, min_age_hours: float = 24) -> DataFrame:
    """Stored files that no row refers to and that are older than the cutoff. A report: nothing
    is deleted. ``images`` has stored_filename and annotated_filename."""
    dets = complete_detections(detections)

    def used(df: DataFrame, folder: str, column: Column | str) -> DataFrame:
        name = F.col(column) if isinstance(column, str) else column
        return df.select(F.lit(folder).alias("folder"), name.alias("filename"))

    thumb = F.concat(F.regexp_replace("stored_filename", r"\.[^.]*$", ""), F.lit(".jpg"))
    referenced = (
        used(images, "uploads", "stored_filename").unionByName(used(images, "thumbs", thumb))
        .unionByName(used(images, "annotated", "annotated_filename"))
        .unionByName(used(dets, "plates", "plate_crop_filename"))
        .unionByName(used(dets, "plates", "plate_rectified_crop_filename"))
        .filter(F.col("filename").isNotNull())
    )
    cutoff = now - F.expr(f"INTERVAL {int(min_age_hours * 3600)} SECOND")
    return files.filter(F.col("modified_at") < cutoff).join(referenced, ["folder", "filename"], "left_anti")


def scan_text_for_plates(docs: DataFrame) -> DataFrame:
    """Documents that quote plate-like strings, with the number of them, over the whole text."""
    hits = F.regexp_count("text", F.lit(r"\b\d{3}\s?[A-Z]{3}\s?\d{2}\b"))
    return docs.withColumn("hits", hits.cast("bigint")).filter(F.col("hits") > 0)


def glob_to_regex(pattern: str) -> str:
    """``**/`` is any number of folders, ``**`` anything, ``*`` and ``?`` stay inside a name."""
    regex, rest = "", pattern
    while rest:
        if rest.startswith("**/"):
            regex, rest = regex + "(?:[^/]+/)*", rest[3:]
        elif rest.startswith("**"):
            regex, rest = regex + ".*", rest[2:]
        elif rest[0] in "*?":
            regex, rest = regex + ("[^/]*" if rest[0] == "*" else "[^/]"), rest[1:]
        else:
            regex, rest = regex + re.escape(rest[0]), rest[1:]
    return f"^{regex}$"


def classify_release_paths(files: DataFrame, rules: Sequence[dims.PathRule], path: str = "path") -> DataFrame:
    """Each file as secret, sensitive or publishable, by the first rule that matches. The rules
    are a short constant list, so they are tested in place instead of joined."""
    label = F.struct(F.lit("publishable").alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("reason"))
    chain = label
    for rule in reversed(rules):
        hit = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.pattern).alias("rule"), F.lit(rule.reason).alias("reason"))
        chain = F.when(F.col(path).rlike(glob_to_regex(rule.pattern)), hit).otherwise(chain)
    return files.withColumn("_label", chain).select(*files.columns, "_label.*")


def release_summary(classified: DataFrame, size: str = "bytes") -> DataFrame:
    return classified.groupBy("kind", "rule").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))


def filter_licensed(candidates: DataFrame, per_term: int = 4, allowed: str = dims.ALLOWED_LICENCES,
                    types=dims.ALLOWED_PHOTO_TYPES) -> DataFrame:
    """Photo candidates (term, position, licence, mime) whose licence, freed of HTML tags, may be
    redistributed; the first ``per_term`` of each search term."""
    plain = F.trim(F.regexp_replace(F.coalesce("licence", F.lit("")), "<[^>]+>", ""))
    usable = candidates.withColumn("licence", plain).filter(
        F.col("licence").rlike(f"(?i){allowed}") & F.col("mime").isin(*types)
    )
    return top_per_key(usable, ["term"], [F.col("position").asc()], per_term)


def digest_manifest(files: DataFrame, content: str = "content") -> DataFrame:
    """sha-256 of each file (path, content); binary and text content alike."""
    return files.select("path", F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def audit_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """State of each pinned or present file: ok, missing, mismatch or unpinned. A pin without a
    digest accepts any content."""
    e, a = expected.select("path", F.col("sha256").alias("pinned"), F.lit(True).alias("_e")), actual.select("path", "sha256", F.lit(True).alias("_a"))
    joined = e.join(a, "path", "full_outer")
    state = (
        F.when(F.col("_e").isNull(), "unpinned")
        .when(F.col("_a").isNull(), "missing")
        .when((F.coalesce("pinned", F.lit("")) == "") | (F.col("pinned") == F.col("sha256")), "ok")
        .otherwise("mismatch")
    )
    return joined.select("path", "pinned", "sha256", state.alias("state"))


def manifest_problems(audit: DataFrame) -> DataFrame:
    return audit.groupBy("state").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("state").isin("missing", "mismatch")).alias("problems")
    )


def duplicate_content(digests: DataFrame) -> DataFrame:
    """Digests shared by several files. Only counts and the first path are kept per digest."""
    return digests.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")
