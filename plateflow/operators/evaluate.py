"""Evaluation of results against hand labels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateflow.functions import expr
from plateflow.operators.results import complete_detections, has_plate


def model_vs_truth(truth: DataFrame, detections: DataFrame, order: str = "detection_id") -> DataFrame:
    """Per labelled image: the first accepted plate, the first raw text, the first plate status,
    the manufacturer of the accepted detection (else the first one stated), and how far the plate
    is from the label. ``first`` is by ``order``; all of it is one partial aggregation."""
    dets = complete_detections(detections)

    def first(condition: Column, *names: str) -> Column:
        return F.min(F.when(condition, F.struct(order, *names)))

    taken = F.col("plate_readable") & (F.coalesce("license_plate", F.lit("")) != "")
    facts = dets.groupBy("image_id").agg(
        first(taken, "license_plate", "manufacturer", "plate_ocr_confidence", "plate_ocr_engine", "plate_ocr_variant", "plate_rectified").alias("_best"),
        first(F.coalesce("manufacturer", F.lit("")) != "", "manufacturer").alias("_maker"),
        first(has_plate() & (F.coalesce("plate_text_raw", F.lit("")) != ""), "plate_text_raw").alias("_raw"),
        first(has_plate(), "plate_status").alias("_status"),
        F.count(F.lit(1)).alias("_n"),
    )
    expected = expr.norm_alnum("plate")
    actual = expr.norm_alnum(F.col("_best.license_plate"))
    return (
        truth.select("image_id", "category", "plate", F.col("manufacturer").alias("expected_manufacturer"))
        .join(facts, "image_id", "left")
        .select(
            "image_id", "category",
            F.col("plate").alias("expected_plate"),
            "expected_manufacturer",
            F.col("_best.license_plate").alias("reported_plate"),
            F.when(F.col("_best").isNotNull(), F.col("_best.manufacturer")).otherwise(F.col("_maker.manufacturer")).alias("reported_manufacturer"),
            F.col("_status").isNotNull().alias("plate_box_found"),
            F.col("_raw.plate_text_raw").alias("best_raw_text"),
            F.col("_best.plate_ocr_confidence").alias("ocr_confidence"),
            F.col("_best.plate_rectified").alias("rectified"),
            F.when(F.col("_status").isNull(), "no_plate_box").otherwise(F.col("_status.plate_status")).alias("status"),
            F.coalesce("_n", F.lit(0)).cast("bigint").alias("vehicles"),
            ((expected != "") & (expected == actual)).alias("exact_match"),
            F.when(expected != "", F.levenshtein(expected, actual)).cast("bigint").alias("char_errors"),
        )
    )


def plate_eval_summary(rows: DataFrame, seconds: str | None = None) -> DataFrame:
    """One-row report over :func:`model_vs_truth`; ratios are written as ``a/b``."""
    kind = F.col("category")
    legible = kind.isin("readable", "partial")
    reported = F.coalesce("reported_plate", F.lit("")) != ""
    labelled = F.coalesce("expected_manufacturer", F.lit("")) != ""
    stated = F.coalesce("reported_manufacturer", F.lit("")) != ""

    def ratio(hit: Column, among: Column) -> Column:
        return F.concat_ws("/", F.count_if(among & F.coalesce(hit, F.lit(False))).cast("string"), F.count_if(among).cast("string"))

    mean_seconds = F.round(F.avg(seconds), 2) if seconds else F.lit(None).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(kind == "readable").alias("readable_frames"),
        F.count_if(kind == "partial").alias("partial_frames"),
        F.count_if(kind == "none_legible").alias("none_legible_frames"),
        ratio(F.col("plate_box_found"), legible).alias("localised"),
        ratio(F.col("exact_match"), kind == "readable").alias("exact_on_readable"),
        F.coalesce(F.sum(F.when(kind == "readable", F.col("char_errors"))), F.lit(0)).alias("char_errors_on_readable"),
        ratio(~reported, kind == "partial").alias("abstained_on_partial"),
        ratio(reported, kind == "none_legible").alias("false_accepts_on_none_legible"),
        ratio(F.col("reported_manufacturer") == F.col("expected_manufacturer"), labelled).alias("manufacturer_correct"),
        F.count_if(stated & labelled & (F.col("reported_manufacturer") != F.col("expected_manufacturer"))).alias("manufacturer_wrong"),
        F.count_if(F.coalesce("rectified", F.lit(False))).alias("accepted_via_rectified"),
        mean_seconds.alias("mean_seconds"),
    )


def abstention_tally(rows: DataFrame, mode: str = "mode", expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Correct, wrong and abstained answers per mode, and the accuracy of the answers given (null
    when there was none). A null prediction is an abstention."""
    answered = F.col(predicted).isNotNull()
    right = answered & (F.col(predicted) == F.col(expected))
    counts = rows.groupBy(mode).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(right).alias("correct"),
        F.count_if(answered & ~right).alias("wrong"),
        F.count_if(~answered).alias("abstained"),
    )
    given = F.col("correct") + F.col("wrong")
    return counts.withColumn("accuracy_when_answering", expr.fixed(F.when(given > 0, F.col("correct") / given), 3))
