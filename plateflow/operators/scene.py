"""From boxes and readings of a photo to its detections, in one job."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateflow import dims
from plateflow.operators.boxes import assign_plates, assign_with, cap_per_group, drop_overlay_band
from plateflow.operators.reads import decide_plate
from plateflow.operators.skew import GROUP_ROWS, heavy_keys
from plateflow.operators.suppress import suppress_plates, suppress_vehicles

#: Detections reported per photo.
MOST = 100
#: Columns of the plate that stands for a vehicle.
_PLATE = ("text", "text_raw", "readable", "ocr_confidence", "plate_format", "region", "status", "detection_confidence")


def photo_detections(images: DataFrame, vehicles: DataFrame, plates: DataFrame, reads: DataFrame, most: int = MOST, **sizes: int) -> DataFrame:
    """Detections of every photo: its vehicles with the plate that stands for each, then plates outside all vehicles.

    ``images`` has image_id and height; ``vehicles`` image_id, box_idx, corners, confidence and vehicle_type; ``plates``
    image_id, plate_idx, corners and confidence; ``reads`` the readings of a plate (image_id, plate_idx, ...). Duplicates of boxes
    go, then plates in the caption band; a plate belongs to the smallest vehicle around its centre; of a vehicle's
    plates the best-read one is primary and up to two more are counted as ``extra_plates``. A plate in no vehicle is reported
    when it was read well enough, as an unidentified vehicle with its own box. ``most`` detections are kept
    per photo, vehicles first, in order of ``box_idx``, then plates by confidence; ``position`` counts from 1. A photo
    without boxes has no row; a plate without a reading is kept with the reason. Every step is keyed by image, so the job is one
    plan on that partitioning.
    """
    here = suppress_vehicles(vehicles, **sizes)
    seen, _ = drop_overlay_band(suppress_plates(plates, **sizes), images)
    limit = sizes.get("group_rows", GROUP_ROWS)
    many = heavy_keys(vehicles.select("image_id").unionByName(plates.select("image_id")), ["image_id"], limit)
    observed = (assign_with(seen, here) if many.isEmpty() else seen.join(assign_plates(seen, here, limit), ["image_id", "plate_idx"])).withColumnRenamed("confidence", "detection_confidence")
    observed = observed.join(decide_plate(reads, ("image_id", "plate_idx")), ["image_id", "plate_idx"], "left").withColumns({
        "readable": F.coalesce("readable", F.lit(False)), "status": F.coalesce("status", F.lit("no_text_recognised"))
    })
    # Boxes and plates meet in one aggregation, so each is worked out once: a group is a vehicle, or a plate in none.
    box = [name for name in here.columns if name not in ("image_id", "box_idx")]
    plate = [*_PLATE, "x1", "y1", "x2", "y2"]
    order = F.struct("readable", F.coalesce("ocr_confidence", F.lit(0.0)), "detection_confidence", (-F.col("plate_idx")).alias("last"), F.struct("plate_idx", *plate).alias("p"))
    lone = F.when(F.col("box_idx") == -1, F.col("plate_idx"))
    rows = here.select("image_id", "box_idx", F.struct(*box).alias("_box")).unionByName(
        observed.select("image_id", F.nullif("box_idx", F.lit(-1)).alias("box_idx"), lone.alias("_lone"), order.alias("_plate")), allowMissingColumns=True
    )
    grouped = rows.groupBy("image_id", "box_idx", "_lone").agg(F.max("_box").alias("_box"), F.max("_plate").alias("_plate"), F.count("_plate").alias("_plates"))
    grouped = grouped.select("image_id", "box_idx", "_box", F.col("_plate.p").alias("_p"), F.least(F.greatest(F.col("_plates") - 1, F.lit(0)), F.lit(2)).alias("extra_plates"))
    readable = F.coalesce("_p.readable", F.lit(False))
    reported = F.col("_box").isNotNull() | (readable & (F.coalesce("_p.ocr_confidence", F.lit(0.0)) >= dims.ORPHAN_PLATE_BAR))
    orphan = F.col("_box").isNull()

    def either(own: Column, other: Column) -> Column:
        return F.when(orphan, other).otherwise(own)

    both = grouped.filter(reported).select(
        "image_id", "box_idx", F.col("_p.plate_idx").alias("plate_idx"), either(F.col("_box.vehicle_type"), F.lit("unidentified_vehicle")).alias("vehicle_type"),
        F.when(readable, F.col("_p.text")).alias("license_plate"), readable.alias("plate_readable"), F.col("_box.confidence").alias("confidence"),
        *[either(F.col(f"_box.{side}"), F.col(f"_p.{side}")).alias(side) for side in ("x1", "y1", "x2", "y2")],
        F.when(orphan, dims.ORPHAN_NOTE).alias("notes"), "extra_plates", F.col("_p.text_raw").alias("plate_text_raw"),
        F.col("_p.status").alias("plate_status"), F.col("_p.ocr_confidence").alias("plate_ocr_confidence"), F.when(orphan, F.col("_p.detection_confidence")).alias("_seen"),
    )
    order = [F.col("box_idx").asc_nulls_last(), F.col("_seen").desc(), F.col("plate_idx").asc()]
    return cap_per_group(both, ["image_id"], order, most).drop("_seen")
