"""Vehicle and plate boxes: decoding, tiling, filtering, assignment and selection."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow import dims
from plateflow.functions import expr
from plateflow.operators.skew import GROUP_ROWS, cut_lineage, split_heavy, top_per_key
from plateflow.operators.suppress import suppress_plates

#: Cell side, in pixels, of the grid that splits a heavy image.
CELL = 64
#: Boxes times centres up to which a cell is not split further.
CELL_PAIRS = 1 << 22


def label_map(label: Column, mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])[label]


def best_class(raw: DataFrame, labels: Sequence[str], threshold: float) -> DataFrame:
    """Per-class logits to (confidence, coco_label): highest sigmoid score, first class on ties."""
    scores = F.transform("logits", lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))
    names = F.array(*[F.lit(name) for name in labels])
    best = F.array_max("_scores")
    return (
        raw.withColumn("_scores", scores)
        .withColumn("confidence", best)
        .filter(F.col("confidence") > threshold)
        .withColumn("coco_label", F.coalesce(F.get(names, F.array_position("_scores", best).cast("int") - 1), F.lit("unknown")))
        .drop("_scores", "logits")
    )


def decode_boxes(raw: DataFrame, width: Column | int, height: Column | int, threshold: float = 0.35,
                 min_side: int = 24, weak_share: float = 0.01) -> DataFrame:
    """Centre/size fractions to clipped pixel corners, our vocabulary, and the size limits. The frame
    size may be a column, for tables with frames of several sizes."""
    width, height = _size(width), _size(height)
    half = F.lit(2.0)

    def pixel(value: Column) -> Column:
        return F.bround(value, 0).cast("bigint")

    boxes = (
        raw.filter((F.col("confidence") > threshold) & F.col("coco_label").isin(*dims.VEHICLE_CLASSES))
        .withColumn("x1", F.greatest(F.lit(0), pixel((F.col("cx") - F.col("bw") / half) * width)))
        .withColumn("y1", F.greatest(F.lit(0), pixel((F.col("cy") - F.col("bh") / half) * height)))
        .withColumn("x2", F.least(width, pixel((F.col("cx") + F.col("bw") / half) * width)))
        .withColumn("y2", F.least(height, pixel((F.col("cy") + F.col("bh") / half) * height)))
        .withColumn("vehicle_type", label_map(F.col("coco_label"), dims.VEHICLE_CLASSES))
    )
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    weak = F.col("coco_label").isin(*dims.WEAK_CLASSES) & (wide * high < weak_share * width * height)
    return boxes.filter((wide >= min_side) & (high >= min_side) & ~weak).drop("cx", "cy", "bw", "bh")


def mark_overlay(plates: DataFrame, height: Column, top: float = 0.045, bottom: float = 0.0) -> DataFrame:
    """Flag plates whose centre lies in the burnt-in caption band; a zero band is switched off."""
    centre = (F.col("y1") + F.col("y2")) / 2
    inside = F.lit(False)
    if top:
        inside = inside | (centre < top * height)
    if bottom:
        inside = inside | (centre > (1.0 - bottom) * height)
    return plates.withColumn("in_overlay", inside)


def drop_overlay_band(plates: DataFrame, images: DataFrame, top: float = 0.045,
                      bottom: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)`` by :func:`mark_overlay`, with the frame height taken from ``images``."""
    marked = mark_overlay(plates.join(images.select("image_id", "height"), "image_id"), F.col("height"), top, bottom)
    marked = marked.drop("height")
    return (
        marked.filter(~F.col("in_overlay")).drop("in_overlay"),
        marked.filter("in_overlay").drop("in_overlay"),
    )


def tile_grid(regions: DataFrame, tile: int = 608, overlap: float = 0.35, max_upscale: float = 3.0) -> DataFrame:
    """One row per tile of each region (x1, y1, x2, y2): origin, size and upscale factor."""
    step = max(1, int(tile * (1.0 - overlap)))
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    small = (wide <= tile) & (high <= tile)
    scale = F.least(F.lit(float(max_upscale)), F.lit(float(tile)) / F.greatest(F.lit(1), wide, high))

    def starts(length: Column) -> Column:
        regular = F.sequence(F.lit(0).cast("bigint"), F.greatest(length - tile, F.lit(0)).cast("bigint"), F.lit(step).cast("bigint"))
        last = F.element_at(regular, -1)
        return F.when(last + tile < length, F.concat(regular, F.array((length - tile).cast("bigint")))).otherwise(regular)

    origin = F.array(F.lit(0).cast("bigint"))
    return (
        regions.withColumn("upscale", F.when(small & (scale > 1.05), scale).otherwise(F.lit(1.0)))
        .withColumn("dy", F.explode(F.when(small, origin).otherwise(starts(high))))
        .withColumn("dx", F.explode(F.when(small, origin).otherwise(starts(wide))))
        .withColumn("tile_x", F.col("x1") + F.col("dx"))
        .withColumn("tile_y", F.col("y1") + F.col("dy"))
        .withColumn("tile_w", F.when(small, wide).otherwise(F.least(F.lit(tile), wide - F.col("dx"))))
        .withColumn("tile_h", F.when(small, high).otherwise(F.least(F.lit(tile), high - F.col("dy"))))
        .drop("dx", "dy")
    )


def tiles_to_frame(tile_boxes: DataFrame) -> DataFrame:
    """Tile-local boxes (b*) to frame pixels: unscale, truncate toward zero, shift."""

    def back(value: str, origin: str) -> Column:
        return F.col(origin) + (F.col(value) / F.col("upscale")).cast("bigint")

    return (
        tile_boxes.withColumn("x1", back("bx1", "tile_x")).withColumn("y1", back("by1", "tile_y"))
        .withColumn("x2", back("bx2", "tile_x")).withColumn("y2", back("by2", "tile_y"))
        .drop("bx1", "by1", "bx2", "by2", "tile_x", "tile_y", "tile_w", "tile_h", "upscale")
    )


def _size(value: Column | int) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def _grow(boxes: DataFrame, dx: Column, dy: Column, width: Column | int, height: Column | int) -> DataFrame:
    return (
        boxes.withColumn("crop_x1", F.greatest(F.lit(0), F.col("x1") - dx))
        .withColumn("crop_y1", F.greatest(F.lit(0), F.col("y1") - dy))
        .withColumn("crop_x2", F.least(_size(width), F.col("x2") + dx))
        .withColumn("crop_y2", F.least(_size(height), F.col("y2") + dy))
    )


def expand_boxes(boxes: DataFrame, width: Column | int, height: Column | int, margin_x: float = 0.3,
                 margin_y: float = 0.1) -> DataFrame:
    """Context crop: whole-pixel margins as a fraction of the box, clipped to the frame."""
    if not (0 <= margin_x <= 1 and 0 <= margin_y <= 1):
        raise ValueError("crop margins must be between 0 and 1")
    dx = (margin_x * (F.col("x2") - F.col("x1"))).cast("bigint")
    dy = (margin_y * (F.col("y2") - F.col("y1"))).cast("bigint")
    return _grow(boxes, dx, dy, width, height)


def plate_crops(plates: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Crop handed to the reader: a tenth of the plate height on every side, three pixels at least."""
    margin = F.greatest(F.lit(3), (0.10 * (F.col("y2") - F.col("y1"))).cast("bigint"))
    return _grow(plates, margin, margin, width, height)


def scan_regions(vehicles: DataFrame, width: Column | int, height: Column | int, pad: int = 24, min_side: int = 24) -> DataFrame:
    """Regions searched for plates: vehicle boxes padded and clipped, slivers left out."""
    grown = _grow(vehicles, F.lit(pad), F.lit(pad), width, height)
    return grown.filter(
        (F.col("crop_x2") - F.col("crop_x1") >= min_side) & (F.col("crop_y2") - F.col("crop_y1") >= min_side)
    )


def normalise_boxes(boxes: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Pixel corners to fractions of the frame, clamped to [0, 1]."""
    return boxes.select(
        "*",
        expr.clamp01(F.col("x1") / width).alias("nx1"), expr.clamp01(F.col("y1") / height).alias("ny1"),
        expr.clamp01(F.col("x2") / width).alias("nx2"), expr.clamp01(F.col("y2") / height).alias("ny2"),
    )


def normalise_quad(quad: Column, offset_x: Column, offset_y: Column, width: Column | int, height: Column | int) -> Column:
    """Crop-local corners [[x, y] x 4] to whole-image fractions with six decimals."""

    def place(point: Column, axis: int, offset: Column, size: Column | int) -> Column:
        return expr.fixed(expr.clamp01((point[axis] + offset) / F.greatest(F.lit(1), _size(size))), 6)

    return F.transform(quad, lambda p: F.array(place(p, 0, offset_x, width), place(p, 1, offset_y, height)))


# ---- assignment ----------------------------------------------------------------------------


def assign_plates(plates: DataFrame, vehicles: DataFrame, group_rows: int = GROUP_ROWS, cell: int = CELL, pairs: int = CELL_PAIRS) -> DataFrame:
    """Vehicle (box_idx) each plate belongs to: the smallest box holding the plate's centre,
    lowest index on ties, -1 when there is none.

    The join keeps the image equality, so the box test is a residual condition, and the minimum
    is taken on the partitioning the join already has. Images above ``group_rows`` boxes and plates go
    through a grid whose cells split by counted density (``_assign_on_grid``).
    """
    points = plates.select(
        "image_id", "plate_idx",
        ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
    )
    boxes = vehicles.select("image_id", "box_idx", "x1", "y1", "x2", "y2")
    both = boxes.select("image_id").unionByName(points.select("image_id"))
    _, _, hot = split_heavy(both, ["image_id"], group_rows)
    if hot is None:
        return _assign(points, boxes, ["image_id"])
    light_boxes, heavy_boxes = boxes.join(hot, "image_id", "left_anti"), boxes.join(hot, "image_id", "left_semi")
    light_points = points.join(hot, "image_id", "left_anti")
    heavy_points = points.join(hot, "image_id", "left_semi")
    return _assign(light_points, light_boxes, ["image_id"]).unionByName(
        _assign_on_grid(heavy_points, heavy_boxes, cell, pairs)
    )


def _rank_box() -> Column:
    return F.struct(expr.area(_corners()).alias("area"), F.col("box_idx").alias("box"))


def _corners() -> dict[str, Column]:
    return {name: F.col(name) for name in ("x1", "y1", "x2", "y2")}


def _holds() -> Column:
    return F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))


def assign_with(plates: DataFrame, vehicles: DataFrame) -> DataFrame:
    """``plates`` with the box_idx of :func:`assign_plates`, for images without very many boxes: the columns go through the
    join, so the plates are read once."""
    rest = [name for name in plates.columns if name not in ("image_id", "plate_idx")]
    points = plates.select(
        "image_id", "plate_idx", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), F.struct(*rest).alias("_rest")
    )
    found = _assign(points, vehicles.select("image_id", "box_idx", "x1", "y1", "x2", "y2"), ["image_id"], "_rest")
    return found.select("image_id", "plate_idx", "_rest.*", "box_idx")


def _assign(points: DataFrame, boxes: DataFrame, keys: list[str], *more: str) -> DataFrame:
    p, b = points.alias("p"), boxes.alias("b")
    same = [F.col(f"p.{key}") == F.col(f"b.{key}") for key in keys]
    joined = p.join(b, [*same, _holds()], "left")
    best = F.min(F.when(F.col("box_idx").isNotNull(), _rank_box()))
    return (
        joined.groupBy(*[F.col(f"p.{key}") for key in keys], "plate_idx")
        .agg(best.alias("_best"), *[F.first(name).alias(name) for name in more])
        .select("image_id", "plate_idx", F.coalesce(F.col("_best.box"), F.lit(-1).cast("bigint")).alias("box_idx"), *more)
    )


def _assign_on_grid(points: DataFrame, boxes: DataFrame, cell: int, pairs: int) -> DataFrame:
    """Assignment through a grid whose cells split where they are dense.

    A box that covers a whole cell competes once per cell; only boxes whose edge crosses a cell are tested
    against the centres in it. Cells in which such boxes times centres exceed ``pairs``, by counts, are cut
    into four, centres keeping the best box found so far; down to cells of one pixel, in which whole boxes
    leave at most a few distinct centres of integer corners. So one crowded cell becomes as many tasks as it needs.
    """
    grid = ["image_id", "gx", "gy"]
    # Boxes with equal corners: only the lowest index can win. Plates with the same centre get the same answer.
    boxes = boxes.groupBy("image_id", "x1", "y1", "x2", "y2").agg(F.min("box_idx").alias("box_idx"))
    edges = boxes.filter((F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2")))
    centres = points.filter(F.col("cx").isNotNull() & F.col("cy").isNotNull()).select("image_id", "cx", "cy").distinct()
    centres = centres.withColumn("_best", F.lit(None).cast(_rank_type(edges)))
    size, settled, first = cell, [], True
    while True:
        def reach(low: str, high: str, parent: str, size=size, first=first) -> Column:
            start, end = F.floor(F.col(low) / size), F.floor(F.col(high) / size)
            inner = (start, end) if first else (F.greatest(start, 2 * F.col(parent)), F.least(end, 2 * F.col(parent) + 1))
            return F.explode(F.when(inner[0] <= inner[1], F.sequence(*inner)))

        reached = edges.withColumn("_gx", reach("x1", "x2", "gx")).withColumn("gx", F.col("_gx")).drop("_gx")
        reached = reached.withColumn("_gy", reach("y1", "y2", "gy")).withColumn("gy", F.col("_gy")).drop("_gy")
        covers = (
            (F.col("x1") <= F.col("gx") * size) & (F.col("x2") >= (F.col("gx") + 1) * size)
            & (F.col("y1") <= F.col("gy") * size) & (F.col("y2") >= (F.col("gy") + 1) * size)
        )
        whole = reached.filter(covers).groupBy(*grid).agg(F.min(_rank_box()).alias("_whole"))
        placed = centres.withColumn("gx", F.floor(F.col("cx") / size)).withColumn("gy", F.floor(F.col("cy") / size))
        placed = placed.join(whole, grid, "left").withColumn("_best", F.least("_best", "_whole")).drop("_whole")
        if size <= 1:
            settled.append(_best_edges(placed, reached.filter(~covers), grid))
            break
        placed, crossing = cut_lineage(placed), cut_lineage(reached.filter(~covers))
        many = placed.groupBy(*grid).agg(F.count(F.lit(1)).alias("_points")).join(crossing.groupBy(*grid).agg(F.count(F.lit(1)).alias("_edges")), grid)
        dense = cut_lineage(many.filter(F.col("_points") * F.col("_edges") > pairs).select(*grid))
        if dense.isEmpty():
            settled.append(_best_edges(placed, crossing, grid))
            break
        settled.append(_best_edges(placed.join(dense, grid, "left_anti"), crossing.join(dense, grid, "left_anti"), grid))
        edges = crossing.join(dense, grid, "left_semi")
        centres = placed.join(dense, grid, "left_semi").drop("gx", "gy")
        size, first = max(1, size // 2), False
    nearest = settled[0]
    for part in settled[1:]:
        nearest = nearest.unionByName(part)
    # A plate without a centre is in no box.
    found = points.join(nearest, ["image_id", "cx", "cy"], "left")
    return found.select("image_id", "plate_idx", F.coalesce("box_idx", F.lit(-1).cast("bigint")).alias("box_idx"))


def _rank_type(boxes: DataFrame):
    return boxes.select(_rank_box().alias("r")).schema["r"].dataType


def _best_edges(centres: DataFrame, edges: DataFrame, grid: list[str]) -> DataFrame:
    """The best box of each centre: of those whose edge crosses its cell, and that of the cells around it."""
    p, e = centres.alias("p"), edges.alias("e")
    tested = p.join(e, [*[F.col(f"p.{name}") == F.col(f"e.{name}") for name in grid], _holds()], "left")
    return (
        tested.groupBy("p.image_id", "cx", "cy")
        .agg(F.min(F.when(F.col("box_idx").isNotNull(), _rank_box())).alias("_edge"), F.first("_best").alias("_best"))
        .select("image_id", "cx", "cy", F.coalesce(F.least("_edge", "_best")["box"], F.lit(-1).cast("bigint")).alias("box_idx"))
    )


# ---- selection -----------------------------------------------------------------------------


def combine_scans(vehicle_hits: DataFrame, frame_hits: DataFrame, threshold: float = 0.3, **sizes: int) -> DataFrame:
    """Hits of the whole-frame sweep count only for images where the vehicle scan found nothing."""
    fallback = frame_hits.join(vehicle_hits.select("image_id").distinct(), "image_id", "left_anti")
    return suppress_plates(vehicle_hits.unionByName(fallback), threshold, **sizes)


def combine_detections(vehicles: DataFrame, orphans: DataFrame, bar: float = dims.ORPHAN_PLATE_BAR) -> DataFrame:
    """Vehicle detections plus unassigned plates that were read well enough to report; such a
    row has the plate's own box and says that the vehicle is unknown."""
    reported = orphans.filter(F.col("readable") & (F.coalesce("ocr_confidence", F.lit(0.0)) >= bar)).select(
        "image_id",
        F.lit(None).cast("bigint").alias("box_idx"),
        "plate_idx",
        F.lit("unidentified_vehicle").alias("vehicle_type"),
        F.col("text").alias("license_plate"),
        F.lit(True).alias("plate_readable"),
        F.lit(None).cast("double").alias("confidence"),
        "x1", "y1", "x2", "y2",
        F.lit(dims.ORPHAN_NOTE).alias("notes"),
    )
    return vehicles.unionByName(reported, allowMissingColumns=True)


def primary_plate(observations: DataFrame, keys: Sequence[str] = ("image_id", "box_idx")) -> DataFrame:
    """Rank the plates of a vehicle: readable first, then OCR confidence, then detection
    confidence. ``role`` is primary for the first and extra for the next two."""
    order = [
        F.col("readable").desc(),
        F.coalesce("ocr_confidence", F.lit(0.0)).desc(),
        F.col("detection_confidence").desc(),
        F.col("plate_idx").asc(),
    ]
    ranked = top_per_key(observations, keys, order, 3, rank="plate_rank")
    return ranked.withColumn("role", F.when(F.col("plate_rank") == 1, "primary").otherwise("extra"))


def main_vehicle(boxes: DataFrame) -> DataFrame:
    """One box per frame: highest confidence times the fourth root of the area, first on ties."""
    weight = F.col("confidence") * F.sqrt(F.sqrt(expr.area(_corners()).cast("double")))
    weighted = boxes.withColumn("weight", weight)
    return top_per_key(weighted, ["image_id"], [F.col("weight").desc(), F.col("box_idx").asc()])


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "position") -> DataFrame:
    """First ``n`` rows per key in the given order, numbered from 1."""
    return top_per_key(df, keys, order, n, rank=rank)


def image_telemetry(images: DataFrame, vehicles: DataFrame, plates: DataFrame, assigned: DataFrame) -> DataFrame:
    """Counts per image: vehicles, plates kept, plates dropped by the overlay, unassigned plates.

    ``plates`` is the output of :func:`mark_overlay`, ``assigned`` that of :func:`assign_plates` for
    the kept ones. The inputs are counted in one aggregation over their union.
    """
    found, band, lost = F.lit(False).alias("vehicle"), F.lit(None).cast("boolean").alias("in_overlay"), F.lit(False).alias("lost")
    facts = (
        vehicles.select("image_id", F.lit(True).alias("vehicle"), band, lost)
        .unionByName(plates.select("image_id", found, "in_overlay", lost))
        .unionByName(assigned.select("image_id", found, band, (F.col("box_idx") == -1).alias("lost")))
    )
    counts = facts.groupBy("image_id").agg(
        F.count_if("vehicle").alias("vehicles_detected"),
        F.count_if(~F.col("in_overlay")).alias("plates_detected"),
        F.count_if("in_overlay").alias("plates_dropped_overlay"),
        F.count_if("lost").alias("unassigned_plates"),
    )
    names = counts.columns[1:]
    return images.select("image_id").join(counts, "image_id", "left").select(
        "image_id", *[F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in names]
    )


def stage_seconds(timings: DataFrame) -> DataFrame:
    """Seconds spent per stage (image_id, stage, seconds): total, mean and share of the whole."""
    totals = timings.groupBy("stage").agg(
        F.count(F.lit(1)).alias("images"), F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("mean_seconds")
    )
    share = F.col("total_seconds") / F.sum("total_seconds").over(Window.partitionBy())
    return totals.withColumn("share", share)
