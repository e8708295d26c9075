"""Vehicle and plate boxes."""

from pyspark.sql import functions as F

from plateflow import dims
from plateflow.functions import expr
from plateflow.operators import boxes as op
from plateflow.operators import suppress
from plateflow.plans import parts as p
from plateflow.plans.registry import query

WIDTH, HEIGHT = 2688, 1520
CLASS_MAP = "CASE coco_label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dims.VEHICLE_CLASSES.items()) + " END"


def _every(size: int):
    """Frames come in two sizes: every third image is half as large."""
    return F.when(F.col("image_id") % 3 == 0, size // 2).otherwise(size)


@query(
    "decode_boxes",
    f"""WITH sized AS (
        SELECT *, CASE WHEN image_id % 3 = 0 THEN {WIDTH // 2} ELSE {WIDTH} END AS w, CASE WHEN image_id % 3 = 0 THEN {HEIGHT // 2} ELSE {HEIGHT} END AS h FROM v_raw_box
    ), px AS (
        SELECT image_id, box_idx, confidence, coco_label, w, h,
               greatest(0, cast(round_even((cx - bw / 2) * w, 0) AS bigint)) AS x1,
               greatest(0, cast(round_even((cy - bh / 2) * h, 0) AS bigint)) AS y1,
               least(w, cast(round_even((cx + bw / 2) * w, 0) AS bigint)) AS x2,
               least(h, cast(round_even((cy + bh / 2) * h, 0) AS bigint)) AS y2
        FROM sized WHERE confidence > 0.35 AND coco_label IN ({p.quoted(dims.VEHICLE_CLASSES)})
    )
    SELECT image_id, box_idx, confidence, coco_label, x1, y1, x2, y2, {CLASS_MAP} AS vehicle_type FROM px
    WHERE x2 - x1 >= 24 AND y2 - y1 >= 24
      AND NOT (coco_label IN ('train', 'boat') AND (x2 - x1) * (y2 - y1) < 0.01 * w * h)""",
)
def _(fx):
    sized = fx.v_raw_box.withColumns({"width": _every(WIDTH), "height": _every(HEIGHT)})
    return op.decode_boxes(sized, F.col("width"), F.col("height")).drop("width", "height")


LOGITS = """SELECT image_id, box_idx, x1, y1, x2, y2, {list} AS logits FROM v_vehicle_box"""
LABELS = ("truck", "bus", "car", "train", "boat", "motorcycle")


@query(
    "best_class",
    f"""WITH raw AS ({LOGITS.format(list="list_transform(range(0, 6), lambda i: cast((image_id * 7 + box_idx * 11 + i * 37) % 41 AS double) / 10 - 2.0)")}),
    best AS (SELECT *, list_max(logits) AS top FROM raw)
    SELECT image_id, box_idx, {p.fixed('1.0 / (1.0 + exp(-top))', 6)} AS confidence,
           list_extract([{p.quoted(LABELS)}], cast(list_position(logits, top) AS bigint)) AS coco_label
    FROM best WHERE 1.0 / (1.0 + exp(-top)) > 0.8""",
)
def _(fx):
    raw = fx.sql(LOGITS.format(list="transform(sequence(0, 5), i -> cast((image_id * 7 + box_idx * 11 + i * 37) % 41 AS double) / 10 - 2.0)"))
    return op.best_class(raw, LABELS, 0.8).select("image_id", "box_idx", expr.fixed("confidence", 6).alias("confidence"), "coco_label")


OVERLAY = f"cast(y1 + y2 AS double) / 2 < 0.045 * {HEIGHT}"


@query(
    "drop_overlay_band",
    f"SELECT image_id, plate_idx, x1, y1, x2, y2, confidence, source FROM v_plate_box WHERE NOT ({OVERLAY})",
)
def _(fx):
    return op.drop_overlay_band(fx.v_plate_box, fx.v_image)[0]


@query(
    "overlay_band_both_ends",
    f"""SELECT image_id, count(*) AS dropped FROM v_plate_box
    WHERE {OVERLAY} OR cast(y1 + y2 AS double) / 2 > (1.0 - 0.40) * {HEIGHT} GROUP BY image_id""",
)
def _(fx):
    dropped = op.drop_overlay_band(fx.v_plate_box, fx.v_image, bottom=0.40)[1]
    return dropped.groupBy("image_id").agg(F.count(F.lit(1)).alias("dropped"))


def _starts(length: str) -> str:
    regular = f"range(0, greatest({length} - 608, 0) + 1, 395)"
    last = f"list_last({regular})"
    return f"CASE WHEN {last} + 608 < {length} THEN list_append({regular}, {length} - 608) ELSE {regular} END"


TILES = f"""WITH r AS (
        SELECT image_id, box_idx, x1, y1, x2, y2, x2 - x1 AS w, y2 - y1 AS h FROM v_vehicle_box
    ), s AS (
        SELECT *, w <= 608 AND h <= 608 AS small, least(3.0::double, 608.0::double / greatest(1, w, h)) AS f FROM r
    ), t AS (
        SELECT *, unnest(CASE WHEN small THEN [0::bigint] ELSE {_starts('h')} END) AS dy FROM s
    ), tiles AS (
        SELECT image_id, box_idx, small, w, h, dy, x1, y1, unnest(CASE WHEN small THEN [0::bigint] ELSE {_starts('w')} END) AS dx,
               CASE WHEN small AND f > 1.05 THEN f ELSE 1.0 END AS upscale FROM t
    )"""


@query(
    "tile_grid",
    f"""{TILES} SELECT image_id, box_idx, x1 + dx AS tile_x, y1 + dy AS tile_y,
        CASE WHEN small THEN w ELSE least(608, w - dx) END AS tile_w, CASE WHEN small THEN h ELSE least(608, h - dy) END AS tile_h,
        {p.fixed('upscale', 6)} AS upscale FROM tiles""",
)
def _(fx):
    regions = fx.v_vehicle_box.select("image_id", "box_idx", "x1", "y1", "x2", "y2")
    return op.tile_grid(regions).select(
        "image_id", "box_idx", "tile_x", "tile_y", "tile_w", "tile_h", expr.fixed("upscale", 6).alias("upscale")
    )


@query(
    "tiles_to_frame",
    f"""{TILES} SELECT image_id, box_idx, x1 + dx AS tile_at_x, y1 + dy AS tile_at_y,
        x1 + dx + cast(trunc((box_idx * 7 + 3) / upscale) AS bigint) AS x1, y1 + dy + cast(trunc((image_id % 50) / upscale) AS bigint) AS y1,
        x1 + dx + cast(trunc((box_idx * 7 + 90) / upscale) AS bigint) AS x2, y1 + dy + cast(trunc((image_id % 50 + 40) / upscale) AS bigint) AS y2
    FROM tiles""",
)
def _(fx):
    regions = fx.v_vehicle_box.select("image_id", "box_idx", "x1", "y1", "x2", "y2")
    tiles = op.tile_grid(regions).drop("x1", "y1", "x2", "y2")
    found = tiles.withColumns({
        "tile_at_x": F.col("tile_x"), "tile_at_y": F.col("tile_y"),
        "bx1": F.col("box_idx") * 7 + 3, "by1": F.col("image_id") % 50,
        "bx2": F.col("box_idx") * 7 + 90, "by2": F.col("image_id") % 50 + 40,
    })
    return op.tiles_to_frame(found)


def _crop_sql(dx: str, dy: str) -> str:
    return (
        f"greatest(0, x1 - {dx}) AS crop_x1, greatest(0, y1 - {dy}) AS crop_y1, "
        f"least({WIDTH}, x2 + {dx}) AS crop_x2, least({HEIGHT}, y2 + {dy}) AS crop_y2"
    )


CROPS = ("crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query(
    "expand_boxes",
    "SELECT image_id, box_idx, "
    + _crop_sql("cast(trunc(0.3::double * (x2 - x1)) AS bigint)", "cast(trunc(0.1::double * (y2 - y1)) AS bigint)")
    + " FROM v_vehicle_box",
)
def _(fx):
    return op.expand_boxes(fx.v_vehicle_box, WIDTH, HEIGHT).select("image_id", "box_idx", *CROPS)


@query(
    "plate_crops",
    "SELECT image_id, plate_idx, "
    + _crop_sql(*["greatest(3, cast(trunc(0.1::double * (y2 - y1)) AS bigint))"] * 2)
    + " FROM v_plate_box",
)
def _(fx):
    return op.plate_crops(fx.v_plate_box, WIDTH, HEIGHT).select("image_id", "plate_idx", *CROPS)


@query(
    "scan_regions",
    f"SELECT * FROM (SELECT image_id, box_idx, {_crop_sql('24', '24')} FROM v_vehicle_box) t WHERE crop_x2 - crop_x1 >= 24 AND crop_y2 - crop_y1 >= 24",
)
def _(fx):
    return op.scan_regions(fx.v_vehicle_box, WIDTH, HEIGHT).select("image_id", "box_idx", *CROPS)


def _unit(c: str, size: str) -> str:
    return f"least(greatest(({c})::double / {size}, 0.0), 1.0)"


@query(
    "normalise_boxes",
    f"""SELECT image_id, plate_idx, {_unit('x1', str(WIDTH))} AS nx1, {_unit('y1', str(HEIGHT))} AS ny1,
        {_unit('x2', str(WIDTH))} AS nx2, {_unit('y2', str(HEIGHT))} AS ny2 FROM v_plate_box""",
)
def _(fx):
    return op.normalise_boxes(fx.v_plate_box, WIDTH, HEIGHT).select("image_id", "plate_idx", "nx1", "ny1", "nx2", "ny2")


def _corner(c: str, offset: str, size: int) -> str:
    return p.fixed(_unit(f"{c} + {offset}", str(size)), 6)


@query(
    "normalise_quads",
    f"""SELECT image_id, plate_idx, {_corner('tlx', 'image_id % 2600', WIDTH)} AS tlx, {_corner('tly', 'image_id % 1500', HEIGHT)} AS tly,
        {_corner('brx', 'image_id % 2600', WIDTH)} AS brx, {_corner('bry', 'image_id % 1500', HEIGHT)} AS bry FROM v_quad""",
)
def _(fx):
    corners = F.array(*[F.array(x, y) for x, y in (("tlx", "tly"), ("trx", "try_"), ("brx", "bry"), ("blx", "bly"))])
    quad = op.normalise_quad(corners, F.col("image_id") % 2600, F.col("image_id") % 1500, WIDTH, HEIGHT)
    return fx.v_quad.select("image_id", "plate_idx", quad.alias("q")).select(
        "image_id", "plate_idx",
        F.col("q")[0][0].alias("tlx"), F.col("q")[0][1].alias("tly"), F.col("q")[2][0].alias("brx"), F.col("q")[2][1].alias("bry"),
    )


@query(
    "suppress_vehicles",
    f"WITH RECURSIVE {p.greedy('v_vehicle_box', 'box_idx', p.VEHICLE_CONFLICT)} SELECT image_id, box_idx FROM survivors",
)
def _(fx):
    return suppress.suppress_vehicles(fx.v_vehicle_box).select("image_id", "box_idx")


@query(
    "suppress_plates",
    f"WITH RECURSIVE {p.greedy('v_plate_box', 'plate_idx', p.PLATE_CONFLICT)} SELECT image_id, plate_idx FROM survivors",
)
def _(fx):
    return suppress.suppress_plates(fx.v_plate_box).select("image_id", "plate_idx")


ASSIGNED = """held AS (
        SELECT p.image_id, p.plate_idx, v.box_idx,
               row_number() OVER (PARTITION BY p.image_id, p.plate_idx
                                  ORDER BY greatest(0, v.x2 - v.x1) * greatest(0, v.y2 - v.y1), v.box_idx) AS rn
        FROM v_plate_box p LEFT JOIN v_vehicle_box v ON v.image_id = p.image_id
         AND (p.x1 + p.x2) / 2.0 BETWEEN v.x1 AND v.x2 AND (p.y1 + p.y2) / 2.0 BETWEEN v.y1 AND v.y2
    ), assigned AS (SELECT image_id, plate_idx, coalesce(box_idx, -1) AS box_idx FROM held WHERE rn = 1)"""


@query("assign_plates", f"WITH {ASSIGNED} SELECT image_id, plate_idx, box_idx FROM assigned")
def _(fx):
    return op.assign_plates(fx.v_plate_box, fx.v_vehicle_box)


SPLIT = """hits AS (SELECT * FROM v_plate_box WHERE confidence >= 0.7),
    sweep AS (SELECT * FROM v_plate_box WHERE confidence < 0.7),
    mixed AS (SELECT * FROM hits UNION ALL SELECT * FROM sweep WHERE image_id NOT IN (SELECT image_id FROM hits))"""


@query(
    "combine_scans",
    f"WITH RECURSIVE {SPLIT}, {p.greedy('mixed', 'plate_idx', p.PLATE_CONFLICT)} SELECT image_id, plate_idx FROM survivors",
)
def _(fx):
    hits = fx.v_plate_box.filter("confidence >= 0.7")
    sweep = fx.v_plate_box.filter("confidence < 0.7")
    return op.combine_scans(hits, sweep).select("image_id", "plate_idx")


ORPHANS = """SELECT image_id, plate_idx, x1, y1, x2, y2, plate_idx % 3 <> 0 AS readable, confidence AS ocr_confidence,
    CASE WHEN plate_idx % 3 <> 0 THEN concat('P', cast(image_id AS string)) END AS text FROM v_plate_box WHERE source = 'frame'"""
NOTE = dims.ORPHAN_NOTE


@query(
    "combine_detections",
    f"""SELECT image_id, box_idx, NULL::bigint AS plate_idx, coco_label AS vehicle_type, NULL AS license_plate, false AS plate_readable,
        confidence, x1, y1, x2, y2, NULL AS notes FROM v_vehicle_box
    UNION ALL
    SELECT image_id, NULL, plate_idx, 'unidentified_vehicle', text, true, NULL, x1, y1, x2, y2, '{NOTE}' FROM ({ORPHANS}) o
    WHERE readable AND ocr_confidence >= 0.6""",
)
def _(fx):
    vehicles = fx.v_vehicle_box.select(
        "image_id", "box_idx", F.col("coco_label").alias("vehicle_type"), F.lit(None).cast("string").alias("license_plate"),
        F.lit(False).alias("plate_readable"), "confidence", "x1", "y1", "x2", "y2",
    )
    return op.combine_detections(vehicles, fx.sql(ORPHANS))


OBSERVED = """SELECT image_id, image_id % 3 AS box_idx, plate_idx, confidence AS detection_confidence, plate_idx % 3 <> 0 AS readable,
    CASE WHEN plate_idx % 5 = 0 THEN NULL ELSE cast((x1 * 7) % 10 AS double) / 10 END AS ocr_confidence FROM v_plate_box"""


@query(
    "primary_plate",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY image_id, box_idx ORDER BY readable DESC, coalesce(ocr_confidence, 0) DESC,
        detection_confidence DESC, plate_idx) AS plate_rank FROM ({OBSERVED}) o)
    SELECT image_id, box_idx, plate_idx, plate_rank, CASE WHEN plate_rank = 1 THEN 'primary' ELSE 'extra' END AS role FROM r WHERE plate_rank <= 3""",
)
def _(fx):
    return op.primary_plate(fx.sql(OBSERVED)).select(
        "image_id", "box_idx", "plate_idx", F.col("plate_rank").cast("bigint").alias("plate_rank"), "role"
    )


@query(
    "main_vehicle",
    f"""WITH w AS (SELECT *, confidence * sqrt(sqrt({p.box_area('b')}::double)) AS weight FROM v_vehicle_box b)
    SELECT image_id, box_idx, {p.fixed('weight', 6)} AS weight FROM w
    QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY w.weight DESC, box_idx) = 1""",
)
def _(fx):
    return op.main_vehicle(fx.v_vehicle_box).select("image_id", "box_idx", expr.fixed("weight", 6).alias("weight"))


@query(
    "cap_per_group",
    """SELECT image_id, box_idx, position FROM (
        SELECT image_id, box_idx, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, box_idx) AS position FROM v_vehicle_box) t
    WHERE position <= 3""",
)
def _(fx):
    capped = op.cap_per_group(fx.v_vehicle_box, ["image_id"], [F.col("confidence").desc(), F.col("box_idx")], 3)
    return capped.select("image_id", "box_idx", F.col("position").cast("bigint").alias("position"))


@query(
    "image_telemetry",
    f"""WITH {ASSIGNED}, v AS (SELECT image_id, count(*) AS n FROM v_vehicle_box GROUP BY 1),
    pl AS (SELECT image_id, count(*) FILTER (WHERE NOT ({OVERLAY})) AS kept, count(*) FILTER (WHERE {OVERLAY}) AS dropped FROM v_plate_box GROUP BY 1),
    u AS (SELECT a.image_id, count(*) AS n FROM assigned a JOIN v_plate_box b ON b.image_id = a.image_id AND b.plate_idx = a.plate_idx
          WHERE a.box_idx = -1 AND NOT ({OVERLAY}) GROUP BY 1)
    SELECT i.image_id, coalesce(v.n, 0) AS vehicles_detected, coalesce(kept, 0) AS plates_detected, coalesce(dropped, 0) AS plates_dropped_overlay,
           coalesce(u.n, 0) AS unassigned_plates
    FROM v_image i LEFT JOIN v ON v.image_id = i.image_id LEFT JOIN pl ON pl.image_id = i.image_id LEFT JOIN u ON u.image_id = i.image_id""",
)
def _(fx):
    marked = op.mark_overlay(fx.v_plate_box, F.lit(HEIGHT))
    assigned = op.assign_plates(marked.filter("NOT in_overlay"), fx.v_vehicle_box)
    return op.image_telemetry(fx.v_image, fx.v_vehicle_box, marked, assigned)


TIMINGS = """SELECT image_id, CASE plate_idx % 3 WHEN 0 THEN 'vehicle_detect' WHEN 1 THEN 'plate_detect' ELSE 'plate_read' END AS stage,
    cast(x1 % 700 AS double) / 100 AS seconds FROM v_plate_box"""


@query(
    "stage_seconds",
    f"""SELECT stage, count(*) AS images, {p.fixed('sum(seconds)', 3)} AS total_seconds, {p.fixed('avg(seconds)', 4)} AS mean_seconds,
        {p.fixed('sum(seconds) / sum(sum(seconds)) OVER ()', 4)} AS share FROM ({TIMINGS}) t GROUP BY stage""",
)
def _(fx):
    spent = op.stage_seconds(fx.sql(TIMINGS))
    return spent.select(
        "stage", "images", expr.fixed("total_seconds", 3).alias("total_seconds"), expr.fixed("mean_seconds", 4).alias("mean_seconds"),
        expr.fixed("share", 4).alias("share"),
    )
