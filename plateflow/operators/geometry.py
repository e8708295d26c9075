"""Plate quadrilaterals: corner order, true proportions, selection, and the fit through glyphs."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow.operators.skew import GROUP_ROWS, cut_lineage, split_heavy
from plateflow.operators.suppress import Rule, greedy_keep

CORNERS = ("tl", "tr", "br", "bl")
#: Distance in pixels from which Huber's rule takes weight off a point, and the least run of a line.
HUBER, UPRIGHT = 1.345, 1e-6
#: Rounds of re-weighting of a fitted line.
FIT_ROUNDS = 6


def _length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _x(corner: str) -> Column:
    return F.col(f"{corner}x")


def _y(corner: str) -> Column:
    # ``try`` is a reserved word in places, so that one column carries an underscore.
    return F.col("try_" if corner == "tr" else f"{corner}y")


def _edge(a: str, b: str) -> Column:
    return _length(_x(b) - _x(a), _y(b) - _y(a))


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def order_corners(quads: DataFrame, points: str = "points", min_area: float = 16.0) -> DataFrame:
    """Four unordered corners (array of struct x, y) to tlx ... bly: clockwise on screen from the
    top left, long side horizontal. ``ordered`` is false, and the corners null, when they are not
    four finite corners of a convex quadrilateral of at least ``min_area``."""
    pts = F.col(points)
    # Four corners are spelled out, which is compiled; functions over array elements are not.
    four = [F.get(pts, F.lit(i)) for i in range(4)]
    finite = F.lit(True)
    for p in four:
        finite = finite & p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < math.inf) & (F.abs(p["y"]) < math.inf)

    def mean(axis: str) -> Column:
        return sum((p[axis] for p in four), F.lit(0.0)) / 4

    # Clockwise with y pointing down; the tie-break keeps equal angles in one order.
    around = F.sort_array(F.array(*[
        F.struct(F.atan2(p["y"] - F.col("_cy"), p["x"] - F.col("_cx")).alias("angle"), p["x"].alias("x"), p["y"].alias("y")) for p in four
    ]))

    def at(name: str, i: int) -> Column:
        return F.col(name)[i % 4]

    turns = [_cross(at("_ring", i), at("_ring", i + 1), at("_ring", i + 2)) for i in range(4)]
    convex = (turns[0] > 0) & (turns[1] > 0) & (turns[2] > 0) & (turns[3] > 0)
    twice = sum((at("_ring", i)["x"] * at("_ring", i + 1)["y"] - at("_ring", i + 1)["x"] * at("_ring", i)["y"] for i in range(4)), F.lit(0.0))

    def rotated(start: int) -> Column:
        return F.array(*[at("_ring", start + i) for i in range(4)])

    sums = [at("_ring", i)["x"] + at("_ring", i)["y"] for i in range(4)]
    least = F.least(*sums)
    first = F.when(sums[0] == least, rotated(0)).when(sums[1] == least, rotated(1)).when(sums[2] == least, rotated(2)).otherwise(rotated(3))

    def side(a: int, b: int) -> Column:
        return _length(at("_turned", b)["x"] - at("_turned", a)["x"], at("_turned", b)["y"] - at("_turned", a)["y"])

    upright = side(0, 1) < side(0, 3)
    final = F.when(upright, F.array(*[at("_turned", i) for i in (3, 0, 1, 2)])).otherwise(F.col("_turned"))
    staged = (
        quads.withColumn("_ok", F.coalesce((F.size(pts) == 4) & finite, F.lit(False)))
        .withColumn("_cx", F.when(F.col("_ok"), mean("x")))
        .withColumn("_cy", F.when(F.col("_ok"), mean("y")))
        .withColumn("_ring", F.when(F.col("_ok"), around))
        .withColumn("ordered", F.coalesce(F.col("_ok") & convex & (F.abs(twice) / 2 >= min_area), F.lit(False)))
        .withColumn("_turned", F.when(F.col("ordered"), first))
        .withColumn("_final", final)
    )
    corners = {}
    for i, corner in enumerate(CORNERS):
        corners[f"{corner}x"] = F.when(F.col("ordered"), F.col("_final")[i]["x"])
        corners["try_" if corner == "tr" else f"{corner}y"] = F.when(F.col("ordered"), F.col("_final")[i]["y"])
    return staged.withColumns(corners).drop("_ok", "_cx", "_cy", "_ring", "_turned", "_final")


def measure_quads(quads: DataFrame, height: Column | None = None, width: Column | None = None,
                  min_area_fraction: float = 0.12) -> DataFrame:
    """True aspect, skew, trust and (with a frame size) validity of ordered quads (tlx ... bly)."""
    wide = (_edge("tl", "tr") + _edge("bl", "br")) / 2
    high = (_edge("tl", "bl") + _edge("tr", "br")) / 2
    gap = _length(
        (_x("tr") - _x("tl")) - (_x("br") - _x("bl")),
        (_y("tr") - _y("tl")) - (_y("br") - _y("bl")),
    )
    shoelace = sum(
        (_x(a) * _y(b) - _x(b) * _y(a) for a, b in (("tl", "tr"), ("tr", "br"), ("br", "bl"), ("bl", "tl"))),
        F.lit(0.0),
    )
    measured = quads.withColumns({
        "edge_w": wide,
        "edge_h": high,
        "aspect": F.when(high > 1e-6, wide / high).otherwise(0.0),
        "skew": F.when(high < 1e-6, 0.0).otherwise(gap / high),
        "quad_area": F.abs(shoelace) / 2,
        "trusted_aspect": F.col("method") == "glyph_row",
    })
    if height is not None:
        inside = F.lit(True)
        for corner in CORNERS:
            inside = inside & _x(corner).between(-0.25 * width, 1.25 * width)
            inside = inside & _y(corner).between(-0.25 * height, 1.25 * height)
        measured = measured.withColumn("valid", F.coalesce(
            inside & (F.col("quad_area") >= min_area_fraction * height * width) & (F.col("edge_h") >= 5) & F.col("aspect").between(0.7, 8.0),
            F.lit(False),
        ))
    return measured


def quad_quality(measured: DataFrame) -> DataFrame:
    """Per estimation method: quads, valid quads, share with a trusted aspect, spread of the skew."""
    return measured.groupBy("method").agg(
        F.count(F.lit(1)).alias("quads"),
        F.count_if("valid").alias("valid"),
        (F.count_if("trusted_aspect") / F.count(F.lit(1))).alias("trusted_share"),
        F.min("skew").alias("min_skew"), F.avg("skew").alias("mean_skew"), F.max("skew").alias("max_skew"),
    )


def select_quads(candidates: DataFrame, k: int = 5, min_height: float = 7.0, low: float = 1.8, high: float = 7.0,
                 min_area: float = 120.0, **sizes: int) -> DataFrame:
    """At most ``k`` plate-shaped quads per image, largest first. A quad is a near-duplicate of a
    chosen one when its centre is closer than half its height and the areas are within 50 %.

    ``candidates`` has image_id, quad_idx, centre cx and cy, quad_area, edge_w and edge_h.
    """
    shaped = candidates.filter(
        (F.col("quad_area") >= min_area) & (F.col("edge_h") >= min_height) & (F.col("edge_w") / F.col("edge_h")).between(low, high)
    )

    def column(later, kept) -> Column:
        gap = _length(later["x1"] - kept["x1"], later["y1"] - kept["y1"])
        return (gap < later["y2"] * 0.5) & (F.abs(kept["x2"] - later["x2"]) / later["x2"] < 0.5)

    def arrays(later, kept):
        gap = ((later[0] - kept[:, 0]) ** 2 + (later[1] - kept[:, 1]) ** 2) ** 0.5
        return (gap < later[3] * 0.5) & (abs(kept[:, 2] - later[2]) / later[2] < 0.5)

    # The selection compares centre, area and height; they travel in the four box slots.
    slots = shaped.withColumns({"x1": F.col("cx"), "y1": F.col("cy"), "x2": F.col("quad_area"), "y2": F.col("edge_h")})
    rule = Rule(column, arrays, equal_conflict=False)
    chosen = greedy_keep(slots, "image_id", [("quad_area", True), ("quad_idx", False)], rule, stop_after=k, **sizes)
    return chosen.drop("x1", "y1", "x2", "y2")


def _weight(line: Column, u: Column, v: Column) -> Column:
    """Huber weight of a point: 1 near the line, falling with the distance beyond."""
    gap = F.abs(line["dx"] * (v - line["y0"]) - line["dy"] * (u - line["x0"]))
    return F.when(gap > HUBER, F.lit(HUBER) / gap).otherwise(F.lit(1.0))


def _line(n: Column, su: Column, sv: Column, suu: Column, suv: Column, svv: Column) -> Column:
    """The line of least squared distances through weighted points, from their moments: a point and a direction."""
    x0, y0 = su / n, sv / n
    angle = F.atan2(2 * (suv / n - x0 * y0), (suu / n - x0 * x0) - (svv / n - y0 * y0)) / 2
    return F.struct(x0.alias("x0"), y0.alias("y0"), F.cos(angle).alias("dx"), F.sin(angle).alias("dy"))


_MOMENTS = ("n", "su", "sv", "suu", "suv", "svv")


def _moments(w: Column, u: Column, v: Column) -> list[Column]:
    return [w, w * u, w * v, w * u * u, w * u * v, w * v * v]


#: Sides of a row of glyphs: the line through their tops and the one through their bottoms.
_SIDES = {"_top": lambda: F.col("y").cast("double"), "_low": lambda: (F.col("y") + F.col("h")).cast("double")}


def _sums(u: Column, weights: dict[str, Column]) -> dict[str, Column]:
    """Weighted moments of both sides, as aggregates."""
    return {f"{side}_{name}": F.sum(c) for side, v in _SIDES.items() for name, c in zip(_MOMENTS, _moments(weights[side], u, v()))}


def _lines() -> list[Column]:
    return [_line(*[F.col(f"{side}_{name}") for name in _MOMENTS]).alias(side) for side in _SIDES]


def _reweighed(u: Column) -> dict[str, Column]:
    return {side: _weight(F.col(side), u, v()) for side, v in _SIDES.items()}


_SHAPE = {
    "glyphs": lambda: F.count(F.lit(1)), "glyph_h": lambda: F.median("h"), "glyph_w": lambda: F.median("w"),
    "_left": lambda: F.min("x"), "_right": lambda: F.max(F.col("x") + F.col("w")), "_width": lambda: F.max("crop_w"),
}


def _fits_of_windows(shaped: DataFrame, key: str) -> DataFrame:
    """After one shuffle by crop every round is a window over its few glyphs: moments, then the next line."""
    crop = Window.partitionBy(key)
    row = shaped.withColumns({"_mid": F.median("h").over(crop), "_n": F.count(F.lit(1)).over(crop)})
    row = row.filter((F.col("_n") >= 3) & F.col("h").between(0.62 * F.col("_mid"), 1.45 * F.col("_mid"))).drop("_mid", "_n")
    own = row.columns
    u = F.col("x") + F.col("w") / 2
    weights = dict.fromkeys(_SIDES, F.lit(1.0))
    for _ in range(FIT_ROUNDS + 1):
        row = row.withColumns({name: c.over(crop) for name, c in _sums(u, weights).items()}).select(*own, *_lines())
        weights = _reweighed(u)
    shape = [c().alias(name) for name, c in _SHAPE.items()]
    return row.groupBy(key).agg(*shape, *[F.first(side).alias(side) for side in _SIDES]).filter("glyphs >= 6")


def _fits_of_moments(shaped: DataFrame, key: str) -> DataFrame:
    """The same for crops with very many glyphs: every round is a partial aggregation of moments, and the
    lines of the round before, one row per crop, are joined to the glyphs."""
    typical = shaped.groupBy(key).agg(F.median("h").alias("_mid"), F.count(F.lit(1)).alias("_n")).filter("_n >= 3").drop("_n")
    row = cut_lineage(shaped.join(typical, key).filter(F.col("h").between(0.62 * F.col("_mid"), 1.45 * F.col("_mid"))).drop("_mid"))
    u = F.col("x") + F.col("w") / 2

    def fitted(rows: DataFrame, weights: dict[str, Column]) -> DataFrame:
        return cut_lineage(rows.groupBy(key).agg(*[c.alias(name) for name, c in _sums(u, weights).items()]).select(key, *_lines()))

    lines = fitted(row, dict.fromkeys(_SIDES, F.lit(1.0)))
    for _ in range(FIT_ROUNDS):
        lines = fitted(row.join(lines, key), _reweighed(u))
    return row.groupBy(key).agg(*[c().alias(name) for name, c in _SHAPE.items()]).filter("glyphs >= 6").join(lines, key)


def glyph_row_quads(glyphs: DataFrame, key: str = "crop_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Plate corners from the glyph boxes of a crop: glyphs of one height, a line through their
    tops and one through their bottoms, closed past the outermost glyphs.

    The lines are robust: least squared distances from the line, re-weighted by Huber's rule for a fixed number of
    rounds, so a glyph off the row hardly tilts them. A line that stands upright gives no quad. Crops above
    ``group_rows`` glyphs are fitted by partial aggregation, others in windows. Glyphs with null sizes are left out.
    """
    x, y, w, h = (F.col(name) for name in ("x", "y", "w", "h"))
    shaped = glyphs.filter(
        h.between(0.16 * F.col("crop_h"), 0.80 * F.col("crop_h")) & (w >= 2) & (w <= 0.35 * F.col("crop_w")) & (w / h).between(0.10, 1.6) & x.isNotNull() & y.isNotNull()
    ).select(key, "x", "y", "w", "h", "crop_w")
    light, heavy, _ = split_heavy(shaped, [key], group_rows)
    fits = _fits_of_windows(light, key)
    if heavy is not None:
        many = _fits_of_moments(heavy, key)
        fits = fits.unionByName(many.select(*[F.col(name).cast(kind) for name, kind in fits.dtypes]))
    fits = fits.filter((F.abs(F.col("_top.dx")) >= UPRIGHT) & (F.abs(F.col("_low.dx")) >= UPRIGHT))
    left = F.col("_left") - 0.9 * F.col("glyph_w")
    right = F.col("_right") + 1.6 * F.col("glyph_w")
    closed = fits.withColumn("left_x", F.least(F.greatest(left, -0.15 * F.col("_width")), F.col("_width").cast("double"))).withColumn(
        "right_x", F.least(F.greatest(right, F.lit(0.0)), 1.15 * F.col("_width"))
    ).filter(F.col("right_x") - F.col("left_x") >= 3 * F.col("glyph_w"))
    pad = 0.28 * F.col("glyph_h")

    def height(line: str, at: str) -> Column:
        return F.col(line)["y0"] + F.col(line)["dy"] / F.col(line)["dx"] * (F.col(at) - F.col(line)["x0"])

    return closed.select(
        key, "glyphs",
        F.col("left_x").alias("tlx"), (height("_top", "left_x") - pad).alias("tly"), F.col("right_x").alias("trx"), (height("_top", "right_x") - pad).alias("try_"),
        F.col("right_x").alias("brx"), (height("_low", "right_x") + pad).alias("bry"), F.col("left_x").alias("blx"), (height("_low", "left_x") + pad).alias("bly"),
    )
