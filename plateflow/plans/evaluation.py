"""Results against hand labels, and plate geometry."""

from pyspark.sql import functions as F

from plateflow.functions import expr
from plateflow.operators import evaluate, geometry
from plateflow.plans import parts as p
from plateflow.plans.registry import query


def _alnum(c: str) -> str:
    return f"regexp_replace(upper(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _first(column: str, condition: str) -> str:
    return f"first({column} ORDER BY detection_id) FILTER (WHERE {condition})"


TAKEN = "plate_readable AND coalesce(license_plate, '') <> ''"
ROWS = f"""f AS (
        SELECT image_id, count(*) AS n, {_first('license_plate', TAKEN)} AS reported_plate, min(detection_id) FILTER (WHERE {TAKEN}) AS best,
               {_first('manufacturer', TAKEN)} AS best_maker, {_first('manufacturer', "coalesce(manufacturer, '') <> ''")} AS any_maker,
               {_first('plate_text_raw', "coalesce(plate_text_raw, '') <> ''")} AS raw, {_first('plate_status', 'plate_text_raw IS NOT NULL')} AS status,
               count(plate_text_raw) AS boxes, {_first('plate_ocr_confidence', TAKEN)} AS ocr
        FROM v_detection GROUP BY image_id
    ), rows AS (
        SELECT t.image_id, t.category, t.plate AS expected_plate, t.manufacturer AS expected_manufacturer, f.reported_plate,
               CASE WHEN f.best IS NOT NULL THEN f.best_maker ELSE f.any_maker END AS reported_manufacturer, coalesce(f.boxes, 0) > 0 AS plate_box_found,
               f.raw AS best_raw_text, f.ocr AS ocr_confidence, CASE WHEN coalesce(f.boxes, 0) = 0 THEN 'no_plate_box' ELSE f.status END AS status, coalesce(f.n, 0) AS vehicles,
               {_alnum('t.plate')} <> '' AND {_alnum('t.plate')} = {_alnum('f.reported_plate')} AS exact_match,
               CASE WHEN {_alnum('t.plate')} <> '' THEN levenshtein({_alnum('t.plate')}, {_alnum('f.reported_plate')}) END AS char_errors
        FROM v_plate_truth t LEFT JOIN f ON f.image_id = t.image_id
    )"""


@query("model_vs_truth", f"WITH {ROWS} SELECT * FROM rows")
def _(fx):
    return evaluate.model_vs_truth(fx.v_plate_truth, fx.v_detection).drop("rectified")


def _ratio(hit: str, among: str) -> str:
    return f"concat(count(*) FILTER (WHERE ({among}) AND coalesce({hit}, false)), '/', count(*) FILTER (WHERE {among}))"


@query(
    "plate_eval_summary",
    f"""WITH {ROWS} SELECT count(*) AS frames, count(*) FILTER (WHERE category = 'readable') AS readable_frames,
        count(*) FILTER (WHERE category = 'partial') AS partial_frames, count(*) FILTER (WHERE category = 'none_legible') AS none_legible_frames,
        {_ratio('plate_box_found', "category IN ('readable', 'partial')")} AS localised, {_ratio('exact_match', "category = 'readable'")} AS exact_on_readable,
        cast(coalesce(sum(char_errors) FILTER (WHERE category = 'readable'), 0) AS bigint) AS char_errors_on_readable,
        {_ratio('reported_plate IS NULL', "category = 'partial'")} AS abstained_on_partial,
        {_ratio('reported_plate IS NOT NULL', "category = 'none_legible'")} AS false_accepts_on_none_legible,
        {_ratio('reported_manufacturer = expected_manufacturer', 'expected_manufacturer IS NOT NULL')} AS manufacturer_correct,
        count(*) FILTER (WHERE reported_manufacturer <> expected_manufacturer) AS manufacturer_wrong FROM rows""",
)
def _(fx):
    rows = evaluate.model_vs_truth(fx.v_plate_truth, fx.v_detection)
    return evaluate.plate_eval_summary(rows).drop("accepted_via_rectified", "mean_seconds")


# ---- geometry ------------------------------------------------------------------------------


def _edge(a: str, b: str) -> str:
    ya, yb = ("try_" if c == "tr" else c + "y" for c in (a, b))
    return f"sqrt(({b}x - {a}x) * ({b}x - {a}x) + ({yb} - {ya}) * ({yb} - {ya}))"


MEASURED = f"""e AS (SELECT *, ({_edge('tl', 'tr')} + {_edge('bl', 'br')}) / 2 AS w, ({_edge('tl', 'bl')} + {_edge('tr', 'br')}) / 2 AS h,
        sqrt(pow((trx - tlx) - (brx - blx), 2) + pow((try_ - tly) - (bry - bly), 2)) AS gap,
        abs(tlx * try_ - trx * tly + trx * bry - brx * try_ + brx * bly - blx * bry + blx * tly - tlx * bly) / 2 AS area FROM v_quad
    ), m AS (
        SELECT *, CASE WHEN h > 1e-6 THEN w / h ELSE 0 END AS aspect, CASE WHEN h < 1e-6 THEN 0 ELSE gap / h END AS skew,
               least(tlx, trx, brx, blx) >= -0.25 * 400 AND greatest(tlx, trx, brx, blx) <= 1.25 * 400
               AND least(tly, try_, bry, bly) >= -0.25 * 160 AND greatest(tly, try_, bry, bly) <= 1.25 * 160
               AND area >= 0.05 * 160 * 400 AND h >= 5 AND (CASE WHEN h > 1e-6 THEN w / h ELSE 0 END) BETWEEN 0.7 AND 8.0 AS valid FROM e
    )"""


def _measured(fx):
    return geometry.measure_quads(fx.v_quad, F.lit(160), F.lit(400), min_area_fraction=0.05)


@query(
    "measure_quads",
    f"WITH {MEASURED} SELECT image_id, plate_idx, {p.fixed('aspect', 6)} AS aspect, {p.fixed('skew', 6)} AS skew, valid FROM m",
)
def _(fx):
    return _measured(fx).select("image_id", "plate_idx", expr.fixed("aspect", 6).alias("aspect"), expr.fixed("skew", 6).alias("skew"), "valid")


@query(
    "quad_quality",
    f"""WITH {MEASURED} SELECT method, count(*) AS quads, count(*) FILTER (WHERE valid) AS valid,
        count(*) FILTER (WHERE method = 'glyph_row')::double / count(*) AS trusted_share, {p.fixed('min(skew)', 6)} AS min_skew,
        {p.fixed('avg(skew)', 6)} AS mean_skew, {p.fixed('max(skew)', 6)} AS max_skew FROM m GROUP BY method""",
)
def _(fx):
    report = geometry.quad_quality(_measured(fx))
    return report.withColumns({name: expr.fixed(name, 6) for name in ("min_skew", "mean_skew", "max_skew")})


#: The quads with their corners in a scrambled order, and some with two corners the same.
SCRAMBLED = """SELECT image_id, plate_idx, array(named_struct('x', brx, 'y', bry), named_struct('x', tlx, 'y', tly),
    CASE WHEN plate_idx = 7 THEN named_struct('x', tlx, 'y', tly) ELSE named_struct('x', blx, 'y', bly) END, named_struct('x', trx, 'y', try_)) AS points FROM v_quad"""


@query(
    "order_corners",
    """WITH r AS (SELECT image_id, plate_idx, [{'x': tlx, 'y': tly}, {'x': trx, 'y': try_}, {'x': brx, 'y': bry}, {'x': blx, 'y': bly}] AS ring FROM v_quad),
    s AS (SELECT *, list_transform(ring, lambda c: c.x + c.y) AS sums FROM r),
    t AS (SELECT *, list_position(sums, list_min(sums)) AS k FROM s),
    u AS (SELECT *, list_concat(ring[k:], ring[:k - 1]) AS q FROM t),
    v AS (SELECT *, sqrt(pow(q[2].x - q[1].x, 2) + pow(q[2].y - q[1].y, 2)) < sqrt(pow(q[4].x - q[1].x, 2) + pow(q[4].y - q[1].y, 2)) AS upright FROM u),
    w AS (SELECT *, CASE WHEN plate_idx = 7 THEN NULL WHEN upright THEN [q[4], q[1], q[2], q[3]] ELSE q END AS f FROM v)
    SELECT image_id, plate_idx, plate_idx <> 7 AS ordered, f[1].x AS tlx, f[1].y AS tly, f[3].x AS brx, f[3].y AS bry FROM w""",
)
def _(fx):
    return geometry.order_corners(fx.sql(SCRAMBLED)).select("image_id", "plate_idx", "ordered", "tlx", "tly", "brx", "bry")


def _fit_sql(n: int) -> str:
    """Lines of least squared distances with weights ``w``, from those of the round before."""
    weighted = "SELECT *, 1.0 AS w FROM p" if n == 0 else (
        f"SELECT p.*, 1.345 / greatest(1.345, abs(cos(l.a) * (p.v - l.y0) - sin(l.a) * (p.u - l.x0))) AS w FROM p JOIN l{n - 1} l USING (crop_id, side)"
    )
    return f"""m{n} AS (SELECT crop_id, side, sum(w * u) / sum(w) AS x0, sum(w * v) / sum(w) AS y0, sum(w * u * u) / sum(w) AS uu, sum(w * u * v) / sum(w) AS uv,
                     sum(w * v * v) / sum(w) AS vv FROM ({weighted}) GROUP BY ALL),
    l{n} AS MATERIALIZED (SELECT crop_id, side, x0, y0, atan2(2 * (uv - x0 * y0), (uu - x0 * x0) - (vv - y0 * y0)) / 2 AS a FROM m{n})"""


FITS = ",\n    ".join(_fit_sql(n) for n in range(geometry.FIT_ROUNDS + 1))
LAST_FIT = f"l{geometry.FIT_ROUNDS}"


@query(
    "glyph_row_quads",
    f"""WITH s AS (SELECT * FROM v_glyph_box WHERE h BETWEEN 0.16 * crop_h AND 0.80 * crop_h AND w >= 2 AND w <= 0.35 * crop_w AND w / h BETWEEN 0.10 AND 1.6),
    t AS (SELECT crop_id, median(h) AS mid FROM s GROUP BY 1 HAVING count(*) >= 3),
    r AS (SELECT s.*, x + w / 2 AS cx FROM s JOIN t ON t.crop_id = s.crop_id WHERE h BETWEEN 0.62 * mid AND 1.45 * mid),
    p AS (SELECT crop_id, 'top' AS side, cx AS u, cast(y AS double) AS v FROM r UNION ALL SELECT crop_id, 'low', cx, cast(y + h AS double) FROM r),
    {FITS},
    f AS (SELECT crop_id, count(*) AS glyphs, median(h) AS gh, median(w) AS gw, min(x) AS l, max(x + w) AS r, max(crop_w) AS cw FROM r GROUP BY 1 HAVING count(*) >= 6),
    c AS (SELECT f.*, least(greatest(l - 0.9 * gw, -0.15 * cw), cw) AS lx, least(greatest(r + 1.6 * gw, 0), 1.15 * cw) AS rx, t.x0 AS tx, t.y0 AS ty, tan(t.a) AS ts,
                 b.x0 AS bx, b.y0 AS by_, tan(b.a) AS bs
          FROM f JOIN {LAST_FIT} t ON t.crop_id = f.crop_id AND t.side = 'top' JOIN {LAST_FIT} b ON b.crop_id = f.crop_id AND b.side = 'low')
    SELECT crop_id, glyphs, {p.fixed('lx', 3)} AS tlx, {p.fixed('ty + ts * (lx - tx) - 0.28 * gh', 3)} AS tly, {p.fixed('by_ + bs * (rx - bx) + 0.28 * gh', 3)} AS bry
    FROM c WHERE rx - lx >= 3 * gw""",
)
def _(fx):
    quads = geometry.glyph_row_quads(fx.v_glyph_box)
    return quads.select("crop_id", "glyphs", *[expr.fixed(name, 3).alias(name) for name in ("tlx", "tly", "bry")])


QUADS = """SELECT image_id, plate_idx AS quad_idx, cast(x1 + x2 AS double) / 2 AS cx, cast(y1 + y2 AS double) / 2 AS cy,
    cast((x2 - x1) * (y2 - y1) AS double) AS quad_area, cast(x2 - x1 AS double) AS edge_w, cast(y2 - y1 AS double) AS edge_h FROM v_plate_box"""


@query(
    "select_quads",
    f"""WITH RECURSIVE c AS (SELECT * FROM ({QUADS}) q WHERE quad_area >= 120 AND edge_h >= 7 AND edge_w / edge_h BETWEEN 1.8 AND 7),
    o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY quad_area DESC, quad_idx) AS rn FROM c),
    s AS (
        SELECT image_id, 1::bigint AS rn, [{{'i': quad_idx, 'x': cx, 'y': cy, 'a': quad_area}}] AS kept FROM o WHERE rn = 1
        UNION ALL
        SELECT s.image_id, s.rn + 1, CASE WHEN len(s.kept) >= 2 OR len(list_filter(s.kept, lambda b: sqrt((o.cx - b.x) * (o.cx - b.x) + (o.cy - b.y) * (o.cy - b.y)) < o.edge_h * 0.5
                    AND abs(b.a - o.quad_area) / o.quad_area < 0.5)) > 0 THEN s.kept
               ELSE list_append(s.kept, {{'i': o.quad_idx, 'x': o.cx, 'y': o.cy, 'a': o.quad_area}}) END
        FROM s JOIN o ON o.image_id = s.image_id AND o.rn = s.rn + 1
    ), f AS (SELECT image_id, kept FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY rn DESC) = 1)
    SELECT image_id, unnest(kept).i AS quad_idx FROM f""",
)
def _(fx):
    return geometry.select_quads(fx.sql(QUADS), k=2).select("image_id", "quad_idx")
