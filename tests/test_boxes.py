"""Suppression and assignment against brute force, including images far above the group limit."""

import random

import pytest
from pyspark.sql import functions as F

from plateflow.operators import boxes, geometry, suppress

BOX = "image_id bigint, box_idx bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, confidence double"


def make(seed, sizes, frame=600, top=120, copies=0.3):
    rng = random.Random(seed)
    data = []
    for image, n in sizes.items():
        mine = []
        for i in range(n):
            if mine and rng.random() < copies:
                x1, y1, x2, y2 = rng.choice(mine)
            else:
                x1, y1 = rng.randrange(frame), rng.randrange(frame)
                x2, y2 = x1 + rng.randrange(top), y1 + rng.randrange(top)
            mine.append((x1, y1, x2, y2))
            data.append((image, i, x1, y1, x2, y2, rng.randrange(50) / 50))
    return data


def area(b):
    return max(0, b[4] - b[2]) * max(0, b[5] - b[3])


def shared(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


def vehicle_clash(later, kept):
    both = shared(later, kept)
    union = area(later) + area(kept) - both
    return (union > 0 and both / union > 0.55) or (area(later) > 0 and both / area(later) > 0.88)


def plate_clash(later, kept):
    return shared(later, kept) / max(1, min(area(later), area(kept))) > 0.3


def greedy(data, clash):
    out = set()
    for image in {b[0] for b in data}:
        kept = []
        for box in sorted((b for b in data if b[0] == image), key=lambda b: (-b[6], b[1])):
            if not any(clash(box, other) for other in kept):
                kept.append(box)
        out |= {(b[0], b[1]) for b in kept}
    return out


@pytest.mark.parametrize(("clash", "op", "index"), [
    (vehicle_clash, suppress.suppress_vehicles, "box_idx"), (plate_clash, suppress.suppress_plates, "plate_idx"),
])
@pytest.mark.parametrize("sizes", [{"group_rows": 10_000}, {"group_rows": 20, "chunk": 60}])
def test_suppression(spark, clash, op, index, sizes):
    data = make(3, {1: 200, 2: 1, 3: 15, 4: 60})
    df = spark.createDataFrame(data, BOX).withColumnRenamed("box_idx", index)
    got = {(row.image_id, row[index]) for row in op(df, **sizes).collect()}
    assert got == greedy(data, clash)


def test_suppressed_boxes_do_not_suppress(spark):
    data = [(1, 0, 0, 0, 100, 100, 0.9), (1, 1, 0, 0, 100, 140, 0.8), (1, 2, 0, 0, 100, 200, 0.7)]
    got = {row.box_idx for row in suppress.suppress_vehicles(spark.createDataFrame(data, BOX)).collect()}
    assert got == {0, 2}


def test_kept_columns_survive_in_both_paths(spark):
    df = spark.createDataFrame(make(5, {1: 40, 2: 3}), BOX).withColumn("label", F.lit("truck"))
    for sizes in ({}, {"group_rows": 5, "chunk": 20}):
        assert suppress.suppress_vehicles(df, **sizes).columns == df.columns


@pytest.mark.parametrize("sizes", [{}, {"group_rows": 20, "cell": 64}, {"group_rows": 1, "cell": 17}, {"group_rows": 1, "pairs": 4}, {"group_rows": 50, "cell": 256, "pairs": 100}])
def test_assignment(spark, sizes):
    vehicles = make(7, {1: 200, 2: 8, 3: 1, 5: 30}, top=400)
    plates = make(8, {1: 200, 2: 30, 3: 10, 4: 5, 5: 25}, top=40)
    want = {}
    for p in plates:
        cx, cy = (p[2] + p[4]) / 2, (p[3] + p[5]) / 2
        holding = [(area(v), v[1]) for v in vehicles if v[0] == p[0] and v[2] <= cx <= v[4] and v[3] <= cy <= v[5]]
        want[p[0], p[1]] = min(holding)[1] if holding else -1
    got = boxes.assign_plates(
        spark.createDataFrame(plates, BOX).withColumnRenamed("box_idx", "plate_idx"), spark.createDataFrame(vehicles, BOX), **sizes
    ).collect()
    assert {(row.image_id, row.plate_idx): row.box_idx for row in got} == want
    assert len(got) == len(plates)


def test_smallest_vehicle_wins(spark):
    vehicles = spark.createDataFrame([(1, 0, 0, 0, 1000, 800, 0.9), (1, 1, 100, 100, 400, 500, 0.8)], BOX)
    plates = spark.createDataFrame([(1, 0, 200, 300, 260, 330, 0.9), (1, 1, 2000, 2000, 2060, 2030, 0.9)], BOX).withColumnRenamed("box_idx", "plate_idx")
    assert {row.plate_idx: row.box_idx for row in boxes.assign_plates(plates, vehicles).collect()} == {0: 1, 1: -1}


@pytest.mark.parametrize("sizes", [{}, {"group_rows": 20, "chunk": 30}])
def test_quad_selection_stops_at_k(spark, sizes):
    rng = random.Random(4)
    data = [(image, i, rng.uniform(0, 90), rng.uniform(0, 90), float(rng.randrange(200, 400)), 30.0, 10.0)
            for image, n in {1: 120, 2: 9}.items() for i in range(n)]
    ddl = "image_id bigint, quad_idx bigint, cx double, cy double, quad_area double, edge_w double, edge_h double"
    want = set()
    for image in (1, 2):
        kept = []
        for q in sorted((q for q in data if q[0] == image), key=lambda q: (-q[4], q[1])):
            near = any(((q[2] - o[2]) ** 2 + (q[3] - o[3]) ** 2) ** 0.5 < q[6] * 0.5 and abs(o[4] - q[4]) / q[4] < 0.5 for o in kept)
            if len(kept) < 25 and not near:
                kept.append(q)
        want |= {(q[0], q[1]) for q in kept}
    got = geometry.select_quads(spark.createDataFrame(data, ddl), k=25, **sizes)
    assert {(row.image_id, row.quad_idx) for row in got.collect()} == want


def test_context_crop(spark):
    df = spark.createDataFrame([(1, 0, 10, 5, 110, 85, 0.5)], BOX)
    row = boxes.expand_boxes(df, 200, 100).first()
    assert (row.crop_y2 - row.crop_y1, row.crop_x2 - row.crop_x1) == (93, 140)
    with pytest.raises(ValueError):
        boxes.expand_boxes(df, 200, 100, margin_x=1.5)


def test_main_vehicle_and_quads(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 10, 10, 0.9), (1, 1, 0, 0, 100, 100, 0.8)], BOX)
    assert boxes.main_vehicle(df).first().box_idx == 1
    square = spark.createDataFrame([([(0.0, 0.0), (100.0, 0.0), (0.0, 20.0), (100.0, 20.0)],)], "points array<struct<x:double,y:double>>")
    row = geometry.order_corners(square).first()
    assert (row.ordered, row.tlx, row.tly, row.brx, row.bry) == (True, 0.0, 0.0, 100.0, 20.0)
    flat = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)],), ([(0.0, 0.0), (10.0, 0.0), (5.0, 2.0), (5.0, 10.0)],)], "points array<struct<x:double,y:double>>")
    assert [row.ordered for row in geometry.order_corners(flat).collect()] == [False, False]


@pytest.mark.parametrize("sizes", [{}, {"group_rows": 10}])
def test_plates_without_a_centre_and_images_of_plates(spark, sizes):
    """Null corners, and an image with few boxes and many plates, answer alike on both paths."""
    vehicles = spark.createDataFrame([(1, 0, 0, 0, 50, 50, 0.9), (1, 1, 0, 0, 20, 20, 0.9)], BOX)
    plates = spark.createDataFrame(
        [(1, i, i, i, i + 2, i + 2, 0.5) for i in range(60)] + [(1, 99, None, 5, 6, 7, 0.5), (2, 0, None, None, None, None, 0.5)], BOX
    ).withColumnRenamed("box_idx", "plate_idx")
    got = {(row.image_id, row.plate_idx): row.box_idx for row in boxes.assign_plates(plates, vehicles, **sizes).collect()}
    assert got == {**{(1, i): 1 if i < 20 else 0 if i < 50 else -1 for i in range(60)}, (1, 99): -1, (2, 0): -1}


@pytest.mark.parametrize("op", [suppress.suppress_vehicles, suppress.suppress_plates])
def test_tied_priorities_are_decided_alike(spark, op):
    """Ties go by the other columns; a group of any size gives the same rows."""
    data = [(image, 0, x1, y1, x2, y2, 0.5) for image, _, x1, y1, x2, y2, _ in make(11, {1: 150}, frame=200, top=60)]
    data += [(1, 0, None, 0, 5, 5, 0.5), (1, 0, 9, 9, 9, 20, 0.5), (1, 0, 9, 9, 9, 20, 0.5)]
    df = spark.createDataFrame(data, BOX).withColumnRenamed("box_idx", "plate_idx" if op is suppress.suppress_plates else "box_idx")
    want = sorted(map(str, op(df, group_rows=10_000).collect()))
    for sizes in ({"group_rows": 10, "chunk": 7}, {"group_rows": 100}):
        assert sorted(map(str, op(df, **sizes).collect())) == want
    chosen = lambda **sizes: sorted(map(str, geometry.select_quads(quads, k=9, **sizes).collect()))
    quads = spark.createDataFrame([(1, 0, float(i % 11), 0.0, 300.0, 30.0, 10.0) for i in range(60)], "image_id bigint, quad_idx bigint, cx double, cy double, quad_area double, edge_w double, edge_h double")
    assert chosen(group_rows=5, chunk=7) == chosen()


@pytest.mark.parametrize(("clash", "op", "index"), [
    (vehicle_clash, suppress.suppress_vehicles, "box_idx"), (plate_clash, suppress.suppress_plates, "plate_idx"),
])
def test_few_rounds_for_a_hot_image(spark, caplog, clash, op, index):
    """Boxes of all sizes in one image: the rounds follow chains of neighbours, not the number of boxes."""
    data = make(21, {1: 1500}, frame=3000, top=90) + [(1, 5000 + i, 10 * i, 0, 10 * i + 1500, 1200, 0.1 * (i % 9)) for i in range(20)]
    df = spark.createDataFrame(data, BOX).withColumnRenamed("box_idx", index)
    with caplog.at_level("INFO", "plateflow.operators.suppress"):
        got = {(row.image_id, row[index]) for row in op(df, group_rows=100).collect()}
    assert got == greedy(data, clash)
    assert 1 < len([r for r in caplog.records if "suppression round" in r.message]) <= 12


def test_frames_of_several_sizes(spark):
    raw = spark.createDataFrame([(1, 0, 0.9, "car", 0.5, 0.5, 0.5, 0.5, 100, 80), (2, 0, 0.9, "car", 0.5, 0.5, 0.5, 0.5, 400, 200)],
                                "image_id bigint, box_idx bigint, confidence double, coco_label string, cx double, cy double, bw double, bh double, w int, h int")
    rows = boxes.decode_boxes(raw, F.col("w"), F.col("h")).collect()
    assert {row.image_id: (row.x1, row.y1, row.x2, row.y2) for row in rows} == {1: (25, 20, 75, 60), 2: (100, 50, 300, 150)}


def glyph_rows(spark, rows):
    return spark.createDataFrame(rows, "crop_id bigint, x int, y int, w int, h int, crop_w int, crop_h int")


def test_one_misplaced_glyph_does_not_tilt_the_quad(spark):
    """Ten glyphs on a slope and one far below; least squares would tilt by several pixels."""
    row = [(1, 20 + 22 * i, 30 + i, 14, 40, 300, 100) for i in range(10)]
    clean, bent = geometry.glyph_row_quads(glyph_rows(spark, row)).first(), geometry.glyph_row_quads(glyph_rows(spark, [*row, (1, 240, 60, 14, 40, 300, 100)])).first()
    slope = (clean.try_ - clean.tly) / (clean.trx - clean.tlx)
    assert abs(slope - 1 / 22) < 1e-6 and bent.glyphs == 11
    assert abs((bent.try_ - bent.tly) / (bent.trx - bent.tlx) - slope) < 0.02


def test_hot_crops_are_fitted_alike(spark):
    rng = random.Random(9)
    rows = [(crop, 10 + 5 * i, 30 + rng.randrange(6) + (40 if rng.random() < 0.1 else 0), 12 + rng.randrange(4), 36 + rng.randrange(8), 600, 100) for crop in (1, 2, 3) for i in range(40)]
    rows += [(4, i, None, 12, 40, 300, 100) for i in range(9)] + [(5, 10 + 20 * i, 30, 12, 40, 300, 100) for i in range(5)]
    one, two = ({r.crop_id: r for r in geometry.glyph_row_quads(glyph_rows(spark, rows), group_rows=n).collect()} for n in (10_000, 20))
    assert set(one) == set(two) == {1, 2, 3}
    for crop in one:
        assert one[crop] == pytest.approx(two[crop], abs=1e-6)


def test_a_crowded_cell_is_split(spark):
    """All boxes and plates of an image in one cell of the first grid: answers equal the plain join, and no cell that is
    tested in the end holds more pairs than asked for, but for cells of one pixel."""
    rng = random.Random(12)
    vehicles = [(1, i, x, y, x + 1 + rng.randrange(30), y + 1 + rng.randrange(30), 0.5) for i in range(800) for x, y in [(rng.randrange(30), rng.randrange(30))]]
    plates = [(1, i, x, y, x + 2, y + rng.randrange(1, 4), 0.5) for i in range(800) for x, y in [(rng.randrange(60), rng.randrange(60))]]
    v, p = spark.createDataFrame(vehicles, BOX), spark.createDataFrame(plates, BOX).withColumnRenamed("box_idx", "plate_idx")
    want = sorted(boxes.assign_plates(p, v, group_rows=10_000).collect())
    seen = []
    keep = boxes._best_edges
    try:
        boxes._best_edges = lambda c, e, grid: seen.append((c, e, grid)) or keep(c, e, grid)
        assert sorted(boxes.assign_plates(p, v, group_rows=10, pairs=2000).collect()) == want
    finally:
        boxes._best_edges = keep
    assert len(seen) > 2
    for c, e, grid in seen[:-1]:
        cells = c.groupBy(*grid).count().withColumnRenamed("count", "a").join(e.groupBy(*grid).count(), grid)
        assert cells.filter(F.col("a") * F.col("count") > 2000).isEmpty()


def test_corners_are_ordered_without_lambdas(spark):
    odd = spark.createDataFrame([(0, [(0.0, 0.0), (9.0, 0.0), (9.0, 5.0)]), (1, [(0.0, 0.0), (9.0, None), (9.0, 5.0), (0.0, 5.0)]), (2, [(0.0, 0.0), None, (9.0, 5.0), (0.0, 5.0)]),
                                 (3, [(0.0, 0.0), (float("nan"), 0.0), (9.0, 5.0), (0.0, 5.0)]), (4, [(9.0, 5.0), (0.0, 0.0), (0.0, 5.0), (9.0, 0.0)]), (5, None), (6, [(0.0, 0.0)] * 5)], "i int, points array<struct<x:double,y:double>>")
    found = geometry.order_corners(odd)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.i for r in found.orderBy("i").collect() if r.ordered] == [4]


def test_queries_keep_to_methods_the_jvm_compiles(spark):
    from plateflow import plans

    name = "spark.sql.codegen.hugeMethodLimit"
    try:
        for own, want in (("65535", "8000"), ("20000", "20000")):
            spark.conf.set(name, own)
            plans.queries()["order_corners"](spark, "/root/testdata/sf0.001")
            assert spark.conf.get(name) == want
    finally:
        spark.conf.unset(name)
