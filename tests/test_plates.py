"""Plate text: layouts, spacing, plausibility, corrections and decisions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from plateflow.functions import expr
from plateflow.operators import reads

READ = "image_id bigint, read_idx bigint, engine string, variant string, text string, mean_confidence double, min_confidence double, shape_aspect double"


def one(spark, text, column, aspect=None):
    row = [(1, 1, "ppocr", "raw", text, 0.9, 0.9, aspect)]
    return reads.classify_reads(spark.createDataFrame(row, READ)).first()[column]


@pytest.mark.parametrize(("text", "layout"), [
    ("123ABC10", "kz_civil_2012"), ("456 LBA 10", "kz_civil_2012"), ("041ahf10", "kz_civil_2012"), ("A123BCD", "kz_private_pre2012"),
    ("A123BC", "kz_other_pre2012"), ("A123BC05", "letter_digits_letters_region"), ("X789YZ123", "letter_digits_letters_region"),
    ("", None), ("WED1355507", None), ("KAMAZ", None), ("123AB10", None), ("123ABC99", None), ("A123BC00", None),
    ("23ABC10", None), ("TOO2026", "kz_machinery_square"), ("1098AAH", "kz_machinery_square_alt"),
])
def test_layouts(spark, text, layout):
    assert one(spark, text, "plate_format") == layout


@pytest.mark.parametrize(("text", "aspect", "fits"), [
    ("TOO2026", 4.6, False), ("AAH1098", 1.3, True), ("123ABC10", 4.6, True), ("123ABC10", 1.1, False), ("123ABC10", 8.0, True),
])
def test_shape_gates_layouts(spark, text, aspect, fits):
    assert (one(spark, text, "plate_format", aspect) is not None) is fits


def test_spacing_and_region(spark):
    assert one(spark, "123abc10", "display") == "123 ABC 10"
    assert one(spark, "23ABC10", "display") == "23ABC10"
    assert one(spark, "123ABC10", "region") == "Kostanay"
    assert one(spark, "A123BC05", "region") == "05"
    assert one(spark, "A123BCD", "region") is None


def test_plausibility_ranks_but_never_accepts(spark):
    texts = spark.createDataFrame([("123ABC10",), ("WED1355507",), ("",), ("123ABC1",), ("KAMAZ",)], "t string")
    values = {row.t: row.p for row in texts.select("t", expr.plausibility("t").alias("p")).collect()}
    assert values["123ABC10"] == 1.0 and values[""] == 0.0
    assert values["WED1355507"] < 0.6 and values["123ABC1"] > values["KAMAZ"]


def test_disagreements(spark):
    pairs = spark.createDataFrame([("384CBA10", "384C8A10"), ("384CBA10", "384CBA10"), ("384CBA10", "384CBA1"), ("", "")], "a string, b string")
    found = [row.d for row in pairs.select(expr.differing_positions(F.col("a"), F.col("b")).alias("d")).collect()]
    assert found == [[4], [], [], []]


@pytest.mark.parametrize(("raw", "patterns", "expected"), [
    ("OIBSZ", ("DDDDD",), "01852"), ("01852", ("LLLLL",), "OIBSZ"), ("OIBSZ", (), "OIBSZ"), ("12ЖABC01", (), ""), ("123/ABC", (), ""),
    ("123 abc-01", (), "123ABC01"), ("123ABC01", ("DDDLLLDD",), "123ABC01"), ("123ABC01", ("DDDDDDDD",), ""), ("I23ABC0I", ("DDDLLLDD",), "123ABC01"),
    ("OOAA", ("DLLL", "LDLL"), ""), ("0OAA", ("DLLL", "XLLL"), "0OAA"),
])
def test_corrections(spark, raw, patterns, expected):
    df = spark.createDataFrame([(raw,)], "text string")
    assert reads.correct_reads(df, patterns).first().corrected == expected


def decide(spark, *found):
    data = [(1, i, engine, variant, text, mean, low, None) for i, (engine, variant, text, mean, low) in enumerate(found)]
    return reads.decide_plate(spark.createDataFrame(data, READ)).first()


def test_accepts_a_clear_plate_and_records_disagreement(spark):
    row = decide(spark, ("ppocr", "rectified", "123ABC10", 0.9, 0.9), ("fast_plate_ocr", "raw", "123A8C10", 0.9, 0.9))
    assert (row.text, row.status, row.readable, row.rectified) == ("123 ABC 10", "accepted", True, True)
    assert row.disagreement_positions == [4]


def test_only_the_best_reading_may_be_accepted(spark):
    row = decide(spark, ("ppocr", "raw", "CAMERA0123", 0.99, 0.99), ("ppocr", "raw", "123ABC10", 0.2, 0.2))
    assert (row.text, row.text_raw, row.status) == (None, "CAMERA0123", "no_matching_plate_format")


def test_provisional_layouts_need_more(spark):
    assert decide(spark, ("ppocr", "raw", "AAH1098", 0.87, 0.87)).status == "below_confidence_threshold"
    assert decide(spark, ("ppocr", "raw", "AAH1098", 0.88, 0.89)).status == "accepted"
    assert decide(spark, ("ppocr", "raw", "123ABC10", 0.56, 0.56)).status == "accepted"


def test_refusals_never_carry_text(spark):
    from plateflow.fixtures import Fixtures
    from tests.conftest import SF

    decided = reads.decide_plate(Fixtures(spark, SF).v_ocr_read)
    assert decided.filter("NOT readable AND text IS NOT NULL").count() == 0
    assert decided.filter("readable AND (text IS NULL OR status <> 'accepted')").count() == 0


def consensus(spark, bodies, regions):
    data = [(1, "body", t, s) for t, s in bodies] + [(1, "region", t, s) for t, s in regions]
    return reads.region_consensus(spark.createDataFrame(data, "plate_id bigint, part string, text string, score double")).first()


def test_region_consensus(spark):
    body = [("X123BC", 0.95)] * 4
    row = consensus(spark, body, [("77", 0.4), ("77", 0.3), ("77", 0.5), ("77", 0.1)])
    assert (row.text_raw, row.text, row.status, row.ocr_confidence) == ("X123BC77", None, "region_needs_review", 0.4)
    assert consensus(spark, body, [("77", 0.8), ("78", 0.8), ("77", 0.8), ("78", 0.8)]) is None
    assert consensus(spark, body, [("77", 0.8)]) is None
    row = consensus(spark, body, [("123", 0.9)] * 4)
    assert (row.text, row.readable, row.ocr_confidence) == ("X 123 BC 123", True, 0.9)


def test_medians_of_hot_plates_are_selected(spark):
    """Selection by histograms equals the sorted middle: outliers, ties, weights, single values and nulls."""
    rng = random.Random(3)
    groups = {
        "even": [rng.random() for _ in range(500)], "odd": [rng.gauss(0, 1) for _ in range(333)], "far": [1e-300, 2e-300, 3.0, 1e300, 5e-300],
        "same": [0.25] * 70, "two": [1.0, 2.0], "close": [0.1 + i * 1e-16 for i in range(50)], "skewed": [2.0**-i for i in range(200)],
    }
    data = [(name, x, rng.choice([1, 1, 3])) for name, xs in groups.items() for x in xs] + [("even", None, 5), ("none", None, 1)]
    got = {r.g: r["median"] for r in reads.hot_medians(spark.createDataFrame(data, "g string, x double, w int"), ["g"], "x", "w", bins=8).collect()}
    for name in groups:
        every = [x for g, x, w in data if g == name and x is not None for _ in range(w)]
        assert got[name] == pytest.approx(statistics.median(every), rel=1e-15), name
    assert "none" not in got
    votes = [(plate, part, "X123BC" if part == "body" else "77", round(rng.uniform(0.3, 1), 4)) for plate in range(4) for part in ("body", "region") for _ in range(60 * (plate + 1))]
    frame = spark.createDataFrame(votes, "plate_id bigint, part string, text string, score double")
    plain, split = (sorted(reads.region_consensus(frame, group_rows=n).collect()) for n in (10_000, 100))
    assert plain == split and len(plain) == 4


def test_variant_reads(spark):
    ddl = "image_id bigint, branch_idx bigint, corrected string, score double, failed boolean"
    data = [(1, 0, "", 0.0, True), (1, 1, "123ABC01", float("nan"), False), (1, 2, "123ABC02", 0.9, False), (1, 3, "123ABC03", 0.9, False),
            (2, 0, "", None, True), (2, 1, "", None, True), (3, 0, "123ABC01", 0.2, False)]
    out = {row.image_id: row for row in reads.best_variant_read(spark.createDataFrame(data, ddl)).collect()}
    assert (out[1].plate_text, out[1].failures, out[1].error) == ("123ABC02", 2, None)
    assert out[2].error == "All OCR branches failed"
    assert (out[3].plate_text, out[3].confidence, out[3].error) == ("", 0.0, None)
