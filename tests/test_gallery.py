"""Nearest references, votes, brands and the settled type."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateflow.operators import badges, gallery

REF = "ref_id bigint, name string, vehicle_type string, source string, embedding array<float>"
QUERY = "query_id bigint, name string, embedding array<float>"


def unit(*values):
    norm = sum(v * v for v in values) ** 0.5
    return [v / norm for v in values]


def classify(spark, entries, query, exclude=(), **bars):
    refs = spark.createDataFrame([(i, name, label, source, vector) for i, (label, name, source, vector) in enumerate(entries)], REF)
    queries = spark.createDataFrame([(1, "frame5.jpg", query)], QUERY)
    return gallery.knn_vote(gallery.cosine_candidates(queries, refs, exclude_same=exclude), **bars).first()


TWO = [("tractor", "kirovets.jpg", "site", unit(1, 0, 0)), ("truck", "kamaz.jpg", "site", unit(0, 1, 0))]


def test_accepts_a_clear_match(spark):
    row = classify(spark, TWO, unit(0.99, 0.14, 0))
    assert (row.vehicle_type, row.reason) == ("tractor", "accepted") and row.similarity > 0.9


def test_refuses_what_is_unlike_everything(spark):
    assert classify(spark, TWO, unit(0, 0, 1)).reason == "below_similarity_floor"


def test_refuses_close_classes(spark):
    entries = [("truck_light", "a.jpg", "site", unit(1, 0.02, 0)), ("trailer", "b.jpg", "site", unit(1, 0, 0.02))]
    row = classify(spark, entries, unit(1, 0.01, 0.01), min_similarity=0.5)
    assert row.reason == "classes_too_close" and row.margin < 0.04


def test_exclusion_changes_the_answer(spark):
    entries = [("tractor", "frame5.jpg", "site_frames", unit(1, 0, 0)), ("truck", "frame1.jpg", "site_frames", unit(0.9, 0.44, 0))]
    assert classify(spark, entries, unit(1, 0, 0), min_margin=0.0).vehicle_type == "tractor"
    assert classify(spark, entries, unit(1, 0, 0), exclude=[("name", "name")], min_margin=0.0).vehicle_type == "truck"
    assert classify(spark, entries[:1], unit(1, 0, 0), exclude=[("name", "name")]) is None


def test_one_outlier_does_not_outvote_a_class(spark):
    entries = [("truck", f"{i}.jpg", "site", unit(1, 0.3 + i / 100, 0)) for i in range(3)] + [("tractor", "d.jpg", "site", unit(1, 0.28, 0))]
    assert classify(spark, entries, unit(1, 0.29, 0), min_margin=0.0).vehicle_type == "truck"


def test_block_path_equals_broadcast_path(spark):
    rng = random.Random(1)
    vector = lambda: unit(*[rng.gauss(0, 1) for _ in range(8)])
    refs = spark.createDataFrame([(i, f"r{i % 7}", f"c{i % 3}", "web", vector()) for i in range(90)], REF)
    queries = spark.createDataFrame([(i, f"r{i % 5}", vector()) for i in range(25)], QUERY)
    same = [("name", "name")]
    small = gallery.cosine_candidates(queries, refs, 4, same).toPandas().sort_values(["query_id", "neighbour_rank"], ignore_index=True)
    blocks = gallery.cosine_candidates(queries, refs, 4, same, block_rows=2, parallelism=2, broadcast_bytes=0)
    blocks = blocks.toPandas().sort_values(["query_id", "neighbour_rank"], ignore_index=True)
    assert small.ref_id.tolist() == blocks.ref_id.tolist() and len(small) == 100
    one = gallery.score_blocks(queries, refs, same).toPandas().sort_values(["query_id", "vehicle_type"], ignore_index=True)
    two = gallery.score_blocks(queries, refs, same, block_rows=2, parallelism=2, broadcast_bytes=0).toPandas()
    two = two.sort_values(["query_id", "vehicle_type"], ignore_index=True)
    assert one.refs_scored.tolist() == two.refs_scored.tolist()
    assert max(abs(one.best_similarity - two.best_similarity)) < 1e-9


TOKEN = "image_id bigint, token_idx bigint, token string, score double"


def read(spark, *tokens):
    return badges.pick_brand(badges.match_brands(spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(tokens)], TOKEN))).first()


@pytest.mark.parametrize(("token", "maker"), [
    ("КИРОВЕЦ", "KIROVETS"), ("КАМАЗ", "KAMAZ"), ("МТЗ", "BELARUS"), ("KAMAZX", "KAMAZ"), ("SCANIB", "SCANIA"), ("MAM", None), ("STAYER", None), ("2026", None),
])
def test_brands(spark, token, maker):
    row = read(spark, (token, 0.95))
    assert (row.manufacturer if row else None) == maker


def test_short_ambiguous_badge_is_refused(spark):
    row = read(spark, ("MA3", 0.85))
    assert (row.manufacturer, row.rejected, row.could_be) == (None, "ambiguous_brand_token", "MAZ,KAMAZ")
    row = read(spark, ("MA3", 0.99), ("KAMAZ", 0.80))
    assert (row.manufacturer, row.badge_type) == ("KAMAZ", "truck")


@pytest.mark.parametrize(("badge", "score", "match", "margin", "reason", "answer"), [
    (None, None, None, None, None, ("truck", "detector", None)),
    ("truck", 0.99, None, None, None, ("truck", "badge_text", None)),
    ("truck", 0.99, "trailer", 0.2, "accepted", ("trailer", "reference_gallery", "accepted")),
    ("truck", 0.99, "trailer", 0.05, "accepted", ("truck", "badge_text", "conflict_with_detector_and_badge")),
    ("truck", 0.60, "trailer", 0.05, "accepted", ("trailer", "reference_gallery", "accepted")),
    (None, None, "tractor", 0.5, "below_similarity_floor", ("truck", "detector", "below_similarity_floor")),
])
def test_type_precedence(spark, badge, score, match, margin, reason, answer):
    vehicles = spark.createDataFrame([(1, 0.77, "truck")], "image_id bigint, confidence double, vehicle_type string")
    read_ = spark.createDataFrame([(1, badge, score)], "image_id bigint, badge_type string, manufacturer_confidence double")
    found = spark.createDataFrame([(1, match, 0.87, margin, reason)], "image_id bigint, vehicle_type string, similarity double, margin double, reason string")
    row = badges.resolve_types(vehicles, read_, found).first()
    assert (row.vehicle_type, row.vehicle_type_source, row.gallery_status) == answer


@pytest.mark.parametrize("sizes", [{"block_rows": 3}, {"block_rows": 3, "broadcast_bytes": 0}])
def test_tiles_do_not_change_the_answer(spark, monkeypatch, sizes):
    """Blocks and tiles smaller than the gallery, with ties and exclusions, on both paths."""
    rng = random.Random(9)
    vectors = [unit(*(rng.choice((-1.0, 0.5, 1.0)) for _ in range(4))) for _ in range(60)]
    refs = spark.createDataFrame([(i, f"n{i % 7}", f"c{i % 3}", "site", v) for i, v in enumerate(vectors)], REF)
    queries = spark.createDataFrame([(i, f"n{i % 7}", v) for i, v in enumerate(vectors)], QUERY)
    want = {}
    for i, q in enumerate(vectors):
        scored = [(-round(sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(q, r)), 9), j) for j, r in enumerate(vectors) if j % 7 != i % 7]
        want[i] = [j for _, j in sorted(scored)[:5]]
    monkeypatch.setattr(gallery, "TILE_QUERIES", 2)
    monkeypatch.setattr(gallery, "TILE_REFS", 5)
    got = {}
    for row in gallery.cosine_candidates(queries, refs, exclude_same=[("name", "name")], **sizes).orderBy("query_id", "neighbour_rank").collect():
        got.setdefault(row.query_id, []).append(row.ref_id)
    assert got == want
    classes = gallery.score_blocks(queries, refs, exclude_same=[("name", "name")], **sizes).collect()
    assert sum(row.refs_scored for row in classes) == sum(j % 7 != i % 7 for i in range(60) for j in range(60))


def clustered(rng, n, dims=12, groups=8, spread=0.05):
    middles = rng.normal(size=(groups, dims))
    v = middles[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * spread
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_bounds_leave_out_far_clusters_and_lose_nothing(spark, caplog):
    """Vectors in groups: same rows as over all pairs, at a part of the products. Zero and long vectors, ties and
    excluded neighbours are no exception."""
    rng = np.random.default_rng(4)
    refs = [(i, "abc"[i % 3], v.tolist(), f"s{i % 5}") for i, v in enumerate(clustered(rng, 600))]
    refs += [(600, "a", [0.0] * 12, "s0"), (601, "b", (3 * np.array(refs[7][2])).tolist(), "s1"), (602, "c", refs[9][2], "s2"), (603, "c", refs[9][2], "s3")]
    rng = np.random.default_rng(4)
    asked = [(i, v.tolist(), f"s{i % 5}") for i, v in enumerate(clustered(rng, 90))] + [(90, [0.0] * 12, "s1"), (91, refs[9][2], "s2")]
    r = spark.createDataFrame(refs, "ref_id bigint, vehicle_type string, embedding array<double>, source string")
    q = spark.createDataFrame(asked, "query_id bigint, embedding array<double>, source string")
    for options in ({}, {"exclude_same": [("source", "source")]}, {"k": 300}):
        want = sorted(map(tuple, gallery.cosine_candidates(q, r, **options).collect()))
        caplog.clear()
        with caplog.at_level("INFO", "plateflow.operators.gallery"):
            got = sorted(map(tuple, gallery.cosine_candidates(q, r, block_rows=24, broadcast_bytes=0, **options).collect()))
        assert got == want
        taken, total = caplog.records[0].args
        assert taken < (0.55 if options.get("k") is None else 1.01) * total


def test_blocks_stay_small_and_spread(spark):
    """Vectors are not kept as doubles beside what was shipped, tiles are bounded, and the queries of one file are dealt out."""
    import pyarrow as pa

    vectors = np.random.default_rng(3).normal(size=(5000, 8)).astype(np.float32)
    table = pa.table({"ref_id": range(5000), "embedding": pa.array(list(vectors), pa.list_(pa.float32())), "_keys": [[f"0:{i // 2}"] for i in range(5000)]})
    block = gallery._Block(table, "ref_id")
    assert block.vectors.dtype == np.float32
    tiles = list(gallery._tiles(block, block))
    assert max(scores.nbytes for _, _, scores in tiles) <= 8 << 20 and sum(scores.size for _, _, scores in tiles) == 25_000_000
    assert sum(int(np.isneginf(scores).sum()) for _, _, scores in tiles) == 10_000
    rows = spark.createDataFrame([(i, [1.0, float(i)], "a" if i else None) for i in range(9)], "query_id long, embedding array<float>, vehicle_type string").coalesce(1)
    refs = rows.withColumnRenamed("query_id", "ref_id").withColumn("source", F.lit("s"))
    found = gallery.cosine_candidates(rows.drop("vehicle_type"), refs, 2, block_rows=2)
    assert found.rdd.getNumPartitions() == 5 and found.count() == 18
    assert {r.vehicle_type for r in gallery.score_blocks(rows.drop("vehicle_type"), refs).collect()} == {"a", None}
