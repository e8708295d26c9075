import hashlib

import numpy as np

from plateflow.llm import centroids


def plain(rows, k=16, rounds=3):
    """The contract, one vector after the other; {vec_id: (cluster, distance)} and the centroids."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:k]
    middles = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middles))

    for _ in range(rounds):
        own = [[] for _ in middles]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        middles = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for c, vs in zip(middles, own)]
    return {i: nearest(v)[::-1] for i, v in kept}, middles


def test_equals_the_plain_version(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(7, 64))
    rows = [(i, (centers[i % 7] + rng.normal(size=64) * 0.2).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    got = centroids.cluster(frame, block=16).collect()
    want, middles = plain(rows)
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in got} == want
    total = sum(d for _, d in want.values())
    for r in got:
        assert r["inertia"] == total
        assert r["cluster_inertia"] == sum(d for c, d in want.values() if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, middles[r["cluster"]])).encode()).hexdigest()


def test_box_bounds_lose_no_nearest_centroid():
    rng = np.random.default_rng(1)
    for _ in range(200):
        dims, k = int(rng.integers(1, 5)), int(rng.integers(1, 8))
        points, middles = rng.integers(-4, 5, (int(rng.integers(1, 9)), dims)), rng.integers(-4, 5, (k, dims))
        fit = centroids.candidates(points.min(axis=0)[None], points.max(axis=0)[None], middles)[0]
        nearest = ((points[:, None] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert fit[nearest].all()


def test_bounds_skip_centroids_of_separate_clusters(spark):
    """Where vectors lie in clusters, most blocks have one candidate."""
    rng = np.random.default_rng(2)
    middles = rng.integers(-40, 40, (8, 64))
    cells = middles[rng.integers(0, 8, 800)] + rng.integers(-2, 3, (800, 64))
    frame = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cells)], "vec_id bigint, cells array<bigint>")
    tables = [centroids._unpacked(b, 64) for b in centroids.zone_maps(frame, block=16).toArrow().to_batches() if b.num_rows]
    fit = np.concatenate([centroids.candidates(lo, hi, middles) for lo, hi, _, _ in tables])
    assert fit.mean() < 0.3


def test_hilbert_places_are_neighbours():
    """Each cell of a grid has its own place, and places that follow each other are cells that touch."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        keys = centroids.hilbert_keys(cells, bits)
        order = np.lexsort(keys.T[::-1])
        assert len({k.tobytes() for k in keys}) == len(cells)
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_odd_rows(spark):
    zero = [0.0] * 64
    rows = [(1, zero), (1, zero), (None, zero), (2, None), (3, []), (4, [1.0] * 63), (5, [None] + zero[1:]), (6, [float("nan")] + zero[1:]), (7, [float("inf")] + zero[1:]), (8, [-0.01] * 64)]
    frame = spark.createDataFrame([(i, v, "x", 3, "c") for i, v in rows], "vec_id bigint, embedding array<double>, cluster string, place int, distance string")
    got = sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in centroids.cluster(frame).collect()), key=str)
    assert len(got) == 4 and [g[0] for g in got].count(1) == 2 and {g[2] for g in got} == {0}
    assert {g[1] for g in got if g[0] == 8} != {g[1] for g in got if g[0] == 1}
    empty = centroids.cluster(frame.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
