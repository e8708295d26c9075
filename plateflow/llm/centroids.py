"""Centroid clustering (operator 12): zone maps over a Hilbert order of the vectors."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.llm.common import schema, staged

CENTROIDS, ROUNDS, DIMS = 16, 3, 64
#: Vectors of a block, bits of the curve per dimension.
BLOCK, BITS = 32, 3
#: Components become floor(STEPS * x). Beyond WIDEST a squared distance of DIMS components need not fit a long.
STEPS, WIDEST = 64, 1 << 27

_KEPT = "vector IS NOT NULL AND size(vector) = {0} AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
_ZONE = "ids array<bigint>, vectors binary, lo binary, hi binary, total binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve, as rows of bytes that sort like the curve, of cells ``n x dims`` of
    ``bits`` bits each. Cell bits are turned, level by level, into the frame of the sub-cube they are
    in, and the levels are written one after the other."""
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        top, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(dims):
            upper = (x[i] & top) != 0
            swap = np.where(upper, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(upper, below, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint32(1 << level)) != 0, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)])
    return np.packbits(planes.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """``blocks x centroids``: whether a centroid can be the nearest one of some point of the box.

    The centroid nearest to the middle of a box rules out another if it is nearer in the whole box; the
    difference of two squared distances is linear, so its maximum lies in a corner and is a sum over the
    dimensions. Equal distances go to the smaller number.
    """
    middle = (lo + hi) / 2
    chosen = ((middle[:, None, :] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    gap = centroids[None] - centroids[chosen][:, None, :]
    corner = 2 * np.where(gap > 0, gap * hi[:, None, :], gap * lo[:, None, :]).sum(axis=2)
    square = (centroids * centroids).sum(axis=1)
    worst = corner + square[chosen][:, None] - square[None, :]
    number = np.arange(len(centroids))
    out = ~((worst < 0) | ((worst == 0) & (chosen[:, None] < number[None, :])))
    out[np.arange(len(lo)), chosen] = True
    return out


def _blocks(keyed: DataFrame, dims: int, block: int) -> DataFrame:
    """A row per block of neighbours on the curve: ids, vectors, box and sum."""

    def zone(ids: list, v: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([ids], pa.list_(pa.int64()))]
        columns += [pa.array([x.tobytes()], pa.binary()) for x in (v, v.min(axis=0), v.max(axis=0), v.sum(axis=0, dtype=np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "vectors", "lo", "hi", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        rows: list[bytes] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            while len(ids) >= block:
                yield zone(ids[:block], np.frombuffer(b"".join(rows[:block]), np.int32).reshape(-1, dims))
                ids, rows = ids[block:], rows[block:]
        if ids:
            yield zone(ids, np.frombuffer(b"".join(rows), np.int32).reshape(-1, dims))

    return keyed.select("vec_id", "cells").mapInArrow(run, schema(_ZONE))


def zone_maps(vectors: DataFrame, dims: int = DIMS, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """Blocks of the usable vectors in Hilbert order, with their boxes. ``vectors`` holds ``vec_id, cells`` (integers).

    The curve visits the dimensions of the widest range first. Rows are dealt by ranges of the place on
    the curve and, within one place, by a counter, so copies of one vector fill as many tasks as they need.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        for batch in batches:
            if batch.num_rows:
                v = np.array(batch.column(0).to_pylist(), dtype=np.int64).reshape(-1, dims)
                lo, hi = np.minimum(lo, v.min(axis=0)), np.maximum(hi, v.max(axis=0))
        if lo[0] <= hi[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(lo), pa.array(hi)], names=["dim", "lo", "hi"])

    found = vectors.select("cells").mapInArrow(ranges, schema("dim bigint, lo bigint, hi bigint"))
    rows = sorted(found.groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
    low = np.array([row["lo"] for row in rows], dtype=float)
    width = np.array([row["hi"] for row in rows], dtype=float) - low + 1
    order = np.argsort(-width, kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column(1).to_pylist(), dtype=np.int64).reshape(-1, dims)
            scaled = np.minimum((v - low) * (1 << bits) / width, (1 << bits) - 1).astype(np.uint32)
            keys = hilbert_keys(scaled[:, order], bits)
            columns = [batch.column(0), pa.array([x.tobytes() for x in v.astype(np.int32)], pa.binary())]
            columns += [pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(np.arange(number, number + len(v)), pa.int64())]
            number += len(v)
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cells", "place", "salt"])

    keyed = staged(vectors.select("vec_id", "cells").mapInArrow(run, schema("vec_id bigint, cells binary, place binary, salt bigint")), "keyed")
    dealt = keyed.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt")
    return staged(_blocks(dealt, dims, block), "zones")


def _unpacked(batch: pa.RecordBatch, dims: int):
    """Boxes, sums and vectors of the blocks of a batch."""
    read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, dims).astype(np.int64)
    return read("lo", np.int32), read("hi", np.int32), read("total", np.int64), read("vectors", np.int32)


def _nearest(batch: pa.RecordBatch, centroids: np.ndarray, dims: int):
    """Cluster and squared distance of each vector of the batch, block sizes, and the compared pairs."""
    lo, hi, _, v = _unpacked(batch, dims)
    sizes = np.array([len(ids) for ids in batch.column("ids")], dtype=np.int64)
    fit = candidates(lo, hi, centroids)
    each = np.repeat(fit, sizes, axis=0)
    best, cluster = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64)
    for number in range(len(centroids)):
        at = np.flatnonzero(each[:, number])
        gap = v[at] - centroids[number]
        distance = np.einsum("ij,ij->i", gap, gap)
        nearer = distance < best[at]
        best[at[nearer]], cluster[at[nearer]] = distance[nearer], number
    return cluster, best, sizes, int(each.sum())


def moved(zones: DataFrame, centroids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The centroids after one round: each the componentwise floor of its vectors' mean; empty ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((len(centroids), dims), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            lo, hi, total, v = _unpacked(batch, dims)
            fit = candidates(lo, hi, centroids)
            sizes = np.array([len(ids) for ids in batch.column("ids")], dtype=np.int64)
            sure = fit.sum(axis=1) == 1
            # A block with one candidate is moved as a whole, by its stored sum.
            np.add.at(totals, fit[sure].argmax(axis=1), total[sure])
            np.add.at(counts, fit[sure].argmax(axis=1), sizes[sure])
            if not sure.all():
                rest = batch.filter(pa.array(~sure))
                cluster, _, _, _ = _nearest(rest, centroids, dims)
                np.add.at(totals, cluster, v[np.repeat(~sure, sizes)])
                np.add.at(counts, cluster, 1)
        at = np.repeat(np.arange(len(centroids)), dims)
        columns = [at, np.tile(np.arange(dims), len(centroids)), totals.ravel(), np.repeat(counts, dims)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "dim", "total", "n"])

    parts = zones.mapInArrow(run, schema("cluster bigint, dim bigint, total bigint, n bigint"))
    out = centroids.copy()
    for row in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0").collect():
        out[row["cluster"], row["dim"]] = row["total"] // row["n"]
    return out


def assigned(zones: DataFrame, centroids: np.ndarray, dims: int = DIMS) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector of the zones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _, _ = _nearest(batch, centroids, dims)
                columns = [pa.array([i for ids in batch.column("ids").to_pylist() for i in ids], pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return zones.mapInArrow(run, schema("vec_id bigint, cluster int, distance bigint"))


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """Per usable row of ``vectors (vec_id, embedding)``: ``vec_id, cluster, distance, cluster_inertia,
    inertia, centroid_sha256``.

    Usable are vectors of exactly ``dims`` components, none null or non-finite; others are left out. A
    component x becomes floor(64 x). The first centroids are the ``k`` usable vectors with the smallest
    SHA-256 of ``1:<vec_id>``; rows with a null vec_id come last in that order and are clustered like the
    others. With fewer usable rows there are as many centroids as rows. Equal distances go to the
    smaller number. Repeated rows count as often as they occur. An empty table gives an empty result.
    Components of 2,097,152 or more in size are an error, as their distances need not fit a long. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    raw = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).filter(_KEPT.format(dims))
    wide = F.exists("vector", lambda x: F.abs(x) >= F.lit(float(WIDEST // STEPS)))
    cells = F.transform("vector", lambda x: F.floor(x * F.lit(float(STEPS))).cast("bigint"))
    usable = raw.select("vec_id", F.when(wide, F.raise_error(F.lit("a component is too large to be clustered"))).otherwise(cells).alias("cells"))
    name = F.coalesce(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256), F.lit("~"))
    first = usable.select(name.alias("name"), "cells").orderBy("name", "cells").limit(k).collect()
    out = schema("vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    if not first:
        return spark.createDataFrame([], out)
    centroids = np.array([row["cells"] for row in first], dtype=np.int64).reshape(-1, dims)
    zones = zone_maps(staged(usable, "cells"), dims, block)
    for _ in range(rounds):
        centroids = moved(zones, centroids, dims)
    found = staged(assigned(zones, centroids, dims), "assigned")
    # At most k rows, from partial sums.
    sums = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(i, n, sum(sums.values()), digest(centroids[i].tolist())) for i, n in sums.items()]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(*out.names)


def _round_sql(n: int) -> str:
    return f"""
 a{n} AS (SELECT r, j FROM (SELECT v.r, c.j, row_number() OVER (PARTITION BY v.r ORDER BY sum((v.x - c.x) * (v.x - c.x)), c.j) AS k
   FROM v JOIN c{n} c USING (i) GROUP BY v.r, c.j) WHERE k = 1),
 m{n} AS (SELECT a.j, v.i, sum(v.x) AS s, count(*) AS n FROM a{n} a JOIN v USING (r) GROUP BY a.j, v.i),
 c{n + 1} AS MATERIALIZED (SELECT c.j, c.i, coalesce(CASE WHEN m.s < 0 THEN -((-m.s + m.n - 1) // m.n) ELSE m.s // m.n END, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (j, i)),"""


#: The same in SQL; floor division is spelled out, as ``//`` truncates.
SQL = f"""WITH k AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
   WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
 v AS MATERIALIZED (SELECT r, unnest(range(1, {DIMS + 1})) AS i, CAST(floor({STEPS} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM k),
 f AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j FROM k QUALIFY j < {CENTROIDS}),
 c0 AS MATERIALIZED (SELECT f.j, v.i, v.x FROM f JOIN v USING (r)),{"".join(_round_sql(n) for n in range(ROUNDS))}
 d AS (SELECT v.r, c.j, sum((v.x - c.x) * (v.x - c.x)) AS q FROM v JOIN c{ROUNDS} c USING (i) GROUP BY v.r, c.j),
 l AS (SELECT r, j, q FROM d QUALIFY row_number() OVER (PARTITION BY r ORDER BY q, j) = 1),
 h AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS s FROM c{ROUNDS} GROUP BY j)
SELECT k.vec_id, CAST(l.j AS INTEGER) AS "cluster", CAST(l.q AS BIGINT) AS distance, CAST(sum(l.q) OVER (PARTITION BY l.j) AS BIGINT) AS cluster_inertia,
 CAST(sum(l.q) OVER () AS BIGINT) AS inertia, h.s AS centroid_sha256
FROM l JOIN k USING (r) JOIN h USING (j)"""
