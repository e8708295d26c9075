"""Embedding near-dedup (operator 5): sign hashing in several tables, exact cosines, components."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.llm.common import by_key, schema, staged
from plateflow.llm.components import connected_components

THRESHOLD = 0.93
#: Hyperplanes per table (at most 8) and number of tables. Two vectors at the threshold agree on a plane
#: with probability 0.88, so they meet in some table with probability 0.9999.
BITS, TABLES = 8, 20
#: Vectors of a bucket that form a block; larger buckets are compared block against block.
BLOCK = 1024
SEED = 20

_USABLE = (
    "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0"
    " AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)"
)
_HASHED = "label string, dim int, slot int, sig int, rep bigint, n bigint, sigs binary, vector binary"


def _unit(vectors: list) -> np.ndarray:
    """Unit vectors in double precision, without overflow for very large components."""
    v = np.array(vectors, dtype=np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _hash(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """One row per class and table. The signatures of all tables travel along, so that every task
    agrees on the first table in which two vectors meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, rep, n, vectors = (c.to_pylist() for c in batch.columns)
            dims = np.array([len(v) for v in vectors], dtype=int)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                unit = _unit([vectors[i] for i in at])
                planes = np.random.default_rng(SEED).standard_normal((dim, bits * tables))
                signs = (unit @ planes > 0).reshape(len(at), tables, bits)
                sigs = (signs @ (1 << np.arange(bits))).astype(np.uint8)
                for slot in range(tables):
                    columns = [
                        pa.array([label[i] for i in at], pa.string()),
                        pa.array(np.full(len(at), dim), pa.int32()),
                        pa.array(np.full(len(at), slot), pa.int32()),
                        pa.array(sigs[:, slot].astype(np.int32)),
                        pa.array([rep[i] for i in at], pa.int64()),
                        pa.array([n[i] for i in at], pa.int64()),
                        pa.array([s.tobytes() for s in sigs], pa.binary()),
                        pa.array([u.tobytes() for u in unit], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _HASHED.split(", ")])

    return classes.select(F.col("label").cast("string"), "rep", "n", "vector").mapInArrow(run, schema(_HASHED))


def _links(hashed: DataFrame, threshold: float, block: int) -> DataFrame:
    """``(rep, links, peer)``: numbers of linked vectors, and links enough to connect what is connected.

    A bucket is cut into blocks by a hash of the id, and each pair of blocks is one small task: one
    matrix product. A pair counts in the first table in which the two meet, and only there.
    """
    bucket = ["label", "dim", "slot", "sig"]
    sizes = staged(hashed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1"), "buckets")
    blocks = F.ceil(F.col("_m") / block).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    spread = (
        hashed.join(sizes, bucket)
        .withColumn("_blocks", blocks)
        .withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            F.xxhash64(*bucket, F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("key"),
            F.least("_mine", "_other").alias("low"), F.greatest("_mine", "_other").alias("high"),
            *bucket, F.col("_mine").alias("mine"), "rep", "n", "sigs", "vector",
        )
    )
    keys = ["key", "low", "high", *bucket]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in by_key(batches, len(keys)):
            if rows.num_rows < 2:
                continue
            slot, mixed = int(key[5]), key[1] != key[2]
            rep, n, mine = (rows.column(c).to_numpy() for c in ("rep", "n", "mine"))
            unit = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(len(rep), -1)
            sigs = np.frombuffer(b"".join(rows.column("sigs").to_pylist()), np.uint8).reshape(len(rep), -1)
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            if mixed:
                near &= mine[:, None] != mine[None, :]
            for earlier in range(slot):
                near &= sigs[:, earlier][:, None] != sigs[:, earlier][None, :]
            at = np.flatnonzero(near.any(axis=1))
            if not len(at):
                continue
            near, rep, n = near[np.ix_(at, at)], rep[at], n[at]
            low = rep.copy()
            while True:
                now = np.minimum(low, np.where(near, low[None, :], low.max()).min(axis=1))
                if (now == low).all():
                    break
                low = now
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array((near @ n).astype(np.int64)), pa.array(low)], names=["rep", "links", "peer"])

    dealt = spread.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema("rep bigint, links bigint, peer bigint"))


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors (vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Vectors of equal label (and length) link when their cosine in double precision is at least
    ``threshold``; candidates share a sign signature in one of ``tables`` tables. Equal vectors are one
    class with a count, so a vector that a third of all rows repeat costs one row. ``n_links`` counts
    the other rows linked directly, ``component_id`` is the smallest vec_id reachable, ``kept`` says
    that it is the row's own. A vector that is null, empty, zero or holds null or non-finite
    components, a null label and a null vec_id link with nothing; the last has a null component and is
    kept. Repeated rows link with each other. Other columns are ignored.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("_ok", F.coalesce(F.expr(_USABLE), F.lit(False)))
    rows = rows.withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector"))
    usable = rows.filter("_ok")
    classes = staged(
        usable.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")),
        "classes",
    )
    found = staged(_links(staged(_hash(classes, bits, tables), "hashed"), threshold, block), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    known = staged(
        classes.drop("vector")
        .join(links, "rep", "left")
        .join(components.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "known",
    )
    keyed = staged(usable.select("vec_id", "label", "k1", "k2"), "keyed")
    linked = keyed.join(known, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("NOT _ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
