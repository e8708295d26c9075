"""Machine type by the nearest reference photos, with abstention."""

import logging
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.functions import expr
from plateflow.operators.skew import BROADCAST_BYTES, cut_lineage, top_per_key

log = logging.getLogger(__name__)

#: Vectors per block; a block pair is one matrix product.
BLOCK_ROWS = 4096
#: Similarities are ranked at this precision, so equal vectors tie whatever the block order.
PLACES = 9
#: One tile of a block product: the largest matrix a task holds, whatever the size of the gallery.
TILE_QUERIES, TILE_REFS = 512, 2048
#: Clusters of a large gallery at most; their centres go to all tasks.
CENTRES = 1024


def gallery_entries(files: DataFrame, path: str = "path", suffixes: Sequence[str] = (), reserved: Sequence[str] = ()) -> DataFrame:
    """(class, source, name) from paths ``class/source/.../name``; files directly below a class
    have the source ``unsorted``."""
    parts = F.split(F.col(path), "/")
    entries = (
        files.withColumn("_parts", parts)
        .filter(F.size("_parts") >= 2)
        .withColumn("vehicle_type", F.col("_parts")[0])
        .withColumn("source", F.when(F.size("_parts") > 2, F.col("_parts")[1]).otherwise("unsorted"))
        .withColumn("name", F.element_at("_parts", -1))
        .drop("_parts")
    )
    if reserved:
        entries = entries.filter(~F.col("vehicle_type").isin(*reserved))
    if suffixes:
        pattern = "(?i)(" + "|".join(suffix.replace(".", r"\.") for suffix in suffixes) + ")$"
        entries = entries.filter(F.col("name").rlike(pattern))
    return entries


def gallery_profile(refs: DataFrame, thin_below: int = 4) -> DataFrame:
    """References per class, per source and per both; a class with too few photos is thin."""
    cube = refs.cube("vehicle_type", "source").agg(
        F.count(F.lit(1)).alias("refs"), F.grouping("vehicle_type").alias("_no_class"), F.grouping("source").alias("_no_source")
    )
    level = (
        F.when((F.col("_no_class") == 1) & (F.col("_no_source") == 1), "all")
        .when(F.col("_no_class") == 1, "source")
        .when(F.col("_no_source") == 1, "class")
        .otherwise("class_source")
    )
    return cube.select(
        level.alias("level"), "vehicle_type", "source", "refs",
        ((level == "class") & (F.col("refs") < thin_below)).alias("thin"),
    )


def seed_gallery(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """The seed fills an empty gallery; a gallery with anything in it stays as it is."""
    return existing.unionByName(seed.filter(~existing.select(F.lit(1)).exists()))


def machine_members(frames: DataFrame, groups: DataFrame) -> DataFrame:
    """Which machines a frame shows: one row per frame and group it is listed in, plus the frame
    on its own. Two frames show the same machine when they share a ``machine`` value.

    This is the frame-to-frames relation kept in linear size: a group of n frames takes n rows
    here and n squared when spelled out as pairs. ``frames`` has (frame), ``groups`` has
    (group_id, frame).
    """
    known = groups.join(frames.select("frame").distinct(), "frame", "left_semi")
    listed = known.select("frame", F.concat(F.lit("g"), F.col("group_id")).alias("machine"))
    alone = frames.select("frame", F.concat(F.lit("f"), F.col("frame")).alias("machine"))
    return listed.unionByName(alone).distinct()


# ---- block scoring -------------------------------------------------------------------------


def _as_keys(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """One array of exclusion keys per row, each tagged with the position of its column."""
    parts = []
    kinds = dict(df.dtypes)
    for place, column in enumerate(columns):
        values = F.col(column) if kinds[column].startswith("array") else F.array(column)
        values = F.filter(values, lambda value: value.isNotNull())
        prefix = f"{place}:"
        parts.append(F.transform(values.cast("array<string>"), lambda value: F.concat(F.lit(prefix), value)))
    empty = F.array().cast("array<string>")
    return df.withColumn(name, F.concat(empty, *parts) if parts else empty)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return _vectors(column).astype(np.float64)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows, in the type they are stored in and without a copy where Arrow allows it."""
    column = column.combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class _Block:
    """Vectors of a block with their exclusion keys, prepared once and used tile by tile. Vectors stay in the type they
    are stored in, labels and keys are numbers; a tile makes doubles of its own rows only."""

    def __init__(self, table: pa.Table, ident: str):
        ids = table[ident].to_numpy()
        if len(ids) and (ids[1:] < ids[:-1]).any():
            table = table.take(np.argsort(ids, kind="stable"))
        table = table.combine_chunks()
        self.ids = table[ident].to_numpy()
        self.vectors = _vectors(table["embedding"]) if len(self.ids) else np.zeros((0, 0))
        self.names, self.codes = [], np.zeros(0, np.int32)
        if "vehicle_type" in table.column_names and len(self.ids):
            labels = pc.dictionary_encode(table["vehicle_type"].combine_chunks(), null_encoding="encode")
            self.names, self.codes = labels.dictionary.to_pylist(), labels.indices.to_numpy()
        keys = table["_keys"].combine_chunks()
        #: The keys of all rows one after the other, and the row each belongs to.
        self.keys = keys.flatten()
        self.owner = np.repeat(np.arange(len(self.ids)), pc.list_value_length(keys).to_numpy(zero_copy_only=False)) if len(self.ids) else np.zeros(0, np.int64)

    @cached_property
    def known_keys(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct keys, and ``key number * rows + row`` of all of them in ascending order."""
        coded = pc.dictionary_encode(self.keys)
        return coded.dictionary, np.sort(coded.indices.to_numpy().astype(np.int64) * len(self.ids) + self.owner)

    def doubles(self, rows: slice) -> np.ndarray:
        return self.vectors[rows].astype(np.float64, copy=False)


def _tiles(left: _Block, right: _Block) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Similarities of two blocks in tiles of bounded size, excluded pairs at minus infinity. All tiles of
    some queries follow each other."""
    n = len(right.ids)
    known, places = right.known_keys
    code = pc.index_in(left.keys, value_set=known)
    shared = pc.is_valid(code).to_numpy(zero_copy_only=False)
    owner, base = left.owner[shared], pc.drop_null(code).to_numpy().astype(np.int64) * n
    for a in range(0, len(left.ids), TILE_QUERIES):
        rows = slice(a, a + TILE_QUERIES)
        some = left.doubles(rows)
        mine = slice(*np.searchsorted(owner, (a, a + TILE_QUERIES)))
        for b in range(0, n, TILE_REFS):
            columns = slice(b, b + TILE_REFS)
            scores = some @ right.doubles(columns).T
            low = np.searchsorted(places, base[mine] + b)
            high = np.searchsorted(places, base[mine] + min(b + TILE_REFS, n))
            for i in np.flatnonzero(high > low):
                scores[owner[mine][i] - a, places[low[i] : high[i]] - base[mine][i] - b] = -np.inf
            yield rows, columns, scores


def _score_all(queries: DataFrame, refs: DataFrame, work: Callable, ddl: str, block_rows: int,
               parallelism: int, broadcast_bytes: int) -> tuple[DataFrame, bool]:
    """``work(query block, reference block)`` over all pairs of blocks; True when every query met
    the whole gallery at once. Both blocks are prepared before; the product is taken in tiles.

    A gallery whose counted size stays below ``broadcast_bytes`` goes to the executors once and
    the queries are scored block by block. A larger one is cut into blocks of ``8 * block_rows``;
    each query block then meets each reference block in one task of bounded size.
    """
    size = refs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()
    if size["n"] * size["d"] * 8 <= broadcast_bytes:
        shared = queries.sparkSession.sparkContext.broadcast(refs.orderBy("ref_id").toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gallery = _Block(shared.value, "ref_id")
            for batch in batches:
                for start in range(0, batch.num_rows, block_rows):
                    part = pa.Table.from_batches([batch.slice(start, block_rows)])
                    yield from work(_Block(part, "query_id"), gallery).to_batches()

        # However few files the queries come from, each part is a block of them.
        parts = -(-queries.count() // block_rows)
        spread = queries.repartition(parts, "query_id") if parts > 1 else queries
        return spread.mapInArrow(scan, ddl), True

    r_blocks = -(-size["n"] // (8 * block_rows))
    q_blocks = max(1, -(-queries.count() // block_rows), parallelism)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("_rb", every(r_blocks))
    right = refs.withColumn("_rb", F.pmod(F.xxhash64("ref_id"), F.lit(r_blocks)).cast("int")).withColumn("_qb", every(q_blocks))

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        return work(_Block(some, "query_id"), _Block(others, "ref_id"))

    return left.groupBy("_qb", "_rb").cogroup(right.groupBy("_qb", "_rb")).applyInArrow(meet, ddl), False


class _Clusters:
    """Centres of a gallery's clusters, and what bounds the products with their members."""

    def __init__(self, centres: np.ndarray):
        norms = np.linalg.norm(centres, axis=1, keepdims=True)
        self.centres = centres / np.where(norms > 0, norms, 1)
        self.count = self.radius = self.norm = np.zeros(len(centres))

    def angles(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Angles to all centres and norms. A zero vector is at right angles to everything."""
        norms = np.linalg.norm(vectors, axis=1)
        unit = vectors / np.where(norms > 0, norms, 1)[:, None]
        return np.arccos(np.clip(unit @ self.centres.T, -1, 1)), norms

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """No member of a cluster has a larger product with a vector: by the triangle inequality on the sphere
        their angle is at least that to the centre less the radius."""
        angles, norms = self.angles(vectors)
        near = np.cos(np.clip(angles - self.radius[None, :] - 1e-7, 0, np.pi))
        return norms[:, None] * self.norm[None, :] * np.maximum(near, 0) + 10.0**-PLACES

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """For each vector the clusters of the highest bounds that hold ``4 k`` members together."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1)
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, held - self.count[order] < 4 * k, axis=1)
        return out & (self.count > 0)


def _bounded(queries: DataFrame, refs: DataFrame, k: int, meet: Callable[[pa.Table, pa.Table], pa.Table], ddl: str, n_refs: int, block_rows: int) -> DataFrame:
    """The best references of each query found in clusters, in two passes: first those whose bound is highest, then only
    those whose bound reaches the ``k``-th similarity found. Every other cluster is left out by its bound.

    Clusters and the queries that visit one are cut into slices of bounded size by counts, so a task multiplies blocks whatever
    the size of a cluster.
    """
    number = min(CENTRES, max(1, -(-n_refs // block_rows)))
    sample = refs.orderBy(F.xxhash64("ref_id"), "ref_id").limit(number).select("embedding").toArrow()
    clusters = _Clusters(_matrix(sample["embedding"]))
    placed_ddl = "ref_id bigint, vehicle_type string, embedding array<double>, _keys array<string>, cluster int, angle double, norm double"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles, norms = clusters.angles(_matrix(pa.Table.from_batches([batch])["embedding"]))
                own = angles.argmin(axis=1)
                columns = [*batch.columns, pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own]), pa.array(norms)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cluster", "angle", "norm"])

    gallery = refs.select("ref_id", F.col("vehicle_type").cast("string").alias("vehicle_type"), F.col("embedding").cast("array<double>").alias("embedding"), "_keys")
    gallery = cut_lineage(gallery.mapInArrow(place, placed_ddl))
    sizes = {row["cluster"]: row for row in gallery.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.max("norm").alias("norm")).collect()}
    read = lambda name, other: np.array([sizes[c][name] if c in sizes else other for c in range(len(clusters.centres))], float)
    clusters.count, clusters.radius, clusters.norm = read("n", 0), read("angle", 0.0), read("norm", 0.0)
    slices = {c: -(-int(n) // (8 * block_rows)) for c, n in enumerate(clusters.count) if n}
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), "_keys")
    visit_ddl = "query_id bigint, embedding array<double>, _keys array<string>, cluster int"

    def visits(rows: DataFrame, second: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    table = pa.Table.from_batches([batch])
                    bounds = clusters.bounds(_matrix(table["embedding"]))
                    chosen = clusters.first(bounds, k)
                    if second:
                        floor = table["floor"].to_numpy()
                        chosen = ~chosen & (clusters.count > 0) & (bounds >= floor[:, None])
                    for start in range(0, len(bounds), 256):
                        r, c = np.nonzero(chosen[start : start + 256])
                        part = batch.select(["query_id", "embedding", "_keys"]).take(pa.array(r + start))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c.astype(np.int32))], names=["query_id", "embedding", "_keys", "cluster"])

        return cut_lineage(rows.mapInArrow(run, visit_ddl))

    def scored(rows: DataFrame) -> DataFrame:
        visited = {row["cluster"]: row["n"] for row in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = [(c, slices[c], -(-n // block_rows)) for c, n in visited.items()]
        products.append(sum(n * clusters.count[c] for c, n in visited.items()))
        # At most CENTRES rows.
        cuts = F.broadcast(rows.sparkSession.createDataFrame(plan or [(-1, 1, 1)], "cluster int, _refs int, _queries int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.join(cuts, "cluster").withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_queries")).cast("int")).withColumn("_r", every("_refs"))
        right = gallery.join(cuts, "cluster").withColumn("_r", F.pmod(F.xxhash64("ref_id"), F.col("_refs")).cast("int")).withColumn("_q", every("_queries"))
        keys = ["cluster", "_q", "_r"]
        found = left.select(*keys, "query_id", "embedding", "_keys").groupBy(*keys).cogroup(right.select(*keys, "ref_id", "vehicle_type", "embedding", "_keys").groupBy(*keys))
        return found.applyInArrow(meet, ddl).drop("neighbour_rank")

    products: list[float] = []
    order = [F.col("similarity").desc(), F.col("ref_id").asc()]
    near = cut_lineage(top_per_key(scored(visits(asked, False)), ["query_id"], order, k))
    floor = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(F.lit(float("-inf"))).alias("floor"))
    known = asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    far = scored(visits(known, True))
    log.info("bounded search: %d of %d products taken", sum(products), queries.count() * n_refs)
    return near.unionByName(far)


def _prepare(queries: DataFrame, refs: DataFrame, exclude_same, exclude_sources):
    if exclude_sources:
        refs = refs.filter(~F.col("source").isin(*exclude_sources))
    queries = _as_keys(queries, [left for left, _ in exclude_same], "_keys").select("query_id", "embedding", "_keys")
    refs = _as_keys(refs, [right for _, right in exclude_same], "_keys").select("ref_id", "vehicle_type", "embedding", "_keys")
    return queries, refs


def cosine_candidates(queries: DataFrame, refs: DataFrame, k: int = 5, exclude_same: Sequence[tuple[str, str]] = (),
                      exclude_sources: Sequence[str] = (), block_rows: int = BLOCK_ROWS, parallelism: int = 8,
                      broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The ``k`` most similar references per query, exactly, ranked from 1.

    ``exclude_same`` lists (query column, reference column) pairs, plain or arrays: a reference
    sharing a value with the query is removed before ranking. ``exclude_sources`` drops whole
    sources. Vectors are compared block against block in tiles of bounded size; each block pair keeps
    the ``k`` best per query as it goes, so the pairs themselves are never materialised. A gallery above
    ``broadcast_bytes`` is cut into clusters, and a query meets only those whose bound reaches its ``k`` best. Similarities are
    returned at the precision they are ranked at.
    """
    queries, refs = _prepare(queries, refs, exclude_same, exclude_sources)

    def best(left: _Block, right: _Block) -> pa.Table:
        nothing = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        found: list[tuple[np.ndarray, ...]] = []
        held, last, bar = nothing, None, np.zeros(0)
        for rows, columns, scores in _tiles(left, right):
            if rows != last:
                found.append(held)
                held, last, bar = nothing, rows, np.full(len(scores), -np.inf)
            fresh = bar == -np.inf
            if fresh.any():
                # Queries that do not have k references yet: the k-th of this tile is their bar.
                at = min(k, scores.shape[1])
                bar[fresh] = np.partition(scores[fresh], scores.shape[1] - at, axis=1)[:, scores.shape[1] - at]
            # Rounding moves a similarity by less than the slack; only what can be among the best is rounded.
            r, c = np.nonzero(scores >= (bar - 2 * 10.0**-PLACES)[:, None])
            v = scores[r, c]
            r, c, v = r[np.isfinite(v)], c[np.isfinite(v)], v[np.isfinite(v)]
            v = np.floor(v * 10.0**PLACES + 0.5) / 10.0**PLACES
            r, c, v = (np.concatenate(x) for x in zip(held, (r + rows.start, c + columns.start, v)))
            order = np.lexsort((c, -v, r))
            r, c, v = r[order], c[order], v[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            held = (r[place < k], c[place < k], v[place < k])
            bar = np.full(len(scores), -np.inf)
            bar[r[place == k - 1] - rows.start] = v[place == k - 1]
        r, c, v = (np.concatenate(x) for x in zip(*found, held))
        places = (np.arange(len(r)) - np.searchsorted(r, r) + 1).astype(np.int32)
        return pa.table(
            [pa.array(left.ids[r]), pa.array(right.ids[c]), pa.array([right.names[i] for i in right.codes[c]], pa.string()), pa.array(v), pa.array(places)],
            schema=schema,
        )

    schema = pa.schema([("query_id", pa.int64()), ("ref_id", pa.int64()), ("vehicle_type", pa.string()), ("similarity", pa.float64()), ("neighbour_rank", pa.int32())])
    ddl = "query_id bigint, ref_id bigint, vehicle_type string, similarity double, neighbour_rank int"
    order = [F.col("similarity").desc(), F.col("ref_id").asc()]
    size = refs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()
    if size["n"] and size["n"] * size["d"] * 8 > broadcast_bytes:
        found = _bounded(queries, refs, k, lambda some, others: best(_Block(some, "query_id"), _Block(others, "ref_id")), ddl, size["n"], block_rows)
        return top_per_key(found, ["query_id"], order, k, rank="neighbour_rank")
    found, complete = _score_all(queries, refs, best, ddl, block_rows, parallelism, broadcast_bytes)
    if complete:
        return found
    return top_per_key(found.drop("neighbour_rank"), ["query_id"], order, k, rank="neighbour_rank")


def score_blocks(queries: DataFrame, refs: DataFrame, exclude_same: Sequence[tuple[str, str]] = (),
                 exclude_sources: Sequence[str] = (), block_rows: int = BLOCK_ROWS, parallelism: int = 8,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per query and class: references scored, highest and mean similarity. The block products
    are reduced per class inside the task."""
    queries, refs = _prepare(queries, refs, exclude_same, exclude_sources)
    schema = pa.schema([
        ("query_id", pa.int64()), ("vehicle_type", pa.string()), ("n", pa.int64()), ("top", pa.float64()), ("total", pa.float64()),
    ])

    def reduce_block(left: _Block, right: _Block) -> pa.Table:
        names, code = right.names, right.codes
        shape = (len(left.ids), len(names))
        count, total, top = np.zeros(shape, np.int64), np.zeros(shape), np.full(shape, -np.inf)
        for rows, columns, scores in _tiles(left, right):
            for label in np.unique(code[columns]):
                part = scores[:, code[columns] == label]
                usable = np.isfinite(part)
                count[rows, label] += usable.sum(axis=1)
                total[rows, label] += np.where(usable, part, 0.0).sum(axis=1)
                top[rows, label] = np.maximum(top[rows, label], part.max(axis=1))
        r, c = np.nonzero(count)
        return pa.table(
            [pa.array(left.ids[r]), pa.array([names[i] for i in c], pa.string()), pa.array(count[r, c]), pa.array(top[r, c]), pa.array(total[r, c])], schema=schema
        )

    parts, _ = _score_all(
        queries, refs, reduce_block, "query_id bigint, vehicle_type string, n bigint, top double, total double",
        block_rows, parallelism, broadcast_bytes,
    )
    return parts.groupBy("query_id", "vehicle_type").agg(
        F.sum("n").alias("refs_scored"), F.max("top").alias("best_similarity"), (F.sum("total") / F.sum("n")).alias("mean_similarity")
    )


# ---- vote ----------------------------------------------------------------------------------


def knn_vote(candidates: DataFrame, min_similarity: float = 0.62, min_margin: float = 0.04) -> DataFrame:
    """Weighted vote over ranked candidates, with a reason for refusing.

    A class gets the cube of each similarity; the class met first wins a tie. The margin is the gap
    to the closest neighbour of any other class, and may be negative.
    """
    weight = F.greatest(F.lit(0.0), F.col("similarity"))
    classes = candidates.groupBy("query_id", "vehicle_type").agg(
        F.sum(weight * weight * weight).alias("vote"),
        F.max("similarity").alias("best"),
        F.min("neighbour_rank").alias("first_seen"),
    )
    entry = F.struct((-expr.fixed("vote", 9)).alias("order"), "first_seen", "vehicle_type", "best", "vote")
    ballots = classes.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("b"))
    winner = F.col("b")[0]
    others = F.array_max(F.transform(F.slice("b", 2, 2147483646), lambda row: row["best"]))
    margin = F.col("similarity_raw") - F.coalesce("others", F.lit(0.0))
    reason = (
        F.when(F.col("similarity_raw") < min_similarity, "below_similarity_floor")
        .when(F.col("others").isNotNull() & (F.col("margin_raw") < min_margin), "classes_too_close")
        .otherwise("accepted")
    )
    return (
        ballots.select("query_id", winner["vehicle_type"].alias("vehicle_type"), winner["best"].alias("similarity_raw"), others.alias("others"))
        .withColumn("margin_raw", margin)
        .withColumn("reason", reason)
        .select("query_id", "vehicle_type", expr.fixed("similarity_raw", 4).alias("similarity"),
                expr.fixed("margin_raw", 4).alias("margin"), "reason")
    )


def neighbours(candidates: DataFrame, k: int = 3) -> DataFrame:
    """The nearest references of a query as one evidence array."""
    entry = F.struct("neighbour_rank", "ref_id", "vehicle_type", expr.fixed("similarity", 4).alias("similarity"))
    return candidates.filter(F.col("neighbour_rank") <= k).groupBy("query_id").agg(
        F.array_sort(F.collect_list(entry)).alias("neighbours")
    )


def verdicts(queries: DataFrame, votes: DataFrame) -> DataFrame:
    """The type answered for each query, null when refused, and why."""
    return queries.select("query_id", "expected").join(votes, "query_id", "left").select(
        "query_id", "expected",
        F.when(F.col("reason") == "accepted", F.col("vehicle_type")).alias("predicted"),
        F.coalesce("reason", F.lit("no_match")).alias("reason"),
        "similarity", "margin",
    )
