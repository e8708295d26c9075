"""Greedy ordered selection of boxes: go through a group in priority order and keep a box unless
one already kept rules it out. A suppressed box must not suppress others, so this is a fold and
not a self join."""

import logging
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateflow.functions import expr
from plateflow.operators.skew import BROADCAST_BYTES, GROUP_ROWS, cut_lineage, split_heavy, top_per_key

log = logging.getLogger(__name__)

CORNERS = ("x1", "y1", "x2", "y2")
#: Boxes decided per heavy group and round, or looked at per grid cell and round.
CHUNK = 4096
CELL_ROWS = 1024
#: Grid cells a box of a heavy group covers at most on average, and the finest and coarsest grid (powers of two).
COVERED, GRIDS = 6, range(3, 31)
#: Rows compared with a chunk of kept boxes at a time.
STRIPE = 256


@dataclass(frozen=True)
class Rule:
    """When a kept box rules out a later one: as a Column, and over NumPy arrays for chunks.

    ``arrays(later, kept)`` takes the four values of one later box, or of a column of them, and the
    kept boxes as rows.
    """

    column: Callable
    arrays: Callable
    #: Two boxes with the same corners always rule each other out (areas above zero).
    equal_conflict: bool = True
    #: Only boxes that share area rule each other out.
    overlapping: bool = False


def vehicle_rule(iou: float = 0.55, containment: float = 0.88) -> Rule:
    """Too much overlap, or the later box lies almost entirely inside the kept one."""

    def column(later, kept) -> Column:
        shared = expr.intersection(later, kept)
        union = expr.area(later) + expr.area(kept) - shared
        return ((union > 0) & (shared / union > iou)) | (
            (expr.area(later) > 0) & (shared / expr.area(later) > containment)
        )

    def arrays(later, kept):
        shared, own, other = _overlap(later, kept)
        union = own + other - shared
        with np.errstate(divide="ignore", invalid="ignore"):
            close = np.where(union > 0, shared / union, 0.0) > iou
            inside = np.where(own > 0, shared / np.where(own > 0, own, 1), 0.0) > containment
        return close | inside

    return Rule(column, arrays, equal_conflict=iou < 1 or containment < 1, overlapping=iou >= 0 and containment >= 0)


def plate_rule(overlap: float = 0.3) -> Rule:
    """Shared area above a fraction of the smaller box (areas below one pixel count as one)."""

    def column(later, kept) -> Column:
        smaller = F.greatest(F.lit(1), F.least(expr.area(later), expr.area(kept)))
        return expr.intersection(later, kept) / smaller > overlap

    def arrays(later, kept):
        shared, own, other = _overlap(later, kept)
        return shared / np.maximum(1, np.minimum(own, other)) > overlap

    return Rule(column, arrays, equal_conflict=overlap < 1, overlapping=overlap >= 0)


def _overlap(later, kept):
    wide = np.minimum(later[2], kept[:, 2]) - np.maximum(later[0], kept[:, 0])
    high = np.minimum(later[3], kept[:, 3]) - np.maximum(later[1], kept[:, 1])
    shared = np.maximum(0, wide) * np.maximum(0, high)
    own = np.maximum(0, later[2] - later[0]) * np.maximum(0, later[3] - later[1])
    other = np.maximum(0, kept[:, 2] - kept[:, 0]) * np.maximum(0, kept[:, 3] - kept[:, 1])
    return shared, own, other


def greedy_keep(boxes: DataFrame, key: str, priority: Sequence[tuple[str, bool]], rule: Rule,
                corners: Sequence[str] = CORNERS, group_rows: int = GROUP_ROWS, chunk: int = CHUNK,
                stop_after: int | None = None) -> DataFrame:
    """Rows of ``boxes`` kept by the greedy selection within each ``key``.

    ``priority`` lists (column, descending). Boxes it leaves tied are taken in the order of their other
    columns, nulls first, in groups of any size; rows equal in all columns in any order.
    ``stop_after`` ends a group once that many boxes are kept. Boxes without a solid area, or with
    null corners, neither rule out nor are ruled out by a rule on shared area.

    Ordinary groups are folded inside one row. In groups above ``group_rows`` boxes are decided by
    neighbourhoods (see ``_neighbourhoods``) if only boxes that share area rule each other out.
    Other rules decide ``chunk`` boxes at a time: the highest undecided boxes are settled exactly,
    everything they rule out is filtered away where it lies, and the next round starts from what is left.
    No round gathers a whole group and nothing is dropped undecided.
    """
    light, heavy, _ = split_heavy(boxes, [key], group_rows)
    kept = _fold(light, key, priority, rule, stop_after)
    if heavy is None:
        return kept
    if rule.overlapping and stop_after is None:
        rest = _neighbourhoods(heavy, key, priority, rule, corners, min(chunk, CELL_ROWS))
    else:
        rest = _rounds(heavy, key, priority, rule, corners, chunk, stop_after)
    return kept.unionByName(rest)


def _sort_value(name: str, descending: bool) -> Column:
    return -F.col(name) if descending else F.col(name)


def _complete_order(boxes: DataFrame, key: str, priority) -> list[Column]:
    """An order of all rows of a group: the priority, then the other columns, then a row number given
    beforehand. The same as that of a fold."""
    named = {name for name, _ in priority}
    return [_sort_value(*p) for p in priority] + [F.col(n) for n in boxes.columns if n != key and n not in named]


def _numbered(boxes: DataFrame) -> DataFrame:
    """``boxes`` with a number per row, which a checkpoint keeps from changing."""
    return cut_lineage(boxes.withColumn("_row", F.monotonically_increasing_id()))


def _solid(corners: Sequence[str]) -> Column:
    x1, y1, x2, y2 = (F.col(name) for name in corners)
    return F.coalesce((x2 > x1) & (y2 > y1), F.lit(False))


def _gridded(boxes: DataFrame, key: str, corners) -> DataFrame:
    """``boxes`` with ``_cells``, the cells of a grid of their group that they cover. The grid is the finest one
    in which a box covers at most ``COVERED`` cells on average, so there are never many more rows than boxes, and
    cells hold few boxes where boxes are small."""
    x1, y1, x2, y2 = (F.col(name) for name in corners)

    def covered(size) -> Column:
        return (F.floor(x2 / size) - F.floor(x1 / size) + 1) * (F.floor(y2 / size) - F.floor(y1 / size) + 1)

    each = [F.avg(covered(F.lit(1 << g)).cast("double")).alias(f"g{g}") for g in GRIDS]
    fine = F.coalesce(*[F.when(F.col(f"g{g}") <= COVERED, F.lit(1 << g)) for g in GRIDS], F.lit(1 << GRIDS[-1]))
    grid = cut_lineage(boxes.groupBy(key).agg(*each).select(key, fine.alias("_size")))
    size = F.col("_size")
    across = F.sequence(F.floor(x1 / size), F.floor(x2 / size))
    down = F.sequence(F.floor(y1 / size), F.floor(y2 / size))
    cells = F.flatten(F.transform(across, lambda cx: F.transform(down, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    return boxes.join(grid, key).withColumn("_cells", cells).drop("_size")


def _neighbourhoods(boxes: DataFrame, key: str, priority, rule: Rule, corners, cell_rows: int) -> DataFrame:
    """The greedy selection by rounds of locally dominant boxes.

    Boxes that share area share a cell of the grid. In each cell the ``cell_rows`` highest undecided boxes
    are looked at; a box is kept when in all its cells it is among them and no higher one of them rules it out,
    so nothing higher that is undecided can. What the boxes kept in a round rule out goes where it lies: a cell
    holds at most ``cell_rows`` of them. At least the highest box of each group is settled per round;
    usually the number of rounds follows the longest chain of neighbours, not the size of the group.
    """
    columns = boxes.columns
    order = [*_complete_order(boxes, key, priority), F.col("_row")]
    numbered = _numbered(boxes)
    apart = numbered.filter(~_solid(corners))
    solid = numbered.filter(_solid(corners))
    if rule.equal_conflict:
        # Equal boxes: only the first can be kept, so copies go before anything is shuffled twice.
        solid = top_per_key(solid, [key, *corners], order)
    undecided = cut_lineage(_gridded(solid, key, corners).withColumn("_rank", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])))
    box = F.struct("_rank", *[F.col(name).alias(corner) for name, corner in zip(corners, CORNERS)])
    here = F.struct(*[F.col(name).alias(corner) for name, corner in zip(corners, CORNERS)])

    def free(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of cells, one cell after the other and the highest first: those no higher one of the cell rules out."""
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if held is None or not len(held):
                continue
            starts = np.flatnonzero(held["_place"].to_numpy() == 1)
            done = len(held) if batch is None else int(starts[-1])
            sides, out = held[list(CORNERS)].to_numpy(dtype=float), np.ones(done, dtype=bool)
            cuts = [*starts[starts < done].tolist(), done]
            for start, end in zip(cuts, cuts[1:]):
                for i in range(start + 1, end):
                    out[i] = not rule.arrays(sides[i], sides[start:i]).any()
            yield held.iloc[:done].loc[out, ["_row"]]
            held = held.iloc[done:].reset_index(drop=True)

    def cells_of(rows: DataFrame, *more) -> DataFrame:
        return rows.select(key, F.explode("_cells").alias("_cell"), *more)

    settled: list[DataFrame] = []
    while not undecided.isEmpty():
        low = cells_of(undecided, "_row", "_rank", *[F.col(name).alias(corner) for name, corner in zip(corners, CORNERS)])
        head = top_per_key(low, [key, "_cell"], [F.col("_rank")], cell_rows, rank="_place")
        dealt = head.select(key, "_cell", "_place", "_row", *CORNERS).repartition(key, "_cell").sortWithinPartitions(key, "_cell", "_place")
        head = dealt.drop(key, "_cell").mapInPandas(free, "_row bigint")
        everywhere = head.groupBy("_row").agg(F.count(F.lit(1)).alias("_free"))
        chosen = cut_lineage(undecided.join(everywhere, "_row").filter(F.col("_free") == F.size("_cells")).drop("_free"))
        settled.append(chosen)
        near = cells_of(chosen, box.alias("_box")).groupBy(key, "_cell").agg(F.collect_list("_box").alias("_kept"))
        rest = undecided.join(chosen.select("_row"), "_row", "left_anti")
        meet = cells_of(rest, "_row", "_rank", here.alias("_here")).join(near, [key, "_cell"])
        hidden = meet.filter(F.exists("_kept", lambda other: (other["_rank"] < F.col("_rank")) & rule.column(F.col("_here"), other)))
        undecided = cut_lineage(rest.join(hidden.select("_row").distinct(), "_row", "left_anti"))
        log.info("suppression round %d: %d boxes kept, %d undecided", len(settled), chosen.count(), undecided.count())
    result = apart.select(*columns)
    for part in settled:
        result = result.unionByName(part.select(*columns))
    return result


def _fold(boxes: DataFrame, key: str, priority, rule: Rule, stop_after: int | None) -> DataFrame:
    order = [_sort_value(name, descending).alias(f"_o{i}") for i, (name, descending) in enumerate(priority)]
    payload = [name for name in boxes.columns if name != key]
    # ``sort_array`` compares natively, ``array_sort`` by an expression per pair.
    sorted_boxes = F.sort_array(F.collect_list(F.struct(*order, *payload)))

    def step(kept: Column, box: Column) -> Column:
        out = F.exists(kept, lambda other: rule.column(box, other))
        if stop_after is not None:
            out = (F.size(kept) >= stop_after) | out
        return F.when(out, kept).otherwise(F.concat(kept, F.array(box)))

    grouped = boxes.groupBy(key).agg(sorted_boxes.alias("_all"))
    folded = F.when(F.size("_all") == 1, F.col("_all")).otherwise(
        F.aggregate("_all", F.slice("_all", 1, 0), step)
    )
    return (
        grouped.select(key, F.explode(folded).alias("_box"))
        .select(key, *[F.col(f"_box.{name}").alias(name) for name in payload])
        .select(*boxes.columns)
    )


def _rounds(boxes: DataFrame, key: str, priority, rule: Rule, corners, chunk: int,
            stop_after: int | None) -> DataFrame:
    order = [*_complete_order(boxes, key, priority), F.col("_row")]
    names, boxes = boxes.columns, _numbered(boxes)
    undecided = boxes
    if rule.equal_conflict:
        # Equal boxes: only the first can be kept, so copies go before anything is shuffled twice.
        x1, y1, x2, y2 = (F.col(name) for name in corners)
        solid = (x2 > x1) & (y2 > y1)
        first = top_per_key(boxes.filter(solid), [key, *corners], order)
        undecided = first.unionByName(boxes.filter(~solid))
    undecided = cut_lineage(undecided)
    positions = list(corners)

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_place").drop(columns="_place")
        cells = group[positions].to_numpy(dtype=float)
        kept = np.empty((len(cells), 4))
        chosen = np.zeros(len(cells), dtype=bool)
        n = 0
        for row, box in enumerate(cells):
            if stop_after is not None and n >= stop_after:
                break
            if not rule.arrays(box, kept[:n]).any():
                kept[n] = box
                n += 1
                chosen[row] = True
        return group.assign(_kept=chosen)

    last = F.struct(*[value.alias(f"_o{i}") for i, value in enumerate(order)])
    box_struct = F.struct(*[F.col(name).alias(corner) for name, corner in zip(corners, CORNERS)])
    here = {corner: F.col(name) for name, corner in zip(corners, CORNERS)}
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in boxes.schema)
    context = boxes.sparkSession.sparkContext
    salts = max(2, int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("_row"), F.lit(salts))

    def hide(kept_of: dict, rows: pd.DataFrame) -> np.ndarray:
        """True for the rows that a kept box of their group rules out."""
        hidden = np.zeros(len(rows), dtype=bool)
        for value, places in rows.groupby(key).indices.items():
            kept = kept_of.get(value)
            if kept is None:
                continue
            cells = rows[positions].to_numpy(dtype=float)[places]
            for start in range(0, len(places), STRIPE):
                part = cells[start : start + STRIPE].T[:, :, None]
                hidden[places[start : start + STRIPE]] = rule.arrays(part, kept).any(axis=1)
        return hidden

    settled: list[DataFrame] = []
    while not undecided.isEmpty():
        # The best of every salt first, so no task sorts a whole group.
        spread = top_per_key(undecided.withColumn("_salt", salt), [key, "_salt"], order, chunk).drop("_salt")
        head = top_per_key(spread, [key], order, chunk, rank="_place")
        decided = cut_lineage(head.groupBy(key).applyInPandas(settle, f"{columns}, `_kept` boolean"))
        chosen = decided.filter("_kept").drop("_kept")
        settled.append(chosen)
        reached = decided.groupBy(key).agg(
            F.max(last).alias("_last"), F.count(F.lit(1)).alias("_taken"), F.count_if("_kept").alias("_n"),
            F.collect_list(F.when(F.col("_kept"), box_struct)).alias("_chosen"),
        )
        small = decided.count() * 64 <= BROADCAST_BYTES
        side = reached.drop("_chosen") if small else reached
        rest = undecided.join(F.broadcast(side) if small else side, key)
        rest = rest.filter((F.col("_taken") == chunk) & (last > F.col("_last")))
        if stop_after is not None:
            rest = rest.filter(F.col("_n") < stop_after)
        if small:
            # A chunk of kept boxes per heavy group, counted above: shipped once, compared in blocks.
            pairs = chosen.select(key, *positions).toPandas()
            shared = context.broadcast({value: part[positions].to_numpy(dtype=float) for value, part in pairs.groupby(key)})

            def survivors(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    yield batch[~hide(shared.value, batch)]

            rest = rest.select(*boxes.columns).mapInPandas(survivors, boxes.schema)
        else:
            rest = rest.filter(~F.exists("_chosen", lambda other: rule.column(here, other))).select(*boxes.columns)
        undecided = cut_lineage(rest)
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    if stop_after is not None:
        result = top_per_key(result, [key], order, stop_after)
    return result.select(*names)


def suppress_vehicles(boxes: DataFrame, iou: float = 0.55, containment: float = 0.88,
                      key: str = "image_id", index: str = "box_idx", **sizes: int) -> DataFrame:
    """One box per machine: drops near-duplicates and boxes nested in a better one."""
    return greedy_keep(boxes, key, [("confidence", True), (index, False)], vehicle_rule(iou, containment), **sizes)


def suppress_plates(boxes: DataFrame, threshold: float = 0.3, key: str = "image_id",
                    index: str = "plate_idx", **sizes: int) -> DataFrame:
    """Overlapping tiles find the same plate several times; the best find is kept."""
    return greedy_keep(boxes, key, [("confidence", True), (index, False)], plate_rule(threshold), **sizes)
