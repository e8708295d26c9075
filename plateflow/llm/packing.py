"""Best-fit packing (operator 8): the linear grouping scheme over a histogram of lengths."""

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.llm.common import documents, schema, staged

CAPACITY = 2048
#: Pieces above this share of a sequence are large; they are grouped, the others are fitted in afterwards.
LARGE = 1 / 4
#: Equal-cardinality groups of large pieces, hence rounded sizes a configuration may use.
GROUPS = 512
#: Encoded chunks a worker remembers.
CACHE = 400_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@lru_cache(maxsize=2)
def _encoder(path: str, merges: str | None):
    """``encode(text) -> bytes`` of unsigned little-endian 32-bit ids.

    The tokenizer cuts text before merging, and a single blank between two other characters always
    begins a new part, so chunks between such blanks can be encoded and remembered one by one. With
    ``merges``, the rank file of the same vocabulary, chunks of Latin text go through the faster
    library that reads it; all other chunks go through the tokenizer itself.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import regex
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    fast = None
    if merges:
        import base64

        import public_tokenizers
        import tiktoken

        with open(merges, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = regex.compile("[\x00-\u024f]*")
    cut = regex.compile(r"(?<=\S)(?= \S)")
    odd_space = regex.compile(r"[^\S ] | [^\S ]|  ")

    def ids(chunk: str) -> bytes:
        if fast is not None and plain.fullmatch(chunk):
            return np.asarray(fast.encode_ordinary(chunk), dtype="<u4").tobytes()
        return np.asarray(slow.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    class Known(dict):
        """Ids of chunks that a blank begins, by the chunk without it."""

        def __missing__(self, chunk: str) -> bytes:
            got = ids(" " + chunk)
            if len(chunk) < 64:
                if len(self) >= CACHE:
                    self.clear()
                self[chunk] = got
            return got

    known = Known()

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in special):
            return np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        text = text.encode("utf-8", "replace").decode("utf-8")
        if odd_space.search(text):
            first, *rest = cut.split(text)
            rest = [chunk[1:] for chunk in rest]
        else:
            first, *rest = text.split(" ")
        return b"".join([ids(first), *map(known.__getitem__, rest)])

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, merges: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: its ids, then id 0. A document longer than ``capacity`` is cut from its
    end into pieces of ``capacity`` ids, so only the first may be shorter. A null or empty text is the
    one id 0. Repeated rows are packed as often as they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, merges)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py() or "") + b"\0\0\0\0"
                n, start, piece = len(data) // 4, 0, 0
                while start < n:
                    size = (n - start) % capacity or capacity
                    crc = zlib.crc32(data[4 * start : 4 * (start + size)])
                    for column, value in zip(out, (doc_id, piece, start, size, crc)):
                        column.append(value)
                    start, piece = start + size, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return documents(docs).mapInArrow(run, schema(PIECES))


class _Plan:
    """Sequences as runs: ``count`` sequences from ``first`` on that are filled alike."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(histogram)
        self.used: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        self.next = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first, count)
        self.rooms: list[int] = []

    def new(self, count: int) -> int:
        self.next += count
        return self.next - count

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.rows.append((length, self.used[length], first, offset))
        self.used[length] += count
        self.left[length] -= count

    def leave(self, room: int, first: int, count: int) -> None:
        if count and room:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((first, count))

    def groups(self, lengths: list[int]) -> list[tuple[int, list[list[int]]]]:
        """Equal-cardinality groups, largest first: (rounded size, [[length, count], ...])."""
        total = sum(self.left[x] for x in lengths)
        size, out, room = -(-total // GROUPS), [], 0
        for x in lengths:
            n = self.left[x]
            while n:
                if not room:
                    out.append((x, []))
                    room = size
                take = min(n, room)
                out[-1][1].append([x, take])
                n, room = n - take, room - take
        return out

    def pack_large(self, lengths: list[int]) -> None:
        groups = self.groups(lengths)
        sizes, counts = [g[0] for g in groups], [sum(n for _, n in g[1]) for g in groups]
        while any(counts):
            pattern = _fullest(sizes, counts, self.capacity)
            times = min(counts[g] // n for g, n in pattern.items())
            runs = [(self.new(times), times, 0)]
            for g, n in pattern.items():
                counts[g] -= times * n
                for _ in range(n):
                    runs = self._substitute(runs, groups[g][1])
            for first, count, fill in runs:
                self.leave(self.capacity - fill, first, count)

    def _substitute(self, runs, stock):
        """Give every sequence of the runs the next actual piece of a group."""
        out = []
        for first, count, fill in runs:
            while count:
                length, n = stock[0]
                take = min(n, count)
                self.put(length, take, first, fill)
                out.append((first, take, fill + length))
                first, count = first + take, count - take
                stock[0][1] -= take
                if not stock[0][1]:
                    stock.pop(0)
        return out

    def fit(self, length: int) -> None:
        """Best fit: pieces of one length into the sequences with the least sufficient room."""
        while self.left[length]:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                per = self.capacity // length
                self.leave(self.capacity, self.new(count := -(-self.left[length] // per)), count)
                at = len(self.rooms) - 1
            room = self.rooms[at]
            first, count = self.open[room].pop()
            if not self.open[room]:
                self.rooms.pop(at)
            per, n = room // length, self.left[length]
            whole = min(count, n // per)
            if not whole:
                per, whole = n, 1
            for k in range(per):
                self.put(length, whole, first, self.capacity - room + k * length)
            self.leave(room - per * length, first, whole)
            self.leave(room, first + whole, count - whole)


def _fullest(sizes: list[int], counts: list[int], capacity: int) -> dict[int, int]:
    """The configuration with the largest remaining size that fills a sequence best: {group: number}."""
    lead = next(i for i, n in enumerate(counts) if n)
    best: dict[int, tuple[int, ...]] = {sizes[lead]: (lead,)}
    for i in range(lead, len(sizes)):
        spare = counts[i] - (i == lead)
        for _ in range(min(spare, capacity // sizes[i])):
            grown = {}
            for fill, made in best.items():
                if (total := fill + sizes[i]) <= capacity and total not in best and total not in grown and made.count(i) < counts[i]:
                    grown[total] = (*made, i)
            if not grown:
                break
            best |= grown
    made = best[max(best)]
    return {g: made.count(g) for g in sorted(set(made))}


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """``(length, first rank, first sequence, offset)`` rows: the pieces of a length from that rank on, up to
    the next row of the length, go into consecutive sequences at that offset. Works on counts per length
    only, so its size depends on ``capacity`` and not on the number of documents."""
    plan = _Plan({k: v for k, v in histogram.items() if v}, capacity)
    lengths = sorted(plan.left, reverse=True)
    large = [x for x in lengths if x > capacity * LARGE]
    if capacity in plan.left:
        plan.put(capacity, plan.left[capacity], plan.new(plan.left[capacity]), 0)
        large.remove(capacity)
    plan.pack_large(large)
    for x in lengths:
        if x <= capacity * LARGE:
            plan.fit(x)
    return plan.rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` ids without gaps.

    1. One aggregation counts the pieces per length: at most ``capacity`` rows reach the driver.
    2. Large lengths are sorted into equal-cardinality groups and rounded up to the largest of their
       group; configurations of the rounded sizes are chosen to fill sequences best; the actual
       pieces of each group are substituted, and small ones best-fitted into the room that is left.
    3. Every piece gets its number among those of its length in its task, and looks up its place; what the
       tasks before hold of each length is a small table, so pieces are neither sorted nor shuffled.
    """
    numbered = staged(_numbered(staged(pieces.select(*schema(PIECES).names), "pieces"), capacity), "numbered")
    held = numbered.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n")).toArrow()
    part, length, n = (held.column(c).to_numpy() for c in ("_part", "length", "n"))
    counts = np.zeros((part.max(initial=-1) + 1, capacity + 1), np.int64)
    counts[part, length] = n
    histogram = counts.sum(axis=0)
    plan = sorted(plan_packing({int(x): int(histogram[x]) for x in np.flatnonzero(histogram)}, capacity))
    table = np.array(plan, dtype=np.int64).reshape(-1, 4)
    before = pieces.sparkSession.sparkContext.broadcast(np.cumsum(counts, axis=0) - counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << 48
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            part, length, nth = (batch.column(c).to_numpy() for c in ("_part", "length", "_nth"))
            rank = before.value[part, length] + nth
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            where = table[at]
            columns = [*batch.columns[:5], pa.array(where[:, 2] + rank - where[:, 1]), pa.array(where[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, schema(f"{PIECES}, sequence_id bigint, offset bigint"))


def _numbered(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``_part``, the task that read them, and ``_nth``, their number among its pieces of the
    same length. Holds only once it is stored, as another run may deal the pieces otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            sorted_, nth = length[order], np.empty(len(length), np.int64)
            nth[order] = seen[sorted_] + np.arange(len(length)) - np.searchsorted(sorted_, sorted_)
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_nth"])

    return pieces.mapInArrow(run, schema(f"{PIECES}, _part int, _nth bigint"))
