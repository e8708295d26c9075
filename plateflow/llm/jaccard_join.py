"""N-gram Jaccard join (operator 10): PartEnum signatures over sets of word shingles."""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.llm.common import documents, schema, staged
from plateflow.llm.components import connected_components
from plateflow.operators.skew import top_per_key

SHINGLE = 5
#: Two sets link when 100 * intersection >= LEAST * union.
LEAST = 75
#: Sets of fewer shingles than this are the first size band; each further band is four times as wide and
#: has four times as many parts.
BAND, WIDER = 32, 4
#: One document in so many is looked at to learn which shingles are frequent; a shingle that occurs in at
#: least HOT_SEEN distinct ones of them is. This only orders signatures, so no link depends on it.
HOT_SAMPLE, HOT_SEEN, HOT_MOST, HOT_BITS = 16, 3, 1 << 20, 26
#: Bits of the filter that keeps documents without any candidate from being read twice.
FILTER_BITS = 23
#: So many ids of documents are sent to all tasks at most.
SENT_IDS = 100_000
#: Members of a group that meet its leaders in one task.
STRETCH = 2_000
#: Words whose shingles are made at once, and pairs whose sketches are compared at once.
CHUNK_WORDS, CHUNK_PAIRS = 1 << 18, 1 << 18
#: Steps of a size's code per doubling; codes are single bytes.
SIZE_STEPS = 16
#: Signatures a task gathers before it hands them on, and aims at per shuffle partition.
FLUSH, PER_PARTITION = 1 << 18, 1 << 20
#: Members of a candidate group that are compared with all others, per round; grows until all groups are settled.
LEADERS = (2, 256, 4096)

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. A-Z are lower-cased; a text of fewer words than
    ``size`` is one shingle; one without words has none."""
    return next(_sets([text], size))[0]


def _sets(texts: Iterable[str | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of texts in their order, some texts at a time: all shingles, and the bounds of each text's."""
    each, counts, held = [], [], 0
    for text in texts:
        words = text.encode("utf-8", "replace").lower().split() if text else []
        each.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        counts.append(len(words))
        held += len(words)
        if held >= CHUNK_WORDS:
            yield _shingled(np.concatenate(each), np.array(counts), size)
            each, counts, held = [], [], 0
    if counts:
        yield _shingled(np.concatenate(each), np.array(counts), size)


def _shingled(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of texts whose words follow each other."""
    first = np.cumsum(counts) - counts
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(first - bounds[:-1], many) + np.arange(bounds[-1])
    total = np.full(len(at), size, np.uint64)
    for j in range(size):
        total = total * _STEP + words[np.minimum(at + j, len(words) - 1)]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        whole = np.array([counts[i]], np.uint64)
        for word in words[first[i] : first[i] + counts[i]]:
            whole = whole * _STEP + word
        total[bounds[i]] = whole[0]
    total = _mix(total)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        total[a:b].sort()
    fresh = np.ones(len(total), bool)
    fresh[1:] = total[1:] != total[:-1]
    fresh[bounds[:-1][many > 0]] = True
    return total[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def _taken(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets ``which`` of the sets between ``bounds``, in that order."""
    sizes = (bounds[1:] - bounds[:-1])[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(bounds[:-1][which] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _identities(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits that name each set, as two signed numbers."""
    whole = memoryview(shingles.tobytes())
    ends = (8 * bounds).tolist()
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(ends, ends[1:])]), np.int64).reshape(-1, 2)


def signatures(shingles: np.ndarray, hot: np.ndarray | None, least: int = LEAST) -> np.ndarray:
    """PartEnum signatures of a set.

    The domain of shingles is cut into parts by the leading bits of the hash, more parts for larger
    sets. Two sets of sizes a and b that link differ in at most (a + b)(100 - least) / (100 + least)
    shingles, hence in at most k parts. A signature names a part together with all the set holds of it.
    Of the m parts in which a set has something, at least m - k are the same in the other set, so the
    first k + 1 signatures in any order common to all sets hold a shared one. Signatures whose
    shingles are all frequent come last in that order. A set with m <= k, which only chance can
    bring about, also gets a signature that all sets of its band share. A set that may link with sets
    of the next band gets signatures of both bands.
    """
    return signatures_of(shingles, np.array([0, len(shingles)]), hot, least)[0]


def signatures_of(shingles: np.ndarray, bounds: np.ndarray, hot: np.ndarray | None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets between ``bounds``, none of them empty, and the set each belongs to. The leading bit of a
    signature tells that its shingles are all frequent, so the order of the signatures is that of their numbers."""
    n = bounds[1:] - bounds[:-1]
    most = n * 100 // least
    limits = BAND * WIDER ** np.arange(24, dtype=np.int64)
    band, last = (np.searchsorted(limits, x, side="right") for x in (n, most))
    more = np.flatnonzero(last > band)
    owner = np.concatenate([np.arange(len(n)), more])
    band = np.concatenate([band, band[more] + 1])
    k = ((n + most) * (100 - least) // (100 + least))[owner]

    frequent, _ = _taken(_is_hot(shingles, hot), bounds, owner)
    shingles, bounds = _taken(shingles, bounds, owner)
    entry = np.repeat(np.arange(len(owner)), n[owner])
    part = shingles >> (58 - 2 * np.maximum(0, band - 1)).astype(np.uint64)[entry]
    starts = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (entry[1:] != entry[:-1])) + 1])
    entry = entry[starts]
    own = _mix(np.add.reduceat(_mix(shingles + _STEP), starts) ^ (part[starts] * _STEP + band[entry].astype(np.uint64)))
    late = np.logical_and.reduceat(frequent, starts)
    own = own & np.uint64((1 << 63) - 1) | late.astype(np.uint64) << np.uint64(63)
    parts = np.bincount(entry, minlength=len(owner))
    ends = np.cumsum(parts)
    for a, b in zip((ends - parts).tolist(), ends.tolist()):
        own[a:b].sort()
    chosen = np.arange(len(own)) - (ends - parts)[entry] <= k[entry]
    rest = np.flatnonzero(parts <= k)
    return np.concatenate([own[chosen], _mix((band[rest] + 1000).astype(np.uint64))]), owner[np.concatenate([entry[chosen], rest])]


def _is_hot(shingles: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    if hot is None:
        return np.zeros(len(shingles), bool)
    at = shingles & np.uint64((1 << HOT_BITS) - 1)
    return (hot[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def sketch(shingles: np.ndarray) -> bytes:
    """One bit per value of the trailing bits of a hash: whether an odd number of shingles has it. The bits in
    which two sketches differ are at most the shingles in which the sets differ. From 2 to 4 bits a shingle."""
    return sketches(shingles, np.array([0, len(shingles)]))[0].as_py()


def sketches(shingles: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The sketches of the sets between ``bounds``."""
    n = bounds[1:] - bounds[:-1]
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(bits)])
    own = (shingles & np.repeat((bits - 1).astype(np.uint64), n)).astype(np.int64) + np.repeat(ends[:-1], n)
    odd = np.packbits((np.bincount(own, minlength=ends[-1]) & 1).astype(bool), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(odd)])


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def least_differences(one: bytes, others: list[bytes]) -> np.ndarray:
    """Lower bounds of the differences of a set from others, from their sketches; the longer one of two is folded."""
    own = np.frombuffer(one, np.uint8)
    out = np.zeros(len(others), np.int64)
    sizes = np.array([len(o) for o in others])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        least = min(len(own), size)
        stack = np.stack([_folded(np.frombuffer(others[i], np.uint8), least) for i in at])
        out[at] = np.bitwise_count(stack ^ _folded(own, least)).sum(axis=1)
    return out


def profile(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_shingles, c1, c2, sketch)``: size, identity and sketch of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for shingles, bounds in _sets((text.as_py() for text in batch.column(1)), size):
                names = _identities(shingles, bounds)
                ids = batch.column(0).slice(at, len(names))
                at += len(names)
                columns = [ids, pa.array(bounds[1:] - bounds[:-1]), pa.array(names[:, 0]), pa.array(names[:, 1]), sketches(shingles, bounds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "c1", "c2", "sketch"])

    return documents(docs).mapInArrow(run, schema("doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint, sketch binary"))


def _distinct_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets of the texts of a task, equal ones once, some at a time: names, shingles and bounds."""
    seen: set[bytes] = set()
    for batch in batches:
        for shingles, bounds in _sets((text.as_py() for text in batch.column("text")), size):
            names, fresh = _identities(shingles, bounds), []
            for i, name in enumerate(map(bytes, names)):
                if bounds[i + 1] > bounds[i] and name not in seen:
                    seen.add(name)
                    fresh.append(i)
            if fresh:
                yield names[fresh], *_taken(shingles, bounds, np.array(fresh))


def frequent_shingles(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """A bitmap of fixed size that holds the shingles which are frequent in a sample of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, _ in _distinct_sets(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    some = documents(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0)
    counted = some.mapInArrow(run, schema("h bigint")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counted.filter(F.col("n") >= HOT_SEEN).orderBy(F.desc("n"), "h").limit(HOT_MOST).select("h").toArrow()
    bitmap = np.zeros(1 << (HOT_BITS - 3), np.uint8)
    at = top.column(0).to_numpy().view(np.uint64) & np.uint64((1 << HOT_BITS) - 1)
    np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return bitmap


def _dealt(docs: DataFrame, hot: np.ndarray, partitions: int, size: int, least: int) -> DataFrame:
    """Signatures packed into one binary row per task and bucket: 17 bytes each, the signature, the
    first half of the set's identity and a code of its size."""
    buckets = 16 * partitions
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        s, c, n = (np.concatenate(x) for x in zip(*held))
        bucket = (s % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        s, c, n, bucket = s[order], c[order], n[order], bucket[order]
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(s)]])
        blobs = [[x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] for x in (s, c, n)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), *(pa.array(b, pa.binary()) for b in blobs)], names=["bucket", "s", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for names, shingles, bounds in _distinct_sets(batches, size):
            sigs, owner = signatures_of(shingles, bounds, shared.value, least)
            codes = np.minimum(255, SIZE_STEPS * np.log2(bounds[1:] - bounds[:-1])).astype(np.uint8)
            held.append((sigs, names[owner, 0], codes[owner]))
            many += len(sigs)
            if many >= FLUSH:
                yield packed(held)
                held, many = [], 0
        if held:
            yield packed(held)

    return documents(docs).mapInArrow(run, schema("bucket int, s binary, c binary, n binary"))


def _groups(dealt: DataFrame, partitions: int, least: int) -> DataFrame:
    """``(gid, c)``: the sets that share a signature. Groups of the same members count once."""
    #: Sizes that may link are at most so many codes apart; the one more is for rounding.
    apart = int(SIZE_STEPS * np.log2(100 / least)) + 1 if least else 255

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = ([], [], [])
        for batch in batches:
            for held, column in zip(blobs, batch.columns[1:]):
                held += column.to_pylist()
        if not blobs[0]:
            return
        s, c, n = (np.frombuffer(b"".join(b), k) for b, k in zip(blobs, (np.uint64, np.int64, np.uint8)))
        del blobs
        order = np.argsort(s, kind="stable")
        tied = np.zeros(len(s), bool)
        same = s[order[1:]] == s[order[:-1]]
        tied[1:] |= same
        tied[:-1] |= same
        order = order[tied]
        s, c, n = s[order], c[order], n[order]
        order = np.lexsort((c, s))
        s, c, n = s[order], c[order], n[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        s, c, n = s[fresh], c[fresh], n[fresh]
        if not len(s):
            return
        starts = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
        many = np.diff(np.append(starts, len(s)))
        low, high = np.minimum.reduceat(n, starts).astype(np.int64), np.maximum.reduceat(n, starts).astype(np.int64)
        gid = _mix(np.add.reduceat(_mix(c.view(np.uint64) + _STEP), starts) ^ many.astype(np.uint64))
        useful = np.flatnonzero((many > 2) | ((many == 2) & (high - low <= apart)))
        _, first = np.unique(gid[useful], return_index=True)
        useful = useful[first]
        lengths = many[useful]
        at = np.repeat(starts[useful] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        for a in range(0, len(at), 100_000):
            part = at[a : a + 100_000]
            ids = np.repeat(gid[useful], lengths)[a : a + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(c[part])], names=["gid", "c"])

    return dealt.repartition(partitions, "bucket").mapInArrow(run, schema("gid bigint, c bigint"))


def _sets_of(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """``(rep, hs)``: the sets of the documents ``reps (rep, c1, c2)``. Few ids are sent to the documents;
    for many, a bitmap of fixed size, which passes all of them and some more, keeps most other documents
    from being hashed and shuffled again."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bitmap[place(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bitmap).tobytes()], pa.binary())], names=["bits"])

    def place(ids: np.ndarray) -> np.ndarray:
        return _mix(ids.view(np.uint64) + _STEP) >> np.uint64(64 - FILTER_BITS)

    texts, shared = documents(docs).filter("doc_id IS NOT NULL"), None
    if reps.count() <= SENT_IDS:
        texts = texts.join(F.broadcast(reps.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    else:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for row in reps.select("rep").coalesce(4).mapInArrow(marks, schema("bits binary")).toLocalIterator():
            bits |= np.frombuffer(row["bits"], np.uint8)
        shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool) if shared else None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            chosen = np.flatnonzero(wanted[place(ids)]) if shared else np.arange(len(ids))
            at = 0
            for shingles, bounds in _sets((batch.column(1)[i].as_py() for i in chosen.tolist()), size):
                names, own = _identities(shingles, bounds), ids[chosen[at : at + len(bounds) - 1]]
                at += len(own)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(names[:, 0]), pa.array(names[:, 1]), sets], names=["rep", "c1", "c2", "hs"])

    found = texts.mapInArrow(run, schema("rep bigint, c1 bigint, c2 bigint, hs array<bigint>"))
    return found.join(reps.select("rep", "c1", "c2"), ["rep", "c1", "c2"], "left_semi").dropDuplicates(["rep"]).select("rep", "hs")


def _plausible(members: DataFrame, leaders: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs ``(a, b)`` of a member and a leader of its group that are not connected yet and that neither sizes nor
    sketches rule out. No pair that links is ruled out.

    A large group is dealt out in stretches, each with all leaders, and compared inside the tasks: only
    plausible pairs come out. A leader that is in its own stretch is sent there once, as a member too: most groups
    are one stretch whose members all lead.
    """
    sizes = members.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / STRETCH).alias("_stretches"))
    marked = members.join(leaders.select("gid", "rep", F.lit(True).alias("_leads")), ["gid", "rep"], "left")
    home = F.pmod(F.xxhash64("rep"), F.col("_stretches"))
    each = marked.join(sizes, "gid").select("gid", home.alias("stretch"), F.coalesce("_leads", F.lit(False)).alias("leads"), F.lit(True).alias("member"), "rep", "n", "component")
    away = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("_stretches") - 1), lambda x: x != home)
    first = leaders.join(sizes.filter("_stretches > 1"), "gid").select("gid", F.explode(away).alias("stretch"), F.lit(True).alias("leads"), F.lit(False).alias("member"), "rep", "n", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            found = [np.zeros((0, 2), np.int64), *_close_pairs(rows, least)]
            pairs = np.unique(np.concatenate(found), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = each.unionByName(first).join(classes.select("rep", "sketch"), "rep").select("gid", "stretch", "leads", "member", "rep", "n", "component", "sketch")
    dealt = dealt.repartition("gid", "stretch").sortWithinPartitions("gid", "stretch", "leads")
    return dealt.mapInArrow(run, schema("a bigint, b bigint")).distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (gid, stretch) in tables that cut none of these groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            ends = [[b.column(c)[i].as_py() for c in (0, 1)] for b, i in ((batch, 0), (batch, -1))]
            if held and [held[-1].column(c)[-1].as_py() for c in (0, 1)] != ends[0]:
                yield pa.Table.from_batches(held)
                held = []
            if ends[0] != ends[1]:
                gid, stretch = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cut = int(np.flatnonzero((gid != gid[-1]) | (stretch != stretch[-1]))[-1]) + 1
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _close_pairs(rows: pa.Table, least: int) -> Iterator[np.ndarray]:
    """Pairs (larger, smaller) of a member and a leader within each (gid, stretch) of ``rows``, where leaders come last."""
    gid, stretch, leads, known, rep, n, component = (rows.column(c).to_numpy() for c in ("gid", "stretch", "leads", "member", "rep", "n", "component"))
    n = n.astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero((gid[1:] != gid[:-1]) | (stretch[1:] != stretch[:-1])) + 1])
    ends = np.append(starts[1:], len(gid))
    top = np.add.reduceat(leads.astype(np.int64), starts)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    bits = rows.column("sketch").to_pylist()
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    place = np.zeros(len(bits), np.int64)
    stacks = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        stacks[w] = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), -1)

    member = np.flatnonzero(known)
    upto = np.cumsum(top[group[member]])
    a = 0
    while a < len(member):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK_PAIRS, side="right")))
        many = top[group[member[a:b]]]
        i = np.repeat(member[a:b], many)
        j = np.repeat((ends - top)[group[member[a:b]]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        a = b
        # Of two members that both lead, the later one meets the other.
        fit = (~leads[i] | (i > j) | ~known[j]) & (component[i] != component[j]) & (100 * n[j] >= least * n[i]) & (100 * n[i] >= least * n[j])
        i, j = i[fit], j[fit]
        most = (n[i] + n[j]) * (100 - least) // (100 + least)
        differ = np.zeros(len(i), np.int64)
        kind = width[i] * (1 << 32) + width[j]
        for pair in np.unique(kind).tolist():
            these = np.flatnonzero(kind == pair)
            wi, wj = pair >> 32, pair & ((1 << 32) - 1)
            # Pieces of few words each, so that long sketches do not add up.
            step = max(1, CHUNK_PAIRS * 32 // max(wi, wj))
            for cut in range(0, len(these), step):
                some = these[cut : cut + step]
                x, y = stacks[wi][place[i[some]]], stacks[wj][place[j[some]]]
                least_words = min(wi, wj) // 8
                differ[some] = np.bitwise_count(_narrow(x, least_words) ^ _narrow(y, least_words)).sum(axis=1)
        near = differ <= most
        yield np.stack([np.maximum(rep[i], rep[j])[near], np.minimum(rep[i], rep[j])[near]], axis=1)


def _narrow(words: np.ndarray, size: int) -> np.ndarray:
    """Sketches, one in each row, folded to ``size`` words."""
    while words.shape[1] > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _nearest_leaders(members: DataFrame, least: int) -> DataFrame:
    """At most one pair ``(a, b)`` per set: with that one of its groups' first members which it shares most of them with."""
    first = members.groupBy("gid").agg(F.max(F.struct("_deg", (-F.col("rep")).alias("_last"), "n")).alias("_first"))
    met = members.join(first, "gid").select("rep", "n", (-F.col("_first._last")).alias("leader"), F.col("_first.n").alias("_n"))
    met = met.filter((F.col("rep") != F.col("leader")) & (100 * F.col("n") >= least * F.col("_n")) & (100 * F.col("_n") >= least * F.col("n")))
    shared = met.groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("_shared"))
    best = shared.groupBy("rep").agg(F.max(F.struct("_shared", "leader"))["leader"].alias("leader"))
    return best.select(F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b")).distinct()


def _not_ruled_out(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` that sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            apart = [least_differences(x, [y])[0] for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
            near = np.array(apart, np.int64) <= (na + nb) * (100 - least) // (100 + least)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    end = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, schema("a bigint, b bigint"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, least: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, counted exactly."""
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    reps = staged(classes.select("rep", "c1", "c2").join(ends, "rep", "left_semi"), "reps")
    sets = staged(_sets_of(docs, reps, size), "sets")
    joined = pairs.join(sets.select(F.col("rep").alias("b"), F.col("hs").alias("hb")), "b").join(
        sets.select(F.col("rep").alias("a"), F.col("hs").alias("ha")), "a"
    )
    both = F.size(F.array_intersect("ha", "hb"))
    return joined.filter(100 * both >= least * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def _settled(members: DataFrame, check: Callable[[DataFrame, DataFrame], DataFrame], begin: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(node, component)`` of the sets that link with others, from groups ``(gid, rep, n)`` of candidates.
    ``check`` finds the links between members and leaders, ``begin`` links of one pair per set.

    Groups of near copies overlap and each has leaders of its own, so comparing all of them would make a pair for every
    leader of every group a set is in. Links of one pair per set come first: they connect most near copies, and
    groups within one component are settled.

    A few members of each group, the leaders of the round, are compared with all other members. Leaders are
    first those outside the largest component, and of these the members of most groups: the text that
    near copies were made from shares more with them than they do with each other. After a round
    a pair matters only if its two sets are not connected yet and neither has been a leader. Groups
    without such a pair are settled. Groups of near copies are settled in the first round; the number
    of leaders grows from round to round, so the others follow in a number of rounds that is the
    logarithm of their size. No pair is left out, and none within a settled group is ever made.
    """
    rows, number = members.count(), 0
    rest = staged(members.join(members.groupBy("rep").agg(F.count(F.lit(1)).alias("_deg")), "rep"), "rest", rows)
    links = staged(begin(rest), "verified")
    component = staged(connected_components(links), "component", 2 * rows)
    while True:
        leaders = LEADERS[min(number, len(LEADERS) - 1)] * WIDER ** max(0, number - len(LEADERS) + 1)
        known = rest.join(component, F.col("rep") == F.col("node"), "left").select("gid", "rep", "n", "_deg", F.coalesce("component", "rep").alias("component"))
        sizes = known.groupBy("gid", "component").agg(F.count(F.lit(1)).alias("_m"))
        mixed = staged(sizes.groupBy("gid").agg(F.count(F.lit(1)).alias("_k"), F.max(F.struct("_m", "component"))["component"].alias("_main")).filter("_k > 1"), "mixed", rows)
        if mixed.isEmpty():
            return component
        open_ = known.join(mixed.select("gid", "_main"), "gid").withColumn("_m", F.col("component") == F.col("_main")).drop("_main")
        open_ = staged(open_, "open", rows)
        lead = staged(top_per_key(open_, ["gid"], [F.col("_m"), F.col("_deg").desc(), F.col("rep")], leaders).select("gid", "rep", "n", "component"), "leaders", rows)
        found = staged(check(open_, lead), "verified")
        links = links.unionByName(found)
        component = staged(connected_components(links), "component", 2 * rows)
        rest = staged(open_.select("gid", "rep", "n", "_deg").join(lead.select("gid", "rep"), ["gid", "rep"], "left_anti"), "rest", rows)
        number += 1


def join_near(docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Documents link when the Jaccard similarity of their sets of ``size``-word shingles is at least
    ``least`` per cent; component_id is the smallest doc_id reachable by links. Texts with equal sets
    are one class that is compared once, however many they are. A null or empty text, or one without
    words, has 0 shingles, links with nothing and is its own component. Repeated rows get the same
    answer; a null doc_id gets the component of its class, or null. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = staged(profile(docs, size), "profile")
    classes = staged(
        known.filter("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).filter("rep IS NOT NULL"), "classes"
    )
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    expected = total * 2 * (100 - least) // (100 + least) * 3 // 2
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), expected // PER_PARTITION)
    groups = _groups(_dealt(docs, frequent_shingles(docs, size), partitions, size, least), partitions, least)
    groups = staged(groups.distinct(), "groups")
    members = staged(groups.join(classes.select(F.col("c1").alias("c"), "rep", "n"), "c").select("gid", "rep", "n"), "members")

    def check(rest: DataFrame, leaders: DataFrame) -> DataFrame:
        pairs = staged(_plausible(rest, leaders, classes, least), "plausible")
        return _verified(pairs, docs, classes, size, least)

    def begin(rest: DataFrame) -> DataFrame:
        pairs = staged(_not_ruled_out(_nearest_leaders(rest, least), classes, least), "nearest")
        return _verified(pairs, docs, classes, size, least)

    component = _settled(members, check, begin)
    component = component.select(F.col("node").alias("rep"), "component")
    answer = staged(classes.join(component, "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component")), "answer")
    return known.drop("sketch").join(answer, ["c1", "c2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest doc_id. Of rows that
    repeat a doc_id one stays; rows without one all stay."""
    first = join_near(docs, size, least).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
