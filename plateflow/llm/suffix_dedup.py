"""Suffix-array dedup (operator 11): repeated byte strings by a difference cover and one suffix bucket at a time."""

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.llm.common import by_key, documents, schema, staged
from plateflow.operators.skew import shared_folder

#: Bytes of a repeated string.
LENGTH = 100
#: Perfect difference sets. Any two places have exactly one common distance below the
#: period at which both are in the cover.
COVERS = {7: (0, 1, 3), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
PERIOD = 57
#: Bytes of text in a chunk, which one task holds with up to 40 times that in arrays; places named at a time.
CHUNK, SLICE = 4 << 20, 1 << 17
#: Names a bucket holds at most on average, and bytes of one file of chunks.
BUCKET, FILE = 1 << 20, 64 << 20
#: Stands for a null doc_id: behind all others.
LAST = (1 << 63) - 1

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHUNK = "chunk bigint, ids binary, sizes binary, body binary"
_BLOB = "bucket int, chunk bigint, names binary, base bigint, docs binary"
_ANSWER = "chunk bigint, bucket int, bits binary"


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of strings made of two parts, from the names of the parts."""
    x = a ^ (a >> np.uint64(29))
    x *= _K1
    x ^= x >> np.uint64(32)
    x += b
    x *= _K2
    x ^= x >> np.uint64(29)
    x *= _K1
    x ^= x >> np.uint64(32)
    return x


def names(text: np.ndarray, first: int, last: int, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit names of the strings of ``length`` (at least 8) bytes that start at ``first .. last - 1``, or at the places ``at`` of these.
    Strings of 8 bytes name themselves; names of twice the length are made from two of them, and any other length is put together from
    the longest of these that fit."""
    part = text[first : last + length - 1].astype(np.uint64)
    part = np.concatenate([part, np.zeros(max(0, last - first + length - 1 - len(part)), np.uint64)])
    for half in (1, 2, 4):
        part = part[:-half] | (part[half:] << np.uint64(8 * half))
    size = 8
    while 2 * size <= length:
        part, size = _join(part[:-size], part[size:]), 2 * size
    pick = np.arange(last - first) if at is None else at - first
    out, done = part[pick], size
    while done < length:
        step = min(done, length - size)
        out, done = _join(out, part[pick + step]), step + size
    return out


class Chunk:
    """Some documents, one after the other, in order of their ids."""

    def __init__(self, row: dict, length: int, period: int):
        self.id, self.length, self.period = row["chunk"], length, period
        self.ids, self.sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.text = np.frombuffer(zstandard.decompress(row["body"], max_output_size=int(self.sizes.sum()) or 1), np.uint8)

    def named(self, places: np.ndarray, length: int) -> np.ndarray:
        """Names of the strings at the ascending places, slice by slice."""
        out = np.empty(len(places), np.uint64)
        cuts = np.searchsorted(places, np.arange(0, len(self.text) + SLICE, SLICE))
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                part = places[a:b]
                out[a:b] = names(self.text, int(part[0]), int(part[-1]) + 1, length, part)
        return out

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def cover(self) -> np.ndarray:
        """Places of the cover at which a whole sample string lies in the document."""
        gram = self.length - self.period + 1
        offsets = np.array(COVERS[self.period])
        rounds = np.arange(0, max(self.sizes, default=0), self.period)
        steps = (rounds[:, None] + offsets[None]).ravel()
        counts = np.searchsorted(steps, self.sizes - gram, side="right")
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(self.starts, counts) + steps[inner]

    def spread(self, places: np.ndarray) -> np.ndarray:
        """Whether a place is one of the given ones or up to ``period - 1`` before it, in the same document."""
        change = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(change, np.maximum(places - self.period + 1, self.starts[self.doc_of(places)]), 1)
        np.add.at(change, places + 1, -1)
        return np.cumsum(change[:-1], out=change[:-1]) > 0

    def fits(self) -> np.ndarray:
        """Whether a string of ``length`` bytes that starts at a place ends in the same document."""
        out = np.zeros(len(self.text), bool)
        for start, end in zip(self.starts.tolist(), self.ends.tolist()):
            out[start : max(start, end - self.length + 1)] = True
        return out

    def places_of(self, marks: np.ndarray) -> np.ndarray:
        """The marked places, as narrow as the text lets them be."""
        kind = np.int32 if len(self.text) < 1 << 31 else np.int64
        parts = [np.zeros(0, kind)]
        for a in range(0, len(marks), SLICE):
            parts.append((np.flatnonzero(marks[a : a + SLICE]) + a).astype(kind))
        return np.concatenate(parts)


class Names:
    """The distinct names of a chunk by bucket, each with its first place."""

    def __init__(self, found: np.ndarray, bits: int, low: bool = False):
        # Short names keep 32 bits besides those of the bucket.
        keys = found >> np.uint64(32 - bits) if low else found
        kind = np.int32 if len(keys) < 1 << 31 else np.int64
        order = np.argsort(keys, kind="stable").astype(kind)
        keys = keys[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        self.which = np.empty(len(keys), kind)
        self.which[order] = np.cumsum(fresh, dtype=kind) - kind(1)
        keys, self.first = keys[fresh], order[fresh]
        self.buckets = (keys >> np.uint64(32 if low else 64 - bits)).astype(np.int64)
        self.kept = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32) if low else keys
        self.cuts = np.flatnonzero(np.diff(self.buckets, prepend=-1, append=-1))

    def blobs(self, chunk: int, docs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """A row per bucket: the names, and the ids of the documents of their first places, as narrow as their range lets them be."""
        rows = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            base, own = 0, b""
            if docs is not None:
                part = docs[self.first[a:b]]
                base = int(part.min())
                gap = part.astype(np.uint64) - np.uint64(base % (1 << 64))
                top = int(gap.max())
                own = gap.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()
            rows.append((int(self.buckets[a]), chunk, self.kept[a:b].tobytes(), base, own))
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "chunk", "names", "base", "docs"])

    def told(self, answers: list[dict]) -> np.ndarray:
        """One answer per distinct name."""
        own = {a["bucket"]: a["bits"] for a in answers or []}
        out = np.zeros(len(self.kept), bool)
        for a, b in zip(self.cuts, self.cuts[1:]):
            out[a:b] = np.unpackbits(np.frombuffer(own[int(self.buckets[a])], np.uint8), count=int(b - a)).astype(bool)
        return out

    def later(self, answers: list[dict]) -> np.ndarray:
        """Of all occurrences: whether the name also occurs earlier, in this chunk or in another."""
        out = self.told(answers)[self.which]
        again = np.ones(len(out), bool)
        again[self.first] = False
        return out | again


class Chain:
    """What is known of a chunk after the answers of some of the three stages."""

    def __init__(self, chunk: Chunk, bits: int):
        self.chunk, self.bits = chunk, bits

    def samples(self) -> Names:
        self.places = self.chunk.cover()
        self.sampled = Names(self.chunk.named(self.places, self.chunk.length - self.chunk.period + 1), self.bits, low=True)
        return self.sampled

    def contexts(self, answers: list[dict]) -> Names:
        """Strings around the samples that occur twice: they span all windows in which the sample can lie."""
        sampled, chunk = self.samples(), self.chunk
        often = np.bincount(sampled.which, minlength=len(sampled.kept)) > 1
        self.live = self.places[(sampled.told(answers) | often)[sampled.which]]
        doc = chunk.doc_of(self.live)
        fit = (self.live - chunk.period + 1 >= chunk.starts[doc]) & (self.live + chunk.length <= chunk.ends[doc])
        self.inner = self.live[fit] - chunk.period + 1
        self.around = Names(chunk.named(self.inner, chunk.length + chunk.period - 1), self.bits)
        return self.around

    def windows(self, samples: list[dict], contexts: list[dict]) -> Names:
        """Windows that hold a sample which occurs twice and that no context has decided."""
        around, chunk = self.contexts(samples), self.chunk
        self.sure = chunk.spread(self.inner[around.later(contexts)] + chunk.period - 1)
        self.open = chunk.places_of(chunk.spread(self.live) & ~self.sure & chunk.fits())
        self.rest = Names(chunk.named(self.open, chunk.length), self.bits)
        return self.rest

    def removed(self, samples: list[dict], contexts: list[dict], windows: list[dict]) -> np.ndarray:
        """Bytes that a window covers which also occurs earlier."""
        rest = self.windows(samples, contexts)
        hit, length = self.sure, self.chunk.length
        hit[self.open[rest.later(windows)]] = True
        del rest, self.open, self.rest
        # Windows that start up to a place, less those that end before it.
        seen = np.cumsum(hit, dtype=np.int32 if len(hit) < 1 << 31 else np.int64)
        covered = seen > 0
        covered[length:] = seen[length:] > seen[:-length]
        return covered


def _chunks(docs: DataFrame, size: int, files: int) -> DataFrame:
    """The texts in chunks of about ``size`` bytes, in files by a hash of the chunk: later joins by chunk
    leave the texts where they are. A longer text is a chunk of its own."""

    def packed(ids: list, texts: list, number: int) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts[i] for i in order))
        key = (TaskContext.get().partitionId() << 32) + number
        columns = [np.array([ids[i] for i in order], np.int64).tobytes(), sizes.tobytes(), body]
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], names=["chunk", "ids", "sizes", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, number = [], [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(LAST if doc is None else doc)
                texts.append(body)
                held += len(body) + 16
                if held >= size:
                    yield packed(ids, texts, number)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield packed(ids, texts, number)

    spark, name = docs.sparkSession, f"chunks_{uuid.uuid4().hex}"
    rows = documents(docs).mapInArrow(run, schema(_CHUNK))
    rows.write.bucketBy(files, "chunk").option("path", shared_folder(spark, "chunks")).option("compression", "none").saveAsTable(name)
    return spark.table(name), name


def _twice(table: pa.Table) -> np.ndarray:
    """Whether a name of this bucket is in two chunks. Names of one row differ."""
    found = np.frombuffer(b"".join(table.column("names").to_pylist()), np.uint32)
    _, which, many = np.unique(found, return_inverse=True, return_counts=True)
    return many[which] > 1


def _not_first(table: pa.Table) -> np.ndarray:
    """Whether a name of this bucket occurs in an earlier document, or in the same one but an earlier chunk:
    the bucket is sorted by name, document and chunk."""
    found = np.frombuffer(b"".join(table.column("names").to_pylist()), np.uint64)
    docs, chunks = [], []
    for chunk, own, base, part in zip(*(table.column(c).to_pylist() for c in ("chunk", "names", "base", "docs"))):
        n = len(own) // 8
        docs.append((np.frombuffer(part, f"<u{len(part) // n}").astype(np.uint64) + np.uint64(base % (1 << 64))).astype(np.int64))
        chunks.append(np.full(n, chunk))
    order = np.lexsort((np.concatenate(chunks), np.concatenate(docs), found))
    out = np.zeros(len(found), bool)
    out[order[1:]] = found[order[1:]] == found[order[:-1]]
    return out


def _answers(blobs: DataFrame, width: int, decide: Callable[[pa.Table], np.ndarray], parts: int, name: str) -> DataFrame:
    """Per chunk and bucket one bit a name. A task sorts the buckets it gets one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in by_key(batches, 1):
            told, at, bits = decide(table), 0, []
            for own in table.column("names").to_pylist():
                n = len(own) // width
                bits.append(np.packbits(told[at : at + n]).tobytes())
                at += n
            yield pa.RecordBatch.from_arrays([table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(bits, pa.binary())], names=["chunk", "bucket", "bits"])

    dealt = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return staged(dealt.mapInArrow(run, schema(_ANSWER)), name)


def remove_repeats(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes. A byte is removed if a string of ``length`` bytes covers it that also starts earlier: in a document of a
    smaller id, or earlier in the same one. Strings are judged on the input and never cross documents. A null or
    empty text has no bytes, a text shorter than ``length`` loses none. Of rows that repeat a doc_id one counts as the earlier one,
    always the same in all comparisons; which one is not defined. A null doc_id comes after all others. An empty table gives an
    empty result. Very long texts are named slice by slice; their bytes have to fit a task. Other columns are ignored.

    Where two equal strings start, some distance below ``period`` on both are in the difference cover, so samples of the
    cover are named first (a seventh of all places). Samples that occur twice are extended to the context
    which holds all windows around them; the order of equal contexts decides ``period`` suffixes at once, which settles
    long repeats. Only suffixes at the ends of repeats are left and are sorted by their own first ``length`` bytes. Each time suffixes
    are dealt into buckets by name, one bucket is sorted at a time, and one bit a name goes back to its chunk.
    Strings are compared by names of 64 bits.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 16 * F.count(F.lit(1))).first()[0]
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    samples = total * len(COVERS[period]) // period
    bits = max(8 * shuffled - 1, samples // BUCKET).bit_length()
    parts = max(shuffled, samples * 4 // FILE)
    chunks, name = _chunks(docs, chunk, max(shuffled, total // FILE))

    def known(*answers: DataFrame) -> DataFrame:
        out = chunks
        for column, rows in zip("abc", answers):
            grouped = rows.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(column))
            out = out.join(grouped.hint("shuffle_hash"), "chunk", "left")
        return out

    def each(rows: DataFrame, work: Callable, out: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    own = Chunk(row, length, period)
                    yield from work(own, Chain(own, bits), *(row.get(c) for c in "abc"))

        return rows.mapInArrow(run, schema(out))

    def first(own, chain, *_):
        yield from chain.samples().blobs(own.id, None)

    def second(own, chain, a, *_):
        found = chain.contexts(a)
        yield from found.blobs(own.id, own.ids[own.doc_of(chain.inner)])

    def third(own, chain, a, b, _):
        found = chain.windows(a, b)
        yield from found.blobs(own.id, own.ids[own.doc_of(chain.open)])

    def result(own, chain, a, b, c):
        gone = chain.removed(a, b, c)
        rows = []
        for doc, start, end in zip(own.ids.tolist(), own.starts.tolist(), own.ends.tolist()):
            part = gone[start:end]
            spans = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum())
            rows.append((None if doc == LAST else doc, end - start, int(part.sum()), spans, hashlib.sha256(own.text[start:end][~part].tobytes()).hexdigest()))
        kinds = (*(pa.int64(),) * 4, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    a = _answers(each(chunks, first, _BLOB), 4, _twice, parts, "samples")
    b = _answers(each(known(a), second, _BLOB), 8, _not_first, parts, "contexts")
    c = _answers(each(known(a, b), third, _BLOB), 8, _not_first, parts, "windows")
    out = staged(each(known(a, b, c), result, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"), "kept")
    spark.sql(f"DROP TABLE {name}")
    return out


#: The same in SQL, over texts in hexadecimal; rows with the same doc_id are beyond it.
SQL = """WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS MATERIALIZED (SELECT r, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
 f AS (SELECT s, min(r * 4294967296 + i) AS first FROM p GROUP BY s HAVING count(*) > 1),
 w AS (SELECT p.r, p.i FROM p JOIN f USING (s) WHERE p.r * 4294967296 + p.i > f.first),
 g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run
   FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM w)),
 x AS (SELECT r, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY r, run),
 c AS (SELECT r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM x GROUP BY r),
 y AS (SELECT r, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS b FROM (SELECT r, a, b FROM x UNION ALL SELECT r, -1, 0 FROM d)),
 k AS (SELECT d.r, string_agg(substr(h, 2 * y.a + 1, 2 * (coalesce(y.b, len(h) // 2) - y.a)), '' ORDER BY y.a) AS kept FROM d JOIN y USING (r) GROUP BY d.r)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (r) LEFT JOIN c USING (r)"""
