"""Ranked lexical search (operator 13): best-first document intervals bounded by range-maximum tables."""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.llm.common import documents, schema, staged
from plateflow.operators.skew import top_per_key

TOP = 10
#: A block of the index holds at most so many documents and ends after so many occurrences of query terms.
BLOCK_DOCS, BLOCK_HITS = 16384, 2_000_000
#: Intervals of at most so many documents are scored as a whole.
LEAF = 128
#: Queries meet the documents in blocks of so many bytes of text.
QUERY_BYTES = 4 << 20
#: Stands for a null doc_id: behind all others.
LAST = (1 << 63) - 1
#: Random orders of the terms that bring like documents together.
DRAWS, SEED = 2, 13

#: Letters of a term stay, A-Z lower-cased; all else becomes a blank. Bytes from 0x80 on are parts of other letters.
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

_INDEX = "docs bigint, total bigint, ids binary, lengths binary, terms binary, starts binary, at binary, tf binary"
_BEST = "query int, score bigint, doc_id bigint"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def _alike(hits: list, lengths: list, draws: np.ndarray) -> np.ndarray:
    """An order of documents in which those of like terms are neighbours: by the least term of each of some random orders
    of the terms, which two documents share as often as they share terms, and then by length."""
    if not hits:
        return np.zeros(0, np.int64)
    starts = np.cumsum([0, *map(len, hits)])[:-1]
    least = np.minimum.reduceat(draws[:, np.concatenate(hits)], starts, axis=1)
    return np.lexsort((lengths, *least[::-1]))


def build_index(docs: DataFrame, terms: dict[bytes, int], block_docs: int = BLOCK_DOCS, block_hits: int = BLOCK_HITS) -> DataFrame:
    """Blocks of documents, like ones next to each other, with the postings of the given terms.

    Every document is counted; ``ids`` and ``lengths`` hold those in which a given term occurs. A posting list is
    ``at`` (places in the block) and ``tf`` from its start on.
    """

    draws = np.random.default_rng(SEED).permuted(np.tile(np.arange(len(terms), dtype=np.int32), (DRAWS, 1)), axis=1)

    def block(ids: list, lengths: list, hits: list, docs_seen: int, total: int) -> pa.RecordBatch:
        order = _alike(hits, lengths, draws)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        own = np.repeat(place, [len(h) for h in hits]) if hits else np.zeros(0, np.int64)
        found = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        keys, tf = np.unique(found * block_docs + own, return_counts=True)
        term, starts = np.unique(keys // block_docs, return_index=True)
        columns = [
            np.array([LAST if ids[i] is None else ids[i] for i in order], np.int64), np.array([lengths[i] for i in order], np.int64),
            term.astype(np.int32), np.append(starts, len(keys)).astype(np.int32), (keys % block_docs).astype(np.int32), tf.astype(np.int64),
        ]
        out = [pa.array([docs_seen], pa.int64()), pa.array([total], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)]
        return pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in _INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, hits, held, seen, total = [], [], [], 0, 0, 0
        get = terms.get
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                seen, total = seen + 1, total + len(words)
                known = np.array([t for t in map(get, words) if t is not None], np.int64)
                if not len(known):
                    continue
                ids.append(doc)
                lengths.append(len(words))
                hits.append(known)
                held += len(known)
                if len(ids) == block_docs or held >= block_hits:
                    yield block(ids, lengths, hits, seen, total)
                    ids, lengths, hits, held, seen, total = [], [], [], 0, 0, 0
        if seen:
            yield block(ids, lengths, hits, seen, total)

    return documents(docs).mapInArrow(run, schema(_INDEX))


def _frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents per term; each task hands on one partial count per term it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms, np.int64)
        for batch in batches:
            for term, starts in zip(batch.column(0), batch.column(1)):
                counts[np.frombuffer(term.as_py(), np.int32)] += np.diff(np.frombuffer(starts.as_py(), np.int32))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for row in index.select("terms", "starts").mapInArrow(run, schema("term int, df bigint")).groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["term"]] = row["df"]
    return out


class Postings:
    """The posting lists of a block with a sparse table of range maxima, and the search in it."""

    def __init__(self, block: dict, n_docs: int, total: int):
        read = lambda name, kind: np.frombuffer(block[name], kind)
        self.ids, self.terms = read("ids", np.int64), read("terms", np.int32)
        self.starts, self.at = read("starts", np.int32).astype(np.int64), read("at", np.int32).astype(np.int64)
        tf = read("tf", np.int64)
        weight = 25 + (75 * read("lengths", np.int64) * n_docs) // total
        self.part = (1_000_000_000 * tf) // (1000 * tf + 8 * weight[self.at])
        sizes = np.diff(self.starts)
        self.width = len(self.ids)
        self.keys = np.repeat(np.arange(len(self.terms)) * self.width, sizes) + self.at
        # table[j, i]: the place of the largest part among i .. i + 2**j - 1 of the concatenated lists. A range inside one list
        # never looks at another list.
        most = int(max(sizes, default=0))
        levels = max(1, most.bit_length())
        self.table = np.tile(np.arange(len(self.at), dtype=np.int32), (levels, 1))
        for j in range(1, levels):
            step = 1 << (j - 1)
            one, two = self.table[j - 1, :-step], self.table[j - 1, step:]
            self.table[j, :-step] = np.where(self.part[one] >= self.part[two], one, two)
        self.log = np.log2(np.maximum(1, np.arange(most + 1))).astype(np.int8)

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the largest parts in the ranges ``a .. b - 1``, none of them empty."""
        level = self.log[b - a]
        one, two = self.table[level, a], self.table[level, b - (1 << level.astype(np.int64))]
        return np.where(self.part[one] >= self.part[two], one, two)

    def search(self, terms: np.ndarray, gains: np.ndarray, best: list, top: int, leaf: int) -> int:
        """Put the documents of this block that belong to the ``top`` ones into ``best``, a heap of (score, -doc_id).
        ``gains`` are the weights of the terms, times their repeats. Returns the number of documents scored.

        An interval of documents is bounded by the sum of its terms' largest parts. The one with the
        highest bound is taken first, split at the document of the largest single contribution, which is
        scored, and its two sides are bounded in turn. The search ends when no interval can hold a better document.
        """
        slot = np.searchsorted(self.terms, terms)
        slot[slot == len(self.terms)] = 0
        there = self.terms[slot] == terms
        slot, gains = slot[there], gains[there]
        scored = 0

        def worth(bound: int, lo: int, hi: int) -> bool:
            if len(best) < top:
                return bound > 0
            score, doc = best[0]
            return bound > score or (bound == score and self.ids[lo:hi].min() < -doc)

        def keep(score: int, doc: int) -> None:
            if score > 0:
                if len(best) < top:
                    heapq.heappush(best, (score, -doc))
                elif (score, -doc) > best[0]:
                    heapq.heapreplace(best, (score, -doc))

        queue: list = []

        def push(lo: int, hi: int, slot: np.ndarray, gain: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            if lo < hi:
                some = np.flatnonzero(a < b)
                if len(some):
                    a, b, slot, gain = a[some], b[some], slot[some], gain[some]
                    place = self.largest(a, b)
                    each = gain * self.part[place]
                    bound = int(each.sum())
                    if worth(bound, lo, hi):
                        heapq.heappush(queue, (-bound, lo, hi, slot, gain, a, b, int(self.at[place[each.argmax()]])))

        if len(slot):
            push(0, self.width, slot, gains, self.starts[slot], self.starts[slot + 1])
        while queue:
            bound, lo, hi, slot, gain, a, b, middle = heapq.heappop(queue)
            if not worth(-bound, lo, hi):
                if len(best) == top and -bound < best[0][0]:
                    break
                continue
            if hi - lo <= leaf:
                sizes = b - a
                place = np.repeat(a - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                scores = np.zeros(hi - lo, np.int64)
                np.add.at(scores, self.at[place] - lo, np.repeat(gain, sizes) * self.part[place])
                scored += hi - lo
                for i in np.flatnonzero(scores >= (best[0][0] if len(best) == top else 1)):
                    keep(int(scores[i]), int(self.ids[lo + i]))
                continue
            cut = np.searchsorted(self.keys, slot * self.width + middle)
            cut = np.clip(cut, a, b)
            hit = (cut < b) & (self.at[np.minimum(cut, len(self.at) - 1)] == middle)
            keep(int((gain[hit] * self.part[cut[hit]]).sum()), int(self.ids[middle]))
            scored += 1
            push(lo, middle, slot, gain, a, cut)
            push(middle + 1, hi, slot, gain, cut + hit, b)
        return scored


def _search(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], n_docs: int, total: int, top: int, leaf: int) -> DataFrame:
    """The best documents of every task for every query. A task carries its best ones from block to block, so that later blocks
    are cut off by what earlier ones held, and hands on at most ``top`` rows a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            for block in batch.to_pylist():
                if not block["ids"]:
                    continue
                postings = Postings(block, n_docs, total)
                for (terms, gains), own in zip(queries, best):
                    postings.search(terms, gains, own, top, leaf)
        rows = [(q, score, None if -doc == LAST else -doc) for q, own in enumerate(best) for score, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 3, (pa.int32(), pa.int64(), pa.int64()))], names=["query", "score", "doc_id"])

    return index.drop("docs", "total").mapInArrow(run, schema(_BEST))


def _query_blocks(items: DataFrame, most: int) -> Iterator[list]:
    """Rows (item_id, terms and their repeats) in blocks of about ``most`` bytes of text."""
    held, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        words = terms_of(row["text"])
        size += len(row["text"] or "") + 64
        held.append((row["item_id"], words))
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, leaf: int = LEAF, query_bytes: int = QUERY_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The ``top`` best documents of ``docs (doc_id, text)`` for each row of ``items (item_id, text)``: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, of the whole text. Documents
    without a term (null, empty, only signs) are not counted and never found; items without a term, or whose
    terms no document holds, give no row. Equal scores are ranked by ascending doc_id, a null doc_id last.
    Rows that repeat a doc_id are documents of their own, rows that repeat an item_id items of their own.
    Very long documents end a block early; a document is never split. Empty tables give an empty result. Other
    columns are ignored.

    Items are a stated query set: they go to all tasks in blocks of ``query_bytes`` of text, one pass over the documents
    each. Documents are dealt as they lie; per item and task ``top`` rows are shuffled.
    """
    spark = docs.sparkSession
    answers = None
    for held in _query_blocks(items, query_bytes):
        terms = {t: i for i, t in enumerate(sorted({t for _, words in held for t in words}))}
        if not terms:
            continue
        index = staged(build_index(docs, terms, block_docs), "postings")
        n_docs, total = index.agg(F.sum("docs"), F.sum("total")).first()
        if not n_docs:
            continue
        df = _frequencies(index, len(terms))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        queries = []
        for _, words in held:
            own, repeats = np.unique(np.array([terms[t] for t in words], np.int64), return_counts=True)
            queries.append((own.astype(np.int32), repeats * weights[own]))
        best = staged(_search(index, queries, n_docs, total, top, leaf), "best")
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        ranked = top_per_key(best, ["query"], order, top, rank="rank")
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(held)], "query int, item_id bigint")
        answer = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        answers = answer if answers is None else answers.unionByName(answer)
    return spark.createDataFrame([], schema("item_id bigint, rank int, doc_id bigint, score bigint")) if answers is None else answers


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

#: The same in SQL.
SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
 g AS (SELECT count(*) AS every, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
 q AS (SELECT i, item_id, term, count(*) AS c FROM (SELECT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark)) GROUP BY ALL),
 p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
 f AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * every + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, every),
 s AS (SELECT i, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * every) // total)))) AS BIGINT) AS score
   FROM f JOIN q USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {TOP}"""
