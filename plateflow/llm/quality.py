"""Quality rules (operator 9): repetition measured with a suffix array over words."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plateflow.llm.common import documents, schema, words_of

#: Fixed values of the base rules.
LEAST_WORDS, WINDOW, MOST_REPEATED = 50, 3, 50
SYMBOLS = "#*$%&|<>"
#: A repeated passage counts from so many words on.
REPEAT_WORDS = 12
#: A document fails if repeated passages cover more than this share of its words.
MOST_COVERED = 0.4
#: A document fails if its longest repeated passage has more words than this and than this share of the document.
LONGEST_WORDS, LONGEST_SHARE = 100, 0.2
#: Words of a batch that are sorted together.
SORTED_WORDS = 400_000

COLUMNS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, covered_words bigint, longest_repeat bigint"


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``ids`` in order, and the length of the prefix each shares with the one before.

    Prefix doubling; positions that are already alone are left out of later rounds. The ranks of each
    round are kept, and the common prefixes of all neighbours are put together from them. A value that
    occurs once, such as a separator, ends every common prefix, so one call sorts many documents.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    head = np.concatenate([[True], ids[order[1:]] != ids[order[:-1]]])
    place = np.empty(n, np.int64)
    place[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    levels, width = [], 1
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        levels.append(place.copy())
        who = order[at]
        ahead = who + width
        follow = np.where(ahead < n, place[np.minimum(ahead, n - 1)], -1)
        group = place[who]
        sort = np.lexsort((follow, group))
        who, follow, group = who[sort], follow[sort], group[sort]
        order[at] = who
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        head[at] = fresh
        place[who] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        width *= 2
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        inside[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        shared[1:][inside] += 1 << k
        a[inside] += 1 << k
        b[inside] += 1 << k
    return order, shared


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def repetition(docs: list[list[bytes]], least: int = REPEAT_WORDS) -> list[tuple[int, int, int]]:
    """Per document: words in repeated windows of three, words that repeated passages of ``least`` words
    or more cover (the union of the maximal ones), and words of the longest repeat.

    Words of different documents are different values, so one suffix array serves all of them.
    """
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    ids = np.empty(int(sizes.sum()) + len(docs), np.int64)
    number, at = 0, 0
    ends = []
    for words in docs:
        known: dict[bytes, int] = {}
        ids[at : at + len(words)] = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        ids[at : at + len(words)] += number
        number += len(known)
        at += len(words)
        ids[at] = number
        number, at = number + 1, at + 1
        ends.append(at)
    order, shared = suffix_array(ids)
    longest = np.zeros(len(ids), np.int64)
    longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    starts = np.array([0, *ends[:-1]], dtype=np.int64)

    def per_document(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), starts)

    three = np.flatnonzero(longest >= WINDOW)
    windows = per_document(_covered(three, np.full(len(three), WINDOW), len(ids)))
    long = np.flatnonzero(longest >= least)
    passages = per_document(_covered(long, longest[long], len(ids)))
    return list(zip(windows.tolist(), passages.tolist(), np.maximum.reduceat(longest, starts).tolist()))


def measure_quality(
    docs: DataFrame, repeat_words: int = REPEAT_WORDS, most_covered: float = MOST_COVERED,
    longest_words: int = LONGEST_WORDS, longest_share: float = LONGEST_SHARE,
) -> DataFrame:
    """One row per row of ``docs``: the base counts, ``base_failed``, ``covered_words``, ``longest_repeat`` and ``kept``.

    A document that passes the base rules is kept unless passages of at least ``repeat_words`` words
    that occur twice or more cover over ``most_covered`` of its words, or its longest repeat has over
    ``longest_words`` words and over ``longest_share`` of the document. A null text counts as one without words, as
    does an empty one; both fail. No shuffle: every document is measured where it is read.
    """

    def measure(ids: list, texts: list[str], words: list[list[bytes]]) -> pa.RecordBatch:
        rows = []
        for doc_id, text, found, (repeat, covered, longest) in zip(ids, texts, words, repetition(words, repeat_words)):
            n = len(found)
            lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            failed = n < LEAST_WORDS or 100 * repeat > MOST_REPEATED * n
            bad = covered > most_covered * n or (longest > longest_words and longest > longest_share * n)
            rows.append((
                doc_id, n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)),
                len(lines) - len(set(lines)), repeat, failed, not (failed or bad), covered, longest,
            ))
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in COLUMNS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, words, size = [], [], [], 0
            for doc_id, text in zip(*batch.columns):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                words.append(words_of(texts[-1]))
                size += len(words[-1])
                if size >= SORTED_WORDS:
                    yield measure(ids, texts, words)
                    ids, texts, words, size = [], [], [], 0
            if ids:
                yield measure(ids, texts, words)

    return documents(docs).mapInArrow(run, schema(COLUMNS))
