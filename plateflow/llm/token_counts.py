"""Token counts (operator 1): a Viterbi over a unigram vocabulary that carries counts only."""

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from plateflow.llm.common import documents, schema

#: The mark that stands for a blank in pieces.
BLANK = "▁"
#: What an unknown character costs below the lowest score of the vocabulary. A fixed value of the tokenizers.
UNKNOWN_PENALTY = 10.0
#: Segments a worker remembers, and how long they may be.
CACHE, CACHE_CHARS = 300_000, 40
_CUT = re.compile(f"(?<=[^{BLANK}])(?={BLANK})")


class Counter(dict):
    """Segment of a text -> number of pieces and their score, by the vocabulary alone.

    An Aho-Corasick automaton lists all pieces that end at a character, longest first. The best path to
    a character is the first of the best candidates in the order of their starts, which is the order in which the
    tokenizers relax edges with a strict comparison; an unknown character is an edge of its own where
    no piece of one character begins. Only score, count and whether the path ends unknown are kept.
    """

    def __init__(self, pieces: dict[str, float], byte_fallback: bool):
        super().__init__()
        self.byte_fallback = byte_fallback
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        #: Where no piece holds a blank mark behind another character, no piece crosses such a place.
        self.cuts = not any(_CUT.search(p) for p in pieces)

    def __missing__(self, segment: str) -> tuple[int, float]:
        found = self.viterbi(segment)
        if len(segment) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[segment] = found
        return found

    def viterbi(self, text: str) -> tuple[int, float]:
        n = len(text)
        score, count, open_ = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        ends = 0
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        at, item = next(matches, (n, None))
        while ends < n:
            best, where = None, -1
            while at == ends:
                size, value = item
                start = at + 1 - size
                value += score[start]
                if best is None or value > best:
                    best, where = value, start
                at, item = next(matches, (n, None))
            ends += 1
            if text[ends - 1] not in self.single:
                value = score[ends - 1] + self.unknown
                if best is None or value > best:
                    score[ends], open_[ends] = value, True
                    if self.byte_fallback:
                        count[ends] = count[ends - 1] + len(text[ends - 1].encode("utf-8", "replace"))
                    else:
                        count[ends] = count[ends - 1] + (not open_[ends - 1])
                    continue
            score[ends], count[ends] = best, count[where] + 1
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of a whole text: blanks become marks, with one in front."""
        if not text:
            return 0, 0.0
        marked = BLANK + text.replace(" ", BLANK)
        if not self.cuts:
            return self.viterbi(marked)
        total, score = 0, 0.0
        for segment in _CUT.split(marked):
            n, s = self[segment]
            total, score = total + n, score + s
        return total, score


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    """The pieces of a sentencepiece model file with their scores; bytes and control pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Counter({model.id_to_piece(i): model.get_score(i) for i in plain}, any(model.is_byte(i) for i in range(model.get_piece_size())))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, score)`` per row of ``docs``: pieces of the best segmentation of the whole text and
    the sum of their scores. Null and empty texts have none. No shuffle: a map over the documents, with
    the vocabulary read once per worker; repeated rows count alike, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary)
        for batch in batches:
            found = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"]
            )

    return documents(docs).mapInArrow(run, schema("doc_id bigint, n_tokens bigint, score double"))
