"""Toxicity (operator 6): a weighted finite-state grammar over the words of a clause."""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.llm.common import documents, schema, staged

#: Labelled rows the grammar is fitted on, at most; those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
#: Learned insults: documents of label 1 a term must occur in, log odds it must reach, and terms at most.
TERM_DOCS, TERM_ODDS, TERMS = 5, 4.0, 5_000
#: Lengths of word beginnings that may be terms of their own; a word is what follows none of them.
STEMS = range(3, 8)
HELD_OUT = 5

#: Fixed word lists of the grammar, beside the insults that are learned.
INSULTS = ("idiot", "moron", "scum", "stupid", "worthless", "pathetic", "disgusting", "trash", "loser", "clown")
THREATS = ("kill", "hurt", "destroy", "beat", "burn", "shoot", "stab", "strangle", "murder", "crush")
TARGETS = ("you", "your", "yours", "u", "ur", "he", "him", "she", "her", "they", "them", "their", "du", "dich", "ihr", "euch", "tu", "toi", "vous", "usted", "ustedes", "vosotros")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "nobody", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "jamás")
REPORTS = ("said", "says", "say", "called", "calls", "quoted", "wrote", "writes", "reported", "claimed", "sagte", "schrieb", "dit", "disait", "dijo", "escribió")

#: Clause patterns over word classes, strongest first: i insult, t threat, y target, n negation, r reported
#: speech, and . for any other word. Each is a transducer that turns the stretch it accepts into one
#: event; they are composed left to right, so that what an earlier one took is gone for the later ones.
GRAMMAR = (
    ("reported", re.compile(r"r[^rit]{0,4}[it]")),
    ("negated", re.compile(r"n[^nit]{0,2}[it]")),
    ("threatened", re.compile(r"t[^t]{0,4}y|y[^t]{0,3}t")),
    ("addressed", re.compile(r"y[^i]{0,4}i|i[^i]{0,3}y")),
    ("insulted", re.compile(r"i")),
    ("violent", re.compile(r"t")),
)
_CLAUSE = re.compile(r"[.!?;:\n]+")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
EVENTS = [name for name, _ in GRAMMAR]


class Lexicon(dict):
    """Word as written -> class and weight, worked out once per word and remembered."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems
        self.fixed = {w: c for c, ws in (("t", THREATS), ("y", TARGETS), ("n", NEGATIONS), ("r", REPORTS)) for w in ws}

    def __missing__(self, raw: str) -> tuple[str, float]:
        found = self.classify(_EDGE.sub("", raw))
        if len(self) < 300_000:
            self[raw] = found
        return found

    def classify(self, word: str) -> tuple[str, float]:
        if word in self.fixed:
            return self.fixed[word], 1.0
        if word in self.words:
            return "i", self.words[word]
        for n in STEMS:
            if (weight := self.stems.get(word[:n])) is not None and len(word) >= n:
                return "i", weight
        return ".", 0.0


def measure(text: str, lexicon: Lexicon) -> np.ndarray:
    """Weights of the matched clauses per event, and their number: what the score is made of."""
    out = np.zeros(len(EVENTS) + 1)
    low = text.lower()
    if not any(lexicon[w][0] in "it" for w in set(low.split())):
        return out
    for clause in _CLAUSE.split(low):
        words = [lexicon[w] for w in clause.split()]
        classes = "".join(c for c, _ in words)
        if "i" not in classes and "t" not in classes:
            continue
        for at, (_, pattern) in enumerate(GRAMMAR):
            taken = []
            for m in pattern.finditer(classes):
                weight = max(w for c, w in words[m.start() : m.end()] if c in "it")
                out[at] += weight
                taken.append(m.span())
            for a, b in taken:
                classes = classes[:a] + "." * (b - a) + classes[b:]
                words[a:b] = [(".", 0.0)] * (b - a)
    out[-1] = (out[:-1] > 0).sum()
    return out


def _terms(text: str) -> tuple[set[str], set[str]]:
    words = {_EDGE.sub("", w) for w in set(text.lower().split())}
    words.discard("")
    return words, {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _count(rows: DataFrame, only: frozenset | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0):
                words, stems = _terms(text.as_py() or "")
                both = words | stems
                counts.update(both if only is None else both & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(run, schema("term string, n bigint")).groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Insults from labelled texts ``(text, toxic)``: words and word beginnings that documents of label 1 use
    far more often than others. A beginning stands for words that were never seen whole. At most
    ``TERMS`` terms reach the driver."""
    by = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    yes, no = by.get(1, 0), by.get(0, 0)
    likely = _count(train.filter("toxic = 1")).filter(F.col("n") >= TERM_DOCS).orderBy(F.desc("n"), "term").limit(40 * TERMS)
    positive = {r["term"]: r["n"] for r in likely.collect()}
    negative = {r["term"]: r["n"] for r in _count(train.filter("toxic = 0"), frozenset(positive)).collect()}
    odds = {t: float(np.log((n + 0.5) / (yes + 1)) - np.log((negative.get(t, 0) + 0.5) / (no + 1))) for t, n in positive.items()}
    good = {t: o for t, o in odds.items() if o >= TERM_ODDS and positive[t] >= 10 * negative.get(t, 0)}
    words, stems = {w: 5.0 for w in INSULTS}, {}
    for term in sorted(good, key=lambda t: (len(t), t)):
        stem = term.endswith("*")
        bare = term.rstrip("*")
        if any(bare[:n] in stems for n in STEMS if n <= len(bare)) or len(words) + len(stems) >= TERMS:
            continue
        if stem and bare not in words:
            stems[bare] = good[term]
        elif not stem and bare not in words:
            words[bare] = good[term]
    return Lexicon(words, stems)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton's method."""
    x = np.column_stack([np.log1p(x), np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not 0 < y.sum() < len(y):
        w[:4], w[-1] = (-0.2, -0.2, 3.0, 3.0), -2.0
        w[4] = 2.0
        return w
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(text, toxic)`` of at most ``sample_rows`` labelled documents outside the held-out fifth. Of several
    labels of a document the largest counts."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    mine = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return staged(documents(docs).join(F.broadcast(mine), "doc_id").select("text", "toxic"), "train")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Lexicon, np.ndarray]:
    """The lexicon, and the weights of the grammar's events, from the training rows alone."""
    rows = training_rows(docs, labels, sample_rows)
    lexicon = learn_lexicon(rows)
    names = [*EVENTS, "kinds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measure(t.as_py() or "", lexicon) for t in batch.column(0)]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1)], names=[*names, "toxic"])

    table = rows.mapInArrow(run, schema(", ".join(f"{n} double" for n in names) + ", toxic int")).toArrow()
    x = np.column_stack([table.column(n).to_numpy() for n in names])
    return lexicon, fit(x, table.column("toxic").to_numpy().astype(float))


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray]) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row, from the whole text and nothing else.

    Words are classed by the lexicon, each clause becomes a string of classes, and the composed
    transducers turn it into weighted events; the score is their logistic combination. A null or
    empty text matches nothing. No shuffle; repeated rows score alike; a null doc_id is not held out.
    """
    lexicon, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measure(t.as_py() or "", lexicon) for t in batch.column(1)]).reshape(-1, len(EVENTS) + 1)
            z = np.log1p(x) @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=["doc_id", "score"])

    scored = documents(docs).mapInArrow(run, schema("doc_id bigint, score double"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: tuple[Lexicon, np.ndarray], bar: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``bar`` or more; all columns stay. A map without a shuffle."""
    lexicon, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measure(t.as_py() or "", lexicon) for t in batch.column("text")]).reshape(-1, len(EVENTS) + 1)
            z = np.log1p(x) @ weights[:-1] + weights[-1]
            yield batch.filter(pa.array(z < np.log(bar / (1 - bar))))

    return docs.mapInArrow(run, docs.schema)
