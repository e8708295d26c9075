"""PII (operator 7): personal data by pattern, and the terms that give it away by co-occurrence."""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.llm.common import documents, schema, staged

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: terms to generalise and terms to remove.
ADDED = ("generalise", "remove")
#: Words on either side of a value that may disclose it, and how far away, in characters, they may be.
CONTEXT_WORDS, CONTEXT_CHARS = 8, 200
#: Distinct contexts of one value a term must appear in.
LEAST_CONTEXTS = 3
#: Normalised pointwise information, 1 when a term determines a value: from GENERALISE on a term is replaced
#: by its shape, from REMOVE on it is removed.
GENERALISE, REMOVE = 0.90, 0.97
#: Bits of the filter for candidate terms.
FILTER_BITS = 23

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
FOUND = (
    "doc_id bigint, key bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string,"
    " at array<bigint>, contexts array<struct<value: bigint, context: bigint, term: string>>"
)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @ so that a long run of other characters is read once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        start, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((start, end))
            start = end + 1
    return out


def _luhn(digits: str) -> bool:
    twice = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {"email": emails(text), "ip": ips(text), "card": cards(text), "phone": phones(text)}


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))).astype(np.int64))


def _contexts(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The words around each value. Equal surroundings are one context, however many copies hold them."""
    out = []
    for kind, a, b in spans:
        left = text[max(0, a - CONTEXT_CHARS) : a].lower()
        right = text[b : b + CONTEXT_CHARS].lower()
        before, after = list(_WORD.finditer(left)), list(_WORD.finditer(right))
        if before and before[0].start() == 0 and a > CONTEXT_CHARS:
            before = before[1:]
        if after and after[-1].end() == len(right) and b + CONTEXT_CHARS < len(text):
            after = after[:-1]
        words = [m[0] for m in before[-CONTEXT_WORDS:]] + [m[0] for m in after[:CONTEXT_WORDS]]
        value = re.sub("[^0-9]", "", text[a:b]) if kind in ("card", "phone") else text[a:b].lower()
        context = _hash("\n".join(words))
        out += [{"value": _hash(f"{kind} {value}"), "context": context, "term": w} for w in sorted(set(words))]
    return out


def find_base(docs: DataFrame) -> DataFrame:
    """Base spans of every row, their digest, and the words around them."""
    kinds = pa.list_(pa.struct([("value", pa.int64()), ("context", pa.int64()), ("term", pa.string())]))
    names = [f.split()[0] for f in FOUND.split(", ")[:8]] + ["at", "contexts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for value in batch.column(1):
                text = value.as_py() or ""
                found = base_spans(text)
                spans = [(k, a, b) for k in KINDS for a, b in found[k]]
                base = joined(spans)
                row = (
                    _hash(text), *(len(found[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base,
                    [x for _, a, b in spans for x in (a, b)], _contexts(text, spans),
                )
                for column, x in zip(columns, row):
                    column.append(x)
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.int64()), kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return documents(docs).mapInArrow(run, schema(FOUND))


def candidate_terms(found: DataFrame, least: int = LEAST_CONTEXTS) -> DataFrame:
    """``(term, value, n, n_value)``: distinct contexts of a value that hold the term, and contexts of the value."""
    seen = found.select(F.explode("contexts").alias("c")).select("c.*").distinct()
    of_value = seen.select("value", "context").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_value")).filter(F.col("n_value") >= least)
    of_term = seen.groupBy("term", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return of_term.join(of_value, "value").select("term", "value", "n", "n_value")


def _occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc_id, key, term, start, end)`` of the candidate terms in all texts, through a bitmap of fixed size."""

    def place(term: str) -> int:
        return xxhash.xxh3_64_intdigest(term.encode("utf-8", "replace")) >> (64 - FILTER_BITS)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bitmap[[place(t) for t in batch.column(0).to_pylist()]] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bitmap).tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in terms.select("term").distinct().coalesce(4).mapInArrow(marks, schema("bits binary")).toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = np.unpackbits(shared.value).astype(bool), {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                key = None
                for m in _WORD.finditer(text):
                    word = m[0]
                    hit = known.get(word)
                    if hit is None:
                        low = word.lower()
                        hit = low if wanted[place(low)] else ""
                        if len(known) < 1_000_000:
                            known[word] = hit
                    if hit:
                        key = _hash(text) if key is None else key
                        rows.append((doc_id, key, hit, m.start(), m.end()))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "key", "term", "start", "end"])

    hits = documents(docs).mapInArrow(run, schema("doc_id bigint, key bigint, term string, start bigint, end bigint"))
    return hits.join(terms.select("term").distinct(), "term", "left_semi")


def disclosing_terms(terms: DataFrame, occurrences: DataFrame, n_docs: int) -> DataFrame:
    """``(term, kind)`` of the terms whose information about a value exceeds a threshold.

    The chance of a value given a term is its contexts among the documents with the term; the
    information that adds to the chance of the value is divided by all there is to learn about it.
    """
    holding = occurrences.select("term", "key").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    given = F.col("n") / F.greatest("df", "n")
    chance = F.least(F.col("n_value") / F.lit(float(max(n_docs, 1))), F.lit(0.999))
    share = F.log2(given / chance) / F.log2(1 / chance)
    rated = terms.join(holding, "term").groupBy("term").agg(F.max(share).alias("share")).filter(F.col("share") >= GENERALISE)
    return rated.select("term", F.when(F.col("share") >= REMOVE, ADDED[1]).otherwise(ADDED[0]).alias("kind"))


def find_personal(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    1. A map finds the base matches of every whole text and the words around them.
    2. Over all texts, distinct contexts are counted per term and value; a candidate term appears in several
       contexts of one value, so words beside a value that was merely copied are none.
    3. Another pass counts the texts that hold each candidate; terms above a threshold are disclosing
       wherever they occur and become ``generalise`` or ``remove`` spans behind the base spans, except inside those.

    A null or empty text has no spans and the digest of the empty string. Repeated rows get equal
    answers, null ids are kept, other columns are ignored. Spans are in code points, their ends exclusive.
    """
    found = staged(find_base(docs), "base")
    terms = staged(candidate_terms(found), "terms")
    base = found.select("doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.col("base").alias("spans"), "at")
    if terms.isEmpty():
        return base.drop("key", "at")
    occurrences = staged(_occurrences(docs, terms), "occurrences")
    kinds = staged(disclosing_terms(terms, occurrences, found.count()), "disclosing")
    spans = occurrences.join(kinds, "term").groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    inside = F.filter(
        "more",
        lambda s: ~F.exists(
            F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda i: (F.get("at", i) < s["end"]) & (s["start"] < F.get("at", i + 1))
        ) | (F.size("at") == 0),
    )
    text = F.array_join(F.transform(F.array_sort(inside), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    added = base.join(staged(spans, "added"), "key", "left").withColumn("_more", F.coalesce(F.when(F.size("at") > 0, text).otherwise(
        F.array_join(F.transform(F.array_sort("more"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")), F.lit("")))
    both = F.concat_ws(",", F.nullif("spans", F.lit("")), F.nullif("_more", F.lit("")))
    return added.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", both.alias("spans"))


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the spans of :func:`find_personal` taken out: values become the name of their
    kind, generalised terms their shape, removed terms nothing. Joined by doc_id, which must be unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [clean(text.as_py(), spans.as_py() or "") for text, spans in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return documents(docs).join(found.select("doc_id", "spans"), "doc_id", "left").mapInArrow(run, schema("doc_id bigint, text string"))


def clean(text: str | None, spans: str) -> str | None:
    if not text or not spans:
        return text
    parts, end = [], 0
    for kind, a, b in sorted((x.split(":") for x in spans.split(",")), key=lambda s: (int(s[1]), -int(s[2]))):
        a, b = int(a), int(b)
        if a < end:
            continue
        put = {"generalise": re.sub(r"[^\W\d_]", "x", text[a:b]), "remove": ""}.get(kind, f"[{kind.upper()}]")
        parts += [text[end:a], put]
        end = b
    return "".join([*parts, text[end:]])
