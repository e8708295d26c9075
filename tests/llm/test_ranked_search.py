import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plateflow.llm import ranked_search
from tests.conftest import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, top=10):
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(t or "")]
    bags = [(d, Counter(lower(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            m = 25 + (75 * sum(bag.values()) * n) // length
            score = sum(
                c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t, c in Counter(lower(text)).items() if t in bag
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top])]
    return out


def test_equals_the_plain_version(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    for options in ({}, {"leaf": 1, "block_docs": 16}, {"leaf": 3, "query_bytes": 500}):
        got = ranked_search.rank_documents(docs, items, **options).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_bounds_cut_off_documents():
    """Random postings: nothing better is lost, and where few documents match well, most are never scored."""
    rng = np.random.default_rng(3)
    n = 4000
    rare = [(i, 40 + i % 60) for i in range(0, n, 37)]
    pairs = sorted({*((int(d), int(t)) for d, t in rng.integers(0, [n, 40], (20000, 2))), *rare}, key=lambda p: (p[1], p[0]))
    terms, starts = np.unique([t for _, t in pairs], return_index=True)
    block = {
        "ids": rng.permutation(n).astype(np.int64).tobytes(), "lengths": rng.integers(5, 50, n).astype(np.int64).tobytes(), "terms": terms.astype(np.int32).tobytes(),
        "starts": np.append(starts, len(pairs)).astype(np.int32).tobytes(), "at": np.array([d for d, _ in pairs], np.int32).tobytes(), "tf": rng.integers(1, 9, len(pairs)).astype(np.int64).tobytes(),
    }
    postings = ranked_search.Postings(block, n, 30 * n)
    for _ in range(30):
        query = np.unique(rng.integers(0, 110, 5)).astype(np.int32)
        gains = rng.integers(1, 5000, len(query))
        scores = np.zeros(n, np.int64)
        for t, g in zip(query, gains):
            if t in terms:
                k = int(np.searchsorted(terms, t))
                a, b = postings.starts[k], postings.starts[k + 1]
                scores[postings.at[a:b]] += g * postings.part[a:b]
        want = sorted((-int(s), int(d)) for s, d in zip(scores, postings.ids) if s > 0)[:10]
        best: list = []
        scored = postings.search(query, gains, best, 10, 4)
        assert sorted((-s, -d) for s, d in best) == want
    best = []
    assert postings.search(np.array([41], np.int32), np.array([7]), best, 10, 4) < n / 4


def test_ties_odd_texts_and_clashing_names(spark, odd):
    items = spark.createDataFrame([(1, "WORD word", 5), (1, "a b", 5), (None, "naïve ß", 5), (3, None, 5), (4, "...", 5), (5, "nowhere", 5)], "item_id bigint, text string, rank int")
    renamed = odd.withColumnsRenamed({"score": "rank", "n_words": "query"})
    want = plain(odd.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    got = ranked_search.rank_documents(renamed, items).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_copies_are_ranked_by_id(spark):
    """Five thousand copies of one text tie; the ten smallest ids win, a null id last."""
    docs = spark.range(5000).select(F.when(F.col("id") == 0, None).otherwise(5000 - F.col("id")).alias("doc_id"), F.lit("one Two three").alias("text"))
    more = docs.unionByName(spark.range(10_000, 30_000).select(F.col("id").alias("doc_id"), F.lit("other words").alias("text")))
    got = ranked_search.rank_documents(more, spark.createDataFrame([(1, "two")], "item_id bigint, text string"), block_docs=300).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(i, i) for i in range(1, 11)] and len({r["score"] for r in got}) == 1


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for docs, asked in ((empty, items), (items.withColumnRenamed("item_id", "doc_id"), items.limit(0)), (empty, items.limit(0))):
        out = ranked_search.rank_documents(docs, asked)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
