import hashlib
import itertools
import tracemalloc

import numpy as np
import pytest
import zstandard

from plateflow.llm import suffix_dedup
from tests.conftest import SF


def plain(rows, length=100):
    """The contract by a dictionary of first places; sorted result rows."""
    texts = [(d, (t or "").encode()) for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    seen, out = set(), []
    for doc, body in texts:
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - length + 1):
            part = body[i : i + length]
            if part in seen:
                gone[i : i + length] = True
            seen.add(part)
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(1 for g, _ in itertools.groupby(gone) if g)
        out.append((doc, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_covers_hold_every_distance_once():
    for period, cover in suffix_dedup.COVERS.items():
        gaps = sorted((a - b) % period for a in cover for b in cover if a != b)
        assert gaps == list(range(1, period))


def test_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = suffix_dedup.remove_repeats(docs, chunk=50_000).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert sum(r["n_removed"] for r in got) > 0


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats(spark, seed):
    """Passages of all lengths around the limit, at all distances of the cover, inside and across documents and chunks."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdé"))
    say = lambda n: "".join(rng.choice(letters, n))
    passages = [say(int(n)) for n in rng.integers(10, 60, 12)]
    rows = []
    for d in range(60):
        pieces = [passages[rng.integers(12)] if rng.random() < 0.5 else say(int(rng.integers(0, 30))) for _ in range(int(rng.integers(0, 8)))]
        rows.append((int(rng.permutation(1000)[0]) * 100 + d, "".join(pieces)))
    rows += [(100_000, "ab" * 150), (100_001, rows[3][1]), (-5, rows[7][1])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for length, period in ((20, 7), (40, 31), (65, 57)):
        got = suffix_dedup.remove_repeats(frame, length, period, chunk=400).collect()
        assert sorted(map(tuple, got), key=str) == plain(rows, length), (length, period)


def test_odd_rows_and_clashing_names(spark, odd, empty):
    renamed = odd.withColumnsRenamed({"score": "chunk", "n_words": "n_bytes", "component_id": "a"})
    got = suffix_dedup.remove_repeats(renamed).collect()
    assert sorted(map(tuple, got), key=str) == plain([(r["doc_id"], r["text"]) for r in odd.collect()])
    out = suffix_dedup.remove_repeats(empty)
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_repeated_rows_keep_one(spark):
    text = "".join(chr(97 + i % 26) * (1 + i % 7) for i in range(80))
    frame = spark.createDataFrame([(1, text)] * 4 + [(None, text)], "doc_id bigint, text string").repartition(3)
    got = suffix_dedup.remove_repeats(frame).collect()
    assert sorted(r["n_removed"] for r in got) == [0] + [len(text)] * 4
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [len(text)]


def test_a_chunk_of_repeats_takes_little_memory():
    """Windows stay open when no context decides them; the arrays take below 20 bytes a byte of text."""
    rng = np.random.default_rng(0)
    base = rng.integers(97, 123, 2_000, dtype=np.uint8)
    bodies = []
    for _ in range(1_500):
        at = int(rng.integers(0, 1_000))
        bodies.append(base[at : at + 1_000].tobytes() + rng.integers(97, 123, 20, dtype=np.uint8).tobytes())
    sizes = np.array([len(b) for b in bodies], np.int64)
    row = {"chunk": 1, "ids": np.arange(len(bodies)).tobytes(), "sizes": sizes.tobytes(), "body": zstandard.compress(b"".join(bodies))}

    def told(found, width, bit):
        rows = [r for b in found.blobs(1, None) for r in b.to_pylist()]
        return [{"bucket": r["bucket"], "bits": np.packbits(np.full(len(r["names"]) // width, bit)).tobytes()} for r in rows]

    def chain():
        return suffix_dedup.Chain(suffix_dedup.Chunk(row, 100, 57), 8)

    a = told(chain().samples(), 4, True)
    b = told(chain().contexts(a), 8, False)
    c = told(chain().windows(a, b), 8, False)
    tracemalloc.start()
    chain().removed(a, b, c)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * sizes.sum()
