"""Line dedup, WARC, embeddings, packing and quality rules."""

import gzip
import hashlib
import base64
import io

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plateflow.llm import embedding_dedup, line_dedup, packing, queries, quality, warc
from tests.conftest import SF
from tests.llm import brute
from tests.llm.conftest import ODD

TOKENIZER, MERGES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_line_dedup_matches_sql(spark, duck):
    got = {r["doc_id"]: tuple(r) for r in queries.queries()["op3_line_dedup"](spark, SF).collect()}
    want = {r[0]: r for r in duck.execute(queries.oracle_sql()["op3_line_dedup"]).fetchall()}
    assert got == want and any(r[3] for r in want.values())


def test_line_dedup_small(rows, odd, empty):
    docs = rows("doc_id bigint, text string", [
        (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "b\nc"), (4, "q\nq\nq\nq\nq\nq"), (5, "q\nq\nq\nz"), (6, "\n\n\n"), (7, "\n\n\n"), (8, "a\nb\nc\nd"), (9, None),
    ])
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {
        1: ("a\nb\nc\nd", 0), 2: ("x\ny", 4), 3: ("b\nc", 0), 4: ("q\nq\nq", 3), 5: ("z", 3), 6: ("\n\n\n", 0), 7: ("\n\n\n", 0), 8: ("", 4), 9: (None, 0),
    }
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(empty).count() == 0


def test_warc_round_trip(spark, rows, tmp_path):
    html = ["<p>one</p>", "two", "<p>one</p>", None, "", "é\r\n\r\nContent-Length: 3", "x" * 200_000, "<p>one</p>"]
    pages = rows("page_id bigint, url string, html string, digest string", [(i, None if i == 3 else f"u{i}\nv", h, "d") for i, h in enumerate(html)] + [(None, "n", "none", "d")])
    index = warc.write_archives(pages, str(tmp_path / "out"))
    got = {r["page_id"]: r for r in warc.read_archives(index).collect()}
    last = {h or "": i for i, h in enumerate(html)} | {"none": None}
    for page_id, text in [*enumerate(html), (None, "none")]:
        data, r = (text or "").encode(), got[page_id]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[text or ""] == page_id else ("revisit", last[text or ""]))
        assert (bytes(r["payload"]) if r["payload"] is not None else None) == (data if r["record_type"] == "response" else None)
    assert got[0]["url"] == "u0\nv"
    twice = warc.write_archives(rows("page_id bigint, url string, html string", [(1, "a", "x"), (1, "a", "y"), (2, "a", "x"), (2, "a", "x")]), str(tmp_path / "twice"))
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(twice).collect()), key=str) == [
        (1, "response", None), (1, "revisit", 2), (2, "response", None), (2, "response", None),
    ]
    files = sorted((tmp_path / "out").iterdir())
    assert {f.name.split(".", 1)[1] for f in files} == {"warc.gz", "warc.gz.idx"}
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files if f.name.endswith("gz")) == 9
    assert warc.read_archives(warc.write_archives(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_normalise_any_shape(tmp_path):
    records = [warc.record_bytes(i, "u", b"z" * (i * 700_000), "response", None) for i in range(4)]
    whole = gzip.compress(records[0] + records[1]) + gzip.compress(records[2] + records[3])
    (tmp_path / "in.gz").write_bytes(whole)
    rows = warc.normalise(str(tmp_path / "in.gz"), str(tmp_path / "out.gz"))
    data = (tmp_path / "out.gz").read_bytes()
    assert [gzip.GzipFile(fileobj=io.BytesIO(data[o : o + n])).read() for _, o, n, _ in rows] == records
    with pytest.raises(ValueError):
        (tmp_path / "cut.gz").write_bytes(gzip.compress(records[1][:-3]))
        warc.normalise(str(tmp_path / "cut.gz"), str(tmp_path / "no.gz"))


def test_embeddings_match_brute_force(spark, rows):
    rng = np.random.default_rng(1)
    made = []
    for label in (0, 1):
        for centre in rng.standard_normal((6, 16)):
            made += [(centre + rng.standard_normal(16) * s, label) for s in (0, 0, 0.1, 0.2, 0.3, 0.3, 0.4)]
    data = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(made)]
    n = len(data)
    data += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0, None] * 8, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, data[0][1], None), (n + 5, [], 1), (n + 6, [1e30] * 16, 1), (n + 7, [1e30] * 16, 1), (n + 8, data[0][1] + [0.0], 0)]
    got = embedding_dedup.link_embeddings(rows("vec_id bigint, embedding array<float>, label int", data), block=8)
    want = brute.embeddings(data)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())
    real = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute.embeddings([(r["vec_id"], r["embedding"], r["label"]) for r in real.collect()])
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.queries()["op5_embedding_dedup"](spark, SF).collect()} == want
    assert embedding_dedup.link_embeddings(real.limit(0)).count() == 0


def check_packing(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for source in (docs, odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")):
        got = packing.pack(packing.token_pieces(source, TOKENIZER, MERGES)).collect()
        want = {
            (r["doc_id"], *p) for r in source.collect()
            for p in brute.pieces(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2048)
        }
        assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
        n = check_packing(got, 2048)
        assert n <= 1.02 * -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(packing.token_pieces(odd, TOKENIZER)).count() >= odd.count()
    assert packing.pack(packing.token_pieces(empty, TOKENIZER)).count() == 0


def test_packing_neither_sorts_nor_shuffles_pieces(spark):
    """One common length in many tasks: ranks come from counts per task, not from windows over all pieces."""
    rows = [(i, 0, 0, 700 if i % 3 else i % 2048 + 1, i) for i in range(5000)]
    pieces = spark.createDataFrame(rows, packing.PIECES).repartition(37)
    packed = packing.pack(pieces)
    plan = packed._jdf.queryExecution().toString()
    assert not any(step in plan for step in ("Exchange", "Window", "Sort", "Join"))
    got = packed.collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
    check_packing(got, 2048)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    histogram = {int(k): int(v) for k, v in zip(rng.integers(1, capacity + 1, 40), rng.integers(1, 500, 40))}
    plan = sorted(packing.plan_packing(histogram, capacity))
    got = []
    for i, (length, rank, first, offset) in enumerate(plan):
        end = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == length else histogram[length]
        got += [{"sequence_id": first + k, "offset": offset, "length": length} for k in range(end - rank)]
    assert len(got) == sum(histogram.values())
    used = check_packing(got, capacity)
    plain = packing._Plan(dict(histogram), capacity)
    for length in sorted(histogram, reverse=True):
        plain.fit(length)
    assert used <= 1.01 * plain.next + 1


def test_quality(spark, docs, odd, empty):
    for source in (docs, odd):
        got = quality.measure_quality(source).collect()
        want = sorted(((r["doc_id"] is None, r["doc_id"] or 0), *brute.quality(r["text"])) for r in source.collect())
        assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), *tuple(r)[1:7]) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.measure_quality(empty).count() == 0


def test_suffix_array_repeats(docs):
    texts = [r["text"] for r in docs.filter("n_chars < 1200").limit(40).collect()] + [t for t in ODD if not t or len(t) < 300]
    texts += ["a b c d e f g h " * 3, "z " * 40, "q a b c d e f x a b c d e f y"]
    got = quality.repetition([brute.WORD.findall(t or "") for t in texts], 5)
    assert [x[1:] for x in got] == [brute.passages(t, 5) for t in texts]
