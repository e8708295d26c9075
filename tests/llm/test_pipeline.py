"""Each stage of the pipeline on its own input, against plain versions."""

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plateflow.llm import line_dedup, mixing, toxicity
from plateflow.llm.common import staged
from tests.conftest import SF
from tests.llm import brute
from tests.llm.test_first import check_packing


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns, after the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), "stage"))
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_columns(kept):
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "best-fit packing"]
    assert all(f.dtypes == kept[0].dtypes for f in kept[:5])


def test_toxic_documents_go(spark, kept):
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(kept[0], toxicity.train(kept[0], spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert set(texts(kept[1])) == {d for d, bad in scores.items() if not bad}


def test_repeated_lines_go(kept):
    con = duckdb.connect()
    con.register("documents", kept[1].toArrow())
    want = {r[0]: r[1] for r in con.execute(line_dedup.SQL).fetchall() if r[3] == 0 or r[3] < r[2]}
    assert texts(kept[2]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2].collect())


def test_one_of_each_group(kept):
    want = {d for d, (_, c) in brute.near(list(texts(kept[2]).items())).items() if d == c}
    assert set(texts(kept[3])) == want and kept[3].count() == len(want)


def test_mixing_keeps_every_document(spark, kept):
    before, after = texts(kept[3]), texts(kept[4])
    assert before == after and kept[4].count() >= len(before)
    rates = mixing.mix(kept[3], spark.read.parquet(f"{SF}/labels.parquet"), F.col("quality"), corpus_pipeline.TARGETS, None)
    rate = {r["doc_id"]: max(1.0, r["rate"]) for r in rates.collect()}
    for r in kept[4].groupBy("doc_id").count().collect():
        assert int(rate[r["doc_id"]]) <= r["count"] <= int(rate[r["doc_id"]]) + 1


def test_mixing_meets_targets_with_every_document(spark, kept):
    """Tokens per domain of what the stage returns; memberships are those of its own fit."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rates = {r["doc_id"]: r for r in mixing.mix(kept[3], labels, F.col("quality"), corpus_pipeline.TARGETS, None).collect()}
    want = [corpus_pipeline.TARGETS[d] for d in sorted(corpus_pipeline.TARGETS)]
    assert min(r["rate"] for r in rates.values()) >= 1
    for times, off in (({d: r["rate"] for d, r in rates.items()}, 1e-4), ({r["doc_id"]: r["count"] for r in kept[4].groupBy("doc_id").count().collect()}, 0.02)):
        got = [sum(n * rates[d]["n_tokens"] * rates[d]["p"][k] for d, n in times.items()) for k in range(2)]
        assert abs(got[0] / sum(got) - want[0]) < off


def test_everything_is_packed(kept):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = kept[5].collect()
    want = sorted(
        (r["doc_id"], *p) for r in kept[4].collect() for p in brute.pieces(tokenizer.encode(r["text"], add_special_tokens=False).ids, 2048)
    )
    assert sorted(tuple(r)[:5] for r in got) == want
    check_packing(got, 2048)


def test_odd_documents(spark, odd, tmp_path):
    folder = str(tmp_path)
    odd.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint")}).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id"} <= set(got.columns) and got.count() >= 8
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{folder}/none/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{folder}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
