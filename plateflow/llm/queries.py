"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm import (
    centroids, embedding_dedup, jaccard_join, line_dedup, mixing, packing, pii, quality, ranked_search, suffix_dedup,
    token_counts, toxicity, warc,
)
from plateflow.llm.common import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(run):
        _QUERIES[run.__name__] = run
        if sql:
            _SQL[run.__name__] = sql
        return run

    return keep


@query()
def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: Weights of the domains that the labels name: documents of good and of poor quality.
TARGETS = {"0": 0.1, "1": 0.9}


@query()
def op2_mixing(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return mixing.mix(table(spark, sf_dir, "documents"), labels, F.col("quality"), TARGETS)


@query(line_dedup.SQL)
def op3_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query()
def op4_warc(spark, sf_dir):
    index = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op5_embedding_dedup(spark, sf_dir):
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))


@query()
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query()
def op7_pii(spark, sf_dir):
    return pii.find_personal(table(spark, sf_dir, "documents"))


@query()
def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(
        packing.token_pieces(
            table(spark, sf_dir, "documents"),
            public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        )
    )


@query()
def op9_quality_rules(spark, sf_dir):
    return quality.measure_quality(table(spark, sf_dir, "documents"))


@query()
def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.join_near(table(spark, sf_dir, "documents"))


@query(suffix_dedup.SQL)
def op11_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query(centroids.SQL)
def op12_centroid_clustering(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query(ranked_search.SQL)
def op13_ranked_search(spark, sf_dir):
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
