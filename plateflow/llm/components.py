"""Connected components of an edge table that may not fit one machine."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.llm.common import staged

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star operation over edges (a, b) with a > b.

    Large star: every neighbour above a node is hung on the smallest neighbour. Small star: the node
    and its smaller neighbours are hung on the smallest one.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    lowest = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star", 2 * rows)
    joined = both.join(lowest, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select("a", F.col("m").alias("b"))
        )
    return out.filter(F.col("a") > F.col("b")).distinct()


def _mark(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``; the component is its smallest node.

    Alternates large-star and small-star operations until nothing changes, which takes a number of
    rounds that grows with the logarithm of the graph. A node with very many neighbours is only ever
    aggregated by minimum or met in a join whose large partitions are split at run time. Edges with a
    null end and loops are ignored.
    """
    edges = staged(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        large = staged(_star(edges, True, mark[0]), "large", 2 * mark[0])
        edges = staged(_star(large, False, 2 * mark[0]), "small", 2 * mark[0])
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
