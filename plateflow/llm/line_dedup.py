"""Line dedup (operator 3): overlapping windows of three lines, later occurrences removed.

DataFrame functions only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.llm.common import documents, staged

#: Lines in a window. The expressions below are written for three.
WINDOW = 3
BLANKS = " \t\n\x0b\f\r"


def _windows(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, h1, h2)``: place and two 64-bit hashes of every window with a non-blank line."""
    lines = F.split("text", "\n")
    shifted = F.arrays_zip(lines.alias("a"), F.slice(lines, 2, 1 << 30).alias("b"), F.slice(lines, 3, 1 << 30).alias("c"))
    every = docs.select("doc_id", F.posexplode(shifted).alias("pos", "w")).select("doc_id", "pos", "w.*").filter("c IS NOT NULL")
    told = [F.ltrim(c, F.lit(BLANKS)) != "" for c in ("a", "b", "c")]
    return every.filter(told[0] | told[1] | told[2]).select(
        "doc_id", "pos", F.xxhash64("a", "b", "c").alias("h1"), F.xxhash64(F.lit(WINDOW), "a", "b", "c").alias("h2")
    )


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos)`` of every occurrence of a window that is not its first.

    The first occurrence is the one with the smallest (doc_id, pos) in the whole table. An occurrence
    in the same document that overlaps the first one is left alone, so the first stays whole. Only
    hashes are shuffled. A window that a third of all documents hold is counted by partial
    aggregation, and met in a join whose large partitions are split at run time.
    """
    at = staged(_windows(documents(docs).filter("doc_id IS NOT NULL")), "windows")
    first = staged(
        at.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")),
        "repeated",
    )
    later = (F.col("doc_id") != F.col("first_doc")) | (F.col("pos") >= F.col("first_pos") + WINDOW)
    return at.join(first, ["h1", "h2"]).filter(later).select("doc_id", "pos")


def _cleaned(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _rest, n_lines, n_removed``: the cleaned texts, with all other columns in ``_rest``."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None)).alias("_rest"))
    starts = repeated_windows(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("_starts"))
    # Kept are the stretches between the windows: from the end of one to the start of the next. Slices of the split
    # text are put together, so the work follows the number of lines.
    joined = packed.join(starts, "doc_id", "left").withColumn("_lines", F.split("text", "\n")).withColumn("_n", F.size("_lines"))
    begin = F.concat(F.array(F.lit(0)), F.transform("_starts", lambda pos: pos + WINDOW))
    end = F.concat("_starts", F.array("_n"))
    none = F.array().cast("array<string>")
    stretches = F.zip_with(begin, end, lambda a, b: F.when(b > a, F.slice("_lines", a + 1, b - a)).otherwise(none))
    kept = joined.withColumn("_kept", F.when(F.col("_starts").isNotNull(), F.flatten(stretches)))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.col("_n"))
    return kept.select(
        "doc_id", "_rest",
        F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text"),
        count.cast("bigint").alias("n_lines"),
        F.when(F.col("_kept").isNull(), 0).otherwise(count - F.size("_kept")).cast("bigint").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, text, n_lines, n_removed``: the text without the lines that any later
    occurrence of a three-line window covers.

    Lines are what ``\\n`` separates, compared exactly; a window of blank lines only is no repeat.
    Documents of fewer than three lines stay as they are; a null text stays null with 0 lines; an
    empty text is one empty line. A text whose lines are all removed becomes empty. Rows with the same
    doc_id count as one document and lose the same lines; rows with a null doc_id stay as they are.
    Other columns are not returned.
    """
    return _cleaned(documents(docs)).select("doc_id", "text", "n_lines", "n_removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with cleaned texts, and ``n_chars``, where there is one, of the new text. A document all of
    whose lines were repeats is left out; one that was empty before stays."""
    cleaned = _cleaned(docs).filter("n_removed = 0 OR n_removed < n_lines")
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return cleaned.select(*[new.get(c, F.col("_rest")[c]).alias(c) for c in docs.columns])


#: The same for another engine.
SQL = r"""
WITH lines AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), spots AS (
    SELECT doc_id, unnest(range(0, len(ls) - 2)) AS pos, ls FROM lines WHERE len(ls) >= 3
), windows AS (
    SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS w FROM spots
), told AS (
    SELECT * FROM windows WHERE regexp_matches(w, '[^\x20\x09-\x0D]')
), ranked AS (
    SELECT doc_id, pos, first_value(doc_id) OVER f AS first_doc, first_value(pos) OVER f AS first_pos
    FROM told WINDOW f AS (PARTITION BY w ORDER BY doc_id, pos)
), covered AS (
    SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, range(0, 3) AS r(k)
    WHERE doc_id <> first_doc OR pos >= first_pos + 3
), gone AS (
    SELECT doc_id, list(pos) AS gone, count(*) AS n FROM covered GROUP BY doc_id
)
SELECT l.doc_id,
       CASE WHEN n IS NULL THEN text
            ELSE coalesce(list_aggregate([ls[i + 1] for i in range(0, len(ls)) if NOT list_contains(gone, i)], 'string_agg', chr(10)), '')
       END AS text,
       coalesce(len(ls), 0)::bigint AS n_lines, coalesce(n, 0)::bigint AS n_removed
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id
"""
