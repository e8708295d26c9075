import time

from pyspark.sql import functions as F

from plateflow.llm import line_dedup, mixing


def test_a_text_of_many_repeated_lines_takes_seconds(spark):
    """Two copies of 200,000 lines, and one with a line changed here and there."""
    lines = [f"line number {i}" for i in range(200_000)]
    some = [x if i % 1000 else "changed" for i, x in enumerate(lines)]
    frame = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join(some))], "doc_id bigint, text string")
    line_dedup.dedup_lines(frame.limit(0)).count()
    started = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame).collect()}
    assert time.time() - started < 60
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 200_000 and got[2]["text"] == ""
    assert got[3]["text"] == "\n".join(["changed"] * 200) and got[3]["n_removed"] == 199_800


def test_copies_of_rows_whose_columns_have_helper_names(spark):
    frame = spark.createDataFrame([(1, "a", 1, 2, 3, 4), (2, "b", 5, 6, 7, 8), (None, "c", 0, 0, 0, 0)], "doc_id bigint, text string, _rate int, _times int, _copy int, _row int")
    rates = spark.createDataFrame([(1, 3.0), (2, 0.0)], "doc_id bigint, rate double")
    out = mixing.apply_rates(frame, rates)
    assert out.columns == frame.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, frame.filter(F.col("doc_id") == 1).collect() * 3 + frame.filter("doc_id IS NULL").collect()))
