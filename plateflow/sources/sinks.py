"""What goes out: result files."""

from functools import reduce

from pyspark.sql import DataFrame


def merge_exports(parts: list[DataFrame]) -> DataFrame:
    """Export pages put together; the header exists once because the columns are a schema."""
    return reduce(DataFrame.unionByName, parts)


def write_results_json(nested: DataFrame, folder: str) -> None:
    """One JSON record per line, written by all tasks in parallel."""
    nested.write.mode("errorifexists").json(folder)


def write_results_csv(flat: DataFrame, folder: str, single_file: bool = False) -> None:
    """CSV with a header in every part file. ``single_file`` brings a bounded page into one file
    and is for spreadsheets, not for whole tables."""
    out = flat.coalesce(1) if single_file else flat
    out.write.mode("errorifexists").option("header", "true").option("escape", '"').csv(folder)


def csv_for_spreadsheets(part_file: str, target: str) -> None:
    """Copy one CSV part with the byte-order mark spreadsheet programs look for."""
    with open(part_file, "rb") as source, open(target, "wb") as sink:
        sink.write(b"\xef\xbb\xbf")
        while block := source.read(1 << 20):
            sink.write(block)
