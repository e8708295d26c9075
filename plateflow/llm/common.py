"""What the operators of this subpackage share."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plateflow.operators.skew import shared_folder

#: White space of the word contracts: blank and \x09 to \x0D. bytes.split() splits on the same six.
SPACE = "\x20\x09-\x0d"

#: Narrow rows that one file holds, where their number is known.
FILE_ROWS = 200_000


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the folder all executors share and read again. Cuts the lineage, so later
    jobs neither repeat the work nor depend on the executors that did it. Of narrow tables with at most
    ``rows`` rows the files are as few as that number asks for, and grow with it."""
    path = shared_folder(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(2 + rows // FILE_ROWS)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that others may have any name."""
    return docs.select("doc_id", "text", *more)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(batches, keys: int):
    """Runs of equal leading columns of sorted record batches: (first row as a tuple, table of the run)."""
    import pyarrow as pa

    held, mark = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = sum((c[1:] != c[:-1]).astype(int) for c in columns) if batch.num_rows > 1 else []
        cuts = [0, *(i + 1 for i, x in enumerate(change) if x), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(c[a] for c in columns)
            if mark is not None and now != mark:
                yield mark, pa.Table.from_batches(held)
                held = []
            mark = now
            held.append(batch.slice(a, b - a))
    if held:
        yield mark, pa.Table.from_batches(held)
