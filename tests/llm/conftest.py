import pytest

from tests.conftest import SF

#: Texts every operator on documents has to survive.
ODD = [None, "", " ", "\n\n\n", "word", "a " * 3000, "x" * 30000, "A\nb\nA\nb\nA\nb", "é ß\x85 naïve text", "\U0001f600 " * 60, "a\x00b", "<|endoftext|> a  b\n\n c"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a null id, repeated rows, and columns whose names an operator might want."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (4, "word"), (100, "word")]
    return spark.createDataFrame([(i, t, "x", 1, "s") for i, t in rows], "doc_id bigint, text string, score string, n_words int, component_id string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
