"""Every registered query against its check SQL, on the smallest tables."""

import math
from pathlib import Path

import pytest

from plateflow import plans
from tests.conftest import SF

CHECKED = sorted(plans.oracle_sql())


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, str)):
        return value
    return value.isoformat() if hasattr(value, "isoformat") else float(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


#: Listings of files, which SQL over the tables cannot see.
LISTINGS = {"scan_image_listing", "stream_new_images"}


def test_every_query_has_a_check():
    assert set(plans.queries()) == {*CHECKED, *LISTINGS}


@pytest.mark.parametrize("name", sorted(LISTINGS))
def test_listings_match_the_folder(spark, name):
    got = {(row[0].rsplit("/", 1)[-1], row[1]) for row in plans.queries()[name](spark, SF).collect()}
    assert got == {(path.name, path.stat().st_size) for path in Path(SF).rglob("*.parquet")}


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF).toArrow()
    cursor = duck.execute(plans.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    want = table(columns, cursor.fetchall())
    assert sorted(got.column_names) == sorted(columns)
    assert table(got.column_names, zip(*[column.to_pylist() for column in got.columns])) == want
