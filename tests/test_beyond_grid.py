"""Queries over events of users beyond the 1500 of the sample tables, whose cells lie below the sample grid's last row."""

import duckdb
import pytest

from tests.conftest import DATA
from tests.test_queries import rows
from tidegrid.plans import stored_queries  # noqa: F401  registers its queries
from tidegrid.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def beyond(tmp_path_factory):
    """(folder, connection): the smallest events, and once more with users from 1490 on, on both sides of the last row."""
    folder = tmp_path_factory.mktemp("beyond")
    con = duckdb.connect()
    source = f"'{DATA}/sf0.001/events.parquet'"
    con.execute(f"copy (from {source} union all select * replace (event_id + 1000 as event_id, user_id + 1490 as user_id) from {source}) to '{folder}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), con


def same_as_sql(spark, beyond, name):
    folder, con = beyond
    df = QUERIES[name](spark, folder)
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    found = rows([tuple(r) for r in df.collect()], df.columns)
    assert found == rows(result.fetchall(), columns)
    return [r[sorted(columns).index("y")] for r in found]


def test_round_trip_keeps_to_the_grid(spark, beyond):
    assert max(same_as_sql(spark, beyond, "chunk_round_trip")) == 99


def test_stream_takes_all_cells(spark, beyond):
    assert max(same_as_sql(spark, beyond, "stream_into_grid")) == 100
