"""Every query of the core gives the rows of its SQL in DuckDB, with the same column names."""

import math
from pathlib import Path

import duckdb
import pytest

from tests.conftest import DATA
from tidegrid.plans import stored_queries  # noqa: F401  registers its queries
from tidegrid.plans.queries import QUERIES, SQL

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.execute(f"create view {path.stem} as select * from '{path}'")
    return c


def rows(found, columns):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9) + 0.0
        return v.isoformat() if hasattr(v, "isoformat") else v

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(result.fetchall(), columns)
