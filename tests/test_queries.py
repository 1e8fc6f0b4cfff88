"""Every registered query against its SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from sigweave.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    made = duckdb.connect()
    for f in os.listdir(sf_dir):
        made.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return made


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        v = float(v) if isinstance(v, Decimal) else v
        return round(v, 5) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in out.collect()]
    if name not in SQL:
        assert rows
        return
    said = con.execute(SQL[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(out.columns)
    assert rows_of(rows, out.columns) == rows_of(said.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
