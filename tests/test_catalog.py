"""Each scoring query against its SQL in DuckDB, exactly."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quorix.plans.oracle import ORACLE


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, data, duck, name):
    from quorix.plans.catalog import QUERIES

    ours, theirs = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(a)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)


def test_stream_equals_batch(spark, data):
    from quorix.plans import catalog

    stream = {tuple(r) for r in catalog.stream_score(spark, data).collect()}
    batch = {tuple(r) for r in catalog.tx_score(spark, data).collect()}
    assert stream and stream <= batch
    valid = {r[0] for r in catalog.validate_payload(spark, data).where("is_valid and tx_id % 20 = 0").collect()}
    assert {r[0] for r in stream} == valid


def test_entry():
    import __spark_entry__ as e

    assert set(ORACLE) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
