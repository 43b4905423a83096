"""Every registered query with an oracle agrees with DuckDB on sf0.001."""

import math

import duckdb
import pytest

from conftest import SF_MID, SF_SMALL

import __spark_entry__ as E

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SQL = E.oracle_sql()


def _norm(v):
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def con():
    return _connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    _agree(spark, con, name, SF_SMALL)


@pytest.mark.parametrize("name", ["t14_scenario_grid", "t2_fit_epochs", "l_main7_line"])
def test_folds_on_more_rows(spark, name):
    """Folds turn a last bit into another prediction now and then: features that are computed, long runs, lock step."""
    _agree(spark, _connect(SF_MID), name, SF_MID)


def _agree(spark, con, name, sf):
    sdf = E.queries()[name](spark, sf)
    cols = sorted(sdf.columns)
    s = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    odf = con.sql(SQL[name]).df()
    assert sorted(odf.columns) == cols
    o = sorted((tuple(_norm(r[c]) for c in cols) for r in odf.to_dict("records")), key=repr)
    assert s == o


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "micro_f1" in df.columns
