"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from ledgerlens.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()
SLOW = {"model_scores", "feature_importance", "local_attributions", "counterfactual_amounts"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def ordered(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns


def test_model_scores(spark, sf_dir):
    rows = QUERIES["model_scores"](spark, sf_dir).collect()
    assert rows and all(0 <= r["p"] <= 1 and r["predicted"] == int(r["p"] >= 0.5) for r in rows)
