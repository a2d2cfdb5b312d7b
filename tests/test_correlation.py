"""Correlations of many columns with nulls against the definition."""

import numpy as np
import pytest

from ledgerlens.operators.correlation import above, correlations, with_label


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 60)) * 10.0 ** rng.integers(-3, 4, 60) + 1e6 * (np.arange(60) % 7 == 0)
    x[:, 1] = -2 * x[:, 0] + 5
    x[:, 2] = 4.0
    x[:, 4] = x[:, 3] + 0.05 * np.abs(x[:, 3]).mean() * rng.normal(size=700)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:350, 5], x[350:, 6] = np.nan, np.nan  # no row has both
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return x, spark.createDataFrame(rows, ", ".join(f"`a.{k}` double" for k in range(60))), [f"a.{k}" for k in range(60)]


def wanted(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    return both.sum(), None if len(a) < 2 or not a.std() or not b.std() else np.corrcoef(a, b)[0, 1]


def test_pairs(table):
    x, df, names = table
    got = {(r["left_col"], r["right_col"]): (r["n"], r["corr"]) for r in correlations(df.repartition(5), names).collect()}
    assert len(got) == 60 * 59 // 2
    for i in range(60):
        for j in range(i + 1, 60):
            n, c = wanted(x, i, j)
            have = got[names[i], names[j]]
            assert have[0] == n and (have[1] is None if c is None else abs(have[1] - c) < 1e-9), (i, j, have, n, c)


def test_selection_and_label(table):
    x, df, names = table
    pairs = correlations(df, names)
    assert [(r["left_col"], r["right_col"]) for r in above(pairs, 0.9).collect()] == [("a.0", "a.1"), ("a.3", "a.4")]
    assert [(r["left_col"], r["right_col"]) for r in above(pairs, 0.9999).collect()] == [("a.0", "a.1")]
    probe = {r["feature"]: (r["abs_corr"], r["leaks"]) for r in with_label(df, names[:4], "a.4").collect()}
    assert probe["a.3"][1] and probe["a.2"] == (None, False) and not probe["a.0"][1]


def test_small_inputs(table):
    df = table[1]
    assert [(r["n"], r["corr"]) for r in correlations(df.limit(0), ["a.0", "a.1"]).collect()] == [(0, None)]
    assert [(r["corr"]) for r in correlations(df.limit(1), ["a.0", "a.1"]).collect()] == [None]
    assert correlations(df, ["a.0"]).collect() == []
