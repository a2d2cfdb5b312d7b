"""Operators whose groups may hold any share of the rows: quantiles, running sums, totals."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.operators import drift as dr
from ledgerlens.operators.joins import HOT_KEYS, with_totals
from ledgerlens.operators.metrics import ranking
from ledgerlens.operators.prefix import segmented_sums
from ledgerlens.operators.quantiles import column_quantiles, order_statistics

PS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows: one group has all but a few, one has one row, one none but NULLs, one is NULL itself."""
    rng = np.random.default_rng(1)
    data = [("all", float(v), float(np.round(v * 3))) for v in rng.normal(size=2900)]
    data += [("few", float(v), None) for v in rng.normal(size=7)] + [("one", 4.5, 1.0), ("none", None, None)] + [(None, float(v), 2.0) for v in rng.normal(size=90)]
    return data, spark.createDataFrame(data, "g string, x double, y double").repartition(6)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_by_group(rows):
    data, df = rows
    got = {(r["g"], r["feature"]): (r["n"], r["q"]) for r in column_quantiles(df, ["x", "y"], PS, ["g"]).collect()}
    want = {}
    for g in ("all", "few", "one", "none", None):
        for i, c in enumerate("xy", 1):
            v = [r[i] for r in data if r[0] == g and r[i] is not None]
            if v:
                want[g, c] = (len(v), np.quantile(v, PS))
    assert set(got) == set(want)
    for k, (n, q) in want.items():
        assert got[k][0] == n and np.allclose(got[k][1], q, rtol=1e-12, atol=1e-12), k


def test_quantiles_of_weighted_rows(rows):
    data, df = rows
    counts = df.where("y IS NOT NULL").groupBy("y").agg(F.count("*").alias("w"))
    got = order_statistics(counts, [], PS, "y", F.col("w")).first()
    v = [r[2] for r in data if r[2] is not None]
    assert got["n"] == len(v) and np.allclose(got["q"], np.quantile(v, PS))
    assert order_statistics(df.limit(0), ["g"], PS, "x").collect() == []


def test_no_buffer_holds_a_column(rows):
    text = plan(column_quantiles(rows[1], ["x"], PS, ["g"]))
    assert "percentile" not in text and "collect_" not in text


def test_segmented_sums(rows, spark):
    data, df = rows
    df = df.withColumn("part", F.lit("mine")).withColumn("i", F.monotonically_increasing_id())
    out = segmented_sums(df, ["g"], [F.desc("x"), "i"], {"n": F.lit(1), "s": F.col("y")})
    w = W.partitionBy("g").orderBy(F.desc("x"), "i").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("g", "i", F.count(F.lit(1)).over(w).alias("n"), F.coalesce(F.sum("y").over(w), F.lit(0.0)).alias("s"), F.count(F.lit(1)).over(W.partitionBy("g")).alias("all_n"))
    key = lambda rs: sorted((r["i"], r["n"], round(r["s"] or 0.0, 6), r["all_n"]) for r in rs)
    assert key(out.select("i", "n", F.coalesce("s", F.lit(0.0)).alias("s"), "all_n").collect()) == key(want.collect())
    assert set(out.select("part").distinct().collect()) == {("mine",)}


def test_a_large_segment_spreads(spark):
    """All rows in one segment: the local windows run over ranges, not over the segment."""
    df = spark.range(20_000).select(F.lit("only").alias("g"), "id").repartition(8)
    out = segmented_sums(df, ["g"], ["id"], {"n": F.lit(1)})
    assert out.agg(F.max("n"), F.count_if(F.col("n") == F.col("id") + 1)).first() == (20_000, 20_000)
    windows = [line for line in plan(out).splitlines() if "Window [" in line and "id" in line]
    assert windows and all("__part" in line for line in windows)


def test_totals_of_a_hot_key(spark):
    data = [(i, 7 if i % 3 == 0 else None if i % 50 == 1 else i % 2000, float(i % 5)) for i in range(9000)]
    df = spark.createDataFrame(data, "id long, k long, v double").repartition(8)
    out = with_totals(df, ["k"], {"n": F.count("*"), "s": F.sum("v")})
    w = W.partitionBy("k")
    want = df.select("id", F.count("*").over(w).alias("n"), F.sum("v").over(w).alias("s"))
    assert sorted(map(tuple, out.select("id", "n", "s").collect())) == sorted(map(tuple, want.collect()))
    text = plan(out)
    assert "Window" not in text and "BroadcastHashJoin" in text
    cold = df.join(df.groupBy("k").count().where(F.col("count") * HOT_KEYS <= 9000), "k").groupBy("k").count().agg(F.max("count")).first()[0]
    assert cold <= 9  # what is shuffled by key has small groups only
    assert with_totals(df.limit(0), ["k"], {"n": F.count("*")}).collect() == []


def test_kolmogorov_smirnov_without_a_window_of_a_feature(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(size=4000), 2), np.round(rng.normal(0.3, 1, size=3000), 2)
    long = spark.createDataFrame([("x", float(v), 0) for v in a] + [("x", float(v), 1) for v in b] + [("empty", None, 0)], "feature string, value double, recent int")
    values = np.unique(np.r_[a, b])
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in values)
    out = dr.ks(long)
    assert [(r["feature"], round(r["ks"], 12)) for r in out.collect()] == [("x", round(want, 12))]
    assert all("__part" in line or "feature#" not in line.split("windowspecdefinition(")[-1] or "value" not in line for line in plan(out).splitlines() if "Window [" in line)


def test_ranking_by_group_equals_one_at_a_time(spark):
    rng = np.random.default_rng(4)
    data = [(m, float(np.round(rng.random(), 2)), int(rng.random() < 0.3)) for m in ("a", "b") for _ in range(800)]
    df = spark.createDataFrame(data, "model string, p double, label int")
    both = {r["model"]: r for r in ranking(df, ["model"]).collect()}
    for m in ("a", "b"):
        one = ranking(df.where(F.col("model") == m)).first()
        assert all(abs(one[c] - both[m][c]) < 1e-9 for c in ("average_precision", "roc_auc", "brier", "n"))


def test_distinct_counts_hold_one_column_a_task(spark):
    """Several distinct counts don't multiply the rows, and are those of one aggregate; NULL isn't a value."""
    from ledgerlens.operators import profile as pf

    rows = [(i, float(i % 7) if i % 5 else None, None, "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, gone double, kind string")
    for out in (pf.overview(df, df.columns), pf.cardinality(df, df.columns), pf.feature_table(df, ["id", "x", "gone"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan
        count = "n_unique" if "n_unique" in out.columns else "n_distinct"
        found = {r["column_name"]: r[count] for r in out.collect()}
        assert found == {c: n for c, n in {"id": 100, "x": 7, "gone": 0, "kind": 2}.items() if c in found} and len(found) >= 3


def test_orders_of_a_large_table_are_joined_in_bounded_tasks(spark, sf_dir, monkeypatch):
    """The number of tasks of the ledger's first join grows with the orders, and the rows are the same."""
    from ledgerlens.plans import views

    few = views.ords(spark, sf_dir)
    monkeypatch.setattr(views, "JOIN_ROWS", 100)
    many = views.ords(spark, sf_dir)
    assert many.rdd.getNumPartitions() == -(-views.read(spark, sf_dir, "orders").count() // 100) > 8
    assert sorted(many.collect()) == sorted(few.collect())
