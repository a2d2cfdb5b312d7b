"""Running totals and lags over a whole table without a one-task window.

Rows are range-partitioned by the order, each partition is summed to one row, and the sums of all
earlier partitions (as many rows as partitions) are joined back to partition-local windows.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.sources.scratch import materialize


def ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` with ``__part``, increasing with ``order``; written, so that parts stay as they are."""
    cut = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    return materialize(cut, "ranged")


def running_sums(df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, Column]) -> DataFrame:
    """Add inclusive running sums over ``order`` (which should be a total order)."""
    cut = ranged(df, order)
    totals = cut.groupBy("__part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("__part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    local = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = cut.withColumns({k: F.sum(c).over(local) for k, c in sums.items()}).join(offsets, "__part")
    return out.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__part", *[f"__{k}" for k in sums])


def row_ids(df: DataFrame, order: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """0-based position in ``order``."""
    return running_sums(df, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("long") - 1)


def lag_global(df: DataFrame, order: Sequence[str], column: str, name: str) -> DataFrame:
    """The column's value in the row before, across partitions."""
    cut = ranged(df, order)
    last = cut.groupBy("__part").agg(F.max_by(column, F.struct(*order)).alias("last"))
    offsets = last.select("__part", F.lag("last").over(W.orderBy("__part")).alias("__before"))
    local = cut.withColumn(name, F.lag(column).over(W.partitionBy("__part").orderBy(*order)))
    first = F.row_number().over(W.partitionBy("__part").orderBy(*order)) == 1
    return local.withColumn("__first", first).join(offsets, "__part").withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col(name))).drop("__part", "__before", "__first")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names where NULL equals NULL; the keys stay once."""
    other = right.withColumnsRenamed({k: f"__on_{k}" for k in keys})
    on = [left[k].eqNullSafe(F.col(f"__on_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"__on_{k}" for k in keys])


def segmented_sums(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, Column]) -> DataFrame:
    """Inclusive running sums over ``order`` in each segment ``by``, and the segment's sums as ``all_*``.

    Rows are range-partitioned by segment and order together, so a segment of any size spreads over as
    many partitions as it needs, and small ones share one. What meets in one place is a partition's rows,
    or a segment's sums of the partitions it touches. ``order`` should be total within a segment.
    """
    cut = ranged(df, [*by, *order])
    parts = cut.groupBy(*by, "__part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    whole = W.partitionBy(*by)
    before = whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(*by, "__part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__{k}") for k in sums], *[F.sum(k).over(whole).alias(f"all_{k}") for k in sums])
    local = W.partitionBy("__part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = null_safe(cut.withColumns({k: F.sum(c).over(local) for k, c in sums.items()}), offsets, ["__part", *by])
    return out.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__part", *[f"__{k}" for k in sums])


def nearest_window(df: DataFrame, order: Sequence[str], label: str, n: int, target: int) -> DataFrame:
    """One row about the best run of ``n`` neighbouring rows in ``order``, whose first column is a time step.

    Runs with at least ``target`` positives and a negative count; of them the one whose positives are nearest
    the target, then with the most distinct steps, then the earliest. Positives and steps of every run are
    differences of distributed running sums, a run's end meeting its start by their row numbers.
    """
    step = order[0]
    seen = lag_global(df.select(*order, label), order, step, "__last")
    changed = (F.col("__last").isNull() | (F.col(step) != F.col("__last"))).cast("int")
    run = running_sums(seen, order, {"i": F.lit(1), "y": F.col(label), "d": changed})
    ends = run.select((F.col("i") - 1).alias("last_row"), F.col("y"), F.col("d"))
    starts = run.select((F.col("i") - 1).alias("first_row"), (F.col("i") + n - 2).alias("last_row"), (F.col("y") - F.col(label)).alias("y0"), F.col("d").alias("d0"))
    runs = starts.join(ends, "last_row").select("first_row", "last_row", (F.col("y") - F.col("y0")).alias("positives"), (F.col("d") - F.col("d0") + 1).alias("steps"))
    fit = runs.where((F.col("positives") >= target) & (F.col("positives") < n))
    return fit.orderBy(F.abs(F.col("positives") - target), F.desc("steps"), "first_row").limit(1)
