"""Pearson correlations of many columns at once, by sums of products over pairs without nulls."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "x", "y", "xx", "yy", "xy")


def pair_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, j, n, x, y, xx, yy, xy)`` for each pair i < j of columns, over the rows in which both have a value.

    One pass: a task multiplies the matrix of its rows (nulls as zeros) and that of their presence with each
    other, and sends one row a pair at its end, however many rows it has read. Values are taken from the
    columns' means first, so sums of squares keep their digits. NaN counts as a null.
    """
    numbers = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"c{k}") for k, c in enumerate(columns)]
    wide = df.select(*numbers)
    means = np.array([m or 0.0 for m in wide.agg(*[F.avg(c) for c in wide.columns]).first()])
    left, right = np.triu_indices(len(columns), 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(left)))
        for batch in batches:
            raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            has = (~np.isnan(raw)).astype(float)
            x = np.where(has > 0, raw - means, 0.0)
            by = has.T @ has, x.T @ has, has.T @ x, (x * x).T @ has, has.T @ (x * x), x.T @ x
            total += np.stack([m[left, right] for m in by])
        if total[0].any():
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), *map(pa.array, total)], ["i", "j", *SUMS])

    parts = wide.mapInArrow(sums, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(left_col, right_col, n, corr)`` of each pair; NULL where a column doesn't vary or no row has both."""
    spark = df.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame([], "left_col string, right_col string, n long, corr double")
    n, x, y, xx, yy, xy = (F.coalesce(F.col(s), F.lit(0.0)) for s in SUMS)
    spread = lambda s, ss: F.when((n > 1) & (ss - s * s / n > 1e-12 * ss), ss - s * s / n)
    corr = (xy - x * y / n) / F.sqrt(spread(x, xx)) / F.sqrt(spread(y, yy))
    names = F.array(*map(F.lit, columns))
    every = spark.range(len(columns) - 1).select(F.col("id").cast("int").alias("i"))
    pairs = every.select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(len(columns) - 1))).alias("j"))
    out = pairs.join(pair_sums(df, columns), ["i", "j"], "left")
    return out.select(names[F.col("i")].alias("left_col"), names[F.col("j")].alias("right_col"), n.cast("long").alias("n"), corr.alias("corr"))


def above(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs that move together, or against each other, to at least ``least``; the strongest first."""
    return pairs.where(F.abs("corr") >= least).orderBy(F.desc(F.abs("corr")), "left_col", "right_col")


def with_label(df: DataFrame, columns: Sequence[str], label: str = "label", limit: float = 0.98) -> DataFrame:
    """How far each feature gives the label away."""
    pairs = correlations(df, [*columns, label]).where(F.col("right_col") == label)
    leak: Column = F.coalesce(F.abs("corr") >= limit, F.lit(False))
    return pairs.select(F.col("left_col").alias("feature"), F.abs("corr").alias("abs_corr"), leak.alias("leaks"))
