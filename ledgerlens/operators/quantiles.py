"""Exact quantiles as order statistics of sorted, counted values.

Equal values of a column are one row with a count before anything is sorted. Those rows are
range-partitioned by (group, column, value), and ranks come from prefix sums over the partitions, so
neither a buffer nor a task ever holds a whole column, however large its group.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.prefix import null_safe, segmented_sums


def order_statistics(long: DataFrame, by: Sequence[str], quantiles: Sequence[float], value: str = "value", weight: Column | None = None) -> DataFrame:
    """``(*by, n, q)``: how many values each group has and its quantiles, by linear interpolation.

    NULLs don't count; NaN is above all numbers. A row stands for ``weight`` equal rows (a whole number).
    """
    counts = long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("n"))
    ranked = segmented_sums(counts.where("n > 0"), by, [value], {"upto": F.col("n")})
    before = F.col("upto") - F.col("n")
    ends = []
    for i, p in enumerate(quantiles):
        at = (F.col("all_upto") - 1) * F.lit(float(p))
        for name, rank in ((f"lo{i}", F.floor(at)), (f"hi{i}", F.ceil(at))):
            ends.append(F.max(F.when((before <= rank) & (rank < F.col("upto")), F.col(value).cast("double"))).alias(name))
    picked = ranked.groupBy(*by).agg(F.max("all_upto").alias("n"), *ends)
    share = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    each = [F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise((1 - share(p)) * F.col(f"lo{i}") + share(p) * F.col(f"hi{i}")) for i, p in enumerate(quantiles)]
    return picked.select(*by, "n", F.array(*each).alias("q"))


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), name: str = "feature", weight: str | None = None) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns])
    keep = [*by, *([weight] if weight else [])]
    return df.select(*keep, F.explode(rows).alias("r")).select(*keep, f"r.{name}", "r.value")


def column_quantiles(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float], by: Sequence[str] = (), name: str = "feature", weight: str | None = None) -> DataFrame:
    """``(*by, name, n, q)`` for several columns in one plan; a column without values has no row."""
    return order_statistics(long_form(df, columns, by, name, weight), [*by, name], quantiles, weight=F.col(weight) if weight else None)


def with_quantiles(out: DataFrame, df: DataFrame, columns: Sequence[str], quantiles: dict[str, float], by: Sequence[str] = (), name: str = "feature") -> DataFrame:
    """``out``, which has a row for each group and column, with a column for each quantile."""
    q = column_quantiles(df, columns, list(quantiles.values()), by, name)
    named = q.select(*by, name, *[F.col("q")[i].alias(k) for i, k in enumerate(quantiles)])
    return null_safe(out, named, [*by, name], "left")


def values_of(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of whole columns on the driver: a row a column."""
    return {r["feature"]: r["q"] for r in column_quantiles(df, columns, quantiles).collect()}


def distinct_edges(values: Sequence[float] | None) -> list[float]:
    return list(dict.fromkeys(values or []))
