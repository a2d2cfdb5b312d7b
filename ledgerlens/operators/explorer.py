"""Filters, search and order over any table, as an explorer of records offers them."""

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explore(df: DataFrame, text: str = "", among: Mapping[str, Sequence[Any]] | None = None, order: str | None = None, descending: bool = False) -> DataFrame:
    """Rows that have ``text`` in any column, whatever the case, and each column of ``among`` in its list.

    An empty text or list excludes nothing. NULLs contain nothing, and come last in either order. Where a list
    is given for a column that the source partitions or indexes by, it reaches the scan.
    """
    for column, values in (among or {}).items():
        if values:
            df = df.where(F.col(column).isin(*values))
    if text:
        found = [F.coalesce(F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(text.lower())), F.lit(False)) for c in df.columns]
        df = df.where(reduce(lambda a, b: a | b, found))
    if order:
        df = df.orderBy(F.desc_nulls_last(order) if descending else F.asc_nulls_last(order))
    return df


def repeated_rows(df: DataFrame) -> DataFrame:
    """How many rows have an exact duplicate."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).alias("n_repeated"))
