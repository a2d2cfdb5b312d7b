"""Joins with checked multiplicity, as-of availability, and set comparisons."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.profile import unpivot_aggs
from ledgerlens.sources.scratch import materialize


def assert_unique(df: DataFrame, keys: Sequence[str], name: str) -> None:
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{name} has more than one row for {twice[0].asDict()}")


def match_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """LEFT join with an indicator ``matched``; a key that repeats on either side is an error."""
    if check:
        assert_unique(left, keys, "left")
        assert_unique(right, keys, "right")
    return left.join(right.withColumn("__hit", F.lit(True)), list(keys), "left").withColumn("matched", F.col("__hit").isNotNull()).drop("__hit")


def delayed_labels(predictions: DataFrame, truth: DataFrame, delay: int, now: int, key: str = "transaction_id") -> DataFrame:
    """Labels joined to predictions, available once ``made_at + delay <= now``; masked before."""
    out = predictions.join(truth, key, "left").withColumn("label_at", F.when(F.col("label").isNotNull(), F.col("made_at") + delay))
    ready = F.coalesce(F.col("label_at") <= now, F.lit(False))
    return out.withColumn("available", ready).withColumn("label", F.when(F.col("available"), F.col("label")))


def flags_from(df: DataFrame, key: str, **others: DataFrame) -> DataFrame:
    """Boolean columns: does each other table have the key. Keys are made distinct first."""
    for name, other in others.items():
        keys = other.select(F.col(key)).distinct().withColumn(name, F.lit(True))
        df = df.join(keys, key, "left").withColumn(name, F.col(name).isNotNull())
    return df


def touching(history: DataFrame, live: DataFrame) -> DataFrame:
    """Events before the first live one that share its senders or its recipients."""
    first = live.agg(F.min(F.struct("step", "event_id")).alias("m")).first()["m"]
    if first is None:
        return history.limit(0)
    past = history.where((F.col("step") < first["step"]) | ((F.col("step") == first["step"]) & (F.col("event_id") < first["event_id"])))
    by = [past.join(live.select(k).distinct(), k, "left_semi").select(*history.columns) for k in ("sender", "dest")]
    return by[0].unionByName(by[1]).dropDuplicates(["event_id"])


def parity(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], rtol: float = 1e-4, atol: float = 0.05) -> DataFrame:
    """For each column: rows compared, rows that differ, largest difference. NULL equals NULL only."""
    b = right.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    both = left.select(key, *columns).join(b, key, "full")
    aggs = {}
    for c in columns:
        x, y = F.col(c).cast("double"), F.col(f"__{c}").cast("double")
        close = F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(F.abs(x - y) <= atol + rtol * F.abs(y))
        aggs[c] = {"n": F.count("*"), "n_different": F.count_if(~close), "max_diff": F.max(F.abs(x - y))}
    return unpivot_aggs(both, aggs, name="column_name")


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many distinct keys two datasets share, for each key."""
    out = [a.select(k).distinct().join(b.select(k).distinct(), k, "left_semi").agg(F.lit(k).alias("key"), F.count("*").alias("shared")) for k in keys]
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first.groupBy("key").agg(F.max("shared").alias("shared"))


#: A key with more than one in so many rows is hot; so there are fewer hot keys than this.
HOT_KEYS = 1_000


def with_totals(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """``df`` with aggregates of each row's group, as a window over ``keys`` would add.

    A window moves all rows of a key to one task. Here groups are summed where rows are read, and rows
    meet their sums in two joins: those of hot keys stay where they are, as the hot keys' sums are fewer
    than ``HOT_KEYS`` rows and broadcast; the others are shuffled, none of their keys being large.
    """
    totals = materialize(df.groupBy(*keys).agg(F.count("*").alias("__n"), *[c.alias(k) for k, c in aggs.items()]), "totals")
    rows = totals.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot = F.broadcast(totals.where(F.col("__n") * HOT_KEYS > rows))
    same = lambda t: [df[k].eqNullSafe(t[f"__{k}"]) for k in keys]
    named = {k: f"__{k}" for k in keys}
    big, small = hot.withColumnsRenamed(named), totals.where(F.col("__n") * HOT_KEYS <= rows).withColumnsRenamed(named)
    here = df.join(big, same(big), "inner")
    rest = df.join(big, same(big), "left_anti")
    there = rest.join(small, [rest[k].eqNullSafe(small[f"__{k}"]) for k in keys], "inner")
    columns = [*df.columns, *aggs]
    return here.select(*columns).unionByName(there.select(*columns))
