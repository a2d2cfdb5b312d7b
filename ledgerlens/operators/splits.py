"""Chronological splits, samples, and de-duplication by order."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import digest_number
from ledgerlens.operators.prefix import null_safe, row_ids

def step_table(df: DataFrame) -> DataFrame:
    """Rows and positives of each step with cumulative share; a window over steps, not rows."""
    by = df.groupBy("step").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"))
    run = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return by.withColumn("share", F.sum("n").over(run) / F.sum("n").over(W.partitionBy()))


def cut_steps(df: DataFrame, fractions: Sequence[float] = (0.7, 0.85)) -> list[int]:
    """For each fraction the smallest step at which so much of the rows has come."""
    row = step_table(df).agg(*[F.min(F.when(F.col("share") >= f, F.col("step"))).alias(str(i)) for i, f in enumerate(fractions)]).first()
    return [row[i] for i in range(len(fractions))]


def temporal_split(df: DataFrame, fractions: Sequence[float] = (0.7, 0.85)) -> DataFrame:
    """``split``: train, validation, test on whole steps."""
    train, validation = cut_steps(df, fractions)
    return df.withColumn("split", F.when(F.col("step") <= train, "train").when(F.col("step") <= validation, "validation").otherwise("test"))


def clamped_split(df: DataFrame, fractions: Sequence[float] = (0.7, 0.85)) -> DataFrame:
    """By rank of steps, clamped so that all three parts have one; needs three steps. Two steps come to the driver."""
    ranked = row_ids(df.select("step").where("step IS NOT NULL").distinct(), ["step"], "rank")
    n = df.agg(F.countDistinct("step")).first()[0]
    if n < 3:
        raise ValueError("a split needs three steps")
    a = max(1, min(int(n * fractions[0] + 1e-9), n - 2))
    b = max(a + 1, min(int(n * fractions[1] + 1e-9), n - 1))
    first = {r["rank"]: r["step"] for r in ranked.where(F.col("rank").isin(a, b)).collect()}
    return df.withColumn("split", F.when(F.col("step") < first[a], "train").when(F.col("step") < first[b], "validation").otherwise("test"))


def split_summary(df: DataFrame) -> DataFrame:
    out = df.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))
    all_ = W.partitionBy()
    return out.withColumns({"share_pct": F.round(100 * F.col("n") / F.sum("n").over(all_), 4), "rate_pct": F.round(100 * F.col("positives") / F.col("n"), 4)})


def window_tag(old: tuple[int, int], recent: tuple[int, int], step: str = "step"):
    s = F.col(step)
    return F.when(s.between(*old), "reference").when(s.between(*recent), "recent").otherwise("excluded")


def cycle_split(df: DataFrame, old: tuple[int, int], recent: tuple[int, int], fractions: Sequence[float] = (0.6, 0.8)) -> DataFrame:
    """Old window in full for training, the recent one split by time, the gap left out."""
    tagged = df.withColumn("part", window_tag(old, recent)).where("part <> 'excluded'")
    a, b = cut_steps(tagged.where("part = 'recent'"), fractions)
    split = F.when((F.col("part") == "reference") | (F.col("step") <= a), "train").when(F.col("step") <= b, "validation").otherwise("test")
    return tagged.withColumn("split", split)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``, by an aggregate: a hot key is combined where it is read."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of ``n`` rows that depends on keys and seed only."""
    return df.orderBy(digest_number(key, seed=seed), key).limit(n)


def covering_sample(df: DataFrame, key: str, features: Sequence[str], n: int, least: int = 30, seed: int = 42) -> DataFrame:
    """``hash_sample`` and, for each feature, the first ``least`` rows by hash where it isn't NULL."""
    h = digest_number(key, seed=seed)
    pick = hash_sample(df, key, n, seed).select(key)
    for f in features:
        pick = pick.unionByName(df.where(F.col(f).isNotNull()).orderBy(h, key).limit(least).select(key))
    return df.join(pick.distinct(), key, "left_semi")


def stratified_sample(df: DataFrame, keys: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """Quotas in proportion to strata, of which there may be any number. A row's turn is its hash's rank, found
    by a threshold on the hash, so that a stratum of any size is ranked by few rows, and settled exactly among them."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = max(df.count(), 1)
    quota = F.bround(F.col("__n") * F.lit(float(n)) / total).cast("long")
    near = F.least(F.lit(1.0), (F.col("__q") + 6 * F.sqrt(F.col("__q") + 1) + 10) / F.col("__n"))
    strata = counts.withColumn("__q", quota).withColumn("__near", near)
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    some = null_safe(df.withColumn("__h", h), strata, keys).where("__h <= __near")
    ranked = some.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy("__h", key)))
    return ranked.where("__rank <= __q").select(*df.columns)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """Without replacement, in proportion to weights: the least of -ln(u) / w."""
    u = (digest_number(key, seed=seed) % (1 << 40) + 0.5) / float(1 << 40)
    return df.where(F.col(weight) > 0).orderBy(-F.ln(u) / F.col(weight), key).limit(n)
