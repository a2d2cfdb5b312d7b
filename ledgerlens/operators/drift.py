"""Distribution drift between a reference and a recent window, all features in one long plan."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import kolmogorov, normal_two_sided
from ledgerlens.operators.prefix import segmented_sums
from ledgerlens.operators.profile import to_long
from ledgerlens.operators.quantiles import order_statistics
from ledgerlens.sources.scratch import materialize

PSI_LIMIT, ALPHA, RATE_LIMIT, LEAST = 0.20, 0.05, 0.15, 30


def long_rows(df: DataFrame, features: Sequence[str], window: Column) -> DataFrame:
    """``(feature, value, recent)`` with recent 0 or 1."""
    tagged = df.withColumn("recent", F.when(window == "reference", 0).when(window == "recent", 1)).where("recent IS NOT NULL")
    return to_long(tagged, features, ["recent"])


def long_windows(df: DataFrame, features: Sequence[str], window: Column) -> DataFrame:
    """``long_rows``, written once: several passes follow."""
    return materialize(long_rows(df, features, window), "long")


def feature_stats(long: DataFrame) -> DataFrame:
    """Counts, null rates, means, population deviations, and whether a feature is binary."""
    v = F.col("value")
    aggs = []
    for w, name in ((0, "ref"), (1, "rec")):
        here = F.when(F.col("recent") == w, v)
        rows = F.count_if(F.col("recent") == w)
        aggs += [F.count(here).alias(f"n_{name}"), F.round(1 - F.try_divide(F.count(here), rows), 6).alias(f"null_{name}"), F.avg(here).alias(f"mean_{name}"), F.stddev_pop(here).alias(f"std_{name}")]
    binary = F.coalesce(F.bool_and(v.isin(0.0, 1.0)), F.lit(False))
    return long.groupBy("feature").agg(*aggs, binary.alias("is_binary"))


def psi(long: DataFrame, stats: DataFrame, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index by reference deciles, [a, b) with the last closed, or by value for
    binary features; NULL below 30 values in a window."""
    v = F.col("value")
    deciles = order_statistics(long.where("recent = 0"), ["feature"], [i / bins for i in range(bins + 1)])
    edges = deciles.select("feature", F.array_distinct("q").alias("q"))
    info = stats.select("feature", "is_binary", "n_ref", "n_rec").join(edges, "feature", "left")
    cuts = F.when(F.col("is_binary"), F.array(F.lit(0.5))).when(F.size("q") <= 2, F.array().cast("array<double>")).otherwise(F.expr("slice(q, 2, size(q) - 2)"))
    info = info.select("feature", "n_ref", "n_rec", cuts.alias("cuts"), (~F.col("is_binary") & (F.size("q") == 1)).alias("flat"), F.col("q")[0].alias("only"))
    binned = long.where(v.isNotNull()).join(F.broadcast(info.select("feature", "cuts", "only")), "feature")  # a row a feature
    at = F.size(F.filter("cuts", lambda e: v >= e))
    counts = binned.groupBy("feature", at.alias("bin")).agg(F.count_if(F.col("recent") == 0).alias("a"), F.count_if(F.col("recent") == 1).alias("b"), F.bool_and((F.col("recent") == 0) | (v == F.col("only"))).alias("same"))
    counts = counts.join(F.broadcast(info.select("feature", "n_ref", "n_rec", "flat", F.size("cuts").alias("n_cuts"))), "feature")
    p = F.greatest(F.try_divide("a", "n_ref"), F.lit(floor))
    q = F.greatest(F.try_divide("b", "n_rec"), F.lit(floor))
    empty = (F.max("n_cuts") + 1 - F.count("*")) * 0.0  # a bin that neither window has adds nothing
    out = counts.groupBy("feature").agg(
        (F.sum((q - p) * F.ln(q / p)) + empty).alias("raw"), F.max("flat").alias("flat"), F.bool_and("same").alias("same"), F.max("n_ref").alias("n_ref"), F.max("n_rec").alias("n_rec")
    )
    value = F.when(F.least("n_ref", "n_rec") < LEAST, None).when(F.col("flat"), F.when(F.col("same"), 0.0)).otherwise(F.col("raw"))
    return out.select("feature", value.alias("psi"))


def ks(long: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic: equal values are one row, then running fractions, a
    feature's values over as many partitions as they take."""
    counts = long.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count_if(F.col("recent") == 0).alias("a"), F.count_if(F.col("recent") == 1).alias("b"))
    run = segmented_sums(counts, ["feature"], ["value"], {"below_a": F.col("a"), "below_b": F.col("b")})
    gap = F.abs(F.try_divide("below_a", "all_below_a") - F.try_divide("below_b", "all_below_b"))
    return run.groupBy("feature").agg(F.max(gap).alias("ks"))


def z_test(stats: DataFrame) -> DataFrame:
    """Two-proportion z for binary features; no spread gives 0."""
    n1, n2, p1, p2 = (F.col(c) for c in ("n_ref", "n_rec", "mean_ref", "mean_rec"))
    one = F.lit(1.0)
    pooled = F.try_divide(n1 * p1 + n2 * p2, n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (F.try_divide(one, n1) + F.try_divide(one, n2)))
    return stats.where("is_binary").select("feature", F.when(se == 0, 0.0).otherwise((p2 - p1) / se).alias("z"))


def bh_adjust(df: DataFrame, p: str = "p_value") -> DataFrame:
    """Benjamini-Hochberg adjusted values of a small table with a row a test; NULLs stay out."""
    tested = df.where(F.col(p).isNotNull())
    n = F.count("*").over(W.partitionBy())
    ranked = tested.withColumn("__rank", F.row_number().over(W.orderBy(p, "feature"))).withColumn("__raw", F.col(p) * n / F.col("__rank"))
    back = W.orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0)
    out = ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("__raw").over(back))).drop("__rank", "__raw")
    return out.unionByName(df.where(F.col(p).isNull()), allowMissingColumns=True)


def feature_drift(df: DataFrame, features: Sequence[str], window: Column) -> DataFrame:
    """PSI, KS or z, p-values with false-discovery control, and the decision for each feature."""
    return tested(long_windows(df, features, window))


def tested(long: DataFrame) -> DataFrame:
    """``feature_drift`` of long rows."""
    stats = materialize(feature_stats(long), "stats")
    out = stats.join(psi(long, stats), "feature", "left").join(ks(long), "feature", "left").join(z_test(stats), "feature", "left")
    enough = F.least("n_ref", "n_rec") >= LEAST
    p = F.when(~enough, None).when(F.col("is_binary"), normal_two_sided(F.col("z"))).otherwise(kolmogorov(F.col("ks"), F.col("n_ref"), F.col("n_rec")))
    out = out.withColumn("p_value", p).withColumn("ks", F.when(~F.col("is_binary"), F.col("ks")))
    out = bh_adjust(materialize(out, "tests"))
    by_psi, by_p = F.coalesce(F.col("psi") >= PSI_LIMIT, F.lit(False)), F.coalesce(F.col("p_adjusted") < ALPHA, F.lit(False))
    decision = F.when(~enough, "insufficient_sample").when(by_psi | by_p, "drift").otherwise("no_drift")
    reason = F.concat_ws(", ", F.when(by_psi, "psi"), F.when(by_p, "p_value"))
    return out.withColumns({"decision": decision, "reason": F.when(decision == "drift", reason).otherwise("")})


def sensitivity(df: DataFrame, column: str, factors: Sequence[float], where: Column, derive: Callable[[DataFrame], DataFrame], features: Sequence[str], window: Column) -> DataFrame:
    """Drift tests with ``column`` scaled by each factor where ``where`` holds, one row ``feature@factor`` each.

    ``derive`` makes what depends on the column anew for each factor, so all features move together as they
    would in real data; those that don't depend on it are the control.
    """
    tagged = df.withColumn("__window", window)
    long = None
    for k in factors:
        scaled = derive(tagged.withColumn(column, F.when(where, F.col(column) * k).otherwise(F.col(column))))
        wide = scaled.select("__window", *[F.col(f).cast("double").alias(f"{f}@{k}") for f in features])
        part = long_rows(wide, [f"{f}@{k}" for f in features], F.col("__window"))
        long = part if long is None else long.unionByName(part)
    return tested(materialize(long, "long"))


def overall_drift(features: DataFrame) -> DataFrame:
    """Drifted share of tested features, and the five with the largest PSI (equal to nine places: the last name first)."""
    tested = F.count_if(F.col("decision") != "insufficient_sample")
    drifted = F.count_if(F.col("decision") == "drift")
    top = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(F.col("psi").isNotNull(), F.struct(F.round("psi", 9).alias("psi"), "feature"))))), 1, 5)
    out = features.agg(tested.alias("tested"), drifted.alias("drifted"), top.alias("t"))
    rate = F.try_divide("drifted", "tested")
    return out.select("tested", "drifted", F.round(rate, 6).alias("rate"), (rate >= RATE_LIMIT).alias("drift"), F.array_join("t.feature", ",").alias("top"))


def psi_bands(features: DataFrame) -> DataFrame:
    band = F.when(F.col("psi") >= PSI_LIMIT, "significant").when(F.col("psi") >= 0.1, "watch").when(F.col("psi").isNotNull(), "little")
    return features.select("feature", F.round("psi", 5).alias("psi"), band.alias("band")).orderBy(F.desc_nulls_last("psi"), "feature")


def new_alerts(alerts: DataFrame, stored: DataFrame) -> DataFrame:
    """Alerts whose key isn't stored yet; keys join type, version and window."""
    keyed = alerts.withColumn("alert_key", F.concat_ws("|", "kind", "version", "window"))
    return keyed.join(stored.select("alert_key"), "alert_key", "left_anti")


def retraining_request(new: DataFrame) -> DataFrame:
    """One request for the sorted new alerts, named by their hash; none without new alerts."""
    out = new.agg(F.array_sort(F.collect_set("alert_key")).alias("keys"))
    return out.where(F.size("keys") > 0).select(F.sha2(F.array_join("keys", ","), 256).alias("request_key"), F.size("keys").alias("n_alerts"))


def label_performance(labelled: DataFrame, threshold: float, baseline_f1: float, least: int = 100, least_positives: int = 10, drop: float = 0.10) -> DataFrame:
    """Metrics on verified labels, or why there are too few; degraded if F1 fell by ``drop``."""
    from ledgerlens.operators.metrics import confusion

    out = confusion(labelled, threshold)
    n, y = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), F.col("tp") + F.col("fn")
    status = F.when((n < least) | (y < least_positives), "insufficient_labels").when(baseline_f1 - F.col("f1") >= drop, "degraded").otherwise("stable")
    return out.withColumn("status", status)
