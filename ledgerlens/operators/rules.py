"""Gates and decisions on typed rows: flags, ranges, windows, provenance, acceptance, positions, late rows."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.labels import reasons
from ledgerlens.operators.profile import unpivot_aggs


def flag_columns(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Add rule flags as 0 or 1; a condition that is NULL stays NULL."""
    return df.withColumns({k: c.cast("int") for k, c in flags.items()})


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None, bool]]) -> DataFrame:
    """Add ``violations``: per column ``(least, most, optional)``, what a row breaks; NULL breaks only what isn't optional."""
    rules = {}
    for c, (least, most, optional) in ranges.items():
        if not optional:
            rules[f"{c}_missing"] = F.col(c).isNull()
        if least is not None:
            rules[f"{c}_below"] = F.col(c) < least
        if most is not None:
            rules[f"{c}_above"] = F.col(c) > most
    return df.withColumn("violations", reasons(rules))


def resolve_windows(splits: DataFrame, reference: str = "train", recent: str = "test") -> DataFrame:
    """``window, first_step, last_step, n`` from split metadata ``(split, first_step, last_step, n)``: the
    reference, the recent window and, between them, the gap that belongs to neither."""
    at = lambda name, c: F.max(F.when(F.col("split") == name, F.col(c)))
    one = splits.agg(at(reference, "first_step").alias("a"), at(reference, "last_step").alias("b"), at(recent, "first_step").alias("c"), at(recent, "last_step").alias("d"), at(reference, "n").alias("m"), at(recent, "n").alias("n"))
    row = lambda name, x, y, n: F.struct(F.lit(name).alias("window"), x.alias("first_step"), y.alias("last_step"), n.alias("n"))
    gap = row("gap", F.col("b") + 1, F.col("c") - 1, F.lit(None).cast("long"))
    rows = F.array(row("reference", F.col("a"), F.col("b"), F.col("m")), gap, row("recent", F.col("c"), F.col("d"), F.col("n")))
    return one.select(F.explode(rows).alias("r")).select("r.*").where("first_step <= last_step")


def drift_inputs(df: DataFrame, features: Sequence[str], forbidden: Sequence[str], recent: Column) -> DataFrame:
    """``check, passed``: no label among the features, all features there, each with values, reference before recent."""
    values = {f"{c}_has_values": F.count(c) > 0 for c in features if c in df.columns}
    order = F.max(F.when(~recent, F.col("step"))) < F.min(F.when(recent, F.col("step")))
    checks = {
        "labels_absent": F.lit(not set(features) & set(forbidden)),
        "columns_present": F.lit(set(features) <= set(df.columns)),
        "reference_precedes_recent": F.coalesce(order, F.lit(False)),
    }
    return unpivot_aggs(df, {k: {"passed": c} for k, c in (checks | values).items()}, name="check")


def position_claims(log: DataFrame, key: str, position: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``claim``: a position of the log belongs to the key that used it first; another key there is
    a conflict, once for each key, and its repeats are conflict_repeat."""
    at = F.struct(*order)
    first = log.groupBy(*position).agg(F.min_by(key, F.struct(*order, key)).alias("__owner"))
    seen = log.groupBy(*position, key).agg(F.min(at).alias("__seen"))
    out = log.join(first, list(position)).join(seen, [*position, key])
    is_first, owns = at == F.col("__seen"), F.col(key) == F.col("__owner")
    claim = F.when(owns & is_first, "registered").when(owns, "duplicate").when(is_first, "conflict").otherwise("conflict_repeat")
    return out.withColumn("claim", claim).drop("__owner", "__seen")


def provenance(df: DataFrame, manifest: DataFrame, measures: Mapping[str, Column], synthetic: Column) -> DataFrame:
    """``check, expected, found, passed``: what a dataset's one-row manifest says, measured again, and
    that no row is marked synthetic."""
    found = df.agg(*[m.alias(f"found_{k}") for k, m in measures.items()], F.count_if(F.coalesce(synthetic, F.lit(False))).alias("found_synthetic"))
    both = found.withColumn("k", F.lit(1)).join(manifest.withColumn("k", F.lit(1)), "k")
    rows = [F.struct(F.lit(k).alias("check"), (F.col(k) if k in measures else F.lit(0)).cast("double").alias("expected"), F.col(f"found_{k}").cast("double").alias("found")) for k in [*measures, "synthetic"]]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("passed", F.col("expected") == F.col("found"))


def acceptance(pair: DataFrame) -> DataFrame:
    """``policy, accepted, reasons`` from one row of champion and candidate counts and metrics
    (``f1, recall, fp, fn`` with suffixes ``_champion, _candidate``)."""
    c = F.col
    delta = lambda m: c(f"{m}_candidate") - c(f"{m}_champion")
    policies = {
        "min_deltas": {"f1_gain_below_0.01": delta("f1") < 0.01, "recall_falls": delta("recall") < 0},
        "capped": {"f1_falls": delta("f1") < 0, "more_false_positives_than_1.1x": c("fp_candidate") > 1.1 * c("fp_champion"), "more_misses": c("fn_candidate") > c("fn_champion")},
        "non_inferior": {"f1_below_by_0.02": delta("f1") < -0.02, "recall_below_by_0.02": delta("recall") < -0.02},
        "regression": {"f1_regression_over_0.02": delta("f1") < -0.02, "recall_below_0.80": c("recall_candidate") < 0.80},
    }
    rows = [F.struct(F.lit(k).alias("policy"), F.array_join(reasons(r), ",").alias("reasons")) for k, r in policies.items()]
    return pair.select(F.explode(F.array(*rows)).alias("r")).select("r.policy", (F.col("r.reasons") == "").alias("accepted"), "r.reasons")


def leaks(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """``column_name, forbidden, n_present`` for each column: names that a payload must not have, and how many rows have them."""
    out = unpivot_aggs(df, {c: {"n_present": F.count(c)} for c in df.columns}, name="column_name")
    return out.withColumn("forbidden", F.col("column_name").isin(*forbidden))


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``key, matches, outcome`` of each key looked up: found, missing, or ambiguous where several rows have it."""
    n = df.join(keys.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("matches"))
    out = keys.select(key).distinct().join(n, key, "left").fillna(0, ["matches"])
    return out.withColumn("outcome", F.when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "found").otherwise("ambiguous"))
