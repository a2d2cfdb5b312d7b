"""Leakage-safe features: everything an account did strictly before each event."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import DAY, WEEK, FrozenParams, amounts, balances, one_hot, post_balances, safe_divide, temporal
from ledgerlens.operators.quantiles import values_of

WINDOWS = (1, DAY, WEEK)


def fit_params(df: DataFrame, train_end: int) -> FrozenParams:
    """Fit on ``step <= train_end``: one row of aggregates."""
    train = df.where(F.col("step") <= train_end)
    types = train.agg(F.sort_array(F.collect_set("type")).alias("types")).first()["types"]
    return FrozenParams(large_amount=values_of(train, ["amount"], [0.99]).get("amount", [None])[0], types=tuple(types))


def mark_new_pairs(df: DataFrame) -> DataFrame:
    """``is_new_pair``: the first event ever of its (sender, dest)."""
    first = F.min(F.struct("step", "event_id")).over(W.partitionBy("sender", "dest"))
    return df.withColumn("is_new_pair", (F.struct("step", "event_id") == first).cast("int"))


def past_windows(df: DataFrame, key: str, prefix: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """History of ``key`` strictly before each event in the order (step, event_id).

    A window of w hours is the events with step in (step - w, step] that come before: those of
    earlier steps by range, those of the same step by row. One shuffle and one sort serve all.
    """
    past = W.partitionBy(key).orderBy("step", "event_id").rowsBetween(W.unboundedPreceding, -1)
    same = W.partitionBy(key, "step").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)

    def recent(agg: Column, w: int) -> Column:
        here = F.coalesce(agg.over(same), F.lit(0))
        if w == 1:
            return here
        return here + F.coalesce(agg.over(W.partitionBy(key).orderBy("step").rangeBetween(-(w - 1), -1)), F.lit(0))

    new = F.sum("is_new_pair")
    out = {
        "prev_count": F.count("*").over(past),
        "prev_total": F.coalesce(F.sum("amount").over(past), F.lit(0.0)),
        "prev_mean": F.avg("amount").over(past),
        "prev_max": F.max("amount").over(past),
        "hours_since_prev": F.col("step") - F.lag("step").over(W.partitionBy(key).orderBy("step", "event_id")),
        "prev_partners": F.coalesce(new.over(past), F.lit(0)),
    }
    for w in windows:
        out[f"count_{w}h"] = recent(F.count("*"), w)
        if w > 1:
            out[f"sum_{w}h"] = recent(F.sum("amount"), w).cast("double")
            out[f"new_partners_{w}h"] = recent(new, w)
    return df.withColumns({f"{prefix}_{k}": v for k, v in out.items()})


def past_windows_hot(df: DataFrame, key: str, prefix: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """``past_windows`` for keys that may hold a large share of all rows.

    Events are summed by (key, step) first, so what a key's windows run over is a row a step;
    only the events of one step of one key meet in one place.
    """
    same = W.partitionBy(key, "step").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    steps = df.groupBy(key, "step").agg(F.count("*").alias("n"), F.sum("amount").alias("s"), F.max("amount").alias("m"), F.sum("is_new_pair").alias("f"))
    past = W.partitionBy(key).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    sums = {"bn": F.sum("n").over(past), "bs": F.sum("s").over(past), "bm": F.max("m").over(past), "bf": F.sum("f").over(past), "bl": F.lag("step").over(W.partitionBy(key).orderBy("step"))}
    for w in windows:
        if w > 1:
            span = W.partitionBy(key).orderBy("step").rangeBetween(-(w - 1), -1)
            sums |= {f"{x}{w}": F.sum(x).over(span) for x in ("n", "s", "f")}
    before = steps.select(key, "step", *[v.alias(k) for k, v in sums.items()])
    here = df.withColumns({"hn": F.count("*").over(same), "hs": F.sum("amount").over(same), "hm": F.max("amount").over(same), "hf": F.sum("is_new_pair").over(same)})
    both = here.join(before, [key, "step"])
    add = lambda a, b: F.coalesce(F.col(a), zero) + F.coalesce(F.col(b), zero)
    out = {
        "prev_count": add("hn", "bn"),
        "prev_total": add("hs", "bs").cast("double"),
        "prev_mean": safe_divide(add("hs", "bs"), add("hn", "bn")),
        "prev_max": F.greatest("hm", "bm"),
        "hours_since_prev": F.when(F.col("hn") > 0, F.lit(0)).otherwise(F.col("step") - F.col("bl")).cast("long"),
        "prev_partners": add("hf", "bf"),
    }
    for w in windows:
        out[f"count_{w}h"] = F.col("hn") if w == 1 else add("hn", f"n{w}")
        if w > 1:
            out[f"sum_{w}h"] = add("hs", f"s{w}").cast("double")
            out[f"new_partners_{w}h"] = add("hf", f"f{w}")
    return both.select(*df.columns, *[v.alias(f"{prefix}_{k}") for k, v in out.items()])


def build_features(df: DataFrame, params: FrozenParams, include_post: bool = False, hot: bool = False) -> DataFrame:
    """Time, amount, type and history features of every event; balance features where there are balances."""
    past = past_windows_hot if hot else past_windows
    out = mark_new_pairs(df)
    for key, prefix in (("sender", "sender"), ("dest", "dest")):
        out = past(out, key, prefix, params.windows)
        out = out.withColumn(f"amount_vs_{prefix}_mean", safe_divide(F.col("amount"), F.col(f"{prefix}_prev_mean")))
    columns = temporal() | one_hot("type", params.types)
    if "sender_old" in df.columns:
        columns |= amounts(params) | balances() | (post_balances(params) if include_post else {})
    else:
        columns |= {"log_amount": F.log1p(F.greatest("amount", F.lit(0.0))), "amount_large": (F.col("amount") >= params.large_amount).cast("int")}
    return out.withColumns(columns)


def history_as_of(history: DataFrame, probes: DataFrame, key: str = "sender") -> DataFrame:
    """History of each probe's account among events with ``step <= t``, and a status.

    An as-of join by window: probes are rows of their own that come last in their step.
    """
    rows = history.select(key, "step", "amount", F.lit(0).alias("probe"), F.lit(None).cast("long").alias("probe_id"))
    asked = probes.select(key, "step", F.lit(None).cast("double").alias("amount"), F.lit(1).alias("probe"), "probe_id")
    w = W.partitionBy(key).orderBy("step", "probe").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = rows.unionByName(asked).withColumns(
        {
            "prev_count": F.count("amount").over(w),
            "prev_total": F.coalesce(F.sum("amount").over(w), F.lit(0.0)),
            "prev_mean": F.avg("amount").over(w),
            "prev_max": F.max("amount").over(w),
            "hours_since_prev": F.col("step") - F.max(F.when(F.col("probe") == 0, F.col("step"))).over(w),
        }
    )
    status = F.when(F.col("prev_count") > 0, "prior_transactions").otherwise("no_prior_transactions")
    return both.where("probe = 1").withColumn("status", status).drop("probe", "amount")


def contract(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly the columns ``names`` in their order; an error names what is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the contract: {missing}")
    return df.select(*names)
