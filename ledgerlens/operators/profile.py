"""Profiles, audits and rates: one pass of conditional aggregates each, results in long form."""

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import digest_number, kurtosis, safe_divide, skewness
from ledgerlens.operators.prefix import null_safe
from ledgerlens.operators.quantiles import column_quantiles, distinct_edges, values_of, with_quantiles
from ledgerlens.sources.scratch import materialize


def unpivot_aggs(df: DataFrame, aggs: Mapping[str, Mapping[str, Column]], keys: Sequence[str] = (), name: str = "name") -> DataFrame:
    """Aggregates ``{row: {column: expression}}`` in one pass, one output row for each entry."""
    flat = [c.alias(f"{r}\x1f{k}") for r, cs in aggs.items() for k, c in cs.items()]
    wide = df.groupBy(*keys).agg(*flat) if keys else df.agg(*flat)
    rows = [F.struct(F.lit(r).alias(name), *[F.col(f"`{r}\x1f{k}`").alias(k) for k in cs]) for r, cs in aggs.items()]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def distinct_counts(rows: DataFrame, columns: Sequence[str], name: str, count: str = "n_distinct") -> DataFrame:
    """``(name, count)``: distinct values of each column of a written table, each column by itself.

    In one aggregate every row would come once for each column, and a task's table would hold all columns' values.
    """
    each = [rows.agg(F.lit(c).alias(name), F.countDistinct(c).alias(count)) for c in columns]
    return reduce(DataFrame.unionByName, each)


def with_distinct(df: DataFrame, aggs: Mapping[str, Mapping[str, Column]], name: str, count: str = "n_distinct", also: Sequence[str] = ()) -> DataFrame:
    """``unpivot_aggs`` with the distinct values of each row's column; only these columns, and those that the
    aggregates use ``also``, are written first."""
    rows = materialize(df.select(*dict.fromkeys([*aggs, *also])), "columns")
    return F.broadcast(distinct_counts(rows, list(aggs), name, count)).join(unpivot_aggs(rows, aggs, name=name), name)  # a row a column


def to_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row for each row and column: ``(*keep, feature, value)``."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.feature", "r.value")


def pct(part: Column, whole: Column) -> Column:
    return F.round(100 * safe_divide(part, whole), 4)


def overview(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values and missing cells of each column."""
    aggs = {c: {"n_missing": F.count_if(F.col(c).isNull()), "pct_missing": pct(F.count_if(F.col(c).isNull()), F.count("*"))} for c in columns}
    return with_distinct(df, aggs, "column_name")


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, quartiles by linear interpolation, IQR, skewness and kurtosis."""

    def of(c: str) -> dict[str, Column]:
        return {
            "n": F.count(c),
            "mean": F.round(F.avg(c), 4),
            "std": F.round(F.stddev_samp(c), 4),
            "min": F.min(c).cast("double"),
            "max": F.max(c).cast("double"),
            "skew": F.round(skewness(c), 3),
            "kurt": F.round(kurtosis(c), 3),
        }

    moments = unpivot_aggs(df, {c: of(c) for c in columns}, keys, name="column_name")
    out = with_quantiles(moments, df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys, "column_name")
    return out.withColumn("iqr", F.round(F.col("q3") - F.col("q1"), 4)).withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


def quality_audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows break each rule, in one pass."""
    return unpivot_aggs(df, {k: {"n_rows": F.count_if(c), "pct_rows": pct(F.count_if(c), F.count("*"))} for k, c in rules.items()}, name="rule")


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Surplus rows (the first of each kind not counted) and rows in any group of duplicates."""
    n = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return n.agg(F.sum(F.col("n") - 1).alias("surplus"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("involved"), F.count("*").alias("distinct_rows"))


def rate_by(df: DataFrame, *keys: str | Column, label: str = "label") -> DataFrame:
    """Rows, positives, rate, share of rows and of positives for each group."""
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.sum(label).cast("long").alias("positives"))
    everything = W.partitionBy()  # groups, not rows: few
    return out.select(
        *[c for c in out.columns if c not in ("total", "positives")],
        "total",
        "positives",
        (F.col("total") - F.col("positives")).alias("negatives"),
        pct(F.col("positives"), F.col("total")).alias("rate_pct"),
        pct(F.col("total"), F.sum("total").over(everything)).alias("share_pct"),
        pct(F.col("positives"), F.sum("positives").over(everything)).alias("share_positives_pct"),
    )


def account_profile(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Count, total, mean, maximum, exact median and positives of each account."""
    a = F.col("amount")
    out = df.groupBy(F.col(key).alias("account")).agg(F.count("*").alias("n"), F.sum(a).alias("total"), F.avg(a).alias("mean"), F.max(a).alias("max"), F.sum(label).cast("long").alias("positives"))
    halves = column_quantiles(df.withColumnRenamed(key, "account"), ["amount"], [0.5], ["account"])
    return null_safe(out, halves.select("account", F.col("q")[0].alias("median")), ["account"], "left")


def profile_summary(profile: DataFrame) -> DataFrame:
    n = F.col("n")
    metrics = {
        "accounts": F.count("*"),
        "repeated_pct": 100 * F.avg((n > 1).cast("int")),
        "mean_count": F.avg(n),
        "max_count": F.max(n),
        "mean_of_means": F.avg("mean"),
        "max_total": F.max("total"),
        "mean_total": F.avg("total"),
        "with_positives": F.count_if(F.col("positives") > 0),
        "several_positives": F.count_if(F.col("positives") > 1),
        "all_positive": F.count_if(F.col("positives") == n),
        "once_pct": 100 * F.avg((n == 1).cast("int")),
        "largest_amount": F.max("max"),
    }
    out = unpivot_aggs(profile, {k: {"value": F.round(v.cast("double"), 4)} for k, v in metrics.items()}, name="metric")
    name = F.when(F.col("feature") == "n", "median_count").otherwise("median_of_medians")
    return out.unionByName(column_quantiles(profile, ["n", "median"], [0.5]).select(name.alias("metric"), F.round(F.col("q")[0], 4).alias("value")))


def concentration(profile: DataFrame, share: float = 0.01) -> DataFrame:
    """Share of rows and positives held by the busiest accounts.

    Positives are those of all accounts with as many rows as one of the busiest.
    Accounts with equal counts are one row before they are ranked, so the ranking is over the
    distinct counts, of which there are few.
    """
    by_n = profile.groupBy("n").agg(F.count("*").alias("accounts"), F.sum("positives").alias("positives"))
    desc = W.orderBy(F.desc("n"))
    ranked = by_n.withColumn("before", F.sum("accounts").over(desc) - F.col("accounts"))
    ranked = ranked.withColumn("top", F.ceil(F.sum("accounts").over(W.partitionBy()) * share))
    taken = F.greatest(F.lit(0), F.least("accounts", F.col("top") - F.col("before")))
    return ranked.agg(
        F.max("top").alias("top_accounts"),
        pct(F.sum(taken * F.col("n")), F.sum(F.col("accounts") * F.col("n"))).alias("top_share_pct"),
        pct(F.max("n"), F.sum(F.col("accounts") * F.col("n"))).alias("busiest_share_pct"),
        pct(F.sum(F.when(F.col("before") < F.col("top"), F.col("positives"))), F.sum("positives")).alias("top_positives_pct"),
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Fences at 1.5 IQR, and what lies outside overall and by class.

    Two passes: exact quartiles of all columns (one row), then counts against them.
    """
    row = values_of(df, columns, [0.25, 0.75])
    aggs = {}
    for c in columns:
        q1, q3 = row.get(c, (None, None))
        lo, hi = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if q1 is not None else (None, None)
        out = (F.col(c) < lo) | (F.col(c) > hi)
        y = F.col(label) == 1
        aggs[c] = {
            "lower": F.round(F.lit(lo), 4),
            "upper": F.round(F.lit(hi), 4),
            "outliers": F.count_if(out),
            "outlier_pct": pct(F.count_if(out), F.count("*")),
            "in_positives_pct": pct(F.count_if(out & y), F.count_if(y)),
            "in_negatives_pct": pct(F.count_if(out & ~y), F.count_if(~y)),
            "rate_in_outliers_pct": pct(F.count_if(out & y), F.count_if(out)),
        }
    return unpivot_aggs(df, aggs, name="column_name")


def leakage_probes(df: DataFrame, conditions: Mapping[str, Column], label: str = "label") -> DataFrame:
    """Rate and lift of the label under each condition."""
    y, n = F.sum(label), F.count("*")
    aggs = {}
    for k, c in conditions.items():
        rows, hits = F.count_if(c), F.count_if(c & (F.col(label) == 1))
        aggs[k] = {"n_rows": rows, "positives": hits, "rate_pct": pct(hits, rows), "lift": F.round(safe_divide(safe_divide(hits, rows), safe_divide(y, n)), 4), "share_positives_pct": pct(hits, y)}
    return unpivot_aggs(df, aggs, name="condition")


def decile_rates(df: DataFrame, column: str, label: str = "label", bins: int = 10) -> DataFrame:
    """Rate of the label by quantile bin (left, right], edges exact and distinct."""
    edges = distinct_edges(values_of(df, [column], [i / bins for i in range(bins + 1)]).get(column))
    inner = edges[1:-1]
    bin_ = sum((F.col(column) > e).cast("int") for e in inner) if inner else F.lit(0)
    out = df.where(F.col(column).isNotNull()).groupBy(F.lit(bin_).alias("bin") if isinstance(bin_, int) else bin_.cast("int").alias("bin"))
    return out.agg(F.count("*").alias("total"), F.sum(label).cast("long").alias("positives"), F.round(F.min(column), 4).alias("lo"), F.round(F.max(column), 4).alias("hi")).withColumn("rate_pct", pct(F.col("positives"), F.col("total")))


def histogram(df: DataFrame, column: str, bins: int, tails: tuple[float, float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts; with ``tails`` values beyond these quantiles are pooled in the end bins."""
    if tails:
        lo, hi = values_of(df, [column], tails)[column]
    else:
        lo, hi = df.agg(F.min(column), F.max(column)).first()
    width = (hi - lo) / bins
    at = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(column)))
    bin_ = F.least(F.floor((at - lo) / width), F.lit(bins - 1)).cast("int") if width else F.lit(0)
    return df.where(F.col(column).isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers: the fences clipped to the data."""
    ends = df.groupBy(*keys).agg(F.lit(column).alias("feature"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    out = with_quantiles(ends, df, [column], {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    iqr = F.col("q3") - F.col("q1")
    return out.select(
        *keys, *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")],
        F.round(F.greatest("lo", F.col("q1") - 1.5 * iqr), 4).alias("whisker_lo"),
        F.round(F.least("hi", F.col("q3") + 1.5 * iqr), 4).alias("whisker_hi"),
    )


def dominant_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column and the share of the commonest; NULL counts as a value."""
    counts = to_long(df, columns).groupBy("feature", "value").agg(F.count("*").alias("n"))
    out = counts.groupBy("feature").agg(F.count("*").alias("n_distinct"), F.max("n").alias("top"), F.sum("n").alias("n"))
    share = F.col("top") / F.col("n")
    return out.select("feature", "n_distinct", F.round(share, 6).alias("top_share"), (F.col("n_distinct") <= 1).alias("constant"), (share >= 0.999).alias("near_zero_variance"))


def duplicate_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs of columns that are equal in every row: equal order-independent signatures, then compared."""
    sig = df.agg(*[F.sum(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0")), "event_id").cast("decimal(38,0)")).alias(c) for c in columns]).first()
    pairs = [(a, b) for a, b in combinations(columns, 2) if sig[a] == sig[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left_col string, right_col string, n_different long")
    aggs = {f"{a}|{b}": {"n_different": F.count_if(~F.col(a).eqNullSafe(F.col(b)))} for a, b in pairs}
    out = unpivot_aggs(df, aggs, name="pair").where("n_different = 0")
    return out.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("left_col"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("right_col"), "n_different")


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-independent fingerprint of a dataset: its rows' digests summed and joined by exclusive or."""
    kinds = dict(df.dtypes)
    h = digest_number(*[F.col(c).cast("decimal(38,6)") if kinds[c] in ("double", "float") else F.col(c) for c in columns])
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def cardinality(df: DataFrame, columns: Sequence[str], low: int = 50, mid: int = 1000, approximate: bool = False) -> DataFrame:
    """Cardinality level and whether a column looks like an identifier."""
    if approximate:
        out = unpivot_aggs(df, {c: {"n_distinct": F.approx_count_distinct(c), "n": F.count("*")} for c in columns}, name="column_name")
    else:
        out = with_distinct(df, {c: {"n": F.count("*")} for c in columns}, "column_name")
    ratio = F.col("n_distinct") / F.col("n")
    level = F.when(F.col("n_distinct") <= low, "low").when(F.col("n_distinct") <= mid, "medium").otherwise("high")
    return out.select("column_name", "n_distinct", F.round(ratio, 6).alias("ratio"), level.alias("level"), F.when(ratio > 0.5, "identifier").when(ratio > 0.05, "id-like").otherwise("feature").alias("kind"))


def full_audit(df: DataFrame, key: str, numeric: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """``rule, n_found, pct``: missing cells, rows with one, whole rows and ids that repeat, infinite and NaN
    values, and how many rows break each of ``rules``. Cells are counted against cells, rows against rows.

    One pass for all that a row shows by itself; repeats come from two aggregates that combine where rows are read.
    """
    columns, n = df.columns, F.count("*")
    missing = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) if c in numeric else F.col(c).isNull() for c in columns]
    cells = sum((m.cast("int") for m in missing), F.lit(0))
    number = [F.col(c).cast("double") for c in numeric]
    infinite, nans = (sum((F.coalesce(f(c), F.lit(False)).cast("int") for c in number), F.lit(0)) for f in (lambda c: F.abs(c) == float("inf"), F.isnan))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    of = lambda found, most: {"n_found": found.cast("long"), "pct": pct(found, most)}
    aggs = {"missing_cells": of(total(cells), n * len(columns)), "rows_with_missing": of(F.count_if(cells > 0), n), "infinite_values": of(total(infinite), n * len(numeric)), "nan_values": of(total(nans), n * len(numeric))}
    aggs |= {k: of(F.count_if(c), n) for k, c in rules.items()}
    out = unpivot_aggs(df, aggs, name="rule")
    for name, by in (("duplicate_rows", columns), ("duplicate_ids", [key])):
        groups = df.groupBy(*by).agg(n.alias("k"))
        out = out.unionByName(groups.agg(F.lit(name).alias("rule"), total(F.col("k") - 1).cast("long").alias("n_found"), pct(total(F.col("k") - 1), F.sum("k")).alias("pct")))
    return out


def feature_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, corrected skewness and kurtosis, and whether a column is binary or constant."""
    aggs = {c: {"skew": F.round(skewness(c), 3), "kurt": F.round(kurtosis(c), 3)} for c in columns}
    out = with_distinct(df, aggs, "column_name", "n_unique")
    return out.withColumns({"is_binary": F.col("n_unique") <= 2, "is_constant": F.col("n_unique") <= 1})


def positive_concentration(profile: DataFrame, top: int = 10, share: float = 0.01) -> DataFrame:
    """How far positives gather in few accounts: accounts that have any, the share of those with several, of the
    ``top`` accounts and of the top ``share`` of them.

    Accounts with equally many positives are one row before they are ranked.
    """
    by = profile.groupBy("positives").agg(F.count("*").alias("accounts"))
    everything = W.partitionBy()
    some = F.when(F.col("positives") > 0, F.col("accounts")).otherwise(0)
    by = by.withColumns({"all_accounts": F.sum("accounts").over(everything), "with_any": F.sum(some).over(everything), "total": F.sum(F.col("accounts") * F.col("positives")).over(everything)}).where("positives > 0")
    ranked = by.withColumn("before", F.sum("accounts").over(W.orderBy(F.desc("positives"))) - F.col("accounts"))
    held = lambda most: F.sum(F.greatest(F.lit(0), F.least(F.col("accounts"), most - F.col("before"))) * F.col("positives"))
    most = F.greatest(F.ceil(F.col("with_any") * share), F.lit(1))
    return ranked.agg(
        F.max("with_any").alias("accounts_with_positives"),
        pct(F.max("with_any"), F.max("all_accounts")).alias("accounts_pct"),
        pct(F.sum(F.when(F.col("positives") >= 2, F.col("accounts") * F.col("positives"))), F.max("total")).alias("in_repeated_pct"),
        pct(held(F.lit(top)), F.max("total")).alias("top_accounts_pct"),
        pct(held(most), F.max("total")).alias("top_share_pct"),
    )


def outlier_review(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Median, P99, P99.9 and maximum of the finite values of each column, and what lies beyond 1.5 IQR, by class."""
    finite = df.select(label, *[F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(c) for c in columns])
    row, aggs, y = values_of(finite, columns, [0.25, 0.5, 0.75, 0.99, 0.999]), {}, F.col(label) == 1
    for c in columns:
        if c in row:
            q1, q2, q3, p99, p999 = row[c]
            v = F.col(c)
            out, ok = (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1)), v.isNotNull()
            share = lambda of, out=out, ok=ok: pct(F.count_if(out & of), F.count_if(ok & of))
            aggs[c] = {"defined_rows": F.count(c), "median": F.round(F.lit(q2), 4), "p99": F.round(F.lit(p99), 4), "p999": F.round(F.lit(p999), 4), "max": F.round(F.max(c), 4), "outlier_pct": share(F.lit(True)), "in_positives_pct": share(y), "in_negatives_pct": share(~y)}
    return unpivot_aggs(finite, aggs, name="feature")


def null_table(df: DataFrame, columns: Sequence[str], by_design: Sequence[str]) -> DataFrame:
    """Nulls and infinities of each feature, and what to make of them: a name with a part in ``by_design`` may have nulls."""
    number = lambda c: F.col(c).cast("double")
    null = lambda c: F.count_if(F.col(c).isNull() | F.isnan(number(c)))
    aggs = {c: {"n_null": null(c), "null_pct": pct(null(c), F.count("*")), "n_infinite": F.count_if(F.abs(number(c)) == float("inf")), "by_design": F.lit(any(k in c for k in by_design))} for c in columns}
    out = unpivot_aggs(df, aggs, name="feature")
    treatment = F.when(F.col("n_null") == 0, "none").when(F.col("by_design"), "undefined").otherwise("unexpected")
    return out.withColumn("treatment", treatment)
