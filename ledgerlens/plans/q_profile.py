"""Queries on features, profiles and audits."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.functions.scalars import risk_level, risk_score, safe_divide, suffix_number
from ledgerlens.operators import correlation as co
from ledgerlens.operators import features as ft
from ledgerlens.operators import joins as jn
from ledgerlens.operators import profile as pf
from ledgerlens.operators.quantiles import column_quantiles, with_quantiles
from ledgerlens.plans.views import EVT, ORD, cut, cut_sql, digest_sql, evt, ords, read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


TYPES = ("click", "error", "purchase", "signup", "view")
HISTORY = ("prev_count", "prev_total", "prev_mean", "prev_max", "hours_since_prev", "prev_partners", "count_1h", "count_24h", "sum_24h", "new_partners_24h", "count_168h", "sum_168h", "new_partners_168h")
SUMS = {"prev_total", "prev_mean", "prev_max", "sum_24h", "sum_168h"}


def _past_sql(key: str, p: str) -> str:
    past = f"(PARTITION BY {key} ORDER BY step, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    same = f"(PARTITION BY {key}, step ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    out = [
        f"count(*) OVER {past} AS {p}_prev_count",
        f"round(coalesce(sum(amount) OVER {past}, 0), 4) AS {p}_prev_total",
        f"{cut_sql(f'avg(amount) OVER {past}')} AS {p}_prev_mean",
        f"round(max(amount) OVER {past}, 4) AS {p}_prev_max",
        f"step - lag(step) OVER (PARTITION BY {key} ORDER BY step, event_id) AS {p}_hours_since_prev",
        f"CAST(coalesce(sum(is_new_pair) OVER {past}, 0) AS BIGINT) AS {p}_prev_partners",
        f"count(*) OVER {same} AS {p}_count_1h",
    ]
    for w in (24, 168):
        r = f"(PARTITION BY {key} ORDER BY step RANGE BETWEEN {w - 1} PRECEDING AND 1 PRECEDING)"
        out += [
            f"count(*) OVER {r} + count(*) OVER {same} AS {p}_count_{w}h",
            f"round(coalesce(sum(amount) OVER {r}, 0) + coalesce(sum(amount) OVER {same}, 0), 4) AS {p}_sum_{w}h",
            f"CAST(coalesce(sum(is_new_pair) OVER {r}, 0) + coalesce(sum(is_new_pair) OVER {same}, 0) AS BIGINT) AS {p}_new_partners_{w}h",
        ]
    return ", ".join(out)


FEATURES_SQL = f"""WITH {EVT}, f AS (SELECT *, CAST(row_number() OVER (PARTITION BY sender, dest ORDER BY step, event_id) = 1 AS INTEGER) AS is_new_pair FROM evt),
k AS (SELECT quantile_cont(amount, 0.99) AS p99 FROM evt WHERE step <= 504)
SELECT event_id, step, is_new_pair, (step - 1) % 24 AS hour, round(ln(1 + greatest(amount, 0)), 6) AS log_amount, CAST(amount >= p99 AS INTEGER) AS amount_large,
{", ".join(f"CAST(type = '{t}' AS INTEGER) AS type_{t}" for t in TYPES)}, {_past_sql("sender", "sender")}, {_past_sql("dest", "dest")} FROM f, k"""


def _features(spark, sf_dir, hot):
    df = evt(spark, sf_dir).drop("label")
    out = ft.build_features(df, ft.fit_params(df, 504), hot=hot)
    cols = ["event_id", "step", "is_new_pair", "hour", F.round("log_amount", 6).alias("log_amount"), "amount_large", *[f"type_{t}" for t in TYPES]]
    for p in ("sender", "dest"):
        cols += [cut(f"{p}_{h}").alias(f"{p}_{h}") if h == "prev_mean" else F.round(f"{p}_{h}", 4).alias(f"{p}_{h}") if h in SUMS else F.col(f"{p}_{h}") for h in HISTORY]
    return out.select(*cols)


@query(FEATURES_SQL)
def event_features(spark, sf_dir):
    return _features(spark, sf_dir, hot=False)


@query(FEATURES_SQL)
def event_features_hot_keys(spark, sf_dir):
    return _features(spark, sf_dir, hot=True)


@query(f"""WITH {ORD}, k AS (SELECT quantile_cont(amount, 0.99) AS p99 FROM ord WHERE step <= 1500)
SELECT event_id, (step - 1) % 24 AS hour, round(sin(((step - 1) % 24) * 2 * pi() / 24), 6) AS hour_sin, round(cos(((step - 1) % 24) * 2 * pi() / 24), 6) AS hour_cos,
CAST(floor(((step - 1) % 24) / 6) AS BIGINT) AS day_part, CAST(floor((step - 1) / 24) AS BIGINT) AS day, CAST(amount = 0 AS INTEGER) AS amount_zero, CAST(amount >= p99 AS INTEGER) AS amount_large,
{cut_sql('CASE WHEN sender_old > 0 THEN amount / sender_old END')} AS amount_to_sender, {cut_sql('CASE WHEN dest_old > 0 THEN amount / dest_old END')} AS amount_to_dest,
CAST(amount >= sender_old - 0.01 AND sender_old > 0 AS INTEGER) AS empties_sender, round(sender_old - amount, 4) AS sender_remaining,
CAST(sender_old = 0 AS INTEGER) AS sender_zero, CAST(dest_old = 0 AS INTEGER) AS dest_zero, round(ln(1 + greatest(sender_old, 0)), 6) AS log_sender, round(ln(1 + greatest(dest_old, 0)), 6) AS log_dest
FROM ord, k""")
def order_features(spark, sf_dir):
    from ledgerlens.functions.scalars import amounts, balances, temporal

    df = ords(spark, sf_dir)
    cols = temporal() | amounts(ft.fit_params(df, 1500)) | balances()
    cols.pop("log_amount")
    six = {"hour_sin", "hour_cos", "log_sender", "log_dest"}
    four = {"amount_to_sender", "amount_to_dest"}
    return df.select("event_id", *[(F.round(c, 6) if n in six else cut(c) if n in four else F.round(c, 4) if n == "sender_remaining" else c).alias(n) for n, c in cols.items()])


@query(f"""WITH {ORD} SELECT event_id, round(sender_new - sender_old, 4) AS sender_change, round(dest_new - dest_old, 4) AS dest_change,
round(CASE WHEN sender_old > 0 THEN (sender_new - sender_old) / sender_old END, 4) AS sender_change_ratio, round(CASE WHEN dest_old > 0 THEN (dest_new - dest_old) / dest_old END, 4) AS dest_change_ratio,
CAST(abs(sender_new) <= 0.01 AS INTEGER) AS sender_zero_after, CAST(abs(sender_old - amount - sender_new) <= 0.01 AS INTEGER) AS sender_consistent,
CAST(abs(dest_old + amount - dest_new) <= 0.01 AS INTEGER) AS dest_consistent FROM ord""")
def order_post_features(spark, sf_dir):
    from ledgerlens.functions.scalars import FrozenParams, post_balances

    cols = post_balances(FrozenParams(0.0, ()))
    return ords(spark, sf_dir).select("event_id", *[(c if n.endswith(("after", "consistent")) else F.round(c, 4)).alias(n) for n, c in cols.items()])


@query(f"""WITH {EVT}, p AS (SELECT event_id AS probe_id, dest, step FROM evt)
SELECT probe_id, p.dest, p.step, count(e.amount) AS prev_count, round(coalesce(sum(e.amount), 0), 4) AS prev_total, {cut_sql('avg(e.amount)')} AS prev_mean, max(e.amount) AS prev_max,
p.step - max(e.step) AS hours_since_prev, CASE WHEN count(e.amount) > 0 THEN 'prior_transactions' ELSE 'no_prior_transactions' END AS status
FROM p LEFT JOIN evt e ON e.dest = p.dest AND e.step <= p.step GROUP BY probe_id, p.dest, p.step""")
def history_as_of(spark, sf_dir):
    e = evt(spark, sf_dir)
    probes = e.select(F.col("event_id").alias("probe_id"), "dest", "step")
    out = ft.history_as_of(e, probes, "dest")
    return out.withColumns({"prev_total": F.round("prev_total", 4), "prev_mean": cut("prev_mean")})


@query(f"""WITH {EVT}
SELECT p.event_id AS probe_id, p.sender, p.step, count(e.amount) AS prev_count, round(coalesce(sum(e.amount), 0), 4) AS prev_total, {cut_sql('avg(e.amount)')} AS prev_mean, max(e.amount) AS prev_max,
p.step - max(e.step) AS hours_since_prev, CASE WHEN count(e.amount) > 0 THEN 'prior_transactions' ELSE 'no_prior_transactions' END AS status
FROM evt p LEFT JOIN evt e ON e.sender = p.sender AND e.step <= p.step GROUP BY p.event_id, p.sender, p.step""")
def history_as_of_all(spark, sf_dir):
    e = evt(spark, sf_dir)
    out = ft.history_as_of(e, e.select(F.col("event_id").alias("probe_id"), "sender", "step"))
    return out.withColumns({"prev_total": F.round("prev_total", 4), "prev_mean": cut("prev_mean")})


COLS = ("event_id", "step", "type", "amount", "sender", "dest", "label")


@query(f"WITH {EVT} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(*) FILTER ({c} IS NULL) AS n_missing, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4) AS pct_missing FROM evt" for c in COLS))
def column_overview(spark, sf_dir):
    return pf.overview(evt(spark, sf_dir), COLS)


NUM = ("amount", "sender_old", "dest_old")
_DESC = """count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS "min", round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
round(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS "max", round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, round(skewness({c}), 3) AS skew, round(kurtosis({c}), 3) AS kurt"""


@query(f"WITH {ORD} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_DESC.format(c=c)} FROM ord" for c in NUM))
def numeric_describe(spark, sf_dir):
    return pf.describe(ords(spark, sf_dir), NUM)


@query(f"WITH {ORD} " + " UNION ALL ".join(f"SELECT label, '{c}' AS column_name, {_DESC.format(c=c)} FROM ord GROUP BY label" for c in NUM))
def describe_by_class(spark, sf_dir):
    return pf.describe(ords(spark, sf_dir), NUM, ["label"])


AUDIT = {
    "negative_amount": "amount < 0",
    "zero_amount": "amount = 0",
    "missing_amount": "amount IS NULL",
    "missing_dest": "dest IS NULL",
    "bad_step": "step < 1 OR step IS NULL",
    "unexpected_type": "type NOT IN ('click', 'purchase', 'view')",
    "label_not_binary": "label NOT IN (0, 1)",
    "self_transfer": "sender = dest",
}


@query(f"WITH {EVT} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({c}) AS n_rows, round(100.0 * count(*) FILTER ({c}) / count(*), 4) AS pct_rows FROM evt" for k, c in AUDIT.items()))
def quality_audit(spark, sf_dir):
    return pf.quality_audit(evt(spark, sf_dir), {k: F.expr(c) for k, c in AUDIT.items()})


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS surplus, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS involved, count(*) AS distinct_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_rows(spark, sf_dir):
    return pf.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


RATE = """count(*) AS total, CAST(sum(label) AS BIGINT) AS positives, count(*) - CAST(sum(label) AS BIGINT) AS negatives, round(100.0 * sum(label) / count(*), 4) AS rate_pct,
round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share_pct, round(100.0 * sum(label) / sum(sum(label)) OVER (), 4) AS share_positives_pct"""


@query(f"WITH {ORD} SELECT type, {RATE} FROM ord GROUP BY type")
def rate_by_type(spark, sf_dir):
    return pf.rate_by(ords(spark, sf_dir), "type")


@query(f"WITH {EVT} SELECT step, {RATE} FROM evt GROUP BY step")
def rate_by_step(spark, sf_dir):
    return pf.rate_by(evt(spark, sf_dir), "step")


@query(f"WITH {EVT} SELECT CAST(floor((step - 1) / 24) AS BIGINT) AS day, {RATE} FROM evt GROUP BY 1")
def rate_by_day(spark, sf_dir):
    return pf.rate_by(evt(spark, sf_dir), F.floor((F.col("step") - 1) / 24).alias("day"))


@query(f"WITH {EVT} SELECT (step - 1) % 24 AS hour, {RATE} FROM evt GROUP BY 1")
def rate_by_hour(spark, sf_dir):
    return pf.rate_by(evt(spark, sf_dir), F.pmod(F.col("step") - 1, F.lit(24)).alias("hour"))


@query(f"WITH {EVT} SELECT count(*) AS total, CAST(sum(label) AS BIGINT) AS positives, round(100.0 * avg(label), 4) AS rate_pct, round((count(*) - sum(label)) / sum(label), 4) AS imbalance FROM evt")
def target_distribution(spark, sf_dir):
    n, y = F.count("*"), F.sum("label")
    return evt(spark, sf_dir).agg(n.alias("total"), y.cast("long").alias("positives"), F.round(100 * F.avg("label"), 4).alias("rate_pct"), F.round(safe_divide(n - y, y), 4).alias("imbalance"))


@query(f"WITH {EVT} SELECT CAST(floor((step - 1) / 24) AS BIGINT) AS day, " + ", ".join(f"count(*) FILTER (type = '{t}') AS {t}" for t in TYPES) + " FROM evt GROUP BY 1")
def type_by_day(spark, sf_dir):
    days = evt(spark, sf_dir).groupBy(F.floor((F.col("step") - 1) / 24).alias("day")).pivot("type", list(TYPES)).count()
    return days.fillna(0)


@query(f"WITH {EVT} SELECT sender AS account, count(*) AS n, round(sum(amount), 4) AS total, round(avg(amount), 4) AS mean, max(amount) AS max, round(quantile_cont(amount, 0.5), 4) AS median, CAST(sum(label) AS BIGINT) AS positives FROM evt GROUP BY sender")
def account_profile(spark, sf_dir):
    out = pf.account_profile(evt(spark, sf_dir), "sender")
    return out.withColumns({c: F.round(c, 4) for c in ("total", "mean", "median")})


PROFILE = "prof AS (SELECT dest AS account, count(*) AS n, sum(amount) AS total, avg(amount) AS mean, max(amount) AS max, quantile_cont(amount, 0.5) AS median, sum(label) AS positives FROM evt GROUP BY dest)"
METRICS = {
    "accounts": "count(*)", "repeated_pct": "100.0 * avg(CAST(n > 1 AS INTEGER))", "mean_count": "avg(n)", "median_count": "quantile_cont(n, 0.5)", "max_count": "max(n)", "mean_of_means": "avg(mean)",
    "median_of_medians": "quantile_cont(median, 0.5)", "max_total": "max(total)", "mean_total": "avg(total)", "with_positives": "count(*) FILTER (positives > 0)",
    "several_positives": "count(*) FILTER (positives > 1)", "all_positive": "count(*) FILTER (positives = n)", "once_pct": "100.0 * avg(CAST(n = 1 AS INTEGER))", "largest_amount": "max(max)",
}


@query(f"WITH {EVT}, {PROFILE} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, round(CAST({v} AS DOUBLE), 4) AS value FROM prof" for k, v in METRICS.items()))
def profile_summary(spark, sf_dir):
    return pf.profile_summary(pf.account_profile(evt(spark, sf_dir), "dest"))


@query(f"""WITH {ORD}, prof AS (SELECT sender, count(*) AS n, sum(label) AS y FROM ord GROUP BY sender), r AS (SELECT n, y, row_number() OVER (ORDER BY n DESC, sender) AS i, ceil(count(*) OVER () * 0.01) AS top FROM prof)
SELECT CAST(max(top) AS BIGINT) AS top_accounts, round(100.0 * sum(n) FILTER (i <= top) / sum(n), 4) AS top_share_pct, round(100.0 * max(n) / sum(n), 4) AS busiest_share_pct, round(100.0 * sum(y) FILTER (n >= (SELECT min(n) FROM r WHERE i <= top)) / sum(y), 4) AS top_positives_pct FROM r""")
def account_concentration(spark, sf_dir):
    return pf.concentration(pf.account_profile(ords(spark, sf_dir), "sender"))


@query(f"""WITH {ORD}, c AS (SELECT label, count(*) OVER (PARTITION BY sender) AS k FROM ord)
SELECT label, count(*) AS n, round(avg(k), 4) AS mean, round(quantile_cont(k, 0.5), 4) AS median, max(k) AS "max", round(100.0 * avg(CAST(k > 1 AS INTEGER)), 4) AS repeat_pct FROM c GROUP BY label""")
def frequency_by_class(spark, sf_dir):
    by = ords(spark, sf_dir).groupBy("sender", "label").agg(F.count("*").alias("n"))
    df = jn.with_totals(by, ["sender"], {"k": F.sum("n")})  # a row an account and class
    mean = lambda c: F.sum(c * F.col("n")) / F.sum("n")
    out = df.groupBy("label").agg(F.sum("n").alias("n"), F.round(mean(F.col("k")), 4).alias("mean"), F.max("k").alias("max"), F.round(100 * mean((F.col("k") > 1).cast("int")), 4).alias("repeat_pct"))
    median = column_quantiles(df, ["k"], [0.5], ["label"], weight="n").select("label", F.round(F.col("q")[0], 4).alias("median"))
    return out.join(median, "label")


FLAGS = {
    "sender_exact": "abs(sender_old - amount - sender_new) <= 0.01",
    "dest_exact": "abs(dest_old + amount - dest_new) <= 0.01",
    "sender_unchanged": "abs(sender_old - sender_new) <= 0.01",
    "dest_unchanged": "abs(dest_old - dest_new) <= 0.01",
    "sender_was_zero": "sender_old = 0",
    "amount_over_balance": "amount > sender_old",
    "dest_was_zero": "dest_old = 0",
    "sender_emptied": "sender_old > 0 AND sender_new <= 0",
    "both_exact": "abs(sender_old - amount - sender_new) <= 0.01 AND abs(dest_old + amount - dest_new) <= 0.01",
    "neither_exact": "abs(sender_old - amount - sender_new) > 0.01 AND abs(dest_old + amount - dest_new) > 0.01",
    "negative_balance": "sender_new < 0 OR dest_new < 0",
}


@query(f"WITH {ORD} SELECT type, label, count(*) AS n, " + ", ".join(f"round(100.0 * avg(CAST({c} AS INTEGER)), 4) AS {k}" for k, c in FLAGS.items()) + " FROM ord GROUP BY GROUPING SETS ((), (type), (label))")
def balance_consistency(spark, sf_dir):
    df = ords(spark, sf_dir).select("type", "label", *[F.expr(f"CAST({c} AS INT)").alias(k) for k, c in FLAGS.items()])
    return df.groupingSets([[], ["type"], ["label"]], "type", "label").agg(F.count("*").alias("n"), *[F.round(100 * F.avg(k), 4).alias(k) for k in FLAGS])


@query(f"""WITH {EVT} SELECT type = 'purchase' AS flag, count(*) FILTER (amount > 100) AS positives, count(*) FILTER (amount <= 100) AS negatives,
round(100.0 * count(*) FILTER (amount > 100) / count(*), 4) AS precision_pct, round(100.0 * count(*) FILTER (amount > 100) / sum(count(*) FILTER (amount > 100)) OVER (), 4) AS coverage_pct FROM evt GROUP BY 1""")
def rule_flag_contingency(spark, sf_dir):
    y = F.count_if(F.col("amount") > 100)
    out = evt(spark, sf_dir).groupBy((F.col("type") == "purchase").alias("flag")).agg(y.alias("positives"), F.count_if(F.col("amount") <= 100).alias("negatives"), F.count("*").alias("n"))
    return out.select("flag", "positives", "negatives", pf.pct(F.col("positives"), F.col("n")).alias("precision_pct"), pf.pct(F.col("positives"), F.sum("positives").over(W.partitionBy())).alias("coverage_pct"))


CORR = ("amount", "sender_old", "sender_new", "dest_old", "dest_new", "label")


@query(f"WITH {ORD} " + " UNION ALL ".join(f"SELECT '{a}' AS left_col, '{b}' AS right_col, round(corr({a}, {b}), 6) AS corr FROM ord" for i, a in enumerate(CORR) for b in CORR[i + 1 :]))
def correlation_pairs(spark, sf_dir):
    return co.correlations(ords(spark, sf_dir), CORR).select("left_col", "right_col", F.round("corr", 6).alias("corr"))


DELTAS = {"sender_delta": "sender_new - sender_old", "dest_delta": "dest_new - dest_old", "sender_error": "sender_old - amount - sender_new", "over": "CASE WHEN amount > sender_old THEN amount - sender_old END"}
MATRIX = (*CORR, *DELTAS)
DELTA_SQL = f"{ORD}, dl AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in DELTAS.items())} FROM ord)"


def _pairs_sql(columns, table):
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return "pr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS left_col, '{b}' AS right_col, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS corr FROM {table}" for a, b in pairs) + ")"


def _with_deltas(spark, sf_dir):
    return ords(spark, sf_dir).withColumns({k: F.expr(v) for k, v in DELTAS.items()})


@query(f"WITH {DELTA_SQL}, {_pairs_sql(MATRIX, 'dl')} SELECT left_col, right_col, n, round(corr, 6) AS corr FROM pr")
def correlation_matrix(spark, sf_dir):
    """Balances, their changes and errors, the last of which has nulls: each pair over the rows that have both."""
    return co.correlations(_with_deltas(spark, sf_dir), MATRIX).withColumn("corr", F.round("corr", 6))


@query(f"WITH {DELTA_SQL}, {_pairs_sql(MATRIX, 'dl')} SELECT left_col, right_col, n, round(corr, 6) AS corr FROM pr WHERE abs(corr) >= 0.9")
def high_correlations(spark, sf_dir):
    return co.above(co.correlations(_with_deltas(spark, sf_dir), MATRIX), 0.9).withColumn("corr", F.round("corr", 6))


FEATURE_SQL = {
    "hour": "(step - 1) % 24", "day": "floor((step - 1) / 24)", "log_amount": "ln(1 + greatest(amount, 0))", "amount": "amount", "amount_to_sender": "CASE WHEN sender_old > 0 THEN amount / sender_old END",
    "sender_remaining": "sender_old - amount", "log_sender": "ln(1 + greatest(sender_old, 0))", "log_dest": "ln(1 + greatest(dest_old, 0))", "sender_old": "sender_old", "step": "step", "label": "label",
}


def _audited(spark, sf_dir):
    from ledgerlens.functions.scalars import FrozenParams, amounts, balances, temporal

    return ords(spark, sf_dir).withColumns(temporal() | amounts(FrozenParams(0.0, ())) | balances())


FEATURE_PAIRS = f"{ORD}, ft AS (SELECT {', '.join(f'{v} AS {k}' for k, v in FEATURE_SQL.items())} FROM ord), {_pairs_sql(tuple(FEATURE_SQL), 'ft')}"


@query(f"WITH {FEATURE_PAIRS} SELECT left_col, right_col, round(corr, 6) AS corr FROM pr WHERE abs(corr) >= 0.98 AND right_col <> 'label'")
def redundant_features(spark, sf_dir):
    """Pairs of features of which one says what the other says, over all rows."""
    pairs = co.correlations(_audited(spark, sf_dir), [c for c in FEATURE_SQL if c != "label"])
    return co.above(pairs, 0.98).select("left_col", "right_col", F.round("corr", 6).alias("corr"))


@query(f"WITH {FEATURE_PAIRS} SELECT left_col AS feature, round(abs(corr), 6) AS abs_corr, coalesce(abs(corr) >= 0.98, false) AS leaks FROM pr WHERE right_col = 'label'")
def label_correlations(spark, sf_dir):
    return co.with_label(_audited(spark, sf_dir), [c for c in FEATURE_SQL if c != "label"]).withColumn("abs_corr", F.round("abs_corr", 6))


def _iqr_sql(c: str) -> str:
    o = f"({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
    f = lambda x: f"count(*) FILTER ({x})"
    return f"""SELECT '{c}' AS column_name, round(min(q1 - 1.5 * (q3 - q1)), 4) AS lower, round(min(q3 + 1.5 * (q3 - q1)), 4) AS upper, {f(o)} AS outliers, round(100.0 * {f(o)} / count(*), 4) AS outlier_pct,
round(100.0 * {f(o + " AND label = 1")} / {f("label = 1")}, 4) AS in_positives_pct, round(100.0 * {f(o + " AND label = 0")} / {f("label = 0")}, 4) AS in_negatives_pct,
round(100.0 * {f(o + " AND label = 1")} / nullif({f(o)}, 0), 4) AS rate_in_outliers_pct FROM ord, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ord)"""


@query(f"WITH {ORD} " + " UNION ALL ".join(map(_iqr_sql, NUM)))
def iqr_outliers(spark, sf_dir):
    return pf.iqr_outliers(ords(spark, sf_dir), NUM)


@query(f"""WITH {ORD}, c AS (SELECT label, round(quantile_cont(amount, 0.5), 4) AS median_amount, round(avg(amount), 4) AS mean_amount, round(100.0 * avg(CAST(sender_old <= 0 AS INTEGER)), 4) AS zero_pct FROM ord GROUP BY label)
SELECT p.median_amount AS positive_median, n.median_amount AS negative_median, round(p.mean_amount / n.mean_amount, 4) AS mean_ratio, p.zero_pct AS positive_zero_pct, n.zero_pct AS negative_zero_pct FROM c p, c n WHERE p.label = 1 AND n.label = 0""")
def class_comparison(spark, sf_dir):
    zero = 100 * F.avg((F.col("sender_old") <= 0).cast("int"))
    o = ords(spark, sf_dir)
    each = o.groupBy("label").agg(F.lit("amount").alias("feature"), F.round(F.avg("amount"), 4).alias("mean"), F.round(zero, 4).alias("zero"))
    each = with_quantiles(each, o, ["amount"], {"median": 0.5}, ["label"])
    out = each.groupBy().pivot("label", [1, 0]).agg(F.round(F.max("median"), 4).alias("median"), F.max("mean").alias("mean"), F.max("zero").alias("zero"))
    return out.select(F.col("1_median").alias("positive_median"), F.col("0_median").alias("negative_median"), F.round(F.col("1_mean") / F.col("0_mean"), 4).alias("mean_ratio"), F.col("1_zero").alias("positive_zero_pct"), F.col("0_zero").alias("negative_zero_pct"))


@query(f"WITH {ORD} " + " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, round(count(DISTINCT {c}) / count(*), 6) AS ratio,
CASE WHEN count(DISTINCT {c}) <= 50 THEN 'low' WHEN count(DISTINCT {c}) <= 1000 THEN 'medium' ELSE 'high' END AS level,
CASE WHEN count(DISTINCT {c}) / count(*) > 0.5 THEN 'identifier' WHEN count(DISTINCT {c}) / count(*) > 0.05 THEN 'id-like' ELSE 'feature' END AS kind FROM ord""" for c in ("event_id", "step", "type", "sender", "dest")))  # fmt: skip
def cardinality(spark, sf_dir):
    return pf.cardinality(ords(spark, sf_dir), ("event_id", "step", "type", "sender", "dest"))


PROBES = {"large_amount": "amount > 200000", "over_balance": "amount > sender_old", "sender_not_positive": "sender_old <= 0", "urgent": "type = '1-URGENT'", "early": "step <= 800"}


@query(f"WITH {ORD} " + " UNION ALL ".join(f"""SELECT '{k}' AS condition, count(*) FILTER ({c}) AS n_rows, count(*) FILTER (({c}) AND label = 1) AS positives, round(100.0 * count(*) FILTER (({c}) AND label = 1) / nullif(count(*) FILTER ({c}), 0), 4) AS rate_pct,
round(count(*) FILTER (({c}) AND label = 1) / nullif(count(*) FILTER ({c}), 0) / (sum(label) / count(*)), 4) AS lift, round(100.0 * count(*) FILTER (({c}) AND label = 1) / sum(label), 4) AS share_positives_pct FROM ord""" for k, c in PROBES.items()))  # fmt: skip
def leakage_probes(spark, sf_dir):
    return pf.leakage_probes(ords(spark, sf_dir), {k: F.expr(c) for k, c in PROBES.items()})


@query(f"""WITH {ORD}, e AS (SELECT quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM ord), b AS (SELECT amount, label, CAST(len(list_filter(q, lambda x: amount > x)) AS INTEGER) AS bin FROM ord, e)
SELECT bin, count(*) AS total, CAST(sum(label) AS BIGINT) AS positives, round(min(amount), 4) AS lo, round(max(amount), 4) AS hi, round(100.0 * sum(label) / count(*), 4) AS rate_pct FROM b GROUP BY bin""")
def decile_rates(spark, sf_dir):
    return pf.decile_rates(ords(spark, sf_dir), "amount")


@query(f"""WITH {EVT}, b AS (SELECT quantile_cont(amount, 0.001) AS lo, quantile_cont(amount, 0.999) AS hi FROM evt)
SELECT label, CAST(least(floor((greatest(lo, least(hi, amount)) - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n FROM evt, b GROUP BY 1, 2""")
def amount_histogram(spark, sf_dir):
    return pf.histogram(evt(spark, sf_dir), "amount", 40, (0.001, 0.999), ["label"])


@query(f"""WITH {ORD}, q AS (SELECT type, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS median, quantile_cont(amount, 0.75) AS q3, min(amount) AS lo, max(amount) AS hi FROM ord GROUP BY type)
SELECT type, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 4) AS whisker_lo, round(least(hi, q3 + 1.5 * (q3 - q1)), 4) AS whisker_hi FROM q""")
def box_plot_stats(spark, sf_dir):
    return pf.box_stats(ords(spark, sf_dir), "amount", ["type"])


DOM = ("label", "sender_old", "step", "dest")


@query(f"WITH {ORD} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n_distinct, round(max(n) / sum(n), 6) AS top_share, count(*) <= 1 AS constant, max(n) / sum(n) >= 0.999 AS near_zero_variance FROM (SELECT {c}, count(*) AS n FROM ord WHERE step <= 1500 GROUP BY 1)" for c in DOM))
def near_zero_variance(spark, sf_dir):
    return pf.dominant_values(ords(spark, sf_dir).where("step <= 1500"), DOM)


TWINS = {"sender": "sender", "dest": "dest", "amount": "amount", "sender_copy": "sender", "sender_old": "sender_old", "almost": "CASE WHEN event_id = (SELECT min(event_id) FROM ord) THEN -1 ELSE dest END", "rounded": "round(amount, 2)"}


@query(f"WITH {ORD}, t AS (SELECT {', '.join(f'{v} AS {k}' for k, v in TWINS.items())} FROM ord), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS left_col, '{b}' AS right_col, count(*) FILTER ({a} IS DISTINCT FROM {b}) AS n_different FROM t" for i, a in enumerate(TWINS) for b in list(TWINS)[i + 1 :]) + ") SELECT * FROM p WHERE n_different = 0")
def duplicate_columns(spark, sf_dir):
    """Equal columns among copies, one that differs in a single row, and amounts that are rounded already."""
    o = ords(spark, sf_dir)
    first = o.agg(F.min("event_id")).first()[0]
    df = o.withColumns({"sender_copy": F.col("sender"), "almost": F.when(F.col("event_id") == first, F.lit(-1)).otherwise(F.col("dest")), "rounded": F.round("amount", 2)})
    return pf.duplicate_columns(df, list(TWINS))


_DIGEST = digest_sql(*[f"CAST({c} AS DECIMAL(38, 6))" if c == "amount" else c for c in COLS])


@query(f"WITH {EVT} SELECT count(*) AS n_rows, bit_xor({_DIGEST}) AS xor_hash, CAST(sum({_DIGEST}) AS VARCHAR) AS sum_hash FROM evt")
def dataset_fingerprint(spark, sf_dir):
    return pf.fingerprint(evt(spark, sf_dir), COLS)


@query(f"""WITH {EVT}, s AS (SELECT type, amount, CASE WHEN step <= 504 THEN 'reference' WHEN step > 552 THEN 'recent' END AS part, step FROM evt)
SELECT part, count(*) AS n, round(avg(amount), 4) AS mean, round(quantile_cont(amount, 0.5), 4) AS median, round(stddev_samp(amount), 4) AS std, round(100.0 * avg(CAST(type = 'purchase' AS INTEGER)), 4) AS purchase_pct FROM s WHERE part IS NOT NULL GROUP BY part""")
def reference_vs_recent(spark, sf_dir):
    part = F.when(F.col("step") <= 504, "reference").when(F.col("step") > 552, "recent")
    e = evt(spark, sf_dir).withColumn("part", part).where("part IS NOT NULL")
    out = e.groupBy("part").agg(F.lit("amount").alias("feature"), F.count("*").alias("n"), F.round(F.avg("amount"), 4).alias("mean"), F.round(F.stddev_samp("amount"), 4).alias("std"), F.round(100 * F.avg((F.col("type") == "purchase").cast("int")), 4).alias("purchase_pct"))
    return with_quantiles(out, e, ["amount"], {"median": 0.5}, ["part"]).drop("feature").withColumn("median", F.round("median", 4))


@query(f"WITH {EVT}, d AS (SELECT CAST(floor((step - 1) / 24) AS BIGINT) AS day, avg(amount) AS m, avg(label) AS r FROM evt GROUP BY 1) SELECT round(stddev_samp(m), 4) AS amount_std, round(stddev_samp(r), 6) AS rate_std, count(*) AS days FROM d")
def daily_variability(spark, sf_dir):
    d = evt(spark, sf_dir).groupBy(F.floor((F.col("step") - 1) / 24).alias("day")).agg(F.avg("amount").alias("m"), F.avg("label").alias("r"))
    return d.agg(F.round(F.stddev_samp("m"), 4).alias("amount_std"), F.round(F.stddev_samp("r"), 6).alias("rate_std"), F.count("*").alias("days"))


@query(f"""WITH {EVT}, s AS (SELECT step, lag(step) OVER (ORDER BY event_id) AS before FROM evt)
SELECT min(step) AS first_step, max(step) AS last_step, count(DISTINCT step) AS steps, max(step) - min(step) + 1 - count(DISTINCT step) AS missing_steps, count(*) FILTER (before > step) AS out_of_order FROM s""")
def step_coverage(spark, sf_dir):
    from ledgerlens.operators.prefix import lag_global

    e = lag_global(evt(spark, sf_dir).select("event_id", "step"), ["event_id"], "step", "before")
    n = F.countDistinct("step")
    return e.agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), n.alias("steps"), (F.max("step") - F.min("step") + 1 - n).alias("missing_steps"), F.count_if(F.col("before") > F.col("step")).alias("out_of_order"))


@query(f"""WITH {EVT} SELECT count(*) AS n_rows, round((count(*) - sum(label)) / sum(label), 4) AS imbalance, round(avg(amount), 4) AS mean_amount,
(SELECT hour FROM (SELECT (step - 1) % 24 AS hour, avg(label) AS r FROM evt GROUP BY 1) ORDER BY r DESC, hour LIMIT 1) AS peak_hour,
(SELECT type FROM (SELECT type, count(*) AS n FROM evt GROUP BY 1) ORDER BY n DESC, type LIMIT 1) AS top_type FROM evt""")
def headline_summary(spark, sf_dir):
    e = evt(spark, sf_dir)
    main = e.agg(F.count("*").alias("n_rows"), F.round(safe_divide(F.count("*") - F.sum("label"), F.sum("label")), 4).alias("imbalance"), F.round(F.avg("amount"), 4).alias("mean_amount"))
    hours = e.groupBy(F.pmod(F.col("step") - 1, F.lit(24)).alias("hour")).agg(F.avg("label").alias("r")).agg(F.max_by("hour", F.struct("r", -F.col("hour"))).alias("peak_hour"))
    types = e.groupBy("type").agg(F.count("*").alias("n")).agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("top_type"))
    one = F.lit(1)
    return main.withColumn("k", one).join(hours.withColumn("k", one), "k").join(types.withColumn("k", one), "k").drop("k")


@query(f"WITH {EVT} SELECT CAST(least(floor((step - 1) / 18.0), 39) AS INTEGER) AS bin, count(*) AS n, round(100.0 * avg(label), 4) AS rate_pct, round(CAST((CAST(least(floor((step - 1) / 18.0), 39) AS INTEGER) + 0.5) * 18.0 + 1 AS DOUBLE), 4) AS centre FROM evt GROUP BY 1")
def label_timeline(spark, sf_dir):
    b = F.least(F.floor((F.col("step") - 1) / 18.0), F.lit(39)).cast("int")
    return evt(spark, sf_dir).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(100 * F.avg("label"), 4).alias("rate_pct")).withColumn("centre", F.round((F.col("bin") + 0.5) * 18.0 + 1, 4))


@query("SELECT count(*) FILTER (c_acctbal = 0) AS zero_den, count(*) FILTER (c_acctbal < 0) AS negative_den, count(*) FILTER (c_acctbal IS NULL) AS missing_den, count(*) FILTER (c_acctbal > 0) AS defined FROM customer")
def naive_division_preview(spark, sf_dir):
    c = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").agg(F.count_if(c == 0).alias("zero_den"), F.count_if(c < 0).alias("negative_den"), F.count_if(c.isNull()).alias("missing_den"), F.count_if(c > 0).alias("defined"))


@query(f"WITH {EVT}, f AS (SELECT step, row_number() OVER (PARTITION BY sender, dest ORDER BY step, event_id) = 1 AS first FROM evt) SELECT CAST(floor((step - 1) / 24) AS BIGINT) AS day, count(*) FILTER (first) AS new_pairs, count(*) AS n FROM f GROUP BY 1")
def new_pairs_by_day(spark, sf_dir):
    f = ft.mark_new_pairs(evt(spark, sf_dir))
    return f.groupBy(F.floor((F.col("step") - 1) / 24).alias("day")).agg(F.sum("is_new_pair").alias("new_pairs"), F.count("*").alias("n"))


@query(f"""WITH {EVT}, c AS (SELECT label, count(*) OVER (PARTITION BY sender) > 60 AS busy, amount > 200 AS large FROM evt), s AS (SELECT round(100.0 * avg(CAST(busy AS INTEGER)) FILTER (label = 1), 4) AS bp, round(100.0 * avg(CAST(busy AS INTEGER)) FILTER (label = 0), 4) AS bn,
round(100.0 * avg(CAST(large AS INTEGER)) FILTER (label = 1), 4) AS lp, round(100.0 * avg(CAST(large AS INTEGER)) FILTER (label = 0), 4) AS ln FROM c), u AS (SELECT 'busy_account' AS candidate, bp AS positive_pct, bn AS negative_pct FROM s UNION ALL SELECT 'large_amount', lp, ln FROM s)
SELECT *, CASE WHEN abs(positive_pct - negative_pct) >= 20 THEN 'High' WHEN abs(positive_pct - negative_pct) >= 5 THEN 'Medium' ELSE 'Low' END AS priority FROM u""")
def candidate_evidence(spark, sf_dir):
    e = jn.with_totals(evt(spark, sf_dir), ["sender"], {"of_account": F.count("*")})
    e = e.withColumns({"busy": F.col("of_account") > 60, "large": F.col("amount") > 200})
    share = lambda c, y: F.round(100 * F.avg(F.when(F.col("label") == y, F.col(c).cast("int"))), 4)
    out = pf.unpivot_aggs(e, {n: {"positive_pct": share(c, 1), "negative_pct": share(c, 0)} for n, c in (("busy_account", "busy"), ("large_amount", "large"))}, name="candidate")
    gap = F.abs(F.col("positive_pct") - F.col("negative_pct"))
    return out.withColumn("priority", F.when(gap >= 20, "High").when(gap >= 5, "Medium").otherwise("Low"))


@query(f"WITH {EVT} SELECT CASE WHEN step <= 504 THEN 'old' ELSE 'recent' END AS source, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(100.0 * avg(label), 4) AS rate_pct FROM evt GROUP BY 1 UNION ALL SELECT NULL, count(*), CAST(sum(label) AS BIGINT), round(100.0 * avg(label), 4) FROM evt")
def class_by_source(spark, sf_dir):
    src = F.when(F.col("step") <= 504, "old").otherwise("recent")
    return evt(spark, sf_dir).withColumn("source", src).rollup("source").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.round(100 * F.avg("label"), 4).alias("rate_pct"))


@query(f"""WITH {EVT}, s AS (SELECT *, round(100 * least(1.0, greatest(0.0, amount / 500)), 4) AS score FROM evt)
SELECT event_id, score, CAST(least(1.0, greatest(0.0, amount / 500)) >= 0.6 AS INTEGER) AS predicted, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""")
def risk_decisions(spark, sf_dir):
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("amount") / 500))
    return evt(spark, sf_dir).select("event_id", risk_score(p).alias("score"), (p >= 0.6).cast("int").alias("predicted"), risk_level(risk_score(p)).alias("level"))


@query("SELECT c_custkey, CAST(coalesce(TRY_CAST(regexp_extract(replace(c_name, '#', '-'), '-([0-9]+)$', 1) AS BIGINT), 0) AS BIGINT) AS sequence FROM customer")
def suffix_numbers(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", suffix_number(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("sequence"))


@query("SELECT substr(p_brand, 1, 1) AS prefix, substr(p_name, 1, 1) AS name_prefix, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY 1, 2")
def prefix_profile(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.substring("p_brand", 1, 1).alias("prefix"), F.substring("p_name", 1, 1).alias("name_prefix")).agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("types"))
