"""Queries on classifier metrics and drift."""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators import drift as dr
from ledgerlens.operators import metrics as mt
from ledgerlens.operators import profile as pf
from ledgerlens.operators.prefix import running_sums
from ledgerlens.operators.splits import temporal_split, window_tag
from ledgerlens.plans.q_joins import CUTS, PRED, TRUTH, truth
from ledgerlens.plans.views import EVT, SCORES, evt, predictions, scores

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _conf_sql(t: float, blank: str = "0.0") -> str:
    part = lambda a, b: f"round(coalesce(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) END, {blank}), 6)"
    return f"""tp, fp, tn, fn, {part("tp", "tp + fp")} AS precision, {part("tp", "tp + fn")} AS recall, {part("2 * tp", "2 * tp + fp + fn")} AS f1, {part("tp + tn", "tp + fp + tn + fn")} AS accuracy,
{part("fp", "fp + tn")} AS fpr, {part("fn", "fn + tp")} AS fnr"""


def _counts_sql(t: float) -> str:
    return f"count(*) FILTER (p >= {t} AND label = 1) AS tp, count(*) FILTER (p >= {t} AND label = 0) AS fp, count(*) FILTER (p < {t} AND label = 0) AS tn, count(*) FILTER (p < {t} AND label = 1) AS fn"


@query(f"WITH {SCORES}, c AS (SELECT {_counts_sql(0.1)} FROM scores) SELECT {_conf_sql(0.1)} FROM c")
def confusion_metrics(spark, sf_dir):
    return mt.confusion(scores(spark, sf_dir), 0.1)


@query(f"WITH {SCORES}, c AS (SELECT type, {_counts_sql(0.9)} FROM scores GROUP BY type) SELECT type, {_conf_sql(0.9, 'NULL')} FROM c")
def confusion_by_type_null(spark, sf_dir):
    return mt.confusion(scores(spark, sf_dir), 0.9, ["type"], undefined="null")


COUNTS = "c AS (SELECT p, count(*) AS n, sum(label) AS y FROM scores GROUP BY p), r AS (SELECT *, sum(y) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS above FROM c)"
RANK = """round(sum(y * tp / above) / sum(y), 6) AS average_precision, round(1 - sum(y * (above - tp - (n - y) / 2)) / (sum(y) * sum(n - y)), 6) AS roc_auc,
round(sum(y * (1 - p) * (1 - p) + (n - y) * p * p) / sum(n), 6) AS brier, CAST(sum(n) AS BIGINT) AS n"""


@query(f"WITH {SCORES}, {COUNTS} SELECT {RANK} FROM r")
def ranking_metrics(spark, sf_dir):
    return mt.ranking(scores(spark, sf_dir))


@query(f"""WITH {EVT}, {CUTS}, c AS (SELECT split, least(1.0, greatest(0.0, amount / 500)) AS p, count(*) AS n, sum(label) AS y FROM p GROUP BY 1, 2),
r AS (SELECT *, sum(y) OVER (PARTITION BY split ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY split ORDER BY p DESC) AS above FROM c) SELECT split, {RANK} FROM r GROUP BY split""")
def ranking_by_split(spark, sf_dir):
    return mt.ranking(temporal_split(scores(spark, sf_dir)), ["split"])


@query(f"WITH {SCORES}, {COUNTS} SELECT p, round(tp / above, 6) AS precision, round(tp / (SELECT sum(y) FROM c), 6) AS recall FROM r")
def precision_recall_points(spark, sf_dir):
    return mt.pr_points(scores(spark, sf_dir))


@query(f"WITH {SCORES}, {COUNTS} SELECT p, round((above - tp) / (SELECT sum(n - y) FROM c), 6) AS fpr, round(tp / (SELECT sum(y) FROM c), 6) AS tpr FROM r")
def roc_points(spark, sf_dir):
    return mt.roc_points(scores(spark, sf_dir))


GRID = """t AS (SELECT i, i / 100 AS threshold FROM range(1, 100) r(i)), b AS (SELECT CAST(floor(round(p * 100, 9)) AS INTEGER) AS b, label FROM scores),
g AS (SELECT threshold, count(b) AS predicted, coalesce(sum(label), 0) AS tp, (SELECT sum(label) FROM scores) AS y FROM t LEFT JOIN b ON b.b >= t.i GROUP BY threshold),
grid AS (SELECT threshold, predicted, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision, round(tp / y, 6) AS recall, round(2 * tp / (predicted + y), 6) AS f1 FROM g)"""


@query(f"WITH {SCORES}, {GRID} SELECT * FROM grid")
def threshold_grid(spark, sf_dir):
    return mt.threshold_grid(scores(spark, sf_dir))


@query(f"WITH {SCORES}, {GRID} SELECT * FROM grid ORDER BY f1 DESC, precision DESC, threshold LIMIT 1")
def selected_threshold(spark, sf_dir):
    return mt.select_threshold(mt.threshold_grid(scores(spark, sf_dir)))


@query(f"""WITH {SCORES}, e AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM scores), b AS (SELECT p, label, CAST(len(list_filter(q, lambda x: p > x)) AS INTEGER) AS bin FROM scores, e)
SELECT bin, count(*) AS n, round(avg(p), 5) AS mean_p, round(avg(label), 5) AS rate FROM b GROUP BY bin""")
def calibration_curve(spark, sf_dir):
    return mt.calibration(scores(spark, sf_dir))


@query(f"""WITH {SCORES}, l AS (SELECT CASE WHEN round(100 * p, 4) >= 70 THEN 'HIGH' WHEN round(100 * p, 4) >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level, label FROM scores)
SELECT level, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct, round(100.0 * avg(label), 4) AS rate_pct FROM l GROUP BY level""")
def risk_band_table(spark, sf_dir):
    from ledgerlens.functions.scalars import risk_level, risk_score

    out = scores(spark, sf_dir).groupBy(risk_level(risk_score(F.col("p"))).alias("level")).agg(F.count("*").alias("n"), F.round(100 * F.avg("label"), 4).alias("rate_pct"))
    return out.withColumn("pct", pf.pct(F.col("n"), F.sum("n").over(W.partitionBy())))


MODELS = "m AS (SELECT 'a' AS model, p, label FROM scores UNION ALL SELECT 'b', least(1.0, amount / 400 + (event_id % 7) / 100), label FROM scores)"
LONG = f"""c AS (SELECT model, {_counts_sql(0.1)} FROM m GROUP BY model), f AS (SELECT model, {_conf_sql(0.1)} FROM c), k AS (SELECT model, p, count(*) AS n, sum(label) AS y FROM m GROUP BY 1, 2),
r AS (SELECT *, sum(y) OVER (PARTITION BY model ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY p DESC) AS above FROM k), g AS (SELECT model, {RANK} FROM r GROUP BY model),
u AS (SELECT model, unnest(['precision', 'recall', 'f1', 'fpr', 'average_precision', 'roc_auc']) AS metric, unnest([precision, recall, f1, fpr, average_precision, roc_auc]) AS value FROM f JOIN g USING (model)),
cmp AS (SELECT metric, max(value) FILTER (model = 'a') AS base, max(value) FILTER (model = 'b') AS other FROM u GROUP BY metric)"""


def _models(spark, sf_dir):
    s = scores(spark, sf_dir)
    b = s.withColumn("p", F.least(F.lit(1.0), F.col("amount") / 400 + F.pmod("event_id", F.lit(7)) / 100))
    return s.select(F.lit("a").alias("model"), "p", "label").unionByName(b.select(F.lit("b").alias("model"), "p", "label"))


@query(f"WITH {SCORES}, {MODELS}, {LONG} SELECT metric, base, other, round(other - base, 5) AS delta, round((other - base) / base, 4) AS relative FROM cmp")
def model_comparison(spark, sf_dir):
    return mt.compare_models(_models(spark, sf_dir), 0.1, "a", "b")


@query(f"""WITH {SCORES}, {MODELS}, {LONG}, d AS (SELECT min(round(other - base, 5)) FILTER (metric IN ('precision', 'recall', 'f1', 'average_precision')) AS worst_delta, max(other) FILTER (metric = 'recall') AS recall FROM cmp)
SELECT worst_delta, recall, CASE WHEN worst_delta >= -0.02 AND recall >= 0.8 THEN 'accept' ELSE 'reject' END AS decision FROM d""")
def acceptance_decision(spark, sf_dir):
    return mt.accept(mt.compare_models(_models(spark, sf_dir), 0.1, "a", "b"))


@query(f"WITH {SCORES} SELECT count(*) AS n, count(*) FILTER (p IS NULL) AS missing, count(*) FILTER (p < 0 OR p > 1) AS out_of_range, count(*) FILTER (isnan(p) OR isinf(p)) AS not_finite FROM scores")
def probability_sanity(spark, sf_dir):
    p = F.col("p")
    bad = F.isnan(p) | (F.abs(p) == float("inf"))
    return scores(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(p.isNull()).alias("missing"), F.count_if((p < 0) | (p > 1)).alias("out_of_range"), F.count_if(bad).alias("not_finite"))


@query(f"WITH {SCORES} SELECT label, CAST(least(floor(p * 40), 39) AS INTEGER) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS density FROM scores GROUP BY 1, 2")
def score_distribution(spark, sf_dir):
    b = F.least(F.floor(F.col("p") * 40), F.lit(39)).cast("int")
    out = scores(spark, sf_dir).groupBy("label", b.alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("density", F.round(F.col("n") / F.sum("n").over(W.partitionBy("label")), 6))


@query(f"WITH {PRED}, {TRUTH}, m AS (SELECT p, label FROM pred JOIN truth USING (transaction_id) WHERE label IS NOT NULL), c AS (SELECT {_counts_sql(0.5)} FROM m) SELECT {_conf_sql(0.5)} FROM c")
def labelled_subset_metrics(spark, sf_dir):
    return mt.confusion(predictions(spark, sf_dir).join(truth(spark, sf_dir), "transaction_id").where("label IS NOT NULL"), 0.5)


@query(f"""WITH {PRED}, {TRUTH}, m AS (SELECT transaction_id, p >= 0.5 AS hit, label = 1 AS y FROM pred JOIN truth USING (transaction_id)), r AS (SELECT row_number() OVER w AS i, count(*) OVER () AS n, sum(CAST(hit AND y AS INTEGER)) OVER w AS tp,
sum(CAST(hit AND NOT y AS INTEGER)) OVER w AS fp, sum(CAST(NOT hit AND y AS INTEGER)) OVER w AS fn FROM m WINDOW w AS (ORDER BY transaction_id))
SELECT i AS labels_seen, round(coalesce(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 0), 6) AS f1 FROM r WHERE i % 10 = 0 OR i = n""")
def cumulative_f1(spark, sf_dir):
    m = predictions(spark, sf_dir).join(truth(spark, sf_dir), "transaction_id")
    hit, y = F.col("p") >= 0.5, F.col("label") == 1
    run = running_sums(m, ["transaction_id"], {"labels_seen": F.lit(1), "tp": (hit & y).cast("int"), "fp": (hit & ~y).cast("int"), "fn": (~hit & y).cast("int")})
    total = m.count()
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return run.where((F.col("labels_seen") % 10 == 0) | (F.col("labels_seen") == total)).select(F.col("labels_seen").cast("long").alias("labels_seen"), F.round(f1, 6).alias("f1"))


@query(f"WITH {SCORES} SELECT step, round(avg(p), 6) AS predicted_rate, round(avg(label), 6) AS actual_rate FROM scores GROUP BY step")
def predicted_vs_actual(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("step").agg(F.round(F.avg("p"), 6).alias("predicted_rate"), F.round(F.avg("label"), 6).alias("actual_rate"))


@query(f"""WITH {PRED}, {TRUTH} SELECT source, count(*) AS n, count(label) AS labelled, round(100.0 * avg(prediction), 4) AS predicted_pct, round(100.0 * avg(label), 4) AS actual_pct,
round(100.0 * avg(CAST(prediction = label AS INTEGER)), 4) AS agreement_pct FROM pred LEFT JOIN truth USING (transaction_id) GROUP BY source""")
def prediction_summary(spark, sf_dir):
    m = predictions(spark, sf_dir).join(truth(spark, sf_dir), "transaction_id", "left")
    pct = lambda c: F.round(100 * F.avg(c), 4)
    return m.groupBy("source").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), pct("prediction").alias("predicted_pct"), pct("label").alias("actual_pct"), pct((F.col("prediction") == F.col("label")).cast("int")).alias("agreement_pct"))


FEATURES = ("amount", "log_amount", "is_purchase", "is_click", "sparse", "shifted")


def _drift_sql(features: dict[str, str]) -> str:
    """CTEs from ``evt`` to long rows ``l`` and their statistics ``st``."""
    return f"""l AS (SELECT * FROM (SELECT CASE WHEN step BETWEEN 1 AND 350 THEN 0 WHEN step BETWEEN 401 AND 720 THEN 1 END AS recent, unnest([{", ".join(f"'{x}'" for x in features)}]) AS feature,
unnest([{", ".join(f"CAST({v} AS DOUBLE)" for v in features.values())}]) AS value FROM evt) WHERE recent IS NOT NULL),
st AS (SELECT feature, count(value) FILTER (recent = 0) AS n_ref, count(value) FILTER (recent = 1) AS n_rec, round(1 - count(value) FILTER (recent = 0) / count(*) FILTER (recent = 0), 6) AS null_ref, round(1 - count(value) FILTER (recent = 1) / count(*) FILTER (recent = 1), 6) AS null_rec,
avg(value) FILTER (recent = 0) AS mean_ref, avg(value) FILTER (recent = 1) AS mean_rec, stddev_pop(value) FILTER (recent = 0) AS std_ref, stddev_pop(value) FILTER (recent = 1) AS std_rec, coalesce(bool_and(value IN (0, 1)), false) AS is_binary FROM l GROUP BY feature)"""


DRIFT = _drift_sql({"amount": "amount", "log_amount": "ln(1 + amount)", "is_purchase": "type = 'purchase'", "is_click": "type = 'click'", "sparse": "CASE WHEN event_id % 997 = 0 THEN amount END", "shifted": "CASE WHEN step > 400 THEN amount * 3 ELSE amount END"})
PSI = """e AS (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (recent = 0) AS q FROM l WHERE value IS NOT NULL GROUP BY feature),
bn AS (SELECT feature, recent, CASE WHEN is_binary THEN CAST(value >= 0.5 AS BIGINT) ELSE len(list_filter(list_distinct(q), lambda x: value >= x)) END AS b FROM l JOIN e USING (feature) JOIN st USING (feature) WHERE value IS NOT NULL),
bc AS (SELECT feature, b, greatest(count(*) FILTER (recent = 0) / any_value(n_ref), 1e-6) AS p, greatest(count(*) FILTER (recent = 1) / any_value(n_rec), 1e-6) AS q FROM bn JOIN st USING (feature) GROUP BY feature, b),
ps AS (SELECT feature, CASE WHEN least(any_value(n_ref), any_value(n_rec)) >= 30 THEN sum((q - p) * ln(q / p)) END AS psi FROM bc JOIN st USING (feature) GROUP BY feature)"""
KS = """kc AS (SELECT feature, value, count(*) FILTER (recent = 0) AS a, count(*) FILTER (recent = 1) AS b FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
kg AS (SELECT feature, abs(sum(a) OVER (PARTITION BY feature ORDER BY value) / sum(a) OVER (PARTITION BY feature) - sum(b) OVER (PARTITION BY feature ORDER BY value) / sum(b) OVER (PARTITION BY feature)) AS gap FROM kc), ks AS (SELECT feature, max(gap) AS ks FROM kg GROUP BY feature)"""
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
_POLY = reduce(lambda out, c: f"(({out}) * t + {c})", reversed(_ERFC[:-1]), str(_ERFC[-1]))
TESTS = f"""zp AS (SELECT feature, mean_rec - mean_ref AS d, (n_ref * mean_ref + n_rec * mean_rec) / (n_ref + n_rec) AS pool, 1.0 / n_ref + 1.0 / n_rec AS m FROM st WHERE is_binary),
z AS (SELECT feature, CASE WHEN pool * (1 - pool) * m = 0 THEN 0 ELSE d / sqrt(pool * (1 - pool) * m) END AS z FROM zp),
zt AS (SELECT feature, z, abs(z) / sqrt(2) AS x, 1 / (1 + abs(z) / sqrt(2) / 2) AS t FROM z), zn AS (SELECT feature, t * exp(-x * x + {_POLY}) AS p FROM zt),
kx AS (SELECT feature, ks * sqrt(n_ref * n_rec / (n_ref + n_rec)) AS x FROM ks JOIN st USING (feature)),
kp AS (SELECT feature, CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 41), lambda k: exp(-2 * k * k * x * x) * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)))) END AS p FROM kx),
tt AS (SELECT st.*, psi, CASE WHEN NOT is_binary THEN ks END AS ks, z, CASE WHEN least(n_ref, n_rec) < 30 THEN NULL WHEN is_binary THEN zn.p ELSE kp.p END AS p_value
  FROM st LEFT JOIN ps USING (feature) LEFT JOIN ks USING (feature) LEFT JOIN z USING (feature) LEFT JOIN zn USING (feature) LEFT JOIN kp USING (feature)),
br AS (SELECT feature, p_value, row_number() OVER (ORDER BY p_value, feature) AS k, count(*) OVER () AS n FROM tt WHERE p_value IS NOT NULL),
ba AS (SELECT feature, least(1.0, min(p_value * n / k) OVER (ORDER BY k DESC)) AS p_adjusted FROM br),
dd AS (SELECT *, least(n_ref, n_rec) >= 30 AS enough, coalesce(psi >= 0.2, false) AS by_psi, coalesce(p_adjusted < 0.05, false) AS by_p FROM tt LEFT JOIN ba USING (feature)),
fd AS (SELECT *, CASE WHEN NOT enough THEN 'insufficient_sample' WHEN by_psi OR by_p THEN 'drift' ELSE 'no_drift' END AS decision, CASE WHEN enough THEN concat_ws(', ', CASE WHEN by_psi THEN 'psi' END, CASE WHEN by_p THEN 'p_value' END) ELSE '' END AS reason FROM dd)"""
SHOWN = {"null_ref": 6, "null_rec": 6, "mean_ref": 4, "mean_rec": 4, "std_ref": 4, "std_rec": 4, "psi": 5, "ks": 6, "z": 4, "p_value": 7, "p_adjusted": 7}
FOUND = "feature, n_ref, n_rec, is_binary, decision, reason, " + ", ".join(f"round({c}, {d}) AS {c}" for c, d in SHOWN.items())


def _drift_input(spark, sf_dir):
    e = evt(spark, sf_dir)
    return e.withColumns(
        {
            "log_amount": F.log1p("amount"),
            "is_purchase": (F.col("type") == "purchase").cast("double"),
            "is_click": (F.col("type") == "click").cast("double"),
            "sparse": F.when(F.col("event_id") % 997 == 0, F.col("amount")),
            "shifted": F.when(F.col("step") > 400, F.col("amount") * 3).otherwise(F.col("amount")),
        }
    )


WINDOW = window_tag, (1, 350), (401, 720)


@query(f"WITH {EVT}, {DRIFT} SELECT feature, n_ref, n_rec, null_ref, null_rec, round(mean_ref, 5) AS mean_ref, round(mean_rec, 5) AS mean_rec, round(std_ref, 5) AS std_ref, round(std_rec, 5) AS std_rec, is_binary FROM st")
def drift_feature_stats(spark, sf_dir):
    s = dr.feature_stats(dr.long_windows(_drift_input(spark, sf_dir), FEATURES, window_tag((1, 350), (401, 720))))
    return s.withColumns({c: F.round(c, 5) for c in ("mean_ref", "mean_rec", "std_ref", "std_rec")})


@query(f"WITH {EVT}, {DRIFT}, {PSI} SELECT feature, round(psi, 5) AS psi, CASE WHEN psi >= 0.2 THEN 'significant' WHEN psi >= 0.1 THEN 'watch' WHEN psi IS NOT NULL THEN 'little' END AS band FROM ps")
def psi_bands(spark, sf_dir):
    long = dr.long_windows(_drift_input(spark, sf_dir), FEATURES, window_tag((1, 350), (401, 720)))
    return dr.psi_bands(dr.psi(long, dr.feature_stats(long)))


@query(f"WITH {EVT}, {DRIFT}, {KS} SELECT feature, round(ks, 6) AS ks FROM ks")
def ks_statistics(spark, sf_dir):
    long = dr.long_windows(_drift_input(spark, sf_dir), FEATURES, window_tag((1, 350), (401, 720)))
    return dr.ks(long).select("feature", F.round("ks", 6).alias("ks"))


@query(f"""WITH {EVT}, {DRIFT}, z AS (SELECT *, (n_ref * mean_ref + n_rec * mean_rec) / (n_ref + n_rec) AS pool FROM st WHERE is_binary) SELECT feature, round((mean_rec - mean_ref) / sqrt(pool * (1 - pool) * (1.0 / n_ref + 1.0 / n_rec)), 5) AS z FROM z""")
def proportion_tests(spark, sf_dir):
    long = dr.long_windows(_drift_input(spark, sf_dir), FEATURES, window_tag((1, 350), (401, 720)))
    return dr.z_test(dr.feature_stats(long)).select("feature", F.round("z", 5).alias("z"))


@query(f"""WITH {EVT}, p AS (SELECT type AS feature, count(*) / 100000.0 + avg(amount) / 10000 AS p_value FROM evt GROUP BY type), r AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS k, count(*) OVER () AS n FROM p)
SELECT feature, round(p_value, 8) AS p_value, round(least(1.0, min(p_value * n / k) OVER (ORDER BY k DESC)), 8) AS p_adjusted FROM r""")
def false_discovery_control(spark, sf_dir):
    p = evt(spark, sf_dir).groupBy(F.col("type").alias("feature")).agg((F.count("*") / 100000.0 + F.avg("amount") / 10000).alias("p_value"))
    return dr.bh_adjust(p).select("feature", F.round("p_value", 8).alias("p_value"), F.round("p_adjusted", 8).alias("p_adjusted"))


def _shown(found):
    return found.select("feature", "n_ref", "n_rec", "is_binary", "decision", "reason", *[F.round(c, d).alias(c) for c, d in SHOWN.items()])


@query(f"WITH {EVT}, {DRIFT}, {PSI}, {KS}, {TESTS} SELECT {FOUND} FROM fd")
def feature_drift(spark, sf_dir):
    return _shown(dr.feature_drift(_drift_input(spark, sf_dir), FEATURES, window_tag((1, 350), (401, 720))))


@query(f"""WITH {EVT}, {DRIFT}, {PSI}, {KS}, {TESTS}, o AS (SELECT count(*) FILTER (decision <> 'insufficient_sample') AS tested, count(*) FILTER (decision = 'drift') AS drifted, (SELECT string_agg(feature, ',' ORDER BY psi DESC, feature DESC) FROM (SELECT feature, round(psi, 9) AS psi FROM fd WHERE psi IS NOT NULL ORDER BY 2 DESC, 1 DESC LIMIT 5)) AS top FROM fd)
SELECT tested, drifted, round(drifted / tested, 6) AS rate, drifted / tested >= 0.15 AS drift, top FROM o""")
def overall_drift(spark, sf_dir):
    found = dr.feature_drift(_drift_input(spark, sf_dir), FEATURES, window_tag((1, 350), (401, 720)))
    return dr.overall_drift(found)


FACTORS = (1.0, 1.1, 1.5, 2.0, 3.0)
#: What follows from the amount, and the hour, which doesn't.
DEPENDANTS = {"amount": "{a}", "log_amount": "ln(1 + {a})", "is_large": "{a} >= 150", "rounded": "floor({a} / 50)", "hour": "(step - 1) % 24"}
SCALED = {f"{n}@{k}": v.format(a=f"(CASE WHEN step > 400 THEN amount * {k} ELSE amount END)") for k in FACTORS for n, v in DEPENDANTS.items()}


@query(f"WITH {EVT}, {_drift_sql(SCALED)}, {PSI}, {KS}, {TESTS} SELECT CAST(split_part(feature, '@', 2) AS DOUBLE) AS factor, split_part(feature, '@', 1) AS feature, * EXCLUDE (feature) FROM (SELECT {FOUND} FROM fd)")
def drift_sensitivity(spark, sf_dir):
    """How the tests answer to recent amounts scaled by several factors, with all that depends on the amount."""

    def derive(df):
        return df.withColumns({n: F.expr(v.format(a="amount")) for n, v in DEPENDANTS.items() if n != "amount"})

    found = dr.sensitivity(evt(spark, sf_dir), "amount", FACTORS, F.col("step") > 400, derive, list(DEPENDANTS), window_tag((1, 350), (401, 720)))
    return _shown(found).withColumns({"factor": F.split_part("feature", F.lit("@"), F.lit(2)).cast("double"), "feature": F.split_part("feature", F.lit("@"), F.lit(1))})


@query(f"""WITH {PRED}, {TRUTH}, m AS (SELECT p, label FROM pred JOIN truth USING (transaction_id)), c AS (SELECT {_counts_sql(0.5)} FROM m), f AS (SELECT {_conf_sql(0.5)} FROM c)
SELECT *, CASE WHEN tp + fp + tn + fn < 100 OR tp + fn < 10 THEN 'insufficient_labels' WHEN 0.4 - f1 >= 0.1 THEN 'degraded' ELSE 'stable' END AS status FROM f""")
def label_performance(spark, sf_dir):
    return dr.label_performance(predictions(spark, sf_dir).join(truth(spark, sf_dir), "transaction_id"), 0.5, 0.4)


ALERTS = "a AS (SELECT DISTINCT 'rate' AS kind, 'v' || CAST(step % 3 AS VARCHAR) AS version, type AS \"window\" FROM evt WHERE amount > 150), k AS (SELECT *, kind || '|' || version || '|' || \"window\" AS alert_key FROM a)"


def _alerts(spark, sf_dir):
    e = evt(spark, sf_dir).where("amount > 150")
    a = e.select(F.lit("rate").alias("kind"), F.concat(F.lit("v"), F.pmod("step", F.lit(3)).cast("string")).alias("version"), F.col("type").alias("window")).distinct()
    stored = evt(spark, sf_dir).where("type = 'view'").select(F.concat_ws("|", F.lit("rate"), F.lit("v1"), "type").alias("alert_key")).distinct()
    return dr.new_alerts(a, stored)


@query(f"WITH {EVT}, {ALERTS} SELECT alert_key, kind, version, \"window\" FROM k WHERE alert_key <> 'rate|v1|view'")
def new_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir)


@query(f"WITH {EVT}, {ALERTS} SELECT sha256(string_agg(alert_key, ',' ORDER BY alert_key)) AS request_key, CAST(count(*) AS INTEGER) AS n_alerts FROM k WHERE alert_key <> 'rate|v1|view'")
def retraining_request(spark, sf_dir):
    return dr.retraining_request(_alerts(spark, sf_dir))
