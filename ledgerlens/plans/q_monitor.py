"""Queries on monitoring, gates and further profiles."""

from pyspark.sql import functions as F

from ledgerlens.operators import monitor as mo
from ledgerlens.operators import profile as pf
from ledgerlens.operators.quantiles import with_quantiles
from ledgerlens.plans.q_joins import TRUTH, truth
from ledgerlens.plans.q_quality import _conf_sql, _counts_sql, label_performance
from ledgerlens.plans.views import EVT, ORD, PRED, evt, ords, predictions, read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_extendedprice DESC) AS r FROM lineitem WHERE l_returnflag = 'A')
SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM l WHERE r = 1 ORDER BY l_shipdate DESC, l_orderkey DESC, l_extendedprice DESC LIMIT 500""")
def recent_scored_window(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_returnflag")
    rest = ["l_linenumber", "l_shipdate", "l_extendedprice"]
    last = li.where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.max_by(F.struct(*rest), F.struct("l_shipdate", "l_linenumber", "l_extendedprice")).alias("r")).select("l_orderkey", "r.*")
    return mo.recent_scored(last.withColumn("v", F.lit(1)), "l_orderkey", ["l_shipdate", "l_orderkey", "l_extendedprice"], F.col("v") == 1, 500).drop("v")


@query(f"""WITH {EVT}, {PRED}, {TRUTH}, m AS (SELECT p, label FROM pred JOIN truth USING (transaction_id)), c AS (SELECT {_counts_sql(0.5)} FROM m), f AS (SELECT {_conf_sql(0.5)} FROM c),
s AS (SELECT CASE WHEN tp + fp + tn + fn < 100 OR tp + fn < 10 THEN 'insufficient_labels' WHEN 0.4 - f1 >= 0.1 THEN 'degraded' ELSE 'stable' END AS status FROM f),
d AS (SELECT abs(avg(amount) FILTER (step > 400) / avg(amount) FILTER (step <= 350) - 1) > 0.2 AS drift, count(*) FILTER (step > 400) AS n_recent FROM evt)
SELECT CASE WHEN n_recent < 30 OR status = 'insufficient_labels' THEN 'insufficient_data' WHEN drift THEN 'drift' WHEN status = 'degraded' THEN 'degraded' ELSE 'healthy' END AS overall,
concat_ws(',', CASE WHEN drift THEN 'feature_drift' END, CASE WHEN status = 'degraded' THEN 'performance' END) AS alerts, drift OR status = 'degraded' AS request_retraining FROM s, d""")
def monitor_roll_up(spark, sf_dir):
    mean = lambda c: F.avg(F.when(c, F.col("amount")))
    s = F.col("step")
    drift = evt(spark, sf_dir).agg((F.abs(F.try_divide(mean(s > 400), mean(s <= 350)) - 1) > 0.2).alias("drift"), F.count_if(s > 400).alias("n_recent"))
    return mo.roll_up(drift, label_performance(spark, sf_dir).select("status"))


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 1")
def latest_report(spark, sf_dir):
    return mo.latest(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")


#: Every fourth event was handed in as recent.
GATES = {"recent_in_window": "event_id % 4 <> 3 OR step >= 401", "no_row_in_gap": "step NOT BETWEEN 351 AND 400", "positive_amount": "amount > 0", "id_given": "event_id IS NOT NULL"}


@query(f"WITH {EVT} " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER (NOT coalesce({c}, false)) AS n_bad, count(*) FILTER (NOT coalesce({c}, false)) = 0 AS passed FROM evt" for k, c in GATES.items()))
def window_gates(spark, sf_dir):
    return mo.gates(evt(spark, sf_dir), {k: F.expr(c) for k, c in GATES.items()})


@query(f"WITH {EVT} SELECT event_id, step, label FROM evt WHERE step > 600")
def ground_truth_table(spark, sf_dir):
    return evt(spark, sf_dir).where("step > 600").select("event_id", "step", "label")


BAL = ("sender_old", "sender_new", "dest_old", "dest_new")


@query(f"WITH {ORD} " + " UNION ALL ".join(f"""SELECT label, '{c}' AS column_name, count({c}) AS n, round(avg({c}), 3) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(100.0 * avg(CAST({c} <= 0 AS INTEGER)), 4) AS not_positive_pct, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4) AS missing_pct FROM ord GROUP BY label""" for c in BAL))
def balance_summary(spark, sf_dir):
    aggs = {
        c: {
            "n": F.count(c),
            "mean": F.round(F.avg(c), 3),
            "not_positive_pct": F.round(100 * F.avg((F.col(c) <= 0).cast("int")), 4),
            "missing_pct": pf.pct(F.count_if(F.col(c).isNull()), F.count("*")),
        }
        for c in BAL
    }
    o = ords(spark, sf_dir)
    out = pf.unpivot_aggs(o, aggs, ["label"], name="column_name")
    return with_quantiles(out, o, BAL, {"median": 0.5}, ["label"], "column_name").withColumn("median", F.round("median", 4))


@query(f"WITH {EVT} SELECT type, (step - 1) % 24 AS hour, count(*) AS n, round(100.0 * avg(label), 4) AS rate_pct FROM evt GROUP BY CUBE (type, hour)")
def type_hour_cube(spark, sf_dir):
    e = evt(spark, sf_dir).withColumn("hour", F.pmod(F.col("step") - 1, F.lit(24)))
    return e.cube("type", "hour").agg(F.count("*").alias("n"), F.round(100 * F.avg("label"), 4).alias("rate_pct"))


@query(f"WITH {EVT} SELECT label, CAST(floor(least(log10(1 + amount), 2.9999) * 10) AS BIGINT) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM evt GROUP BY 1, 2")
def log_amount_histogram(spark, sf_dir):
    from pyspark.sql import Window as W

    b = F.floor(F.least(F.log10(1 + F.col("amount")), F.lit(2.9999)) * 10)
    out = evt(spark, sf_dir).groupBy("label", b.alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("label")), 6))


@query(f"WITH {PRED}, {TRUTH}, b AS (SELECT CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level, label FROM pred LEFT JOIN truth USING (transaction_id)) SELECT level, count(*) AS n, count(label) AS labelled, CAST(coalesce(sum(label), 0) AS BIGINT) AS positives FROM b GROUP BY level")
def levels_with_labels(spark, sf_dir):
    from ledgerlens.functions.scalars import risk_level

    m = predictions(spark, sf_dir).join(truth(spark, sf_dir), "transaction_id", "left")
    return m.groupBy(risk_level(100 * F.col("p")).alias("level")).agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("positives"))


@query(f"WITH {EVT}, n AS (SELECT type, CAST(floor((step - 1) / 168) AS BIGINT) AS week, count(*) AS n FROM evt GROUP BY 1, 2) SELECT type, week, n, n - lag(n) OVER (PARTITION BY type ORDER BY week) AS change FROM n")
def weekly_volume_change(spark, sf_dir):
    from pyspark.sql import Window as W

    n = evt(spark, sf_dir).groupBy("type", F.floor((F.col("step") - 1) / 168).alias("week")).agg(F.count("*").alias("n"))
    return n.withColumn("change", F.col("n") - F.lag("n").over(W.partitionBy("type").orderBy("week")))
