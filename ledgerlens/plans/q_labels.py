"""Queries on validation, registries and labels, reports, and sources."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators import labels as lb
from ledgerlens.operators import profile as pf
from ledgerlens.operators.quantiles import order_statistics
from ledgerlens.operators import validate as va
from ledgerlens.plans.q_joins import TRUTH, truth
from ledgerlens.plans.views import EVT, ORD, PRED, SUB, evt, ords, predictions, read, registry, submissions
from ledgerlens.sources import tables
from ledgerlens.sources.scratch import materialize, shared_dir

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: What becomes of the events by number, to have something of each kind to reject.
RAW = """CASE WHEN event_id % 50 = 0 THEN '{' WHEN event_id % 50 = 1 THEN '[1]' WHEN event_id % 50 = 2 THEN good_label WHEN event_id % 50 = 3 THEN short WHEN event_id % 50 = 4 THEN replace(good, '"step":', '"step":0.5,"was":')
WHEN event_id % 50 = 5 THEN replace(good, '"amount":', '"amount":"10","was":') WHEN event_id % 50 = 6 THEN replace(good, '"amount":', '"amount":-1,"was":') WHEN event_id % 50 = 7 THEN replace(good, '"event_id":"', '"event_id":7,"was":"') ELSE good END"""


def raw_events(spark, sf_dir):
    """Events as JSON text, one in some of each broken kind."""
    e = evt(spark, sf_dir)
    good = F.concat(F.lit('{"event_id":"e'), F.col("event_id"), F.lit('","step":'), "step", F.lit(',"type":"'), "type", F.lit('","amount":'), F.col("amount").cast("decimal(18,2)"), F.lit(',"sender":"s'), "sender", F.lit('","dest":"d'), "dest", F.lit('"}'))
    label = F.concat(F.lit('{"label":1,"event_id":"e'), F.col("event_id"), F.lit('"}'))
    short = F.concat(F.lit('{"event_id":"e'), F.col("event_id"), F.lit('"}'))
    return e.withColumns({"good": good, "good_label": label, "short": short}).select(F.col("event_id").alias("n"), F.col("type").alias("kind"), F.expr(RAW).alias("value"))


REASON = """CASE WHEN event_id % 50 IN (0, 1) THEN 'not_an_object' WHEN event_id % 50 = 2 THEN 'label_present' WHEN event_id % 50 = 3 THEN 'missing_key' WHEN event_id % 50 = 7 THEN 'bad_id' WHEN event_id % 50 = 4 THEN 'bad_step'
WHEN type NOT IN ('click', 'purchase', 'view', 'error') THEN 'unknown_type' WHEN event_id % 50 IN (5, 6) THEN 'bad_amount' END"""
ALLOWED = ("click", "purchase", "view", "error")


@query(f"WITH {EVT} SELECT event_id AS n, {REASON} AS reason, CASE WHEN event_id % 50 = 2 THEN '{{\"label\":\"[REDACTED]\",\"event_id\":\"e' || event_id || '\"}}' END AS redacted FROM evt WHERE {REASON} IS NOT NULL")
def rejected_events(spark, sf_dir):
    _, bad = va.validate_events(raw_events(spark, sf_dir), "value", ALLOWED)
    return bad.select("n", "reason", F.when(F.col("reason") == "label_present", F.col("value")).alias("redacted"))


@query(f"WITH {EVT} SELECT 'e' || event_id AS event_id, step, type, round(amount, 2) AS amount, 's' || sender AS sender, 'd' || dest AS dest FROM evt WHERE {REASON} IS NULL")
def accepted_events(spark, sf_dir):
    good, _ = va.validate_events(raw_events(spark, sf_dir), "value", ALLOWED)
    return good.select("event_id", "step", "type", F.round("amount", 2).alias("amount"), "sender", "dest")


@query("""WITH r AS (SELECT event_id, value / 400 AS p, event_type AS level FROM events) SELECT coalesce(CASE WHEN p > 1 THEN 'bad_probability' WHEN level NOT IN ('view', 'click', 'error') THEN 'bad_level' WHEN event_id % 11 = 0 THEN 'half_position' WHEN event_id % 13 = 0 THEN 'bad_time' END, 'valid') AS outcome, count(*) AS n FROM r GROUP BY 1""")
def prediction_record_outcomes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    names = {"view": "LOW", "click": "MEDIUM", "error": "HIGH"}
    level = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("NONE"))
    r = e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        (F.col("value") / 400).alias("p"),
        F.least(F.lit(100.0), F.col("value") / 4).alias("risk_score"),
        level.alias("level"),
        F.lit(0).alias("partition"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id")).alias("offset"),
        F.when(F.col("event_id") % 13 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00+02:00").alias("at"),
    )
    return r.groupBy(F.coalesce(va.first_failure(va.prediction_rules()), F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {ORD} SELECT 'unique_id' AS "check", count(*) = count(DISTINCT event_id) AS passed, count(*) - count(DISTINCT event_id) AS detail FROM ord UNION ALL SELECT 'label_binary', count(*) FILTER (label NOT IN (0, 1)) = 0, count(*) FILTER (label NOT IN (0, 1)) FROM ord
UNION ALL SELECT 'finite', count(*) FILTER (isinf(amount)) = 0, count(*) FILTER (isinf(amount)) FROM ord UNION ALL SELECT 'step_range', count(*) FILTER (step NOT BETWEEN 1 AND 2000) = 0, count(*) FILTER (step NOT BETWEEN 1 AND 2000) FROM ord UNION ALL SELECT 'no_audit_columns', false, 2""")
def dataset_contract(spark, sf_dir):
    return va.validate_dataset(ords(spark, sf_dir), ["amount", "sender_old", "dest_old"], (1, 2000), audit=["sender_new", "dest_new"])


LOG = "log AS (SELECT l_orderkey || '-' || l_linenumber AS transaction_id, l_partkey, l_suppkey, l_shipdate AS shipped_at, l_extendedprice, l_quantity AS quantity FROM lineitem)"


@query(f"""WITH {LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY shipped_at, l_extendedprice, quantity) AS r, first(l_partkey) OVER w AS fp, first(l_suppkey) OVER w AS fs,
row_number() OVER (PARTITION BY transaction_id, l_partkey, l_suppkey ORDER BY shipped_at, l_extendedprice, quantity) AS q FROM log WINDOW w AS (PARTITION BY transaction_id ORDER BY shipped_at, l_extendedprice, quantity))
SELECT CASE WHEN r = 1 THEN 'registered' WHEN l_partkey = fp AND l_suppkey = fs THEN 'duplicate' WHEN q = 1 THEN 'conflict' ELSE 'conflict_repeat' END AS disposition, count(*) AS n FROM o GROUP BY 1""")
def prediction_registry(spark, sf_dir):
    out = lb.fold_predictions(registry(spark, sf_dir), ["shipped_at", "l_extendedprice", "quantity"])
    return out.groupBy("disposition").agg(F.count("*").alias("n"))


@query(f"""WITH {SUB}, a AS (SELECT *, row_number() OVER (PARTITION BY transaction_id, submission_id ORDER BY turn) AS n, first(outcome) OVER (PARTITION BY transaction_id, submission_id ORDER BY turn) AS f FROM sub),
g AS (SELECT *, CASE WHEN source_type NOT IN ('user', 'assistant') THEN 'rejected' WHEN n > 1 THEN CASE WHEN outcome = f THEN 'replay' ELSE 'submission_conflict' END END AS gate FROM a),
m AS (SELECT *, min(CASE WHEN gate IS NULL THEN turn END) OVER (PARTITION BY transaction_id) AS t FROM g), l AS (SELECT *, max(CASE WHEN turn = t THEN outcome END) OVER (PARTITION BY transaction_id) AS lab FROM m)
SELECT transaction_id, turn, coalesce(gate, CASE WHEN turn = t THEN CASE WHEN transaction_id % 3 <> 0 AND transaction_id IN (SELECT doc_id FROM documents) THEN 'accepted' ELSE 'pending_prediction' END END, CASE WHEN outcome = lab THEN 'duplicate_identical' ELSE 'conflict' END) AS disposition FROM l""")
def label_submissions(spark, sf_dir):
    known = predictions(spark, sf_dir).where("transaction_id % 3 <> 0")
    return lb.fold_labels(submissions(spark, sf_dir), known, ["user", "assistant"]).select("transaction_id", "turn", "disposition")


@query(f"WITH {PRED}, {TRUTH}, p AS (SELECT * FROM pred WHERE transaction_id % 5 <> 0) SELECT CASE WHEN label IS NULL THEN 'unlabelled' WHEN p.transaction_id IS NULL THEN 'pending_prediction' ELSE 'resolved' END AS state, count(*) AS n FROM truth FULL JOIN p USING (transaction_id) GROUP BY 1")
def pending_label_resolution(spark, sf_dir):
    p = predictions(spark, sf_dir).where("transaction_id % 5 <> 0")
    return lb.label_state(truth(spark, sf_dir), p).groupBy("state").agg(F.count("*").alias("n"))


ELIGIBLE = {"no_label": "label IS NULL", "low_probability": "p < 0.2", "other_language": "lang NOT IN ('en', 'de')", "late": "made_at > 50000"}


@query(f"WITH {PRED}, {TRUTH}, f AS (SELECT * FROM pred LEFT JOIN truth USING (transaction_id)) " + " UNION ALL ".join(f"SELECT '{k}' AS reason, count(*) AS n FROM f WHERE {c} HAVING count(*) > 0" for k, c in ELIGIBLE.items()))
def label_exclusions(spark, sf_dir):
    facts = predictions(spark, sf_dir).join(truth(spark, sf_dir), "transaction_id", "left")
    return lb.eligible_labels(facts, {k: F.expr(c) for k, c in ELIGIBLE.items()})[1]


@query(f"WITH {PRED}, {TRUTH} SELECT transaction_id, label FROM pred JOIN truth USING (transaction_id) WHERE label IS NOT NULL AND p >= 0.2 AND lang IN ('en', 'de') AND made_at <= 50000")
def eligible_labels(spark, sf_dir):
    facts = predictions(spark, sf_dir).join(truth(spark, sf_dir), "transaction_id", "left")
    return lb.eligible_labels(facts, {k: F.expr(c) for k, c in ELIGIBLE.items()})[0].select("transaction_id", "label")


@query(f"WITH {EVT} SELECT CASE WHEN step <= 380 THEN 'old' ELSE 'recent' END AS source, event_id, step, amount, label FROM evt WHERE step <= 350 OR step >= 401 ORDER BY step, event_id")
def retraining_set(spark, sf_dir):
    e = evt(spark, sf_dir).select("event_id", "step", "amount", "label", F.lit(0.5).alias("p"))
    return lb.retraining_set(e.where("step <= 380"), e.where("step > 380"), (351, 400), ["p"]).select("source", "event_id", "step", "amount", "label").orderBy("step", "event_id")


@query(f"""WITH {EVT}, s AS (SELECT avg(amount) FILTER (step > 400) > 1.0 * avg(amount) FILTER (step <= 350) AS drift, count(*) FILTER (step > 700) AS n_labels, count(*) FILTER (step > 700 AND label = 1) AS n_positives, count(*) FILTER (step BETWEEN 351 AND 400) AS in_gap FROM evt)
SELECT drift, n_labels, n_positives, in_gap, CASE WHEN NOT drift THEN 'NOT_REQUIRED' WHEN n_labels < 100 OR n_positives < 10 OR in_gap > 0 THEN 'BLOCKED' ELSE 'ELIGIBLE' END AS decision,
concat_ws(',', CASE WHEN n_labels < 100 THEN 'too_few_labels' END, CASE WHEN n_positives < 10 THEN 'too_few_positives' END, CASE WHEN in_gap > 0 THEN 'rows_in_gap' END) AS reasons FROM s""")
def retraining_eligibility(spark, sf_dir):
    s = F.col("step")
    mean = lambda c: F.avg(F.when(c, F.col("amount")))
    summary = evt(spark, sf_dir).agg((mean(s > 400) > mean(s <= 350)).alias("drift"), F.count_if(s > 700).alias("n_labels"), F.count_if((s > 700) & (F.col("label") == 1)).alias("n_positives"), F.count_if(s.between(351, 400)).alias("in_gap"))
    return lb.eligibility(summary)


@query(f"WITH {SUB} SELECT transaction_id, turn, source_type, outcome FROM sub ORDER BY transaction_id, turn")
def audit_trail(spark, sf_dir):
    return submissions(spark, sf_dir).select("transaction_id", "turn", "source_type", "outcome").orderBy("transaction_id", "turn")


@query(f"WITH {SUB} SELECT source_type, outcome, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM sub GROUP BY GROUPING SETS ((), (source_type), (source_type, outcome))")
def registry_stats(spark, sf_dir):
    s = submissions(spark, sf_dir)
    return s.groupingSets([[], ["source_type"], ["source_type", "outcome"]], "source_type", "outcome").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500), m AS (SELECT max(ts) AS t FROM n) SELECT event_type, count(*) AS n, max(value) AS largest FROM n, m WHERE ts > t - INTERVAL 300 MINUTE GROUP BY event_type")
def recent_activity(spark, sf_dir):
    n = read(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    newest = n.withColumn("t", F.max("ts").over(W.partitionBy()))  # of 500 rows
    return newest.where(F.col("ts") > F.col("t") - F.expr("INTERVAL '300' MINUTE")).groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("largest"))


@query(f"WITH {PRED}, {TRUTH} SELECT transaction_id, p, CASE WHEN made_at + 7200 <= 30000 THEN label END AS label FROM pred LEFT JOIN truth USING (transaction_id) WHERE p >= 0.9")
def high_risk_extract(spark, sf_dir):
    m = predictions(spark, sf_dir).where("p >= 0.9").join(truth(spark, sf_dir), "transaction_id", "left")
    return m.select("transaction_id", "p", F.when(F.col("made_at") + 7200 <= 30000, F.col("label")).alias("label"))


@query("WITH g AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS us FROM events) SELECT count(us) AS n, round(avg(us) / 1e6, 3) AS mean_s, round(min(us) / 1e6, 3) AS min_s, round(max(us) / 1e6, 3) AS max_s FROM g")
def latency_stats(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")), F.col("ts"))
    return e.select(gap.alias("us")).agg(F.count("us").alias("n"), F.round(F.avg("us") / 1e6, 3).alias("mean_s"), F.round(F.min("us") / 1e6, 3).alias("min_s"), F.round(F.max("us") / 1e6, 3).alias("max_s"))


@query(f"WITH {EVT} SELECT event_id AS id, amount / 500 AS p, 'events' AS source FROM evt WHERE amount / 500 <= 1 UNION ALL SELECT transaction_id, p, 'documents' FROM (SELECT doc_id AS transaction_id, (n_chars % 1000) / 1000 AS p FROM documents)")
def union_of_logs(spark, sf_dir):
    logs = {"events": evt(spark, sf_dir).select("event_id", (F.col("amount") / 500).alias("probability")), "documents": predictions(spark, sf_dir).select("transaction_id", "p")}
    return tables.union_logs(logs, {"id": ["transaction_id", "event_id"], "p": ["p", "probability"]}).where("p BETWEEN 0 AND 1")


@query("SELECT max(event_id) AS name, max_by(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT), event_id) AS k FROM events WHERE CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) < 50")
def newest_valid_report(spark, sf_dir):
    return tables.newest_valid(read(spark, sf_dir, "events"), "event_id", "props", "k bigint", F.col("r.k") < 50)


@query(f"WITH {EVT} SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives FROM evt")
def verified_write(spark, sf_dir):
    import uuid

    back = tables.write_verified(evt(spark, sf_dir), f"{shared_dir(spark)}/verified-{uuid.uuid4().hex}")
    return back.agg(F.count("*").alias("n_rows"), F.sum("label").cast("long").alias("positives"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def csv_round_trip(spark, sf_dir):
    import uuid

    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    df.write.csv(path, header=True)
    return tables.read_csv(spark, path, df.schema, ["o_orderkey", "o_custkey", "o_totalprice"])


@query(f"WITH {EVT} SELECT count(*) FILTER (event_id % 50 NOT IN (0, 1)) AS parsed, count(*) FILTER (event_id % 50 IN (0, 1)) AS malformed FROM evt")
def json_lines_scan(spark, sf_dir):
    import uuid

    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    raw_events(spark, sf_dir).select("value").write.text(path)
    good, bad = tables.read_jsonl(spark, path, "event_id string, step string, amount string")
    one = F.lit(1)
    return good.agg(F.count("*").alias("parsed"), F.max(one).alias("k")).join(bad.agg(F.count("*").alias("malformed"), F.max(one).alias("k")), "k").drop("k")


TIMED = ("event_id", "step", "type", "amount", "sender", "dest", "sender_old", "sender_new", "dest_old", "dest_new", "label")


@query(f"WITH {ORD} SELECT column_name, known, n_present, CASE known WHEN 'before' THEN 'feature' WHEN 'after' THEN 'audit' ELSE 'review' END AS use FROM (SELECT unnest(['event_id', 'step', 'type', 'amount', 'sender', 'dest', 'sender_old', 'sender_new', 'dest_old', 'dest_new', 'label']) AS column_name, unnest(['unclear', 'before', 'before', 'before', 'before', 'before', 'before', 'after', 'before', 'after', 'after']) AS known) JOIN (UNPIVOT (SELECT {', '.join(f'count({c}) AS {c}' for c in TIMED)} FROM ord) ON COLUMNS(*) INTO NAME column_name VALUE n_present) USING (column_name)")
def column_timing(spark, sf_dir):
    o = ords(spark, sf_dir)
    present = pf.unpivot_aggs(o, {c: {"n_present": F.count(c)} for c in TIMED}, name="column_name")
    return va.column_timing(o).join(F.broadcast(present), "column_name")  # a row a column


LONG = ("amount", "sender_old", "sender_new", "dest_old", "dest_new")


@query(f"WITH {ORD} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4) AS null_pct, round(avg({c}), 3) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, min({c}) AS \"min\", max({c}) AS \"max\", round(100.0 * count(*) FILTER ({c} = 0) / count({c}), 4) AS zero_pct, count(*) FILTER (isinf({c})) AS n_inf FROM ord" for c in LONG))
def feature_part_summary(spark, sf_dir):
    v = F.col("value")
    long = pf.to_long(ords(spark, sf_dir), LONG)
    median = order_statistics(long, ["feature"], [0.5]).select("feature", F.round(F.col("q")[0], 4).alias("median"))
    out = long.groupBy("feature").agg(
        F.round(100 * F.count_if(v.isNull()) / F.count("*"), 4).alias("null_pct"), F.round(F.avg(v), 3).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.round(100 * F.count_if(v == 0) / F.count(v), 4).alias("zero_pct"), F.count_if(F.abs(v) == float("inf")).alias("n_inf"),
    )
    return out.join(median, "feature", "left")


@query(f"WITH {ORD}, c AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, max(abs(corr)) AS top_corr FROM ord, (SELECT corr({c}, label) AS corr FROM ord) GROUP BY ALL" for c in LONG) + ")) SELECT feature, CASE WHEN feature LIKE '%new' THEN 'EXCLUDE_AFTER' WHEN n_distinct <= 1 THEN 'EXCLUDE_CONSTANT' WHEN top_corr >= 0.98 THEN 'EXCLUDE_LEAK' ELSE 'KEEP' END AS decision FROM c")
def feature_audit(spark, sf_dir):
    o = ords(spark, sf_dir)
    facts = pf.with_distinct(o, {c: {"corr": F.abs(F.corr(c, "label"))} for c in LONG}, "feature", also=["label"])
    known = va.column_timing(o).withColumnRenamed("column_name", "feature")
    decision = F.when(F.col("known") == "after", "EXCLUDE_AFTER").when(F.col("n_distinct") <= 1, "EXCLUDE_CONSTANT").when(F.col("corr") >= 0.98, "EXCLUDE_LEAK").otherwise("KEEP")
    return facts.join(known, "feature").select("feature", decision.alias("decision"))


@query(f"WITH {EVT}, s AS (SELECT step, count(*) AS n, sum(label) AS y FROM evt WHERE step > 611 GROUP BY step) SELECT count(*) AS steps, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(n), 4) AS mean_per_step, max(n) AS busiest, CAST(sum(y) AS BIGINT) AS positives, count(*) FILTER (y > 0) AS steps_with_positives FROM s")
def replay_plan(spark, sf_dir):
    s = evt(spark, sf_dir).where("step > 611").groupBy("step").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    return s.agg(F.count("*").alias("steps"), F.sum("n").alias("n_rows"), F.round(F.avg("n"), 4).alias("mean_per_step"), F.max("n").alias("busiest"), F.sum("y").alias("positives"), F.count_if(F.col("y") > 0).alias("steps_with_positives"))


@query(f"""WITH {EVT}, f AS (SELECT sender, step, amount, event_id, first(amount) OVER w AS previous FROM evt WINDOW w AS (PARTITION BY sender ORDER BY step, event_id ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING))
SELECT event_id, amount, previous, round(amount - previous, 4) AS change FROM f WHERE previous IS NOT NULL AND amount > 2 * previous""")
def amount_jumps(spark, sf_dir):
    previous = F.lag("amount").over(W.partitionBy("sender").orderBy("step", "event_id"))
    f = materialize(evt(spark, sf_dir).select("event_id", "amount", previous.alias("previous")), "jumps")
    return f.where("previous IS NOT NULL AND amount > 2 * previous").withColumn("change", F.round(F.col("amount") - F.col("previous"), 4))
