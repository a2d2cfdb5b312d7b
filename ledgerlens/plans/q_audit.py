"""Queries on audits of tables, features, labels and logs, searches and reports."""

from pyspark.sql import functions as F

from ledgerlens.functions.scalars import FrozenParams, amounts, balances
from ledgerlens.operators import explorer as ex
from ledgerlens.operators import features as ft
from ledgerlens.operators import labels as lb
from ledgerlens.operators import metrics as mt
from ledgerlens.operators import monitor as mo
from ledgerlens.operators import profile as pf
from ledgerlens.operators.prefix import nearest_window
from ledgerlens.operators.splits import temporal_split
from ledgerlens.plans.q_joins import CUTS, TRUTH, truth
from ledgerlens.plans.q_quality import RANK, _conf_sql, _counts_sql
from ledgerlens.plans.views import EVT, ORD, PRED, SCORES, SUB, evt, ords, predictions, read, scores, submissions
from ledgerlens.sources import tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


COLUMNS = ("event_id", "step", "type", "amount", "sender", "dest", "sender_old", "sender_new", "dest_old", "dest_new", "label")
NUMERIC = ("amount", "sender_old", "sender_new", "dest_old", "dest_new")
RULES = {
    "negative_amount": "amount < 0", "zero_amount": "amount = 0", **{f"negative_{c}": f"{c} < 0" for c in NUMERIC[1:]}, "unexpected_type": "type NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    "bad_step": "step < 1", "label_not_binary": "label NOT IN (0, 1)", "flag_not_binary": "over NOT IN (0, 1)",
}
#: Orders with damage: every 97th comes twice, every 53rd without a payee's balance, every 71st with an infinite one.
DAMAGED = f"""dm0 AS (SELECT event_id, step, type, amount, sender, dest, sender_old, sender_new, CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 71 = 0 THEN 'inf'::DOUBLE ELSE dest_old END AS dest_old, dest_new, label,
CAST(amount > sender_old AS INTEGER) + CASE WHEN event_id % 89 = 0 THEN 1 ELSE 0 END AS over FROM ord), dm AS (SELECT * FROM dm0 UNION ALL SELECT * FROM dm0 WHERE event_id % 97 = 0)"""


def damaged(spark, sf_dir):
    o = ords(spark, sf_dir).select(*COLUMNS)
    old = F.when(F.col("event_id") % 53 == 0, F.lit(None)).when(F.col("event_id") % 71 == 0, F.lit(float("inf"))).otherwise(F.col("dest_old"))
    o = o.withColumns({"over": (F.col("amount") > F.col("sender_old")).cast("int") + (F.col("event_id") % 89 == 0).cast("int"), "dest_old": old})
    return o.unionByName(o.where("event_id % 97 = 0"))


_ALL = (*COLUMNS, "over")
_CELLS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _ALL)
_RULE = "SELECT '{k}' AS rule, CAST({n} AS BIGINT) AS n_found, round(100.0 * {n} / {d}, 4) AS pct FROM dm"


@query(f"WITH {ORD}, {DAMAGED} " + " UNION ALL ".join([
    _RULE.format(k="missing_cells", n=f"sum({_CELLS})", d=f"(count(*) * {len(_ALL)})"), _RULE.format(k="rows_with_missing", n=f"count(*) FILTER ({_CELLS} > 0)", d="count(*)"),
    _RULE.format(k="infinite_values", n="sum(" + " + ".join(f"CAST(coalesce(isinf({c}), false) AS INTEGER)" for c in NUMERIC) + ")", d=f"(count(*) * {len(NUMERIC)})"),
    _RULE.format(k="nan_values", n="sum(" + " + ".join(f"CAST(coalesce(isnan({c}), false) AS INTEGER)" for c in NUMERIC) + ")", d=f"(count(*) * {len(NUMERIC)})"),
    *[_RULE.format(k=k, n=f"count(*) FILTER ({c})", d="count(*)") for k, c in RULES.items()],
    "SELECT 'duplicate_rows', CAST(sum(k - 1) AS BIGINT), round(100.0 * sum(k - 1) / sum(k), 4) FROM (SELECT count(*) AS k FROM dm GROUP BY ALL, " + ", ".join(_ALL) + ")".replace("ALL, ", ""),
    "SELECT 'duplicate_ids', CAST(sum(k - 1) AS BIGINT), round(100.0 * sum(k - 1) / sum(k), 4) FROM (SELECT count(*) AS k FROM dm GROUP BY event_id)",
]).replace("GROUP BY ALL, ", "GROUP BY "))
def full_quality_audit(spark, sf_dir):
    """Sixteen rules over orders with planted damage."""
    return pf.full_audit(damaged(spark, sf_dir), "event_id", NUMERIC, {k: F.expr(c) for k, c in RULES.items()})


TABLE = ("amount", "sender_old", "dest", "label", "step")


@query(f"WITH {ORD} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, round(skewness({c}), 3) AS skew, round(kurtosis({c}), 3) AS kurt, count(DISTINCT {c}) <= 2 AS is_binary, count(DISTINCT {c}) <= 1 AS is_constant FROM ord" for c in TABLE))
def numeric_feature_table(spark, sf_dir):
    return pf.feature_table(ords(spark, sf_dir), TABLE)


@query(f"""WITH {ORD}, p AS (SELECT sender, sum(label) AS y FROM ord GROUP BY sender), r AS (SELECT y, row_number() OVER (ORDER BY y DESC) AS i, count(*) OVER () AS k FROM p WHERE y > 0)
SELECT count(*) AS accounts_with_positives, round(100.0 * count(*) / (SELECT count(*) FROM p), 4) AS accounts_pct, round(100.0 * sum(y) FILTER (y >= 2) / sum(y), 4) AS in_repeated_pct,
round(100.0 * sum(y) FILTER (i <= 10) / sum(y), 4) AS top_accounts_pct, round(100.0 * sum(y) FILTER (i <= greatest(ceil(k * 0.01), 1)) / sum(y), 4) AS top_share_pct FROM r""")
def positive_concentration(spark, sf_dir):
    by = ords(spark, sf_dir).groupBy("sender").agg(F.sum("label").cast("long").alias("positives"))
    return pf.positive_concentration(by)


def _review_sql(c: str) -> str:
    o = f"({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
    share = lambda of: f"round(100.0 * count(*) FILTER ({o} AND {of}) / count(*) FILTER ({of}), 4)"
    return f"""SELECT '{c}' AS feature, count(*) AS defined_rows, round(any_value(q2), 4) AS median, round(any_value(p99), 4) AS p99, round(any_value(p999), 4) AS p999, round(max({c}), 4) AS "max", {share("true")} AS outlier_pct, {share("label = 1")} AS in_positives_pct, {share("label = 0")} AS in_negatives_pct
FROM dm, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3, quantile_cont({c}, 0.99) AS p99, quantile_cont({c}, 0.999) AS p999 FROM dm WHERE isfinite({c})) WHERE isfinite({c})"""


@query(f"WITH {ORD}, {DAMAGED} " + " UNION ALL ".join(map(_review_sql, ("amount", "sender_old", "dest_old"))))
def feature_outliers(spark, sf_dir):
    return pf.outlier_review(damaged(spark, sf_dir), ["amount", "sender_old", "dest_old"])


BY_DESIGN = ("_to_", "prev_mean", "hours_since")
FEATURE_NULLS = {
    "amount_to_sender": "CASE WHEN sender_old > 0 THEN amount / sender_old END", "amount_to_dest": "CASE WHEN dest_old > 0 THEN amount / dest_old END", "sender_remaining": "sender_old - amount", "log_dest": "ln(1 + greatest(dest_old, 0))",
    "dest_old": "dest_old", "sender_prev_mean": "prev_mean", "sender_hours_since_prev": "gap",
}


@query(f"""WITH {ORD}, {DAMAGED}, h AS (SELECT *, avg(amount) OVER w AS prev_mean, step - lag(step) OVER (PARTITION BY sender ORDER BY step, event_id) AS gap FROM dm0 WINDOW w AS (PARTITION BY sender ORDER BY step, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT {", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in FEATURE_NULLS.items())} FROM h), t AS ({" UNION ALL ".join(f"SELECT '{k}' AS feature, count(*) FILTER ({k} IS NULL) AS n_null, round(100.0 * count(*) FILTER ({k} IS NULL) / count(*), 4) AS null_pct, count(*) FILTER (isinf({k})) AS n_infinite, {'true' if any(d in k for d in BY_DESIGN) else 'false'} AS by_design FROM f" for k in FEATURE_NULLS)})
SELECT *, CASE WHEN n_null = 0 THEN 'none' WHEN by_design THEN 'undefined' ELSE 'unexpected' END AS treatment FROM t""")
def feature_nulls(spark, sf_dir):
    """Nulls by design and others, and infinities, among features of orders some of which lack a balance."""
    o = damaged(spark, sf_dir).dropDuplicates(["event_id"])
    past = ft.past_windows(ft.mark_new_pairs(o), "sender", "sender", (1,))
    return pf.null_table(past.withColumns(amounts(FrozenParams(0.0, ())) | balances()), list(FEATURE_NULLS), BY_DESIGN)


@query(f"""WITH {ORD}, {DAMAGED}, s AS (SELECT sender, count(*) AS n FROM dm GROUP BY 1), d AS (SELECT dest, count(*) AS n FROM dm GROUP BY 1)
SELECT count(*) AS n_rows, CAST(sum({_CELLS}) AS BIGINT) AS missing_cells, (SELECT CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM dm GROUP BY {", ".join(_ALL)})) AS duplicate_rows, round(100.0 * avg(label), 4) AS rate_pct,
(SELECT round(100.0 * avg(CAST(n > 1 AS INTEGER)), 4) FROM s) AS sender_repeat_pct, (SELECT round(100.0 * avg(CAST(n > 1 AS INTEGER)), 4) FROM d) AS dest_repeat_pct, round(quantile_cont(amount, 0.5), 4) AS median_amount, min(step) AS first_step, max(step) AS last_step FROM dm""")
def dataset_headline(spark, sf_dir):
    """One row: size, missing cells, repeated rows, rate, accounts seen more than once, median amount, time span."""
    from ledgerlens.operators.quantiles import values_of

    d = damaged(spark, sf_dir)
    cells = sum((F.col(c).isNull().cast("int") for c in _ALL), F.lit(0))
    median = values_of(d, ["amount"], [0.5])["amount"][0]
    out = d.agg(F.count("*").alias("n_rows"), F.sum(cells).alias("missing_cells"), F.round(100 * F.avg("label"), 4).alias("rate_pct"), F.round(F.lit(median), 4).alias("median_amount"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.lit(1).alias("k"))
    out = out.join(d.groupBy(*d.columns).count().agg(F.sum(F.col("count") - 1).alias("duplicate_rows"), F.lit(1).alias("k")), "k")
    for c in ("sender", "dest"):
        out = out.join(d.groupBy(c).count().agg(F.round(100 * F.avg((F.col("count") > 1).cast("int")), 4).alias(f"{c}_repeat_pct"), F.lit(1).alias("k")), "k")
    return out.drop("k")


@query(f"""WITH {EVT}, o AS (SELECT step, event_id, label, row_number() OVER (ORDER BY step, event_id) - 1 AS i, CAST(step IS DISTINCT FROM lag(step) OVER (ORDER BY step, event_id) AS INTEGER) AS c FROM evt),
r AS (SELECT i, step, label, c, sum(label) OVER (ORDER BY i) AS y, sum(c) OVER (ORDER BY i) AS d FROM o), w AS (SELECT a.i AS first_row, b.i AS last_row, b.y - a.y + a.label AS positives, b.d - a.d + 1 AS steps FROM r a JOIN r b ON b.i = a.i + 199)
SELECT first_row, last_row, CAST(positives AS BIGINT) AS positives, CAST(steps AS BIGINT) AS steps FROM w WHERE positives >= 30 AND positives < 200 ORDER BY abs(positives - 30), steps DESC, first_row LIMIT 1""")
def representative_window(spark, sf_dir):
    """The run of 200 events with positives nearest to 30, then with the most steps, then the earliest."""
    out = nearest_window(evt(spark, sf_dir), ["step", "event_id"], "label", 200, 30)
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("first_row", "last_row", "positives", "steps")])


#: Lines of a scored log: every 41st is cut off, every 29th lacks a feature, every 31st has text for one, every 37th a null, every 43rd no origin.
LIVE = """lg AS (SELECT event_id AS line, 't' || event_id % 4000 AS id, CASE WHEN event_id % 7 = 0 THEN 'V1' ELSE 'V2' END AS version, event_id % 41 = 0 AS cut, event_id % 29 = 0 OR event_id % 31 = 0 AS broken, CASE WHEN event_id % 37 <> 0 THEN value END AS amount, user_id AS account,
CASE WHEN event_id % 43 = 0 THEN 'unspecified' ELSE event_type END AS origin, printf('2024-01-01T%09d', event_id) AS seen_at FROM events),
nl AS (SELECT * FROM lg ORDER BY line DESC LIMIT 5000), vv AS (SELECT * FROM nl WHERE version = 'V2' AND NOT cut AND NOT broken QUALIFY row_number() OVER (PARTITION BY id ORDER BY line DESC) = 1)"""


def scored_log(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    pick = lambda n, a, b: F.when(i % n == 0, a).otherwise(b)
    amount = pick(37, F.lit("null"), F.col("value").cast("string"))
    vector = F.concat(F.lit('{"account":'), F.col("user_id").cast("string"), pick(29, F.lit(""), F.concat(F.lit(',"amount":'), pick(31, F.lit('"much"'), amount))), F.lit("}"))
    line = F.concat(
        F.lit('{"transaction_id":"t'), (i % 4000).cast("string"), F.lit('","model_version":"'), pick(7, F.lit("V1"), F.lit("V2")), F.lit('","processed_at":"'), F.format_string("2024-01-01T%09d", i), F.lit('"'),
        pick(43, F.lit(""), F.concat(F.lit(',"data_origin":"'), F.col("event_type"), F.lit('"'))), F.lit(',"feature_values":'), vector, F.lit("}"),
    )
    return e.select(i.alias("line"), pick(41, F.substring(line, 1, 40), line).alias("value"))


@query(f"WITH {LIVE} SELECT id AS transaction_id, seen_at AS processed_at, origin, CAST(account AS DOUBLE) AS account, round(amount, 6) AS amount FROM vv")
def recent_feature_vectors(spark, sf_dir):
    vectors, _ = mo.recent_vectors(scored_log(spark, sf_dir), ["account", "amount"], "V2", 5000)
    return vectors.withColumn("amount", F.round("amount", 6))


@query(f"""WITH {LIVE} SELECT (SELECT count(*) FROM nl) AS records_read, (SELECT count(*) FROM nl WHERE cut OR (version = 'V2' AND broken)) AS malformed_records, count(*) AS vectors, min(seen_at) AS window_start, max(seen_at) AS window_end,
(SELECT string_agg(origin || '=' || n, ',' ORDER BY origin) FROM (SELECT origin, count(*) AS n FROM vv GROUP BY origin)) AS origins FROM vv""")
def recent_window_summary(spark, sf_dir):
    return mo.recent_vectors(scored_log(spark, sf_dir), ["account", "amount"], "V2", 5000)[1]


@query(f"""WITH {PRED}, {TRUTH}, j AS (SELECT transaction_id, CASE WHEN transaction_id % 37 = 0 THEN 2 ELSE label END AS label FROM pred LEFT JOIN truth USING (transaction_id) UNION ALL SELECT transaction_id, 1 FROM pred WHERE transaction_id % 91 = 0),
b AS (SELECT transaction_id, count(*) AS n, count(*) FILTER (label IS NULL) AS missing, count(*) FILTER (label NOT IN (0, 1)) AS odd, min(label) AS lo, max(label) AS hi FROM j GROUP BY 1),
c AS (SELECT 'labels_are_0_or_1' AS "check", sum(odd) AS n_bad FROM b UNION ALL SELECT 'one_row_a_transaction', sum(n - 1) FROM b UNION ALL SELECT 'one_label_a_transaction', count(*) FILTER (lo <> hi) FROM b UNION ALL SELECT 'every_transaction_matched', sum(missing) FROM b UNION ALL SELECT 'label_column_present', 0)
SELECT "check", CAST(n_bad AS BIGINT) AS n_bad, n_bad = 0 AS passed FROM c""")
def label_checks(spark, sf_dir):
    j = predictions(spark, sf_dir).join(truth(spark, sf_dir), "transaction_id", "left").select("transaction_id", F.when(F.col("transaction_id") % 37 == 0, 2).otherwise(F.col("label")).alias("label"))
    again = predictions(spark, sf_dir).where("transaction_id % 91 = 0").select("transaction_id", F.lit(1).alias("label"))
    return lb.label_checks(j.unionByName(again))


@query(f"""WITH {SCORES}, c AS (SELECT type, {_counts_sql(0.95)} FROM scores WHERE label = 0 OR type = 'error' GROUP BY type), f AS (SELECT type, {_conf_sql(0.95, 'NULL')} FROM c)
SELECT type, tp, fp, tn, fn, precision, recall, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN coalesce(f1, 0) END AS f1, accuracy, fpr, fnr,
concat_ws('; ', CASE WHEN tp + fp = 0 THEN 'precision: no positive predictions' END, CASE WHEN tp + fn = 0 THEN 'recall: no positive labels' END, CASE WHEN tp + fp = 0 OR tp + fn = 0 THEN 'f1: precision or recall is undefined' END) AS reasons FROM f""")
def undefined_metrics(spark, sf_dir):
    """Metrics by type, where most types have no positives: NULL with the reason."""
    return mt.undefined_reasons(mt.confusion(scores(spark, sf_dir), 0.95, ["type"], undefined="null"))


@query(f"""WITH {EVT}, {CUTS}, sp AS (SELECT split, least(1.0, greatest(0.0, amount / 500)) AS p, label FROM p), cc AS (SELECT split, {_counts_sql(0.1)} FROM sp GROUP BY split), f AS (SELECT split, {_conf_sql(0.1)} FROM cc),
kc AS (SELECT split, p, count(*) AS n, sum(label) AS y FROM sp GROUP BY 1, 2), r AS (SELECT *, sum(y) OVER (PARTITION BY split ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY split ORDER BY p DESC) AS above FROM kc), g AS (SELECT split, {RANK} FROM r GROUP BY split),
u AS (SELECT split, unnest(['precision', 'recall', 'f1', 'average_precision', 'roc_auc']) AS metric, unnest([precision, recall, f1, average_precision, roc_auc]) AS v FROM f JOIN g USING (split)),
tt AS (SELECT metric, max(v) FILTER (split = 'train') AS train, max(v) FILTER (split = 'validation') AS validation, max(v) FILTER (split = 'test') AS test FROM u GROUP BY metric)
SELECT *, round(train - validation, 6) AS gap_train_validation, round(validation - test, 6) AS gap_validation_test FROM tt""")
def split_report(spark, sf_dir):
    return mt.split_report(temporal_split(scores(spark, sf_dir)), 0.1)


@query(f"WITH {EVT} SELECT event_id, type, amount FROM evt WHERE (" + " OR ".join(f"contains(lower(CAST({c} AS VARCHAR)), 'ur')" for c in ("event_id", "type", "sender")) + ") AND label = 0 ORDER BY amount DESC NULLS LAST")
def explorer_search(spark, sf_dir):
    """Text in any column, of one class, the largest amounts first; no limit."""
    e = evt(spark, sf_dir).select("event_id", "type", "sender", "amount", "label")
    return ex.explore(e, "UR", {"label": [0], "type": []}, "amount", descending=True).select("event_id", "type", "amount")


@query("SELECT count(*) AS n_repeated FROM (SELECT count(*) OVER (PARTITION BY l_partkey, l_quantity, l_returnflag) AS k FROM lineitem) WHERE k > 1")
def explorer_repeated(spark, sf_dir):
    return ex.repeated_rows(read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag"))


@query("""WITH u AS (SELECT 'e' || event_id AS id, value / 500 AS p, epoch(ts) AS made, 'events' AS source FROM events UNION ALL SELECT 'd' || doc_id, (n_chars % 1000) / 1000, 1704067200 + doc_id * 60, 'documents' FROM documents)
SELECT id, round(p, 6) AS p, source FROM u WHERE p BETWEEN 0 AND 1 ORDER BY made DESC, id DESC LIMIT 500""")
def newest_logs(spark, sf_dir):
    """The newest 500 records of two logs with other names for the same fields."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("event"), (F.col("value") / 500).alias("probability"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    d = predictions(spark, sf_dir).select(F.concat(F.lit("d"), "transaction_id").alias("id"), "p", (1704067200 + F.col("made_at")).cast("double").alias("at"))
    logs = tables.union_logs({"events": e, "documents": d}, {"id": ["id", "event"], "p": ["p", "probability"], "at": ["at", "ts"]})
    return tables.newest(logs.where("p BETWEEN 0 AND 1"), ["at", "id"], 500).select("id", F.round("p", 6).alias("p"), "source")


CONTRACT = ("event_id", "step", "hour", "log_amount", "sender_prev_count", "dest_prev_count")


@query(f"""WITH {EVT} SELECT event_id, step, (step - 1) % 24 AS hour, round(ln(1 + greatest(amount, 0)), 6) AS log_amount, count(*) OVER (PARTITION BY sender ORDER BY step, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sender_prev_count,
count(*) OVER (PARTITION BY dest ORDER BY step, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dest_prev_count FROM evt""")
def contract_columns(spark, sf_dir):
    """Exactly the columns of the contract, in its order, of all that are built."""
    e = evt(spark, sf_dir).drop("label")
    out = ft.contract(ft.build_features(e, ft.fit_params(e, 504)), CONTRACT)
    return out.withColumn("log_amount", F.round("log_amount", 6))


TRUSTED_SQL = f"""{SUB}, {PRED}, a AS (SELECT *, row_number() OVER (PARTITION BY transaction_id, submission_id ORDER BY turn) AS n, first(outcome) OVER (PARTITION BY transaction_id, submission_id ORDER BY turn) AS f FROM sub),
g AS (SELECT *, CASE WHEN source_type NOT IN ('user', 'assistant') THEN 'rejected' WHEN n > 1 THEN CASE WHEN outcome = f THEN 'replay' ELSE 'submission_conflict' END END AS gate FROM a),
m AS (SELECT *, min(CASE WHEN gate IS NULL THEN turn END) OVER (PARTITION BY transaction_id) AS t FROM g), l AS (SELECT *, max(CASE WHEN turn = t THEN outcome END) OVER (PARTITION BY transaction_id) AS lab FROM m),
pr AS (SELECT transaction_id, prediction, transaction_id % 3 AS version, CASE WHEN source LIKE '%1' THEN 'Synthetic-' || source ELSE source END AS origin, transaction_id * 5 AS step FROM pred WHERE transaction_id % 11 <> 0
  UNION ALL SELECT transaction_id, 1, 2, source, transaction_id * 5 FROM pred WHERE transaction_id % 13 = 0 AND transaction_id % 11 <> 0),
d AS (SELECT l.*, coalesce(gate, CASE WHEN turn = t THEN CASE WHEN transaction_id IN (SELECT transaction_id FROM pr) THEN 'accepted' ELSE 'pending_prediction' END END, CASE WHEN outcome = lab THEN 'duplicate_identical' ELSE 'conflict' END) AS disposition FROM l),
said AS (SELECT transaction_id, count(*) FILTER (disposition IN ('conflict', 'submission_conflict')) AS n_conflicts FROM d GROUP BY 1), made AS (SELECT transaction_id, count(*) AS n_predictions, min(prediction) <> max(prediction) AS prediction_conflict, max(version) AS version, min(origin) AS origin, max(step) AS step FROM pr GROUP BY 1),
vv AS (SELECT vec_id AS transaction_id, vec_id % 17 <> 0 AS valid FROM embeddings UNION ALL SELECT vec_id, true FROM embeddings WHERE vec_id % 19 = 0), kn AS (SELECT transaction_id, count(*) AS n_vectors, bool_and(valid) AS vector_valid FROM vv GROUP BY 1),
fx AS (SELECT d.*, n_conflicts, coalesce(n_predictions, 0) AS n_predictions, prediction_conflict, version, origin, step, coalesce(n_vectors, 0) AS n_vectors, vector_valid FROM d JOIN said USING (transaction_id) LEFT JOIN made USING (transaction_id) LEFT JOIN kn USING (transaction_id))"""
TRUST = {
    "synthetic_label": "source_type = 'assistant'", "untrusted_or_unauthorized": "source_type NOT IN ('user', 'assistant')", "pending_or_rejected": "disposition IN ('pending_prediction', 'rejected')", "unmatched_prediction": "n_predictions = 0",
    "synthetic_prediction": "lower(origin) LIKE 'synthetic%'", "other_version": "version <> 2", "label_conflict": "n_conflicts > 0", "prediction_conflict": "prediction_conflict", "submission_not_accepted": "disposition <> 'accepted'",
    "missing_or_duplicate_feature_vector": "n_vectors <> 1", "invalid_feature_vector": "n_vectors > 0 AND NOT vector_valid", "heldout_boundary_violation": "step <= 300",
}


def _trusted(spark, sf_dir):
    pred = predictions(spark, sf_dir).where("transaction_id % 11 <> 0")
    origin = F.when(F.col("source").like("%1"), F.concat(F.lit("Synthetic-"), "source")).otherwise(F.col("source"))
    step = F.col("transaction_id") * 5
    made = pred.select("transaction_id", "prediction", (F.col("transaction_id") % 3).alias("version"), origin.alias("origin"), step.alias("step"))
    again = pred.where("transaction_id % 13 = 0").select("transaction_id", F.lit(1).alias("prediction"), F.lit(2).cast("long").alias("version"), F.col("source").alias("origin"), step.alias("step"))
    made = made.unionByName(again)
    ids = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("transaction_id"))
    vectors = ids.withColumn("valid", F.col("transaction_id") % 17 != 0).unionByName(ids.where("transaction_id % 19 = 0").withColumn("valid", F.lit(True)))
    folded = lb.fold_labels(submissions(spark, sf_dir), made, ["user", "assistant"])
    return lb.trusted_facts(folded, made, vectors), lb.trust_rules(["user", "assistant"], "assistant", 2, 300)


@query(f"WITH {TRUSTED_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS reason, count(*) AS n FROM fx WHERE {c} HAVING count(*) > 0" for k, c in TRUST.items()))
def trusted_label_exclusions(spark, sf_dir):
    """Twelve reasons that keep a submitted label from training, each counted."""
    facts, rules = _trusted(spark, sf_dir)
    return lb.eligible_labels(facts, rules)[1]


@query(f"WITH {TRUSTED_SQL}, ok AS (SELECT *, " + " AND ".join(f"NOT coalesce({c}, false)" for c in TRUST.values()) + " AS good FROM fx) SELECT source_type, disposition, count(*) AS n, count(*) FILTER (good) AS eligible, count(*) FILTER (good AND outcome = 1) AS eligible_positives FROM ok GROUP BY 1, 2")
def trusted_label_breakdown(spark, sf_dir):
    facts, rules = _trusted(spark, sf_dir)
    return lb.trust_breakdown(facts, rules, ["source_type", "disposition"])
