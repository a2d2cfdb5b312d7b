"""Queries on flags, ranges, windows, provenance, acceptance, exclusions, and streams with late and earlier events."""

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions.scalars import digest_number
from ledgerlens.operators import labels as lb
from ledgerlens.operators import rules as ru
from ledgerlens.plans.q_streams import _sql, arriving
from ledgerlens.plans.views import EVT, ORD, PRED, SCORES, digest_sql, evt, ords, predictions, read, scores
from ledgerlens.sources.scratch import materialize, shared_dir
from ledgerlens.streaming import history, jobs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


PASSED = {"over_balance": "amount > sender_old", "emptied": "sender_new <= 0", "round_amount": "amount = floor(amount)"}


@query(f"WITH {ORD} SELECT event_id, " + ", ".join(f"CAST({c} AS INTEGER) AS {k}" for k, c in PASSED.items()) + " FROM ord")
def rule_flag_passthrough(spark, sf_dir):
    return ru.flag_columns(ords(spark, sf_dir), {k: F.expr(c) for k, c in PASSED.items()}).select("event_id", *PASSED)


RANGES = {"amount": (1_000.0, 250_000.0, False), "sender_old": (0.0, 9_000.0, True), "step": (1, 1_000, False), "dest_old": (None, 9_000.0, True)}
BREAKS = [
    b
    for c, (lo, hi, optional) in RANGES.items()
    for b in ([] if optional else [(f"{c}_missing", f"{c} IS NULL")]) + ([] if lo is None else [(f"{c}_below", f"{c} < {lo}")]) + ([] if hi is None else [(f"{c}_above", f"{c} > {hi}")])
]


@query(f"WITH {ORD} SELECT event_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in BREAKS) + ") AS violations FROM ord")
def range_violations(spark, sf_dir):
    return ru.range_violations(ords(spark, sf_dir), RANGES).select("event_id", F.array_join("violations", ",").alias("violations"))


SPLITS = """last AS (SELECT max(step) AS z FROM evt), tagged AS (SELECT step, CASE WHEN step <= floor(z * 0.6) THEN 'train' WHEN step <= floor(z * 0.8) THEN 'validation' ELSE 'test' END AS split FROM evt, last),
meta AS (SELECT split, min(step) AS a, max(step) AS b, count(*) AS n FROM tagged GROUP BY split)"""


def split_metadata(spark, sf_dir):
    e = evt(spark, sf_dir)
    last = e.agg(F.max("step").alias("z"), F.lit(1).alias("k"))
    tagged = e.withColumn("k", F.lit(1)).join(F.broadcast(last), "k")  # one row
    split = F.when(F.col("step") <= F.floor(F.col("z") * 0.6), "train").when(F.col("step") <= F.floor(F.col("z") * 0.8), "validation").otherwise("test")
    return tagged.groupBy(split.alias("split")).agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count("*").alias("n"))


@query(f"""WITH {EVT}, {SPLITS} SELECT 'reference' AS "window", a AS first_step, b AS last_step, n FROM meta WHERE split = 'train' UNION ALL SELECT 'recent', a, b, n FROM meta WHERE split = 'test'
UNION ALL SELECT 'gap', (SELECT b + 1 FROM meta WHERE split = 'train'), (SELECT a - 1 FROM meta WHERE split = 'test'), NULL""")
def drift_windows(spark, sf_dir):
    return ru.resolve_windows(split_metadata(spark, sf_dir))


@query(f"""WITH {EVT}, c AS (SELECT max(step) FILTER (step <= 350 OR event_id % 1000 = 0) < min(step) FILTER (step > 400 AND event_id % 1000 <> 0) AS o, count(amount) > 0 AS a, count(dest) > 0 AS d FROM evt)
SELECT 'labels_absent' AS "check", true AS passed UNION ALL SELECT 'columns_present', true UNION ALL SELECT 'reference_precedes_recent', coalesce(o, false) FROM c UNION ALL SELECT 'amount_has_values', a FROM c UNION ALL SELECT 'dest_has_values', d FROM c""")
def drift_input_checks(spark, sf_dir):
    """A thousandth of the rows is tagged as reference whatever its step: the order check sees it."""
    e = evt(spark, sf_dir).where("step <= 350 OR step > 400 OR event_id % 1000 = 0")
    return ru.drift_inputs(e, ["amount", "dest"], ["label"], (F.col("step") > 400) & (F.col("event_id") % 1000 != 0))


POSITION = ["topic", "part", "pos"]
LOG = "log AS (SELECT l_orderkey AS id, l_returnflag AS topic, l_suppkey % 7 AS part, l_partkey AS pos, l_shipdate AS made, l_linenumber AS line FROM lineitem)"


@query(f"""WITH {LOG}, o AS (SELECT *, first(id) OVER (PARTITION BY topic, part, pos ORDER BY made, line, id) AS owner, min(row(made, line)) OVER (PARTITION BY topic, part, pos, id) AS seen FROM log)
SELECT CASE WHEN id = owner THEN CASE WHEN row(made, line) = seen THEN 'registered' ELSE 'duplicate' END WHEN row(made, line) = seen THEN 'conflict' ELSE 'conflict_repeat' END AS claim, count(*) AS n FROM o GROUP BY 1""")
def position_claims(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    log = li.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("topic"), (F.col("l_suppkey") % 7).alias("part"), F.col("l_partkey").alias("pos"), F.col("l_shipdate").alias("made"), F.col("l_linenumber").alias("line"))
    return ru.position_claims(log, "id", POSITION, ["made", "line"]).groupBy("claim").agg(F.count("*").alias("n"))


FACTS = f"""{PRED}, said AS (SELECT conv_id AS transaction_id, min(role) FILTER (turn = 0) AS submitted_by, count(*) AS turns FROM conversations GROUP BY conv_id),
facts AS (SELECT p.*, l.toxic AS label, l.quality, e.label AS version, s.submitted_by, s.turns FROM pred p LEFT JOIN labels l ON l.doc_id = p.transaction_id LEFT JOIN embeddings e ON e.vec_id = p.transaction_id LEFT JOIN said s USING (transaction_id))"""
EXCLUSIONS = {
    "no_label": "label IS NULL", "outcome_invalid": "label NOT IN (0, 1)", "not_submitted": "submitted_by IS NULL", "source_untrusted": "submitted_by <> 'user'", "one_turn_only": "turns < 2", "vector_missing": "version IS NULL",
    "version_retired": "version = 0", "probability_missing": "p IS NULL", "probability_out_of_range": "p < 0.01 OR p > 0.99", "made_before_start": "made_at < 600", "language_not_served": "lang NOT IN ('en', 'de')", "low_quality": "quality = 0",
}


def label_facts(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("transaction_id")).agg(F.min(F.when(F.col("turn") == 0, F.col("role"))).alias("submitted_by"), F.count("*").alias("turns"))
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("transaction_id"), F.col("toxic").alias("label"), "quality")
    vec = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("transaction_id"), F.col("label").alias("version"))
    return predictions(spark, sf_dir).join(lab, "transaction_id", "left").join(vec, "transaction_id", "left").join(said, "transaction_id", "left")


@query(f"WITH {FACTS} " + " UNION ALL ".join(f"SELECT '{k}' AS reason, count(*) AS n FROM facts WHERE {c} HAVING count(*) > 0" for k, c in EXCLUSIONS.items()))
def label_exclusion_reasons(spark, sf_dir):
    return lb.eligible_labels(label_facts(spark, sf_dir), {k: F.expr(c) for k, c in EXCLUSIONS.items()})[1]


@query(f"WITH {FACTS} SELECT source, coalesce(submitted_by, 'none') AS submitted_by, count(*) AS n, count(*) FILTER (" + " AND ".join(f"NOT coalesce({c}, false)" for c in EXCLUSIONS.values()) + ") AS eligible FROM facts GROUP BY 1, 2")
def label_eligibility_by_source(spark, sf_dir):
    excluded = lb.reasons({k: F.expr(c) for k, c in EXCLUSIONS.items()})
    facts = label_facts(spark, sf_dir).withColumn("excluded", excluded)
    return facts.groupBy("source", F.coalesce("submitted_by", F.lit("none")).alias("submitted_by")).agg(F.count("*").alias("n"), F.count_if(F.size("excluded") == 0).alias("eligible"))


MEASURES = {"n_rows": "count(*)", "n_positives": "sum(label)", "id_sum": "sum(event_id)", "cents": "sum(CAST(round(amount * 100) AS BIGINT))"}
#: The lower bits of the rows' digests, which a number of checks can hold exactly.
_PRINT = digest_sql("event_id", "step", "type", "CAST(amount AS DECIMAL(38, 6))", "label")
MEASURED = MEASURES | {"fingerprint": f"bit_xor({_PRINT}) % 9007199254740992"}


@query(f"""WITH {EVT}, kept AS (SELECT * FROM evt WHERE event_id % 997 <> 5), m AS (SELECT {', '.join(f'{c} AS {k}' for k, c in MEASURED.items())} FROM evt), f AS (SELECT {', '.join(f'{c} AS {k}' for k, c in MEASURED.items())}, count(*) FILTER (type = 'signup') AS synthetic FROM kept) """
    + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", CAST(m.{k} AS DOUBLE) AS expected, CAST(f.{k} AS DOUBLE) AS found, m.{k} = f.{k} AS passed FROM m, f" for k in MEASURED)
    + " UNION ALL SELECT 'synthetic', 0.0, CAST(synthetic AS DOUBLE), synthetic = 0 FROM f")
def provenance_gate(spark, sf_dir):
    """A dataset that lost a few rows, against the manifest of the whole."""
    e = evt(spark, sf_dir)
    digest = digest_number("event_id", "step", "type", F.col("amount").cast("decimal(38,6)"), "label")
    measures = {k: F.expr(c) for k, c in MEASURES.items()} | {"fingerprint": F.bit_xor(digest) % (1 << 53)}
    return ru.provenance(e.where("event_id % 997 <> 5"), e.agg(*[m.alias(k) for k, m in measures.items()]), measures, F.col("type") == "signup")


def _confusion(name: str, cut: float) -> str:
    return f"count(*) FILTER (p >= {cut} AND label = 1) AS tp_{name}, count(*) FILTER (p >= {cut} AND label = 0) AS fp_{name}, count(*) FILTER (p < {cut} AND label = 1) AS fn_{name}"


_RATES = ", ".join(f"fp_{m}, fn_{m}, tp_{m} / nullif(tp_{m} + fn_{m}, 0) AS recall_{m}, 2 * tp_{m} / nullif(2 * tp_{m} + fp_{m} + fn_{m}, 0) AS f1_{m}" for m in ("champion", "candidate"))
_POLICIES = {
    "min_deltas": {"f1_gain_below_0.01": "f1_candidate - f1_champion < 0.01", "recall_falls": "recall_candidate - recall_champion < 0"},
    "capped": {"f1_falls": "f1_candidate - f1_champion < 0", "more_false_positives_than_1.1x": "fp_candidate > 1.1 * fp_champion", "more_misses": "fn_candidate > fn_champion"},
    "non_inferior": {"f1_below_by_0.02": "f1_candidate - f1_champion < -0.02", "recall_below_by_0.02": "recall_candidate - recall_champion < -0.02"},
    "regression": {"f1_regression_over_0.02": "f1_candidate - f1_champion < -0.02", "recall_below_0.80": "recall_candidate < 0.80"},
}


@query(f"WITH {SCORES}, c AS (SELECT {_confusion('champion', 0.5)}, {_confusion('candidate', 0.4)} FROM scores), r AS (SELECT {_RATES} FROM c), "
    + "a AS (" + " UNION ALL ".join(f"SELECT '{k}' AS policy, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in v.items()) + ") AS reasons FROM r" for k, v in _POLICIES.items()) + ") SELECT policy, reasons = '' AS accepted, reasons FROM a")
def acceptance_policies(spark, sf_dir):
    s = scores(spark, sf_dir)
    hit = {m: F.col("p") >= cut for m, cut in (("champion", 0.5), ("candidate", 0.4))}
    counts = s.agg(*[a for m, h in hit.items() for a in (F.count_if(h & (F.col("label") == 1)).alias(f"tp_{m}"), F.count_if(h & (F.col("label") == 0)).alias(f"fp_{m}"), F.count_if(~h & (F.col("label") == 1)).alias(f"fn_{m}"))])
    rates = {f"recall_{m}": F.try_divide(F.col(f"tp_{m}"), F.col(f"tp_{m}") + F.col(f"fn_{m}")) for m in hit} | {f"f1_{m}": F.try_divide(2 * F.col(f"tp_{m}"), 2 * F.col(f"tp_{m}") + F.col(f"fp_{m}") + F.col(f"fn_{m}")) for m in hit}
    return ru.acceptance(counts.withColumns(rates))


@query(f"WITH {ORD} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {str(c in ('label', 'sender_new', 'dest_new')).lower()} AS forbidden, count({c}) AS n_present FROM ord" for c in ("event_id", "step", "type", "amount", "sender_new", "dest_new", "label")))
def payload_leaks(spark, sf_dir):
    return ru.leaks(ords(spark, sf_dir).select("event_id", "step", "type", "amount", "sender_new", "dest_new", "label"), ["label", "sender_new", "dest_new"])


@query("SELECT b.item_id AS l_orderkey, count(l.l_orderkey) AS matches, CASE count(l.l_orderkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM (SELECT DISTINCT item_id FROM benchmark) b LEFT JOIN lineitem l ON l.l_orderkey = b.item_id GROUP BY b.item_id")
def lookup_outcomes(spark, sf_dir):
    keys = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("l_orderkey"))
    return ru.lookup(read(spark, sf_dir, "lineitem"), keys, "l_orderkey")


@query(f"WITH {SCORES}, y AS (SELECT avg(label) AS baseline FROM scores) SELECT label, CAST(least(floor(p * 40), 39) AS BIGINT) AS bin, count(*) AS n, round(count(*) * 40.0 / sum(count(*)) OVER (PARTITION BY label), 6) AS density, round(any_value(baseline), 6) AS no_skill FROM scores, y GROUP BY 1, 2")
def score_density(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("bin", F.least(F.floor(F.col("p") * 40), F.lit(39)))
    bins = s.groupBy("label", "bin").agg(F.count("*").alias("n"))
    whole = bins.groupBy("label").agg(F.sum("n").alias("of"))
    base = bins.agg((F.sum(F.col("n") * F.col("label")) / F.sum("n")).alias("base"), F.lit(1).alias("k"))
    out = bins.join(whole, "label").withColumn("k", F.lit(1)).join(F.broadcast(base), "k")  # one row
    return out.select("label", "bin", "n", F.round(F.col("n") * 40.0 / F.col("of"), 6).alias("density"), F.round("base", 6).alias("no_skill"))


@query(f"""WITH {ORD}, d AS (SELECT step, count(*) AS n, step - lag(step) OVER (ORDER BY step) - 1 AS gap FROM ord GROUP BY step)
SELECT CASE WHEN gap IS NULL THEN 'first' WHEN gap = 0 THEN 'none' WHEN gap <= 2 THEN 'short' ELSE 'long' END AS gap_band, count(*) AS steps, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(n), 4) AS rows_per_step FROM d GROUP BY 1""")
def step_gaps(spark, sf_dir):
    from pyspark.sql import Window as W

    d = ords(spark, sf_dir).groupBy("step").agg(F.count("*").alias("n"))  # a row a step
    gap = F.col("step") - F.lag("step").over(W.orderBy("step")) - 1
    band = F.when(gap.isNull(), "first").when(gap == 0, "none").when(gap <= 2, "short").otherwise("long")
    return d.withColumn("gap_band", band).groupBy("gap_band").agg(F.count("*").alias("steps"), F.sum("n").alias("n_rows"), F.round(F.avg("n"), 4).alias("rows_per_step"))


@query(f"WITH {ORD} SELECT label, count(*) AS n, round(avg(sender_new - sender_old), 4) AS sender_change, round(avg(dest_new - dest_old), 4) AS dest_change, round(avg(abs(sender_old - amount - sender_new)), 4) AS sender_error, round(avg(abs(dest_old + amount - dest_new)), 4) AS dest_error FROM ord GROUP BY label")
def balance_changes(spark, sf_dir):
    mean = lambda c: F.round(F.avg(F.expr(c)), 4)
    return ords(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), mean("sender_new - sender_old").alias("sender_change"), mean("dest_new - dest_old").alias("dest_change"), mean("abs(sender_old - amount - sender_new)").alias("sender_error"), mean("abs(dest_old + amount - dest_new)").alias("dest_error"))


@query(f"WITH {EVT} SELECT * FROM (SELECT event_id, {_sql('sender')}, {_sql('dest')}, step FROM evt) WHERE step > 360".replace("SELECT * FROM (", "SELECT * EXCLUDE (step) FROM ("))
def stream_warm_start(spark, sf_dir):
    """The state of the earlier events comes from a batch table; only later events go through the stream."""
    events = evt(spark, sf_dir).select("event_id", "step", "amount", "sender", "dest")
    known = materialize(history.history_state(events.where("step <= 360")), "known")
    blocks = history.blocks_for(events)
    rows = arriving(events.where("step > 360"), lambda s: history.account_features(s, known, blocks=blocks), 3, "warm")
    out = jobs.paired(rows)
    return out.select(*[F.round(c, 4).alias(c) if "total" in c or "sum" in c else F.col(c) for c in out.columns])


@query("""WITH e AS (SELECT event_id, user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) - event_id % 5 AS step FROM events), m AS (SELECT *, max(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
SELECT event_id, user_id, step, last - step AS hours_late FROM m WHERE last > step""")
def stream_late_events(spark, sf_dir):
    """Events behind the newest of their account, as a stream of its own for the dead letters."""
    e = read(spark, sf_dir, "events")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    e = e.select("event_id", "user_id", (F.floor(micros / 3_600_000_000) - F.col("event_id") % 5).alias("step"))
    return arriving(e, lambda s: jobs.late_events(s, "user_id"), 3, "late", by="event_id")


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_json_files(spark, sf_dir):
    """JSON files as a source with a schema, and JSON lines appended by the sink."""
    base = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    e.write.json(f"{base}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 5).json(f"{base}/in")
    return jobs.drain(stream, path=f"{base}/out", checkpoint=f"{base}/checkpoint", fmt="json")[0]


@query(f"WITH {EVT} SELECT type, count(*) AS n, round(sum(amount), 2) AS total FROM evt GROUP BY type")
def stream_csv_append(spark, sf_dir):
    """Rows appended to CSV files with a header in each, batch by batch, then read back typed."""
    rows = arriving(evt(spark, sf_dir).select("event_id", "step", "type", "amount"), lambda s: s, 3, "csv", fmt="csv")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))
