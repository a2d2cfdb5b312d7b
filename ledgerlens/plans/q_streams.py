"""Queries that run streams over the given tables, and those that fit a model."""

from pyspark.sql import functions as F

from ledgerlens.operators import features as ft
from ledgerlens.operators import model as ml
from ledgerlens.operators import validate as va
from ledgerlens.operators.splits import cut_steps, temporal_split
from ledgerlens.plans.q_labels import ALLOWED, REASON, raw_events
from ledgerlens.plans.views import EVT, evt, ords, read
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


def event_stream(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def arriving(df, transform, parts: int, name: str, by: str = "step", fmt: str = "parquet"):
    """Run ``transform`` as a stream over a table that arrives in ``parts`` ranges of a column, one
    bounded run for each with the same checkpoint; return all rows written."""
    import uuid

    spark, base = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    last, out = df.agg(F.max(by)).first()[0] or 0, None
    for i in range(parts):
        low = F.col(by) > last * i // parts if i else F.lit(True)
        df.where(low & (F.col(by) <= last * (i + 1) // parts)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
        out, _ = jobs.drain(transform(stream), f"{base}/checkpoint", f"{base}/out", fmt)
    return out


def _sql(role: str) -> str:
    past = f"(PARTITION BY {role} ORDER BY step, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    same = f"(PARTITION BY {role}, step ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    out = [f"count(*) OVER {past} AS {role}_prev_count", f"round(coalesce(sum(amount) OVER {past}, 0), 4) AS {role}_prev_total", f"max(amount) OVER {past} AS {role}_prev_max", f"step - lag(step) OVER (PARTITION BY {role} ORDER BY step, event_id) AS {role}_hours_since_prev"]
    for w in (24, 168):
        r = f"(PARTITION BY {role} ORDER BY step RANGE BETWEEN {w - 1} PRECEDING AND 1 PRECEDING)"
        out += [f"count(*) OVER {r} + count(*) OVER {same} AS {role}_count_{w}h", f"round(coalesce(sum(amount) OVER {r}, 0) + coalesce(sum(amount) OVER {same}, 0), 4) AS {role}_sum_{w}h"]
    return ", ".join(out)


@query(f"WITH {EVT} SELECT event_id, {_sql('sender')}, {_sql('dest')} FROM evt")
def stream_account_features(spark, sf_dir):
    events = evt(spark, sf_dir).select("event_id", "step", "amount", "sender", "dest")
    blocks = history.blocks_for(events)
    rows = arriving(events, lambda s: history.account_features(s, blocks=blocks), 3, "ordered")
    out = jobs.paired(rows)
    return out.select(*[F.round(c, 4).alias(c) if "total" in c or "sum" in c else F.col(c) for c in out.columns])


@query(f"WITH {EVT} SELECT coalesce({REASON}, 'valid') AS outcome, count(*) AS n FROM evt GROUP BY 1")
def stream_validation(spark, sf_dir):
    import uuid

    path = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    raw_events(spark, sf_dir).select("value").write.text(path)
    lines = spark.readStream.option("maxFilesPerTrigger", 5).text(path)
    good, bad = va.validate_events(lines, "value", ALLOWED)
    valid, _ = jobs.drain(good.select("event_id", "step", "amount"))
    dead, _ = jobs.drain(bad.select("reason", "value"))
    counts = dead.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n"))
    return counts.unionByName(valid.agg(F.lit("valid").alias("outcome"), F.count("*").alias("n")))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') AS s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT CAST(epoch(s) AS BIGINT) AS start, event_type, n, total FROM w WHERE s + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_activity_windows(spark, sf_dir):
    s = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows, _ = jobs.drain(jobs.activity(s))
    return rows.select(F.unix_timestamp(F.col("start")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_deduplication(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    twice = materialize(e.unionByName(e.where("event_id % 3 = 0")), "twice")
    path = twice.inputFiles()[0].rsplit("/", 1)[0]
    s = spark.readStream.schema(e.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    rows, _ = jobs.drain(jobs.once(s, "event_id", late="800 hours"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '2000-01-01') - to_hours(2 * i) AS s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 3) r(i) GROUP BY 1, 2)
SELECT CAST(epoch(s) AS BIGINT) AS start, event_type, n, total FROM w WHERE s + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sliding_windows(spark, sf_dir):
    s = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows, _ = jobs.drain(jobs.activity(s, slide="2 hours"))
    return rows.select(F.unix_timestamp(F.col("start")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOURS) AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, sf_dir):
    """Sessions of accounts that arrive in three parts, so that most are open from one batch to the next."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    rows = arriving(e.withColumn("at", F.unix_timestamp("ts") - F.lit(1704067200)), lambda s: jobs.sessions(s, "user_id", gap="6 hours"), 3, "sessions", by="at")
    return rows.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", F.round("total", 4).alias("total"))


@query("""WITH t AS (SELECT least(max(ts) - INTERVAL 1 HOUR, max(ts) FILTER (event_id % 4 = 0)) AS mark FROM events)
SELECT event_type, count(*) FILTER (event_id % 4 = 0) AS matched, count(*) FILTER (event_id % 4 <> 0 AND ts + INTERVAL 2 HOURS < mark) AS unmatched FROM events, t GROUP BY event_type""")
def stream_delayed_labels(spark, sf_dir):
    """Labels that come an hour later. A prediction without one is released, as unmatched, once the
    watermark says that none can come any more; those that may still get one are held back."""
    p = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    t = event_stream(spark, sf_dir).where("event_id % 4 = 0").select(F.col("event_id").alias("label_key"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("label_ts"))
    rows, _ = jobs.drain(jobs.delayed_labels(p, t, "event_id"))
    hit = F.col("label_key").isNotNull()
    return rows.groupBy("event_type").agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def stream_batch_sink(spark, sf_dir):
    """Batches written to partitions of their own number, two runs with one checkpoint."""
    import uuid

    base = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    e.repartition(6, "event_id").write.parquet(f"{base}/in")
    for _ in range(2):
        jobs.write_batches(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint")
    rows = jobs.read_batches(spark, f"{base}/out", e.schema)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS batches, CAST(1 AS BIGINT) AS n_queries FROM events")
def stream_progress(spark, sf_dir):
    """What a listener has recorded of a run over six files by two, and of a second one, which has nothing to do."""
    import uuid

    base = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    e = read(spark, sf_dir, "events").select("event_id", "value")
    e.repartition(6, "event_id").write.parquet(f"{base}/in")
    with jobs.ProgressTable(spark, f"{base}/progress") as log:
        for _ in range(2):
            jobs.drain(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in"), f"{base}/checkpoint", f"{base}/out")
    worked = log.table().where("n_rows > 0")
    return worked.agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("batches"), F.countDistinct("query").alias("n_queries"))


HISTORY = ("prev_count", "prev_total", "prev_mean", "prev_max", "hours_since_prev", "count_168h", "sum_168h")
AMOUNTS = ("log_amount", "amount_large", "amount_to_sender", "amount_to_dest", "empties_sender", "sender_remaining", "amount_vs_sender_mean", "amount_vs_dest_mean")
BALANCES = ("sender_old", "dest_old", "dest_zero", "log_sender", "log_dest")


def _risk():
    """A label that can be learned, which the order's status can't: 4 % of orders, and more of those that are
    urgent, far above what their account spent before, or beyond its balance; by the hash of the order."""
    share = 4 + 16 * (F.col("type") == "1-URGENT").cast("int") + 30 * F.coalesce(F.col("amount") > 2 * F.col("sender_prev_mean"), F.lit(False)).cast("int") + 25 * (F.col("sender_old") < 500).cast("int")
    return (F.pmod(F.xxhash64("event_id"), F.lit(100)) < share).cast("int")


def _model_input(spark, sf_dir):
    """Orders with 34 features of amount, balances, type, time and both accounts' past; how to make those that
    depend on amount or type anew; the features' names and the types."""
    from ledgerlens.functions.scalars import amounts, one_hot, safe_divide

    o = materialize(ords(spark, sf_dir), "ledger")
    train_end = cut_steps(o)[0]
    params = ft.fit_params(o, train_end)
    kinds = one_hot("type", params.types)

    def derived(df):
        ratios = {f"amount_vs_{r}_mean": safe_divide(F.col("amount"), F.col(f"{r}_prev_mean")) for r in ("sender", "dest")}
        return df.withColumns(amounts(params) | ratios | kinds)

    features = ["amount", *AMOUNTS, *BALANCES, "step", *kinds, *[f"{r}_{h}" for r in ("sender", "dest") for h in HISTORY]]
    rows = ft.build_features(temporal_split(o), params).withColumn("label", _risk()).select("event_id", "label", "split", "type", *features)
    return materialize(rows, "model-input"), derived, features, params.types


def _model(spark, sf_dir):
    o, derived, features, types = _model_input(spark, sf_dir)
    model, how = ml.fit(o.where("split = 'train'"), features, o.where("split = 'validation'"))
    return o, model, how, derived, types


@query()
def model_scores(spark, sf_dir):
    o, model, how, _, _ = _model(spark, sf_dir)
    return ml.score(model, how, o.where("split <> 'train'")).select("event_id", "label", "split", "p", "predicted", "risk", "level")


@query()
def model_rounds(spark, sf_dir):
    """Loss of both parts after each round up to the one at which the validation part ended the boosting."""
    o, model, how, _, _ = _model(spark, sf_dir)
    parts = [ml.losses(model, how, o.where(F.col("split") == s)) for s in ("train", "validation")]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(zip(*parts, strict=True), 1)], "round int, train_loss double, validation_loss double")


@query()
def feature_importance(spark, sf_dir):
    _, model, how, _, _ = _model(spark, sf_dir)
    return ml.importance(model, how, spark)


@query()
def local_attributions(spark, sf_dir):
    o, model, how, _, _ = _model(spark, sf_dir)
    return ml.attributions(model, how, o.where("split = 'test'"))


@query()
def global_attributions(spark, sf_dir):
    o, model, how, _, _ = _model(spark, sf_dir)
    return ml.global_attributions(model, how, o.where("split = 'test'"))


@query()
def counterfactual_amounts(spark, sf_dir):
    """The nearest change of amount (by 1 to 400 %, both ways) or type that flips each decision of the test part."""
    o, model, how, derived, types = _model(spark, sf_dir)
    return ml.counterfactuals(model, how, o.where("split = 'test'"), types, derived)
