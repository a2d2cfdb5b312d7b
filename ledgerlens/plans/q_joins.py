"""Queries on joins, splits, samples, sorts and sets."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators import features as ft
from ledgerlens.operators import joins as jn
from ledgerlens.operators import splits as sp
from ledgerlens.operators.prefix import row_ids, running_sums
from ledgerlens.plans.views import EVT, ORD, PRED, digest_sql, evt, ords, predictions, read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def truth(spark, sf_dir):
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("transaction_id"), F.col("toxic").alias("label"))


TRUTH = "truth AS (SELECT doc_id AS transaction_id, toxic AS label FROM labels)"


@query(f"WITH {PRED}, {TRUTH} SELECT source, count(*) AS n, count(label) AS matched, round(100.0 * count(label) / count(*), 4) AS match_pct FROM pred LEFT JOIN truth USING (transaction_id) GROUP BY source")
def one_to_one_match(spark, sf_dir):
    out = jn.match_one_to_one(predictions(spark, sf_dir), truth(spark, sf_dir), ["transaction_id"])
    hit = F.count_if("matched")
    return out.groupBy("source").agg(F.count("*").alias("n"), hit.alias("matched"), F.round(100 * hit / F.count("*"), 4).alias("match_pct"))


@query(f"""WITH {PRED}, {TRUTH} SELECT transaction_id, prediction, CASE WHEN label IS NOT NULL THEN made_at + 7200 END AS label_at, coalesce(label IS NOT NULL AND made_at + 7200 <= 30000, false) AS available,
CASE WHEN label IS NOT NULL AND made_at + 7200 <= 30000 THEN label END AS label FROM pred LEFT JOIN truth USING (transaction_id)""")
def delayed_label_join(spark, sf_dir):
    return jn.delayed_labels(predictions(spark, sf_dir), truth(spark, sf_dir), 7200, 30000).select("transaction_id", "prediction", "label_at", "available", "label")


@query(f"""WITH {PRED}, {TRUTH} SELECT transaction_id, p, label FROM pred JOIN truth t USING (transaction_id) WHERE lang IN ('en', 'de') AND source NOT LIKE 'src1%'
AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = t.transaction_id) AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = t.transaction_id AND c.turn > 4)""")
def eligible_labelled(spark, sf_dir):
    conflicts = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("transaction_id"))
    other = read(spark, sf_dir, "conversations").where("turn > 4").select(F.col("conv_id").alias("transaction_id"))
    p = predictions(spark, sf_dir).where(F.col("lang").isin("en", "de") & ~F.col("source").like("src1%"))
    out = p.join(truth(spark, sf_dir), "transaction_id").join(conflicts, "transaction_id", "left_anti").join(other, "transaction_id", "left_anti")
    return out.select("transaction_id", "p", "label")


@query(f"""WITH {PRED} SELECT transaction_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = transaction_id) AS labelled, EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = transaction_id) AS discussed FROM pred""")
def exists_flags(spark, sf_dir):
    return jn.flags_from(predictions(spark, sf_dir).select("transaction_id"), "transaction_id", labelled=truth(spark, sf_dir), discussed=read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("transaction_id")))


@query("WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM u WHERE k = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def vectors_of_labels(spark, sf_dir):
    keep = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    li = read(spark, sf_dir, "lineitem").join(keep, "l_orderkey", "left_semi")
    out = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("k"), F.max("l_partkey").alias("l_partkey"))
    return out.where("k = 1").drop("k")


@query(f"WITH {EVT}, a AS (SELECT * FROM evt WHERE step <= 400), b AS (SELECT * FROM evt WHERE step >= 390) SELECT 'step' AS key, count(*) AS shared FROM (SELECT step FROM a INTERSECT SELECT step FROM b) UNION ALL SELECT 'event_id', count(*) FROM (SELECT event_id FROM a INTERSECT SELECT event_id FROM b)")
def dataset_overlap(spark, sf_dir):
    e = evt(spark, sf_dir)
    return jn.overlap(e.where("step <= 400"), e.where("step >= 390"), ["step", "event_id"])


@query(f"WITH {EVT} SELECT sender AS account FROM evt INTERSECT SELECT dest FROM evt WHERE label = 1")
def accounts_in_both_roles(spark, sf_dir):
    e = evt(spark, sf_dir)
    return e.select(F.col("sender").alias("account")).intersect(e.where("label = 1").select("dest"))


@query(f"WITH {EVT} SELECT event_id, count(*) OVER (PARTITION BY dest) AS dest_total FROM evt")
def account_totals_per_row(spark, sf_dir):
    return jn.with_totals(evt(spark, sf_dir).select("event_id", "dest"), ["dest"], {"dest_total": F.count("*")}).drop("dest")


@query(f"WITH {PRED}, {TRUTH} SELECT count(*) AS n_labels, count(p.transaction_id) AS matched, count(*) - count(p.transaction_id) AS unmatched FROM truth LEFT JOIN (SELECT * FROM pred WHERE prediction = 1) p USING (transaction_id)")
def registry_match_rate(spark, sf_dir):
    p = predictions(spark, sf_dir).where("prediction = 1").select("transaction_id", F.lit(1).alias("hit"))
    return truth(spark, sf_dir).join(p, "transaction_id", "left").agg(F.count("*").alias("n_labels"), F.count("hit").alias("matched"), (F.count("*") - F.count("hit")).alias("unmatched"))


_COMPARED = ("prev_count", "prev_total", "prev_mean", "prev_max", "hours_since_prev", "count_24h", "sum_168h", "prev_partners")
_DEFINED = {"prev_mean": "AND r > 1", "prev_max": "AND r > 1", "hours_since_prev": "AND r > 1"}


@query(f"WITH {EVT}, w AS (SELECT event_id, row_number() OVER (PARTITION BY sender ORDER BY step, event_id) AS r FROM evt) " + " UNION ALL ".join(f"SELECT 'sender_{c}' AS column_name, count(*) AS n, count(*) FILTER (event_id % 97 = 0 {_DEFINED.get(c, '')}) AS n_different FROM w" for c in _COMPARED))
def feature_parity(spark, sf_dir):
    """Two ways to the same features, one of which is then off by more than the tolerance in every 97th event."""
    e = ft.mark_new_pairs(evt(spark, sf_dir))
    cols = [f"sender_{c}" for c in _COMPARED]
    other = ft.past_windows_hot(e, "sender", "sender").withColumns({c: F.when(F.col("event_id") % 97 == 0, F.col(c) * 1.01 + 1).otherwise(F.col(c)) for c in cols})
    return jn.parity(ft.past_windows(e, "sender", "sender"), other, "event_id", cols).drop("max_diff")


@query(f"""WITH {EVT}, w AS (SELECT *, sum(CAST(event_id % 50 = 0 AS INTEGER)) OVER (PARTITION BY dest ORDER BY step, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lost FROM evt)
SELECT 'whole' AS prefix, count(*) AS n, count(*) FILTER (false) AS n_different FROM w WHERE step <= 300 UNION ALL SELECT 'thinned', count(*), count(*) FILTER (event_id % 50 = 0 OR lost > 0) FROM w WHERE step <= 300""")
def prefix_invariance(spark, sf_dir):
    """Features of the first 300 hours don't change when later events are left out; they do where earlier ones are."""
    e = evt(spark, sf_dir)
    full = ft.past_windows(ft.mark_new_pairs(e), "dest", "dest").where("step <= 300")
    whole = ft.past_windows(ft.mark_new_pairs(e.where("step <= 300")), "dest", "dest")
    thinned = ft.past_windows(ft.mark_new_pairs(e.where("step <= 300 AND event_id % 50 <> 0")), "dest", "dest")
    cols = [c for c in full.columns if c.startswith("dest_")]
    worst = lambda part, of: jn.parity(full, part, "event_id", of, 0.0, 1e-9).agg(F.max("n").alias("n"), F.max("n_different").alias("n_different"))
    return worst(whole, cols).withColumn("prefix", F.lit("whole")).unionByName(worst(thinned, ["dest_prev_count"]).withColumn("prefix", F.lit("thinned")))


@query(f"""WITH {EVT}, live AS (SELECT * FROM evt WHERE step >= 600 AND label = 1), f AS (SELECT step AS s, event_id AS i FROM live ORDER BY step, event_id LIMIT 1)
SELECT event_id, step FROM evt, f WHERE (step < s OR (step = s AND event_id < i)) AND (sender IN (SELECT sender FROM live) OR dest IN (SELECT dest FROM live))""")
def warm_up_rows(spark, sf_dir):
    e = evt(spark, sf_dir)
    return jn.touching(e, e.where("step >= 600 AND label = 1")).select("event_id", "step")


@query(f"""WITH {EVT}, live AS (SELECT * FROM evt WHERE step >= 700), f AS (SELECT step AS s, event_id AS i FROM live ORDER BY step, event_id LIMIT 1)
SELECT event_id, step FROM evt, f WHERE (step < s OR (step = s AND event_id < i)) AND (sender IN (SELECT sender FROM live) OR dest IN (SELECT dest FROM live))""")
def warm_up_rows_all(spark, sf_dir):
    e = evt(spark, sf_dir)
    return jn.touching(e, e.where("step >= 700")).select("event_id", "step")


@query(f"WITH {ORD} SELECT event_id, amount, type FROM ord ORDER BY amount DESC, event_id LIMIT 25")
def top_amounts(spark, sf_dir):
    return ords(spark, sf_dir).select("event_id", "amount", "type").orderBy(F.desc("amount"), "event_id").limit(25)


@query(f"WITH {EVT} SELECT sender, count(*) AS n, round(sum(amount), 4) AS total FROM evt GROUP BY sender ORDER BY n DESC, sender LIMIT 10")
def top_accounts(spark, sf_dir):
    return evt(spark, sf_dir).groupBy("sender").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("total")).orderBy(F.desc("n"), "sender").limit(10)


@query(f"WITH {EVT} SELECT event_id, step, amount FROM evt ORDER BY step DESC, event_id DESC LIMIT 500")
def newest_events(spark, sf_dir):
    return evt(spark, sf_dir).select("event_id", "step", "amount").orderBy(F.desc("step"), F.desc("event_id")).limit(500)


CUTS = "s AS (SELECT step, sum(count(*)) OVER (ORDER BY step) / sum(count(*)) OVER () AS share FROM evt GROUP BY step), k AS (SELECT min(step) FILTER (share >= 0.7) AS a, min(step) FILTER (share >= 0.85) AS b FROM s), p AS (SELECT *, CASE WHEN step <= a THEN 'train' WHEN step <= b THEN 'validation' ELSE 'test' END AS split FROM evt, k)"
SUMMARY = "count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, min(step) AS first_step, max(step) AS last_step, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share_pct, round(100.0 * sum(label) / count(*), 4) AS rate_pct"


@query(f"WITH {EVT}, {CUTS} SELECT split, {SUMMARY} FROM p GROUP BY split")
def chronological_split(spark, sf_dir):
    return sp.split_summary(sp.temporal_split(evt(spark, sf_dir)))


@query(f"""WITH {EVT}, d AS (SELECT DISTINCT step FROM evt), r AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS i, count(*) OVER () AS n FROM d),
p AS (SELECT evt.*, CASE WHEN i < greatest(1, least(CAST(floor(n * 0.7) AS BIGINT), n - 2)) THEN 'train' WHEN i < greatest(greatest(1, least(CAST(floor(n * 0.7) AS BIGINT), n - 2)) + 1, least(CAST(floor(n * 0.85) AS BIGINT), n - 1)) THEN 'validation' ELSE 'test' END AS split FROM evt JOIN r USING (step))
SELECT split, {SUMMARY} FROM p GROUP BY split""")
def clamped_split(spark, sf_dir):
    return sp.split_summary(sp.clamped_split(evt(spark, sf_dir)))


@query(f"""WITH {EVT}, r AS (SELECT step, sum(count(*)) OVER (ORDER BY step) / sum(count(*)) OVER () AS share FROM evt WHERE step BETWEEN 401 AND 720 GROUP BY step), k AS (SELECT min(step) FILTER (share >= 0.6) AS a, min(step) FILTER (share >= 0.8) AS b FROM r),
p AS (SELECT *, CASE WHEN step <= 350 OR step <= a THEN 'train' WHEN step <= b THEN 'validation' ELSE 'test' END AS split FROM evt, k WHERE step <= 350 OR step BETWEEN 401 AND 720) SELECT split, {SUMMARY} FROM p GROUP BY split""")
def cycle_split(spark, sf_dir):
    return sp.split_summary(sp.cycle_split(evt(spark, sf_dir), (1, 350), (401, 720)))


@query(f"WITH {EVT} SELECT CASE WHEN step BETWEEN 1 AND 350 THEN 'reference' WHEN step BETWEEN 401 AND 720 THEN 'recent' ELSE 'excluded' END AS part, count(*) AS n, min(step) AS first_step, max(step) AS last_step FROM evt GROUP BY 1")
def window_tags(spark, sf_dir):
    return evt(spark, sf_dir).groupBy(sp.window_tag((1, 350), (401, 720)).alias("part")).agg(F.count("*").alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query(f"""WITH {EVT}, {CUTS}, t AS (SELECT split, count(*) AS n, count(DISTINCT event_id) AS ids, count(DISTINCT label) AS classes, min(step) AS lo, max(step) AS hi FROM p GROUP BY split)
SELECT (SELECT min(classes) = 2 FROM t) AS both_classes, (SELECT bool_and(n = ids) FROM t) AS unique_ids, (SELECT CAST(sum(n) AS BIGINT) FROM t) = (SELECT count(*) FROM evt) AS covers_all,
(SELECT hi FROM t WHERE split = 'train') < (SELECT lo FROM t WHERE split = 'validation') AND (SELECT hi FROM t WHERE split = 'validation') < (SELECT lo FROM t WHERE split = 'test') AS in_order""")
def split_audit(spark, sf_dir):
    s = sp.temporal_split(evt(spark, sf_dir))
    t = s.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.countDistinct("label").alias("classes"), F.min("step").alias("lo"), F.max("step").alias("hi"))
    at = lambda col, name: F.max(F.when(F.col("split") == name, F.col(col)))
    total = evt(spark, sf_dir).count()
    return t.agg(
        (F.min("classes") == 2).alias("both_classes"),
        F.bool_and(F.col("n") == F.col("ids")).alias("unique_ids"),
        (F.sum("n") == total).alias("covers_all"),
        ((at("hi", "train") < at("lo", "validation")) & (at("hi", "validation") < at("lo", "test"))).alias("in_order"),
    )


@query(f"""WITH {EVT}, a AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY event_id) AS r FROM evt WHERE step > 504), b AS (SELECT *, row_number() OVER (PARTITION BY type, amount, sender, dest ORDER BY step, event_id) AS q FROM a WHERE r = 1)
SELECT event_id, step, type, amount FROM b WHERE q = 1""")
def first_per_step_and_payload(spark, sf_dir):
    one = sp.first_per(evt(spark, sf_dir).where("step > 504"), ["step"], ["event_id"])
    return sp.first_per(one, ["type", "amount", "sender", "dest"], ["step", "event_id"]).select("event_id", "step", "type", "amount")


HASH = digest_sql("event_id", "42")


@query(f"WITH {EVT} SELECT * FROM evt ORDER BY {HASH}, event_id LIMIT 500")
def uniform_sample(spark, sf_dir):
    return sp.hash_sample(evt(spark, sf_dir), "event_id", 500)


@query(f"""WITH {ORD}, r AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN amount END AS rare, {HASH} AS h FROM ord)
SELECT * EXCLUDE (h) FROM r WHERE event_id IN (SELECT event_id FROM r ORDER BY h, event_id LIMIT 300) OR event_id IN (SELECT event_id FROM r WHERE rare IS NOT NULL ORDER BY h, event_id LIMIT 30) OR event_id IN (SELECT event_id FROM r WHERE amount IS NOT NULL ORDER BY h, event_id LIMIT 30)""")
def covering_sample(spark, sf_dir):
    o = ords(spark, sf_dir).withColumn("rare", F.when(F.col("event_id") % 97 == 0, F.col("amount")))
    return sp.covering_sample(o, "event_id", ["rare", "amount"], 300)


@query(f"WITH {EVT} SELECT type, label, CAST(round(1000 * count(*) / (SELECT count(*) FROM evt)) AS BIGINT) AS n FROM evt GROUP BY type, label")
def stratified_sample(spark, sf_dir):
    out = sp.stratified_sample(evt(spark, sf_dir), ["type", "label"], "event_id", 1000)
    return out.groupBy("type", "label").agg(F.count("*").alias("n"))


@query(f"WITH {EVT} SELECT * FROM evt WHERE amount > 0 ORDER BY -ln(({HASH} % 1099511627776 + 0.5) / 1099511627776.0) / amount, event_id LIMIT 400")
def weighted_sample(spark, sf_dir):
    return sp.weighted_sample(evt(spark, sf_dir), "event_id", "amount", 400)


@query(f"""WITH {EVT}, c AS (SELECT *, count(*) OVER (PARTITION BY sender) AS k, row_number() OVER (PARTITION BY sender ORDER BY step, event_id) AS r FROM evt), s AS (SELECT sender FROM c WHERE k >= 2 ORDER BY k DESC, sender LIMIT 1)
SELECT event_id, sender, step, amount FROM c WHERE r <= 2 AND sender = (SELECT sender FROM s)""")
def first_repeating_account(spark, sf_dir):
    e = evt(spark, sf_dir)
    top = e.groupBy("sender").count().where("count >= 2").orderBy(F.desc("count"), "sender").limit(1).select("sender")
    return e.join(F.broadcast(top), "sender", "left_semi").select("event_id", "sender", "step", "amount").orderBy("step", "event_id").limit(2)  # one row is broadcast


@query(f"WITH {EVT}, {CUTS} SELECT 'SIM-' || lpad(CAST(row_number() OVER (ORDER BY step, event_id) - 1 AS VARCHAR), 6, '0') AS transaction_id, event_id, step FROM p WHERE split = 'test'")
def held_out_stream(spark, sf_dir):
    test = sp.temporal_split(evt(spark, sf_dir)).where("split = 'test'")
    return row_ids(test, ["step", "event_id"]).select(F.format_string("SIM-%06d", "row_id").alias("transaction_id"), "event_id", "step")


@query(f"WITH {EVT}, r AS (SELECT step, avg(label) AS rate FROM evt GROUP BY step) SELECT step, round(avg(rate) OVER (ORDER BY step ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS rolling_rate FROM r")
def rolling_rate(spark, sf_dir):
    r = evt(spark, sf_dir).groupBy("step").agg(F.avg("label").alias("rate"))
    return r.select("step", F.round(F.avg("rate").over(W.orderBy("step").rowsBetween(-23, 0)), 6).alias("rolling_rate"))


@query(f"WITH {EVT} SELECT step, round(sum(count(*)) OVER (ORDER BY step) / sum(count(*)) OVER (), 6) AS share FROM evt GROUP BY step")
def cumulative_share(spark, sf_dir):
    return sp.step_table(evt(spark, sf_dir)).select("step", F.round("share", 6).alias("share"))


@query(f"WITH {EVT} SELECT event_id, row_number() OVER (ORDER BY amount, event_id) - 1 AS row_id, CAST(sum(label) OVER (ORDER BY amount, event_id) AS BIGINT) AS positives_so_far FROM evt")
def distributed_running_sum(spark, sf_dir):
    out = running_sums(evt(spark, sf_dir), ["amount", "event_id"], {"row_id": F.lit(1), "positives_so_far": F.col("label")})
    return out.select("event_id", (F.col("row_id") - 1).cast("long").alias("row_id"), F.col("positives_so_far").cast("long").alias("positives_so_far"))


@query(f"""WITH {EVT}, r AS (SELECT event_id, step, row_number() OVER (ORDER BY event_id) - 1 AS i, sum(label) OVER (ORDER BY event_id) AS c FROM evt), w AS (SELECT b.i AS last_row, b.c - coalesce(a.c, 0) AS positives FROM r b LEFT JOIN r a ON a.i = b.i - 200 WHERE b.i >= 199)
SELECT last_row, CAST(positives AS BIGINT) AS positives FROM w ORDER BY abs(positives - 40), last_row LIMIT 1""")
def best_row_window(spark, sf_dir):
    n = 200
    run = running_sums(evt(spark, sf_dir), ["event_id"], {"i": F.lit(1), "c": F.col("label")}).select((F.col("i") - 1).alias("i"), "c")
    start = run.select((F.col("i") + n).alias("i"), F.col("c").alias("c0"))
    w = run.where(F.col("i") >= n - 1).join(start, "i", "left").withColumn("positives", F.col("c") - F.coalesce("c0", F.lit(0)))
    return w.orderBy(F.abs(F.col("positives") - 40), "i").limit(1).select(F.col("i").cast("long").alias("last_row"), F.col("positives").cast("long").alias("positives"))


@query(f"WITH {EVT} SELECT event_id, type, amount FROM evt WHERE (contains(lower(type), 'ur') OR contains(CAST(event_id AS VARCHAR), '77')) AND type IN ('purchase', 'view') ORDER BY amount DESC NULLS LAST, event_id")
def explorer_filter(spark, sf_dir):
    e = evt(spark, sf_dir)
    has = F.contains(F.lower("type"), F.lit("ur")) | F.contains(F.col("event_id").cast("string"), F.lit("77"))
    return e.where(has & F.col("type").isin("purchase", "view")).select("event_id", "type", "amount").orderBy(F.desc_nulls_last("amount"), "event_id")


@query(f"WITH {EVT} SELECT 'old' AS part, event_id, step, label FROM evt WHERE step <= 100 UNION ALL SELECT 'recent', event_id, step, label FROM evt WHERE step >= 650")
def concatenated_windows(spark, sf_dir):
    e = evt(spark, sf_dir).select("event_id", "step", "label")
    return e.where("step <= 100").withColumn("part", F.lit("old")).unionByName(e.where("step >= 650").withColumn("part", F.lit("recent")))


@query(f"WITH {EVT} SELECT event_id, type FROM evt WHERE amount > 150 UNION SELECT event_id, type FROM evt WHERE type = 'error'")
def union_of_samples(spark, sf_dir):
    e = evt(spark, sf_dir)
    return e.where("amount > 150").select("event_id", "type").union(e.where("type = 'error'").select("event_id", "type")).dropDuplicates()


@query("SELECT c_custkey AS account FROM customer EXCEPT SELECT o_custkey FROM orders")
def accounts_without_orders(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account")).join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account")), "account", "left_anti").distinct()


@query("SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_discount < 0.02")
def pruned_scan(spark, sf_dir):
    """Filters and columns reach the Parquet scan."""
    return read(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1998-06-01' AND l_discount < 0.02").select("l_orderkey", "l_partkey", "l_shipdate")


@query("SELECT event_id, event_type, value FROM events WHERE event_id IN (SELECT item_id * 13 FROM benchmark)")
def point_lookup(spark, sf_dir):
    wanted = read(spark, sf_dir, "benchmark").select((F.col("item_id") * 13).alias("event_id"))
    found = read(spark, sf_dir, "events").join(wanted, "event_id", "left_semi")
    jn.assert_unique(found, ["event_id"], "events")
    return found.select("event_id", "event_type", "value")


@query("SELECT l_orderkey, max(l_shipdate) AS l_shipdate, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def last_record_wins(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    out = li.groupBy("l_orderkey").agg(F.max_by(F.struct("l_shipdate", "l_linenumber"), F.struct("l_shipdate", "l_linenumber")).alias("r"), F.count("*").alias("n"))
    return out.select("l_orderkey", "r.l_shipdate", "n")
