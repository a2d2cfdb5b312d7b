"""Hand-made cases with known results."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import FrozenParams, kolmogorov, normal_two_sided, risk_level, suffix_number
from ledgerlens.operators import drift, features, joins, labels, metrics, splits, validate
from ledgerlens.operators.prefix import lag_global, row_ids, running_sums
from ledgerlens.sources import tables
from ledgerlens.streaming import jobs

LEDGER = "event_id long, step long, amount double, sender string, dest string"


def ledger(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LEDGER)


def last(spark, rows, key, hot=False):
    df = features.mark_new_pairs(ledger(spark, rows))
    past = features.past_windows_hot if hot else features.past_windows
    return past(df, key, "h").orderBy(F.desc("event_id")).first()


@pytest.mark.parametrize("hot", [False, True])
def test_history(spark, hot):
    r = last(spark, [(10, 40.0, "S1", "D1")], "sender", hot)
    assert (r["h_prev_count"], r["h_prev_mean"], r["h_hours_since_prev"]) == (0, None, None)
    r = last(spark, [(10, 100.0, "S1", "D1"), (11, 50.0, "S1", "D2")], "sender", hot)
    assert (r["h_prev_count"], r["h_prev_total"], r["h_prev_mean"], r["h_prev_max"], r["h_hours_since_prev"]) == (1, 100, 100, 100, 1)
    r = last(spark, [(10, 100.0, "S1", "D1"), (11, 50.0, "S1", "D2"), (12, 25.0, "S2", "D1")], "dest", hot)
    assert (r["h_prev_count"], r["h_prev_total"], r["h_count_24h"], r["h_sum_24h"]) == (1, 100, 1, 100)
    r = last(spark, [(3, 80.0, "A", "B"), (4, 20.0, "C", "D")], "sender", hot)
    assert r["h_prev_count"] == 0
    r = last(spark, [(5, 1.0, "A", "X"), (5, 2.0, "A", "X"), (5, 4.0, "A", "Y")], "sender", hot)
    assert (r["h_count_1h"], r["is_new_pair"], r["h_prev_partners"], r["h_hours_since_prev"]) == (2, 1, 1, 0)
    assert last(spark, [(1, 1.0, "A", "X"), (25, 1.0, "A", "X")], "sender", hot)["h_count_24h"] == 0
    assert last(spark, [(2, 1.0, "A", "X"), (25, 1.0, "A", "X")], "sender", hot)["h_count_24h"] == 1


def test_unseen_type_is_all_zeros(spark):
    df = ledger(spark, [(1, 5.0, "A", "B")]).withColumn("type", F.lit("NEW"))
    r = features.build_features(df, FrozenParams(9.0, ("IN", "OUT"))).first()
    assert (r["type_IN"], r["type_OUT"], r["amount_large"], r["hour"]) == (0, 0, 0, 0)


def test_contract_keeps_order_and_names_what_is_missing(spark):
    df = ledger(spark, [(1, 5.0, "A", "B")])
    assert features.contract(df, ["amount", "step"]).columns == ["amount", "step"]
    with pytest.raises(ValueError, match="nothing"):
        features.contract(df, ["nothing"])


@pytest.mark.parametrize(("score", "level"), [(0.0, "LOW"), (29.9999, "LOW"), (30.0, "MEDIUM"), (69.9999, "MEDIUM"), (70.0, "HIGH"), (100.0, "HIGH")])
def test_bands(spark, score, level):
    assert spark.range(1).select(risk_level(F.lit(score)).alias("x")).first()["x"] == level


def test_small_functions(spark):
    r = spark.range(1).select(suffix_number(F.lit("SIM-000123")).alias("a"), suffix_number(F.lit("x")).alias("b"), normal_two_sided(F.lit(1.959964)).alias("p"), kolmogorov(F.lit(0.1), F.lit(200), F.lit(200)).alias("k")).first()
    assert (r["a"], r["b"]) == (123, 0)
    assert r["p"] == pytest.approx(0.05, abs=1e-6) and r["k"] == pytest.approx(0.27, abs=1e-3)


def test_performance_on_120_labels(spark):
    rows = [(1.0 if i < 15 or 20 <= i < 25 else 0.0, int(i < 20)) for i in range(120)]
    r = drift.label_performance(spark.createDataFrame(rows, "p double, label int"), 0.5, 0.75).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["precision"], r["recall"], r["f1"], r["status"]) == (15, 5, 95, 5, 0.75, 0.75, 0.75, "stable")


def test_undefined_metrics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "p double, label int")
    assert metrics.confusion(df, 0.5).first()["recall"] == 0.0
    assert metrics.confusion(df, 0.5, undefined="null").first()["recall"] is None


def test_drift_by_hand(spark):
    rows = [(i, 1 + (i >= 400), float(i % 100), float(i % 100) + (10 if i >= 400 else 0), 1.0 if i == 7 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id long, part int, same double, moved double, rare double")
    out = {r["feature"]: r for r in drift.feature_drift(df, ["same", "moved", "rare"], F.when(F.col("part") == 1, "reference").otherwise("recent")).collect()}
    assert out["same"]["decision"] == "no_drift" and out["same"]["psi"] == pytest.approx(0, abs=1e-9)
    assert out["moved"]["decision"] == "drift" and out["moved"]["ks"] == pytest.approx(0.1)
    assert out["rare"]["decision"] == "insufficient_sample" and out["rare"]["psi"] is None


def test_cycle_drops_the_gap(spark):
    df = spark.createDataFrame([(s, 0) for s in (1, 2, 3, *range(5, 15))], "step long, label int")
    got = {r["step"]: r["split"] for r in splits.cycle_split(df, (1, 2), (5, 14)).collect()}
    assert 3 not in got and got[1] == got[2] == "train" and got[14] == "test"
    with pytest.raises(ValueError, match="three"):
        splits.clamped_split(df.where("step < 3"))


def test_first_per_step_then_payload(spark):
    df = ledger(spark, [(s, float(s), f"S{s}", f"D{s}") for s in (2, 4, 4, 5, 6)]).where("step > 3")
    assert sorted(r["step"] for r in splits.first_per(df, ["step"], ["event_id"]).collect()) == [4, 5, 6]


def test_samples_are_deterministic(spark):
    df = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 10 == 0).cast("int").alias("label"), (F.col("id") % 3 + 1.0).alias("w"))
    a, b = (sorted(r["event_id"] for r in splits.hash_sample(df.repartition(n), "event_id", 50).collect()) for n in (2, 7))
    assert a == b and len(a) == 50
    strata = {r["label"]: r["count"] for r in splits.stratified_sample(df, ["label"], "event_id", 100).groupBy("label").count().collect()}
    assert strata == {0: 90, 1: 10}
    assert splits.weighted_sample(df, "event_id", "w", 30).count() == 30


def test_one_to_one_refuses_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(ValueError, match="left"):
        joins.match_one_to_one(a, a.limit(1).withColumnRenamed("v", "w"), ["k"])


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        ("{", "not_an_object"),
        ("[1]", "not_an_object"),
        (None, "not_an_object"),
        ('{"isFraud":1}', "label_present"),
        ('{"event_id":"a"}', "missing_key"),
        ('{"event_id":7,"step":1,"type":"IN","amount":1,"sender":"s","dest":"d"}', "bad_id"),
        ('{"event_id":"a","step":true,"type":"IN","amount":1,"sender":"s","dest":"d"}', "bad_step"),
        ('{"event_id":"a","step":1.5,"type":"IN","amount":1,"sender":"s","dest":"d"}', "bad_step"),
        ('{"event_id":"a","step":1,"type":"NO","amount":1,"sender":"s","dest":"d"}', "unknown_type"),
        ('{"event_id":"a","step":1,"type":"IN","amount":"10","sender":"s","dest":"d"}', "bad_amount"),
        ('{"event_id":"a","step":1,"type":"IN","amount":-1,"sender":"s","dest":"d"}', "bad_amount"),
        ('{"event_id":"a","step":1,"type":"IN","amount":true,"sender":"s","dest":"d"}', "bad_amount"),
    ],
)
def test_event_rules(spark, raw, reason):
    good, bad = validate.validate_events(spark.createDataFrame([(raw,)], "value string"), "value", ["IN"])
    assert good.count() == 0
    (r,) = bad.collect()
    assert r["reason"] == reason
    assert raw is None or "isFraud" not in raw or '"[REDACTED]"' in r["value"]


def test_leak_check():
    validate.assert_no_leak(["amount"])
    with pytest.raises(ValueError, match="label"):
        validate.assert_no_leak(["amount", "label"])


def test_running_sums_and_lags(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    got = [r["s"] for r in running_sums(df, ["k"], {"s": F.col("k")}).orderBy("k").collect()]
    keys = sorted(r["k"] for r in df.collect())
    total, want = 0, []
    for k in keys:
        total += k
        want.append(total)
    assert got == want
    assert [r["row_id"] for r in row_ids(df, ["k"]).orderBy("k").collect()] == list(range(5000))
    assert [r["b"] for r in lag_global(df, ["k"], "k", "b").orderBy("k").collect()] == [None, *keys[:-1]]


def test_registry_records_each_conflict_once(spark):
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("a", "y", 4), ("b", None, 5), ("b", None, 6)]
    out = labels.fold_predictions(spark.createDataFrame(rows, "transaction_id string, payload string, t long"), ["t"])
    assert [r["disposition"] for r in out.orderBy("t").collect()] == ["registered", "duplicate", "conflict", "conflict_repeat", "registered", "duplicate"]


def test_create_only_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 0)], "event_id long, label int")
    tables.write_new(df, f"{tmp_path}/x")
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_new(df, f"{tmp_path}/x")


def test_csv_is_strict(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2.5\nx,3\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), "k long, v double").collect()


def test_kafka_options():
    o = tables.kafka_options("host:9092", "events")
    assert o["subscribe"] == "events" and o["maxOffsetsPerTrigger"] == "1000"


def test_restart_takes_up_where_it_ended(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.range(10).write.parquet(src)
    s = spark.readStream.schema("id long").parquet(src)
    rows, _ = jobs.drain(s, f"{tmp_path}/c", f"{tmp_path}/o")
    assert rows.count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    rows, q = jobs.drain(s, f"{tmp_path}/c", f"{tmp_path}/o")
    assert sorted(r["id"] for r in rows.collect()) == list(range(15))
    assert sum(p["rows"] for p in jobs.progress(q)) == 5
