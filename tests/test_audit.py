"""Audits, redaction, samples, label trust and searches on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import explorer, labels, metrics, monitor, profile, splits, validate
from ledgerlens.operators.prefix import nearest_window


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"label":1,"event_id":"e"}', '{"label":"[REDACTED]","event_id":"e"}'),
        ('{"a":{"isFraud" : true, "b":[{"outcome":"fra\\"ud"}]}}', '{"a":{"isFraud":"[REDACTED]", "b":[{"outcome":"[REDACTED]"}]}}'),
        ('{"label":{"value":1}}', "[REDACTED]"),
        ('{"a":[1,{"outcome":[1,2]}]}', "[REDACTED]"),
        ('{"event_id":"a","label":"fra', "[REDACTED]"),
        ('{"event_id":"a","label":1', '{"event_id":"a","label":"[REDACTED]"'),
        ('{"\\u006cabel":1}', "[REDACTED]"),
        ('{"labels":1,"text":"label"}', '{"labels":1,"text":"label"}'),
        ("no json", "no json"),
        (None, None),
    ],
)
def test_redaction_at_any_depth(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "value string").select(validate.redact("value").alias("v")).first()["v"] == want


def test_events_are_parsed_once(spark):
    df = spark.createDataFrame([(json.dumps({"event_id": "a", "step": 3, "type": "IN", "amount": 2.5, "sender": "s", "dest": "d"}), 9)], "value string, event_id int")
    good, bad = validate.validate_events(df.drop("event_id"), "value", ["IN"])
    assert good.drop("value").first() == ("a", 3, "IN", 2.5, "s", "d") and bad.count() == 0
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") <= 2  # the call and its name in the plan


def test_stratified_sample_of_many_strata(spark):
    df = spark.range(20_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 300).alias("k"))
    rows = splits.stratified_sample(df, ["k"], "event_id", 2000)
    sizes = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    got = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    assert got == {k: round(2000 * n / 20_000) for k, n in sizes.items() if round(2000 * n / 20_000)}
    assert rows.columns == df.columns and sorted(r[0] for r in rows.select("event_id").collect()) == sorted(r[0] for r in splits.stratified_sample(df.repartition(7), ["k"], "event_id", 2000).select("event_id").collect())


def test_clamped_split_has_all_parts(spark):
    df = spark.createDataFrame([(s, 0) for s in (3, 3, 5, 9)], "step long, label int")
    assert {r["step"]: r["split"] for r in splits.clamped_split(df).collect()} == {3: "train", 5: "validation", 9: "test"}


def test_full_audit(spark):
    rows = [(1, 2.0, "a"), (1, 2.0, "a"), (2, None, "b"), (3, float("inf"), None), (4, float("nan"), "c"), (4, -1.0, "c")]
    out = {r["rule"]: (r["n_found"], r["pct"]) for r in profile.full_audit(spark.createDataFrame(rows, "id long, x double, t string"), "id", ["x"], {"negative": F.col("x") < 0}).collect()}
    assert out == {"missing_cells": (3, 16.6667), "rows_with_missing": (3, 50.0), "infinite_values": (1, 16.6667), "nan_values": (1, 16.6667), "negative": (1, 16.6667), "duplicate_rows": (1, 16.6667), "duplicate_ids": (2, 33.3333)}
    empty = profile.full_audit(spark.createDataFrame([], "id long, x double"), "id", ["x"], {}).collect()
    assert {r["n_found"] for r in empty} == {0}


def test_concentration_of_positives(spark):
    data = [(5,), (5,), (2,), (1,), (1,), (1,)] + [(0,)] * 4
    r = profile.positive_concentration(spark.createDataFrame(data, "positives long"), top=3, share=0.2).first()
    assert tuple(r) == (6, 60.0, 80.0, 80.0, 66.6667)


def test_nearest_window_prefers_steps_then_the_earliest(spark):
    steps = [1, 1, 1, 2, 3, 3, 3, 4, 5, 6]
    label = [1, 0, 0, 1, 0, 0, 1, 0, 1, 0]
    df = spark.createDataFrame([(s, i, y) for i, (s, y) in enumerate(zip(steps, label, strict=True))], "step long, event_id long, label int").repartition(3)
    best = min((abs(sum(label[i : i + 4]) - 1), -len(set(steps[i : i + 4])), i) for i in range(7) if 1 <= sum(label[i : i + 4]) < 4)
    r = nearest_window(df, ["step", "event_id"], "label", 4, 1).first()
    assert (r["first_row"], r["last_row"], r["positives"], r["steps"]) == (best[2], best[2] + 3, 1 + best[0], -best[1])
    assert nearest_window(df, ["step", "event_id"], "label", 4, 4).collect() == []


def test_recent_vectors(spark):
    line = lambda i, **x: json.dumps({"transaction_id": f"t{i % 3}", "model_version": "V2", "processed_at": f"2024-01-0{i}", "feature_values": {"a": i, "b": None}} | x)
    lines = [line(1), line(2, data_origin="live"), "{", line(4, model_version="V1", feature_values={}), line(5, feature_values={"a": True, "b": 1}), line(6, feature_values={"b": 1}), "[1]", line(8)]
    vectors, about = monitor.recent_vectors(spark.createDataFrame(list(enumerate(lines)), "line long, value string"), ["a", "b"], "V2", 100)
    assert {r["transaction_id"]: (r["a"], r["b"], r["origin"]) for r in vectors.collect()} == {"t1": (1.0, None, "unspecified"), "t2": (8.0, None, "unspecified")}
    assert about.first().asDict() == {"records_read": 8, "malformed_records": 4, "vectors": 2, "window_start": "2024-01-01", "window_end": "2024-01-08", "origins": "unspecified=2"}
    none, about = monitor.recent_vectors(spark.createDataFrame([], "line long, value string"), ["a"], "V2", 100)
    assert none.count() == 0 and about.first()["vectors"] == 0


def test_each_trust_reason(spark):
    good = {"transaction_id": 1, "source_type": "user", "disposition": "accepted", "outcome": 1, "n_conflicts": 0, "n_predictions": 1, "prediction_conflict": False, "version": 2, "origin": "live", "step": 9, "n_vectors": 1, "vector_valid": True}
    bad = {
        "synthetic_label": {"source_type": "test"}, "untrusted_or_unauthorized": {"source_type": "other"}, "pending_or_rejected": {"disposition": "pending_prediction"}, "unmatched_prediction": {"n_predictions": 0, "version": None, "origin": None, "step": None},
        "synthetic_prediction": {"origin": "Synthetic-x"}, "other_version": {"version": 1}, "label_conflict": {"n_conflicts": 1}, "prediction_conflict": {"prediction_conflict": True}, "submission_not_accepted": {"disposition": "conflict"},
        "missing_or_duplicate_feature_vector": {"n_vectors": 2}, "invalid_feature_vector": {"vector_valid": False}, "heldout_boundary_violation": {"step": 3},
    }
    schema = "transaction_id long, source_type string, disposition string, outcome int, n_conflicts long, n_predictions long, prediction_conflict boolean, version int, origin string, step long, n_vectors long, vector_valid boolean"
    facts = spark.createDataFrame([good] + [good | x | {"transaction_id": i} for i, x in enumerate(bad.values(), 2)], schema)
    rules = labels.trust_rules(["user", "test"], "test", 2, 3)
    why = {r["transaction_id"]: r["why"] for r in facts.select("transaction_id", labels.reasons(rules).alias("why")).collect()}
    assert why[1] == []
    for i, name in enumerate(bad, 2):
        assert name in why[i] and set(why[i]) <= {name, "submission_not_accepted"}, (name, why[i])


def test_reasons_for_undefined_metrics(spark):
    df = spark.createDataFrame([("a", 0.9, 0), ("b", 0.1, 1), ("c", 0.1, 0), ("d", 0.9, 1), ("e", 0.9, 0), ("e", 0.1, 1)], "g string, p double, label int")
    out = {r["g"]: (r["precision"], r["recall"], r["f1"], r["reasons"].count(":")) for r in metrics.undefined_reasons(metrics.confusion(df, 0.5, ["g"], undefined="null")).collect()}
    assert out == {"a": (0.0, None, None, 2), "b": (None, 0.0, None, 2), "c": (None, None, None, 3), "d": (1.0, 1.0, 1.0, 0), "e": (0.0, 0.0, 0.0, 0)}


def test_explorer(spark):
    df = spark.createDataFrame([(1, "Alpha", 2.0), (2, "beta", None), (77, None, 1.0)], "id long, name string, x double")
    ids = lambda **k: [r["id"] for r in explorer.explore(df, **k).collect()]
    assert ids(text="ALPHA") == [1] and ids(text="7") == [77] and sorted(ids()) == [1, 2, 77]
    assert ids(order="x") == [77, 1, 2] and ids(order="x", descending=True) == [1, 77, 2]
    assert ids(among={"id": [2, 77], "name": []}, order="id") == [2, 77] and ids(text="%") == []
    assert explorer.repeated_rows(df.unionByName(df.where("id = 1"))).first()[0] == 2
