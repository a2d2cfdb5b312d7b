"""The boosted classifier: early stop, additive attributions, counterfactuals against the definition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import model as ml

FEATURES = ["amount", "ratio", "old", "gap", "kind_a", "kind_b"]


def derive(df):
    kinds = {f"kind_{t}": (F.col("type") == t).cast("int") for t in "ab"}
    return df.withColumns({"ratio": F.when(F.col("old") > 0, F.col("amount") / F.col("old"))} | kinds)


@pytest.fixture(scope="module")
def data(spark):
    """Odds are a sum over features, so boosting needs many shallow trees; one feature has nulls that matter."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        amount, old, gap, kind = rng.random() * 100, rng.random() * 80 * (rng.random() > 0.1), rng.random() if rng.random() > 0.3 else None, "abc"[rng.integers(3)]
        odds = 4 * math.sin(amount / 12) + old / 15 - 3 + (2 if gap is None else 3 * gap - 2) + (1.5 if kind == "a" else 0)
        rows.append((i, float(amount), float(old), None if gap is None else float(gap), kind, int(rng.random() < 1 / (1 + math.exp(-odds)))))
    return derive(spark.createDataFrame(rows, "event_id long, amount double, old double, gap double, type string, label int")).cache()


@pytest.fixture(scope="module")
def fitted(data):
    train, validation = data.where("event_id % 3 <> 0"), data.where("event_id % 3 = 0")
    return train, validation, *ml.fit(train, FEATURES, validation, rounds=40, depth=2, step=0.3)


def test_validation_ends_the_boosting(fitted):
    train, validation, model, how = fitted
    chosen = model.stages[-1].getNumTrees
    assert 3 < chosen < 40
    loss = ml.losses(model, how, validation)
    assert len(loss) == chosen and all(b < a for a, b in zip(loss, loss[1:], strict=False))
    more, _ = ml.fit(train, FEATURES, None, rounds=chosen + 2, depth=2, step=0.3)
    longer = ml.losses(more, how, validation)
    assert np.allclose(longer[:chosen], loss)  # the same trees
    assert longer[chosen] > loss[-1] * (1 - 1e-4)  # and the next doesn't help


def test_nulls_have_an_indicator_where_training_has_some(fitted):
    _, _, model, how = fitted
    assert how.marked == ("ratio", "gap")
    assert abs(sum(r["importance"] for r in ml.importance(model, how, fitted[0].sparkSession).collect()) - 1) < 1e-9


def test_contributions_add_up_to_the_log_odds(fitted):
    train, validation, model, how = fitted
    p = {r["event_id"]: r["p"] for r in ml.score(model, how, validation).collect()}
    rows = ml.contributions(model, how, validation).collect()
    assert len(rows) == len(p) and all(len(r["parts"]) == len(FEATURES) for r in rows)
    for r in rows:
        q = p[r["event_id"]]
        assert abs(r["bias"] + sum(r["parts"]) - math.log(q / (1 - q))) < 1e-9


def test_largest_contributions_and_their_means(fitted):
    _, validation, model, how = fitted
    parts = {r["event_id"]: r["parts"] for r in ml.contributions(model, how, validation).collect()}
    for r in ml.attributions(model, how, validation, top=3).collect():
        order = sorted(range(len(FEATURES)), key=lambda i: (-abs(parts[r["event_id"]][i]), FEATURES[i]))
        at = order[r["rank"] - 1]
        assert (r["feature"], r["contribution"]) == (FEATURES[at], parts[r["event_id"]][at])
    means = {r["feature"]: (r["mean_abs"], r["mean"]) for r in ml.global_attributions(model, how, validation).collect()}
    table = np.array(list(parts.values()))
    for i, f in enumerate(FEATURES):
        assert np.allclose(means[f], (np.abs(table[:, i]).mean(), table[:, i].mean()))


def test_counterfactuals(fitted, spark):
    """Each found change is the nearest of the whole grid, with what depends on it made anew."""
    _, validation, model, how = fitted
    some = validation.where("event_id < 120")
    found = {r["event_id"]: r for r in ml.counterfactuals(model, how, some, ["a", "b", "c"], derive).collect()}
    grid = []
    for r in some.collect():
        tries = [("amount", i, max(0.0, r["amount"] * (1 + s * f)), r["type"]) for i, (f, s) in enumerate((f, s) for f in ml.FRACTIONS for s in (-1, 1))]
        tries += [("type", i, r["amount"], t) for i, t in enumerate("abc") if t != r["type"]]
        for kind, i, amount, t in tries:
            distance = 1.0 if kind == "type" else abs(amount - r["amount"]) / max(abs(r["amount"]), 1.0)
            grid.append((r["event_id"] * 1000 + len(grid) % 1000, r["event_id"], kind, i, distance, amount, r["old"], r["gap"], t))
    key = {g[0]: g for g in grid}
    assert len(key) == len(grid)
    rows = derive(spark.createDataFrame([(g[0], g[5], g[6], g[7], g[8]) for g in grid], "event_id long, amount double, old double, gap double, type string"))
    was = {r["event_id"]: r["predicted"] for r in ml.score(model, how, some).collect()}
    flips = {}
    for r in ml.score(model, how, rows).collect():
        _, e, kind, i, distance, amount, *_ = key[r["event_id"]]
        if r["predicted"] != was[e]:
            flips.setdefault(e, []).append((round(distance, 12), kind, i, amount, r["type"]))
    assert set(found) == set(flips) and len(flips) > 20
    for e, options in flips.items():
        _, kind, _, amount, t = min(options)
        assert (found[e]["kind"], found[e]["type"]) == (kind, t) and abs(found[e]["amount"] - amount) < 1e-9


def test_a_fit_holds_a_bounded_number_of_rows_a_task_whatever_the_files(fitted, data, monkeypatch):
    """The same model from rows in another order and other partitions; the rows a task reads of a fit are bounded."""
    train, validation, model, how = fitted
    other, _ = ml.fit(train.orderBy("amount").repartition(7), FEATURES, validation.coalesce(1), rounds=40, depth=2, step=0.3)
    assert other.stages[-1].toDebugString.split("\n")[1:] == model.stages[-1].toDebugString.split("\n")[1:]
    seen = []
    monkeypatch.setattr(ml.GBTClassifier, "fit", lambda self, rows: seen.append(rows.where("NOT held_out").groupBy(F.spark_partition_id()).count().collect()) or model.stages[-1])
    monkeypatch.setattr(ml, "TASK_ROWS", 200)
    ml.fit(train.coalesce(1), FEATURES, validation)
    assert len(seen[0]) == 10 and sum(r["count"] for r in seen[0]) == train.count() and max(r["count"] for r in seen[0]) < 300


def test_counterfactuals_shuffle_only_what_flips(fitted):
    _, validation, model, how = fitted
    plan = ml.counterfactuals(model, how, validation.where("event_id < 120"), ["a", "b", "c"], derive)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
