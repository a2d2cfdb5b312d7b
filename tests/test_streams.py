"""State with timers, initial state, replayed batches, released outer rows, windows, progress."""

import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import q_rules, q_streams
from ledgerlens.streaming import history, jobs

EVENTS = "event_id long, step long, amount double, sender long, dest long"


def source(spark, path, schema, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def put(spark, rows, path, schema):
    """One more file of a stream's source."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def brute(events, w=history.WINDOWS):
    """Features of each account's events in order of arrival, from the definition."""
    out = {}
    for role in ("sender", "dest"):
        seen = {}
        for e, s, a, src, dst in events:
            k = src if role == "sender" else dst
            past = seen.setdefault(k, [])
            near = [[x for x in past if x[0] > s - h] for h in w]
            out[role, e] = (len(past), sum(x[1] for x in past), max([x[1] for x in past], default=None), s - past[-1][0] if past else None, *[v for n in near for v in (len(n), sum(x[1] for x in n))])
            past.append((s, a))
    return out


def collected(rows):
    names = ["prev_count", "prev_total", "prev_max", "hours_since_prev"] + [f"{k}_{w}h" for w in history.WINDOWS for k in ("count", "sum")]
    return {(r["role"], r["event_id"]): tuple(r[c] for c in names) for r in rows.collect()}


def same(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert all(a == b or a is not None and b is not None and abs(a - b) < 1e-6 for a, b in zip(got[k], v, strict=True)), (k, got[k], v)


@pytest.fixture(scope="module")
def ledger():
    rng = np.random.default_rng(7)
    steps = np.sort(rng.integers(1, 700, 400))
    return [(i, int(s), float(round(rng.random() * 90, 2)), int(rng.integers(1, 6)) if i % 3 else 1, int(rng.integers(1, 9))) for i, s in enumerate(steps)]


def test_past_of_one_account():
    """In order, late, and over several batches: equal to the definition, with no more hours than the longest window."""
    rng = np.random.default_rng(1)
    for trial in range(20):
        past, arrived = history.Past(), []
        for batch in range(6):
            step = np.sort(rng.integers(1 + 150 * batch, 260 + 150 * batch, 40)) - (90 if trial % 2 and batch % 2 else 0)
            amount = np.round(rng.random(40) * 10, 2)
            got = past.features(step, amount)
            for i, (s, a) in enumerate(zip(step.tolist(), amount.tolist(), strict=True)):
                newest = max([x[0] for x in arrived[: len(arrived) - i]], default=None)
                kept = [x for j, x in enumerate(arrived) if j >= len(arrived) - i or x[0] > newest - history.LONGEST]
                for w in history.WINDOWS:
                    near = [x for x in kept if x[0] > s - w]
                    assert got[f"count_{w}h"][i] == len(near) and abs(got[f"sum_{w}h"][i] - sum(x[1] for x in near)) < 1e-6
                arrived.append((s, a))
            past.add(step, amount)
            assert len(past.hours) <= history.LONGEST and past.n == len(arrived)


def test_stream_equals_definition(spark, tmp_path, ledger):
    for part in (ledger[:150], ledger[150:300], ledger[300:]):
        put(spark, part, f"{tmp_path}/in", EVENTS)
    rows, _ = jobs.drain(history.account_features(source(spark, f"{tmp_path}/in", EVENTS)), f"{tmp_path}/c", f"{tmp_path}/o")
    same(collected(rows), brute(ledger))


def test_initial_state_instead_of_replay(spark, tmp_path, ledger):
    """Cold start, own history and windows of later events are those of a full replay, which doesn't happen."""
    early, late = ledger[:250], ledger[250:]
    known = history.history_state(spark.createDataFrame(early, EVENTS))
    assert known.agg(F.max(F.size("hours"))).first()[0] <= history.LONGEST
    put(spark, late[:70], f"{tmp_path}/in", EVENTS)
    put(spark, late[70:], f"{tmp_path}/in", EVENTS)
    rows, query = jobs.drain(history.account_features(source(spark, f"{tmp_path}/in", EVENTS), known), f"{tmp_path}/c", f"{tmp_path}/o")
    want = brute(ledger)
    same(collected(rows), {k: v for k, v in want.items() if k[1] >= 250})
    assert sum(p["rows"] for p in jobs.progress(query)) == len(late)


def state_of(spark, checkpoint):
    rows = spark.read.format("statestore").option("stateVarName", "past").load(checkpoint)
    return {(r["key"]["role"], r["key"]["account"]): r["value"] for r in rows.collect()}


def test_hours_leave_without_arrivals(spark, tmp_path):
    """Once others' events move the watermark, a quiet account's hours go by its timer; its totals stay."""
    put(spark, [(i, 1 + i % 100, 2.0, 1, 2) for i in range(200)], f"{tmp_path}/in", EVENTS)
    run = lambda: jobs.drain(history.account_features(source(spark, f"{tmp_path}/in", EVENTS), late_hours=10), f"{tmp_path}/c", f"{tmp_path}/o")
    run()
    assert len(state_of(spark, f"{tmp_path}/c")["sender", 1]["hours"]) == 100
    put(spark, [(300, 290, 1.0, 8, 9)], f"{tmp_path}/in", EVENTS)
    run()
    quiet = state_of(spark, f"{tmp_path}/c")["sender", 1]
    assert quiet["hours"] == [] and (quiet["n"], quiet["total"], quiet["last"]) == (200, 400.0, 100)
    put(spark, [(301, 295, 5.0, 1, 9)], f"{tmp_path}/in", EVENTS)
    rows, _ = run()
    assert collected(rows)["sender", 301] == (200, 400.0, 2.0, 195, 0, 0.0, 0, 0.0)


def test_busy_account_keeps_a_bounded_state(spark, tmp_path):
    for part in range(3):
        put(spark, [(1000 * part + i, 300 * part + i // 3, 1.0, 1, 2) for i in range(900)], f"{tmp_path}/in", EVENTS)
    jobs.drain(history.account_features(source(spark, f"{tmp_path}/in", EVENTS)), f"{tmp_path}/c", f"{tmp_path}/o")
    busy = state_of(spark, f"{tmp_path}/c")["sender", 1]
    assert len(busy["hours"]) == history.LONGEST and busy["n"] == 2700 and sum(busy["counts"]) == 3 * history.LONGEST


def test_blocks_of_accounts_equal_definition(spark, tmp_path, ledger):
    """Several accounts to a block, among them one that is null, over three batches."""
    rows = [(i, s, a, None if i % 11 == 0 else src, dst) for i, s, a, src, dst in ledger]
    for part in (rows[:150], rows[150:300], rows[300:]):
        put(spark, part, f"{tmp_path}/in", EVENTS)
    out, query = jobs.drain(history.account_features(source(spark, f"{tmp_path}/in", EVENTS), blocks=3), f"{tmp_path}/c", f"{tmp_path}/o")
    same(collected(out), brute(rows))
    got = {(r["role"], r["event_id"]): r["account"] for r in out.collect()}
    assert got == {(role, r[0]): r[k] for r in rows for role, k in (("sender", 3), ("dest", 4))}
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def test_blocks_begin_with_a_state(spark, tmp_path, ledger):
    early, late = ledger[:250], ledger[250:]
    known = history.history_state(spark.createDataFrame(early, EVENTS))
    put(spark, late[:70], f"{tmp_path}/in", EVENTS)
    put(spark, late[70:], f"{tmp_path}/in", EVENTS)
    out, _ = jobs.drain(history.account_features(source(spark, f"{tmp_path}/in", EVENTS), known, blocks=2), f"{tmp_path}/c", f"{tmp_path}/o")
    same(collected(out), {k: v for k, v in brute(ledger).items() if k[1] >= 250})


def test_hours_of_a_block_leave_without_arrivals(spark, tmp_path):
    put(spark, [(i, 1 + i % 100, 2.0, 1 + i % 2, 3) for i in range(200)], f"{tmp_path}/in", EVENTS)
    run = lambda: jobs.drain(history.account_features(source(spark, f"{tmp_path}/in", EVENTS), late_hours=10, blocks=1), f"{tmp_path}/c", f"{tmp_path}/o")
    state = lambda: {(r["key"]["role"], p["account"]): p for r in spark.read.format("statestore").option("stateVarName", "pasts").load(f"{tmp_path}/c").collect() for p in r["value"]["pasts"]}
    run()
    assert [len(state()["sender", k]["hours"]) for k in (1, 2)] == [50, 50]
    put(spark, [(300, 290, 1.0, 8, 9)], f"{tmp_path}/in", EVENTS)
    run()
    held = state()
    for k in (1, 2):
        assert held["sender", k]["hours"] == [] and (held["sender", k]["n"], held["sender", k]["total"]) == (100, 200.0)
    assert held["sender", 8]["hours"] == [290]  # which the block's next timer looks at
    put(spark, [(301, 295, 5.0, 1, 9)], f"{tmp_path}/in", EVENTS)
    rows, _ = run()
    assert collected(rows)["sender", 301] == (100, 200.0, 2.0, 196, 0, 0.0, 0, 0.0)


def test_frames_of_a_block():
    """A block's rows are cut between accounts, and each account's are those of its own past."""

    class Kept:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def registerTimer(self, at):
            pass

    rng, block, pasts = np.random.default_rng(3), history.BlockHistory(), {}
    block.handle = block.state = Kept()
    block.FRAME = 50
    for batch in range(3):
        n = 400
        df = pd.DataFrame({"missing": False, "account": rng.integers(0, 20, n) ** 2 // 40, "step": rng.integers(200 * batch, 200 * batch + 200, n), "event_id": np.arange(n), "amount": rng.random(n)})
        frames = list(block.handleInputRows(("sender", 0), iter([df[:150], df[150:]]), None))
        assert len(frames) > 2 and sum(len(f) for f in frames) == n and all(len(f) >= 50 for f in frames[:-1])
        got = pd.concat(frames).set_index("event_id")
        for account, part in df.sort_values(["step", "event_id"]).groupby("account"):
            past = pasts.setdefault(account, history.Past())
            want = past.features(part["step"].to_numpy(), part["amount"].to_numpy())
            past.add(part["step"].to_numpy(), part["amount"].to_numpy())
            mine = got.loc[part["event_id"]]
            assert (mine["account"] == account).all()
            for c, v in want.items():
                np.testing.assert_array_equal(mine[c].to_numpy(float), v.astype(float))


@pytest.mark.parametrize("name", ["stream_account_features", "stream_warm_start"])
def test_account_queries_call_python_by_block(spark, sf_dir, monkeypatch, name):
    """Rows of state, each a call in a batch, are two a block and not one an account."""
    rows, drain = [], jobs.drain

    def watched(*args):
        out, query = drain(*args)
        rows.extend(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
        return out, query

    monkeypatch.setattr(jobs, "drain", watched)
    {**q_rules.QUERIES, **q_streams.QUERIES}[name](spark, sf_dir)
    assert rows and 0 < max(rows) <= 2


def test_replayed_batch_is_there_once(spark, tmp_path):
    """A crash after a batch's write, before its entry in the checkpoint: Spark writes it again, in its place."""
    for part in range(3):
        put(spark, [(10 * part + i,) for i in range(10)], f"{tmp_path}/in", "id long")
    s = source(spark, f"{tmp_path}/in", "id long")
    run = lambda: jobs.write_batches(s, f"{tmp_path}/o", f"{tmp_path}/c")
    run()
    for f in glob.glob(f"{tmp_path}/c/commits/2") + glob.glob(f"{tmp_path}/c/commits/.2.crc"):
        os.remove(f)
    query = run()
    assert [p["batchId"] for p in query.recentProgress if p["numInputRows"]] == [2]
    rows = jobs.read_batches(spark, f"{tmp_path}/o", spark.createDataFrame([], "id long").schema)
    assert sorted(r["id"] for r in rows.collect()) == list(range(30))
    assert {r["batch_id"]: r["count"] for r in rows.groupBy("batch_id").count().collect()} == {0: 10, 1: 10, 2: 10}


def stamped(rows):
    return [(k, f"2024-01-01 {t}") for k, t in rows]


def test_unmatched_predictions_are_released(spark, tmp_path):
    """A prediction without a label comes out once the watermark has passed its last chance, and leaves the state."""
    P, L = "id long, at string", "label_key long, at string"
    put(spark, stamped([(1, "01:00:00"), (2, "01:10:00"), (3, "01:20:00")]), f"{tmp_path}/p", P)
    put(spark, stamped([(2, "02:00:00")]), f"{tmp_path}/l", L)

    def run():
        p = source(spark, f"{tmp_path}/p", P).select("id", F.to_timestamp("at").alias("ts"))
        t = source(spark, f"{tmp_path}/l", L).select("label_key", F.to_timestamp("at").alias("label_ts"))
        rows, query = jobs.drain(jobs.delayed_labels(p, t, "id"), f"{tmp_path}/c", f"{tmp_path}/o")
        return {(r["id"], r["label_key"]) for r in rows.collect()}, query.lastProgress["stateOperators"][0]["numRowsTotal"]

    found, held = run()
    assert found == {(2, 2)} and held == 4
    put(spark, stamped([(9, "09:00:00")]), f"{tmp_path}/p", P)
    put(spark, stamped([(3, "03:00:00"), (9, "09:30:00")]), f"{tmp_path}/l", L)
    found, after = run()
    assert found == {(2, 2), (3, 3), (1, None), (9, 9)}
    assert after == 2  # the pair that is still in reach


def test_sessions_merge_and_windows_slide(spark, tmp_path):
    E = "user long, at string, value double"
    rows = [[(1, "2024-01-01 01:00:00", 1.0), (1, "2024-01-01 02:30:00", 2.0), (2, "2024-01-01 02:00:00", 7.0)], [(1, "2024-01-01 01:45:00", 4.0)], [(1, "2024-01-01 12:00:00", 8.0)]]
    for r in rows:
        put(spark, r, f"{tmp_path}/in", E)
    s = source(spark, f"{tmp_path}/in", E).select("user", "value", F.to_timestamp("at").alias("ts"))
    found, _ = jobs.drain(jobs.sessions(s, "user", gap="1 hour", late="3 hours"), f"{tmp_path}/c1", f"{tmp_path}/o1")
    assert sorted((r["user"], str(r["start"])[11:], str(r["end"])[11:], r["n"], r["total"]) for r in found.collect()) == [(1, "01:00:00", "03:30:00", 3, 7.0), (2, "02:00:00", "03:00:00", 1, 7.0)]
    found, _ = jobs.drain(jobs.activity(s, length="2 hours", slide="1 hour", late="3 hours", by="user"), f"{tmp_path}/c2", f"{tmp_path}/o2")
    assert sorted((r["user"], str(r["start"])[11:13], r["n"], r["total"]) for r in found.collect()) == [(1, "00", 2, 5.0), (1, "01", 3, 7.0), (1, "02", 1, 2.0), (2, "01", 1, 7.0), (2, "02", 1, 7.0)]


def test_progress_of_a_long_run(spark, tmp_path):
    """All batches are in the table after the query has ended; the query itself remembers a hundred."""
    spark.range(110).repartitionByRange(110, "id").write.parquet(f"{tmp_path}/in")
    n = len(glob.glob(f"{tmp_path}/in/*.parquet"))
    jobs.ProgressTable.HELD, held = 40, jobs.ProgressTable.HELD
    try:
        with jobs.ProgressTable(spark, f"{tmp_path}/progress") as log:
            _, query = jobs.drain(source(spark, f"{tmp_path}/in", "id long"), f"{tmp_path}/c", f"{tmp_path}/o")
        rows = log.table().where("n_rows > 0").collect()
    finally:
        jobs.ProgressTable.HELD = held
    assert n > 100 and len(query.recentProgress) <= 100
    assert sorted(r["batch"] for r in rows) == list(range(n)) and sum(r["n_rows"] for r in rows) == 110
    assert {r["query"] for r in rows} == {query.id}
