"""Strictly past features of accounts over a stream, with bounded state, timers and an initial state.

An account's state in one role is one row: totals for ever, and sums of each of its last hours. Hours leave
it when the account's next events come, or, without any, by a timer once the watermark has passed the longest
window. A stream can begin with the state that a batch table of the past gives, instead of replaying it.

A call of Python for each account costs some 13 ms, most of it whatever the number of its events.
``BlockHistory`` does the same for a block of accounts, whose pasts are one row of state.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOWS = (24, 168)
LONGEST = max(WINDOWS)
HOUR = 3_600_000
#: Hours from 1970 to where step 0 is put, so that no step is before the watermark's start.
ORIGIN = 262_968
PAST = "n long, total double, largest double, last long, hours array<long>, counts array<long>, sums array<double>"
STATE = f"{PAST}, timer long"
#: Events of a stream for each block of its accounts, about, where their number is known beforehand.
BLOCK_ROWS = 1 << 13
OUT = "role string, account long, event_id long, prev_count long, prev_total double, prev_max double, hours_since_prev long, " + ", ".join(f"count_{w}h long, sum_{w}h double" for w in WINDOWS)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def by_role(events: DataFrame) -> DataFrame:
    """One row for each account of an event: its sender's and its recipient's."""
    roles = F.array(F.struct(F.lit("sender").alias("role"), F.col("sender").alias("account")), F.struct(F.lit("dest").alias("role"), F.col("dest").alias("account")))
    return events.select("event_id", "step", "amount", F.explode(roles).alias("r")).select("r.role", "r.account", "event_id", "step", "amount")


class Past:
    """What is known of an account: totals, and count and sum of each hour of the longest window."""

    def __init__(self, n=0, total=0.0, largest=None, last=None, hours=(), counts=(), sums=(), timer=None):
        self.n, self.total, self.largest, self.last, self.timer = n, total, largest, last, timer
        self.hours, self.counts, self.sums = np.array(hours, np.int64), np.array(counts, np.int64), np.array(sums, float)

    def row(self) -> tuple:
        return self.n, self.total, self.largest, self.last, self.hours.tolist(), self.counts.tolist(), self.sums.tolist(), self.timer

    def features(self, step: np.ndarray, amount: np.ndarray) -> dict[str, np.ndarray]:
        """Features of new events in order, each before it is added. Both parts of a window are
        differences of running sums, whether events are late or not."""
        place = np.arange(len(step))
        paid = np.concatenate(([0.0], np.cumsum(amount)))
        before = np.maximum.accumulate(np.concatenate(([-np.inf if self.largest is None else self.largest], amount)))[:-1]
        out = {
            "prev_count": self.n + place,
            "prev_total": self.total + paid[:-1],
            "prev_max": np.where(np.isinf(before), np.nan, before),
            "hours_since_prev": step - np.concatenate(([np.nan if self.last is None else self.last], step[:-1])),
        }
        known_n, known_sum = np.concatenate(([0], np.cumsum(self.counts))), np.concatenate(([0.0], np.cumsum(self.sums)))
        for w in WINDOWS:
            old, new = np.searchsorted(self.hours, step - w, "right"), np.searchsorted(step, step - w, "right")
            out[f"count_{w}h"] = known_n[-1] - known_n[old] + place - new
            out[f"sum_{w}h"] = known_sum[-1] - known_sum[old] + paid[place] - paid[new]
        return out

    def add(self, step: np.ndarray, amount: np.ndarray) -> None:
        self.n, self.total, self.last = self.n + len(step), self.total + float(amount.sum()), int(step[-1])
        self.largest = float(amount.max()) if self.largest is None else max(self.largest, float(amount.max()))
        hours, at = np.unique(np.concatenate((self.hours, step)), return_inverse=True)
        counts = np.concatenate((self.counts, np.ones(len(step), np.int64)))
        self.hours = hours
        self.counts, self.sums = np.bincount(at, counts, len(hours)).astype(np.int64), np.bincount(at, np.concatenate((self.sums, amount)), len(hours))
        self.drop_until(int(hours[-1]) - LONGEST)

    def drop_until(self, hour: int) -> None:
        keep = self.hours > hour
        self.hours, self.counts, self.sums = self.hours[keep], self.counts[keep], self.sums[keep]


class AccountHistory(StatefulProcessor):
    """The features of each event of an account, then the event is added to its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("past", STATE)

    def _read(self) -> Past:
        found = self.state.get()
        return Past() if found is None else Past(*found)

    def _write(self, past: Past) -> None:
        """Keep the state; while it has hours, a timer is set that looks at them again."""
        if past.timer is None and len(past.hours):
            past.timer = (int(past.hours[-1]) + LONGEST + ORIGIN) * HOUR
            self.handle.registerTimer(past.timer)
        self.state.update(past.row())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A batch's events of one account; of each, three numbers are held to put them in order."""
        parts = [(r["step"].to_numpy(np.int64), r["event_id"].to_numpy(np.int64), r["amount"].to_numpy(float)) for r in rows]
        step, event, amount = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((event, step))
        step, event, amount = step[order], event[order], amount[order]
        past = self._read()
        out = pd.DataFrame({"role": key[0], "account": key[1], "event_id": event, **past.features(step, amount)})
        past.add(step, amount)
        self._write(past)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = self._read()
        past.drop_until(expiredTimerInfo.getExpiryTimeInMs() // HOUR - ORIGIN - LONGEST)
        past.timer = None
        self._write(past)
        yield from ()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self._write(Past(int(r["n"]), float(r["total"]), float(r["largest"]), int(r["last"]), r["hours"], r["counts"], r["sums"]))

    def close(self) -> None:
        pass


class BlockHistory(StatefulProcessor):
    """The features of ``AccountHistory`` for a block of accounts at a time: one call, one read and one write of
    state, one frame of rows and one timer for all of them. An account of many events is a frame of its own."""

    #: Rows after which a frame ends.
    FRAME = 1 << 14

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pasts", f"pasts array<struct<account long, {PAST}>>, timer long")

    def _read(self) -> tuple[dict[int | None, Past], int | None]:
        found = self.state.get()
        return ({}, None) if found is None else ({r[0]: Past(*r[1:]) for r in found[0]}, found[1])

    def _write(self, pasts: dict[int | None, Past], timer: int | None) -> None:
        """Keep the state; while an account has hours, a timer is set that looks at all of them again."""
        newest = max((int(p.hours[-1]) for p in pasts.values() if len(p.hours)), default=None)
        if timer is None and newest is not None:
            timer = (newest + LONGEST + ORIGIN) * HOUR
            self.handle.registerTimer(timer)
        self.state.update(([(account, *p.row()[:-1]) for account, p in pasts.items()], timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A batch's events of a block; of each, four numbers and a flag are held to put them in order."""
        parts = [(r["missing"].to_numpy(bool), r["account"].to_numpy(np.int64), r["step"].to_numpy(np.int64), r["event_id"].to_numpy(np.int64), r["amount"].to_numpy(float)) for r in rows]
        missing, account, step, event, amount = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((event, step, account, missing))
        missing, account, step, event, amount = missing[order], account[order], step[order], event[order], amount[order]
        ends = np.append(np.flatnonzero((np.diff(account) != 0) | np.diff(missing)) + 1, len(order))
        pasts, timer = self._read()
        frames, begun, start, held = [], 0, 0, []
        for end in ends.tolist():
            past = pasts.setdefault(None if missing[start] else int(account[start]), Past())
            held.append(past.features(step[start:end], amount[start:end]))
            past.add(step[start:end], amount[start:end])
            start = end
            if end - begun >= self.FRAME or end == len(order):
                of = slice(begun, end)
                columns = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                frames.append(pd.DataFrame({"role": key[0], "account": pd.arrays.IntegerArray(account[of], missing[of]), "event_id": event[of], **columns}))
                begun, held = end, []
        self._write(pasts, timer)
        yield from frames

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pasts, _ = self._read()
        for past in pasts.values():
            past.drop_until(expiredTimerInfo.getExpiryTimeInMs() // HOUR - ORIGIN - LONGEST)
        self._write(pasts, None)
        yield from ()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A block's accounts, which may come in several frames."""
        pasts, timer = self._read()
        for r in initialState.to_dict("records"):
            pasts[int(r["account"])] = Past(int(r["n"]), float(r["total"]), float(r["largest"]), int(r["last"]), r["hours"], r["counts"], r["sums"])
        self._write(pasts, timer)

    def close(self) -> None:
        pass


def blocks_for(events: DataFrame) -> int:
    """Blocks for a stream over a table that is there already: they grow with its events, a block's work doesn't."""
    return max(1, events.count() // BLOCK_ROWS)


def history_state(events: DataFrame) -> DataFrame:
    """``(role, account, *state)`` after ``events``, a batch table: what a stream would know after all of them.

    Events are summed by hour first, so a busy account brings a row an hour to its group, and the group
    keeps the hours of the longest window.
    """
    rows = by_role(events)
    hours = rows.groupBy("role", "account", "step").agg(F.count("*").alias("c"), F.sum("amount").alias("s"), F.max("amount").alias("m"))
    sums = hours.groupBy("role", "account").agg(F.sum("c").alias("n"), F.sum("s").alias("total"), F.max("m").alias("largest"), F.max("step").alias("last"))
    near = hours.join(sums.select("role", "account", "last"), ["role", "account"]).where(F.col("step") > F.col("last") - LONGEST)
    kept = near.groupBy("role", "account").agg(F.sort_array(F.collect_list(F.struct("step", "c", "s"))).alias("h"))  # 168 at most
    return sums.join(kept, ["role", "account"]).select("role", "account", "n", F.col("total").cast("double").alias("total"), F.col("largest").cast("double").alias("largest"), "last", F.col("h.step").alias("hours"), F.col("h.c").alias("counts"), F.col("h.s").cast("array<double>").alias("sums"))


def account_features(events: DataFrame, known: DataFrame | None = None, late_hours: int = LONGEST, blocks: int | None = None) -> DataFrame:
    """Strictly past features of both accounts of each event, keyed by (role, account).

    ``known`` is a table from ``history_state``: the state that the stream's first batch begins with.
    Events of an account are put in order by (step, event_id) in a batch, by arrival between batches; one
    with a lower step than its account's last is taken as it comes (its hours are negative). Events more
    than ``late_hours`` behind the newest of an earlier batch are left out, as the watermark has passed them.

    With ``blocks``, accounts are dealt over that many by their hash, and a block's pasts are one row of state. That
    pays where a batch has events of most accounts (``blocks_for``), not where few of many accounts are seen, as
    a block's state is written whole. The number is part of the state: it stays the same for a checkpoint.
    """
    session = events.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # which state with timers needs
    rows = by_role(events).withColumn("at", F.timestamp_millis((F.col("step") + ORIGIN) * HOUR)).withWatermark("at", f"{late_hours} hours")
    by, processor = ("role", "account"), AccountHistory()
    if blocks:
        by, processor, block = ("role", "block"), BlockHistory(), F.pmod(F.xxhash64("account"), F.lit(blocks))
        rows = rows.select("*", block.alias("block"), F.col("account").isNull().alias("missing")).fillna(0, "account")
        known = known.withColumn("block", block) if known is not None else None
    initial = known.groupBy(*by) if known is not None else None
    return rows.groupBy(*by).transformWithStateInPandas(processor, OUT, "append", "eventTime", initialState=initial)
