"""Repeated windows: which runs of W tokens of a text also start anywhere else.

The same steps serve words and bytes. A *probe* is a key made from content, with the window
starts ``lo:hi`` of one row that it speaks for. Probes with equal keys meet in one shuffle;
those of keys that occur once are done with, the others go on. Within a task equal keys are
joined first, so that a passage of any number of copies sends at most one probe a task.

* ``sample``: from each window the leftmost smallest hash of its q-grams is probed. Two equal
  windows pick the same q-gram, so nothing is lost, and one probe speaks for W - q + 1 windows
  on average half over.
* ``stretch``: long repeats are settled whole: from one content-chosen start to the next, with the
  W tokens after it, as one probe. If it is repeated, so is every window in it. One copy of each
  settled stretch goes on probing, for the sake of windows elsewhere that have a copy there only.
* with q = W a probe is one window, which gives the exact answer.

Probes that only rule windows out have keys of 64 bits: a collision costs time. Those that settle
stretches and windows have 128 bits from two independent hashes.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.hashing import U, Tokens, byte_tokens, gram_hash, mix, pair_hash, placed_hash, quick_gram_hash, slices, word_tokens

PROBE = "key long, other long, n int, row long, lo int, hi int"
#: Probes that a task gathers before it joins equal keys and sends them on.
BLOCK = 1 << 20


def tokens_of(column: pa.Array, unit: str) -> Tokens:
    return byte_tokens(column) if unit == "byte" else word_tokens(column)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value (by its first 32 bits) in each run of ``width`` values.

    Smallest values up to and from the ends of blocks of ``width`` give those of all runs in two passes.
    """
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    full[:n] = (values & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    blocks = full.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(onward[: n - width + 1], upto[width - 1 : n]) & U(0xFFFFFFFF)).astype(np.int64)


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of the positions in any of the ranges ``lo:hi``."""
    steps = np.bincount(np.minimum(lo, n), minlength=n + 1) - np.bincount(np.minimum(hi, n), minlength=n + 1)
    return np.cumsum(steps[:-1]) > 0


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def ranges_mask(batch: pa.RecordBatch, names: tuple[str, str], first: np.ndarray) -> np.ndarray | None:
    """Mask over all tokens of a batch from a pair of list columns with ranges per document."""
    if names[0] not in batch.schema.names:
        return None
    lo, hi = (batch.column(x) for x in names)
    count = pc.list_value_length(lo).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.repeat(first[:-1], count)
    return covered(int(first[-1]), lo.flatten().to_numpy(zero_copy_only=False) + base, hi.flatten().to_numpy(zero_copy_only=False) + base)


def open_windows(batch: pa.RecordBatch, tokens: Tokens, window: int) -> np.ndarray:
    """Mask of window starts that still probe: inside a document, candidates, and not settled.

    Of settled stretches one for each content still probes: another window may have its copy there.
    """
    first, n = tokens.first, len(tokens.values)
    mask = covered(n, first[:-1], np.maximum(first[1:] - window + 1, first[:-1]))
    candidates = ranges_mask(batch, ("cand_lo", "cand_hi"), first)
    if candidates is not None:
        mask &= candidates
    done = ranges_mask(batch, ("done_lo", "done_hi"), first)
    if done is not None:
        mask &= ~done | ranges_mask(batch, ("spoken_lo", "spoken_hi"), first)
    return mask


def window_hash(grams: np.ndarray, at: np.ndarray, window: int, q: int, seed: int = 0) -> np.ndarray:
    """Hashes of the windows that start at ``at``, from the q-grams that tile them."""
    h = grams[at]
    for step in [*range(q, window - q, q), window - q]:
        h = pair_hash(h, grams[at + step], seed)
    return h


def sampled(tokens: Tokens, mask: np.ndarray, window: int, q: int) -> tuple[np.ndarray, ...]:
    """Keys and window ranges of the chosen q-grams; ``mask`` has the windows that count."""
    at = np.flatnonzero(mask)
    if not len(at):
        return np.zeros(0, U), np.zeros(0, U), at, at
    if q == window:
        tile = -(-window // 8)
        keys = [window_hash(gram_hash(v, tile, i), at, window, tile, i) for i, v in enumerate((tokens.values, tokens.other()))]
        return *keys, at, at + 1
    grams = quick_gram_hash(tokens.values, q)
    chosen = sliding_argmin(grams, window - q + 1)[at]
    new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    key = grams[chosen[new]]
    return key, np.zeros(len(key), U), at[new], at[np.append(new[1:], len(at)) - 1] + 1


def stretches(tokens: Tokens, mask: np.ndarray, window: int, q: int, every: int) -> tuple[np.ndarray, ...]:
    """Keys and ranges of runs between neighbouring starts that their own q-gram chooses, or that begin or
    end an open run: equal texts are so settled up to their ends."""
    grams = gram_hash(tokens.values, q)
    pick = mask.copy()
    pick[: len(grams)] &= grams % U(every) == 0
    begin, end = spans(mask)
    pick[begin], pick[end - 1] = True, True
    at = np.flatnonzero(pick)
    if len(at) < 2:
        return np.zeros(0, U), np.zeros(0, U), at[:0], at[:0]
    open_before = np.concatenate(([0], np.cumsum(mask)))
    whole = open_before[at[1:] + 1] - open_before[at[:-1]] == at[1:] + 1 - at[:-1]
    left, right = at[:-1][whole], at[1:][whole]
    other = tokens.other()
    keys = []
    for seed, (values, own) in enumerate(((tokens.values, grams), (other, gram_hash(other, q, 1)))):
        between = placed_hash(values[at[0] : at[-1]], at - at[0], seed)[whole]
        keys.append(pair_hash(between, window_hash(own, right, window, q, seed), seed))
    return *keys, left, right + 1


def send(key: np.ndarray, other: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Probes with one row a key. The first of equal ones speaks for all (n is their number); the
    others are known to repeat, so they go on under keys of their own with n = -1."""
    order = np.lexsort((other, key)) if other.any() else np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1]))))
    count = np.full(len(key), -1, np.int32)
    count[order[new]] = np.diff(np.append(new, len(key)))
    own = mix(key ^ mix(row.astype(U) * U(0x9E3779B97F4A7C15) + lo.astype(U)))
    rows = {
        "key": np.where(count > 0, key, own).view(np.int64),
        "other": np.where((count > 0) | (other != 0), other, key).view(np.int64),  # a key of its own doesn't lose the old one
        "n": count,
        "row": row,
        "lo": lo.astype(np.int32),
        "hi": hi.astype(np.int32),
    }
    table = pa.RecordBatch.from_pydict(rows)
    for i in range(0, len(table), 1 << 16):
        yield table.slice(i, 1 << 16)


def sent(probes: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Gather probes and send them in blocks."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for some in probes:
        held.append(some)
        size += len(some[0])
        if size >= BLOCK:
            yield from send(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield from send(*map(np.concatenate, zip(*held, strict=True)))


def probe_batches(batches: Iterator[pa.RecordBatch], unit: str, window: int, q: int, every: int) -> Iterator[pa.RecordBatch]:
    def probes() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = tokens_of(part.column("text"), unit)
                mask = open_windows(part, tokens, window)
                key, other, lo, hi = stretches(tokens, mask, window, q, every) if every else sampled(tokens, mask, window, q)
                text = np.searchsorted(tokens.first, lo, "right") - 1
                yield key, other, part.column("row").to_numpy(zero_copy_only=False)[text], lo - tokens.first[text], hi - tokens.first[text]

    yield from sent(probes())


def shared(probes: DataFrame, speaks: bool = False) -> DataFrame:
    """Probes whose key occurs more than once in all documents."""
    same = W.partitionBy("key", "other")
    least = F.min(F.struct("row", "lo")).over(same) == F.struct("row", "lo") if speaks else F.lit(False)
    counted = probes.withColumn("total", F.sum("n").over(same)).withColumn("speaks", (F.col("n") > 0) & least)
    return counted.where("total > 1 OR n < 0")


def repeated(docs: DataFrame, unit: str, window: int, q: int, every: int = 0) -> DataFrame:
    """Window ranges ``(row, lo, hi, speaks)`` whose probe occurs more than once in all documents.

    ``speaks`` marks one range of each key.
    """
    probes = docs.mapInArrow(partial(probe_batches, unit=unit, window=window, q=q, every=every), PROBE)
    if q == window and not every:  # a probe is one window: its end needn't be sent
        return shared(probes.drop("hi")).select("row", "lo", (F.col("lo") + 1).alias("hi"), "speaks")
    return shared(probes, bool(every)).select("row", "lo", "hi", "speaks")


def picked(tokens: Tokens, window: int, q: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that their own q-gram chooses, in texts with a window; their grams, and numbers in the text."""
    grams = quick_gram_hash(tokens.values, q)
    inside = covered(len(tokens.values), tokens.first[:-1], np.where(np.diff(tokens.first) >= window, tokens.first[1:] - q + 1, tokens.first[:-1]))
    at = np.flatnonzero(inside[: len(grams)] & (grams % U(every) == 0))
    start = np.searchsorted(at, tokens.first[:-1])
    return at, grams[at], np.arange(len(at)) - start[np.searchsorted(tokens.first, at, "right") - 1]


def open_ranges(batches: Iterator[pa.RecordBatch], window: int, q: int, every: int) -> Iterator[pa.RecordBatch]:
    """The parts ``(of, base, text)`` of texts whose windows all have their chosen places, pairs and fours
    of them in buckets with others: row and offset that each is from, and its bytes.

    Columns ``open1``, ``open2`` and ``open4`` have the numbers of those of each text; any other place,
    pair or four closes the windows that have it inside.
    """
    for batch in batches:
        for part in slices(batch, "text"):
            tokens = byte_tokens(part.column("text"))
            first, n = tokens.first, len(tokens.values)
            at, _, number = picked(tokens, window, q, every)
            text = np.searchsorted(first, at, "right") - 1
            base = np.searchsorted(at, first[:-1])
            mask = covered(n, first[:-1], np.maximum(first[1:] - window + 1, first[:-1]))
            known = np.ones(len(at), bool)
            for size in (1, 2, 4):
                column = part.column(f"open{size}")
                count = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                here = np.zeros(len(at), bool)
                here[np.repeat(base, count) + column.flatten().to_numpy(zero_copy_only=False)] = True
                last = np.flatnonzero(known) + size - 1  # what the last round closed closes no more windows
                last = last[last < len(at)]
                start = last - size + 1
                own = (text[last] == text[start]) & ~here[start]
                lo = np.maximum(at[last[own]] + q - window, first[text[start[own]]])
                mask &= ~covered(n, lo, np.maximum(at[start[own]] + 1, lo))
                known = here
            lo, hi = spans(mask)
            row = np.searchsorted(first, lo, "right") - 1
            raw = tokens.data.tobytes()
            parts = [raw[x : y + window - 1] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"of": part.column("row").take(pa.array(row)), "base": (lo - first[row]).astype(np.int32), "text": pa.array(parts, pa.binary())})


def per_document(ranges: DataFrame, name: str) -> DataFrame:
    """Ranges of each document as two lists; as long as the document at most. A range is one number on its way."""
    both = ranges.select("row", F.expr("shiftleft(CAST(lo AS BIGINT), 32) + hi").alias("r")).groupBy("row").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return both.selectExpr("row", f"transform(r, x -> CAST(shiftright(x, 32) AS INT)) AS {name}_lo", f"transform(r, x -> CAST(x & 2147483647 AS INT)) AS {name}_hi")


def settled(ranges: DataFrame) -> DataFrame:
    """Settled ranges of each document, and those of them that go on speaking for their content."""
    pairs = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    spoken = F.array_sort(F.collect_list(F.when(F.col("speaks"), F.struct("lo", "hi"))))
    both = ranges.groupBy("row").agg(pairs.alias("r"), spoken.alias("s"))
    return both.selectExpr("row", "r.lo AS done_lo", "r.hi AS done_hi", "s.lo AS spoken_lo", "s.hi AS spoken_hi")
