"""Byte-level deduplication: bucket-pointer refinement of suffixes."""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bucketed, materialize, partitions, release, remove, scratch_path
from ledgerlens.llm.hashing import U, byte_tokens, pair_hash, slices, text_bytes
from ledgerlens.llm.repeats import PROBE, open_ranges, per_document, picked, ranges_mask, repeated, sent, settled, shared, spans
from ledgerlens.llm.substring import text_copy


def kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, first = text_bytes(part.column("text"))
            n = len(data)
            gone = ranges_mask(part, ("done_lo", "done_hi"), first)
            gone = gone if gone is not None and n else np.zeros(n, bool)
            kept, removed = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                lo, hi = spans(gone[a:b])
                removed.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)])
                kept.append(data[a:b][~gone[a:b]].tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": np.diff(first),
                    "removed": pa.array(removed, pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))),
                    "kept": pa.array(kept, pa.binary()),
                }
            )


def gram_buckets(batches: Iterator[pa.RecordBatch], window: int, q: int, every: int) -> Iterator[pa.RecordBatch]:
    """Probes of the suffixes that their q-gram chooses: ``lo`` is the offset, ``hi`` the number in the text."""

    def probes() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = byte_tokens(part.column("text"))
                at, key, number = picked(tokens, window, q, every)
                text = np.searchsorted(tokens.first, at, "right") - 1
                yield key, np.zeros(len(key), U), part.column("row").to_numpy(zero_copy_only=False)[text], at - tokens.first[text], number

    yield from sent(probes())


def pointer_pairs(batches: Iterator[pa.RecordBatch], window: int, q: int, step: int) -> Iterator[pa.RecordBatch]:
    """Probes of suffixes by their bucket's identifier and that of the suffix ``step`` chosen places later.

    Both come from the last round; a suffix whose later one was alone in its bucket is alone now.
    """

    def probes() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            lists = batch.column("s")
            row = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            own = lists.flatten()
            lo, number, name = (own.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "hi", "name"))
            text = np.repeat(np.arange(len(batch), dtype=np.int64), np.diff(lists.offsets.to_numpy())) << 32
            place = text + number
            later = np.searchsorted(place, place + step)
            has = np.flatnonzero(later < len(place))
            has = has[place[later[has]] == place[has] + step]
            gap = lo[later[has]] - lo[has]
            has, gap = has[gap + q <= window], gap[gap + q <= window]
            key = pair_hash(pair_hash(name[has].view(U), name[later[has]].view(U)), gap.astype(U))
            yield key, np.zeros(len(key), U), row[has], lo[has], number[has]

    yield from sent(probes())


def refine(state: DataFrame, window: int, q: int, step: int, round_: str, folder: str) -> DataFrame:
    """The next round's buckets: ``(row, lo, hi, name)`` of suffixes that are not alone."""
    lists = state.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "name"))).alias("s"))
    return buckets(lists.mapInArrow(partial(pointer_pairs, window=window, q=q, step=step), PROBE), round_, folder)


def buckets(probes: DataFrame, round_: str, folder: str) -> DataFrame:
    """Suffixes that share a bucket, with its identifier."""
    name = F.when(F.col("n") > 0, F.col("key")).otherwise(F.col("other"))
    out = materialize(shared(probes).select("row", "lo", "hi", name.alias("name")), round_, folder)
    release(out.sparkSession)
    return out


def numbers(state: DataFrame, name: str) -> DataFrame:
    return state.groupBy("row").agg(F.array_sort(F.collect_list("hi")).alias(name))


def whole_runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Maximal runs ``(row, lo, hi)`` of bytes in repeated windows, in terms of the text that each part is ``of``."""
    for batch in batches:
        base, starts, ends = batch.column("base").to_numpy(zero_copy_only=False).astype(np.int64), [], []
        for name in ("one", "done"):
            lo, hi = batch.column(f"{name}_lo"), batch.column(f"{name}_hi")
            part = np.repeat(np.arange(len(batch)), pc.list_value_length(lo).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            for held, values, more in ((starts, lo, 0), (ends, hi, window - 1)):
                held.append((part << 32) + values.flatten().to_numpy(zero_copy_only=False) + more)
        lo, hi = np.concatenate(starts), np.concatenate(ends)
        order = np.argsort(lo, kind="stable")
        lo, upto = lo[order], np.maximum.accumulate(hi[order])
        new = np.flatnonzero(np.concatenate(([True], lo[1:] > upto[:-1]))) if len(lo) else np.zeros(0, np.int64)
        part, lo, hi = lo[new] >> 32, lo[new] & 0xFFFFFFFF, upto[np.append(new[1:], len(upto)) - 1][: len(new)] & 0xFFFFFFFF
        yield pa.RecordBatch.from_pydict({"row": batch.column("of").take(pa.array(part)), "lo": (lo + base[part]).astype(np.int32), "hi": (hi + base[part]).astype(np.int32)})


def suffix_dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", every: int = 40) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Bucket-pointer refinement over the suffixes that a q-gram (an eighth of the length) chooses, one
    in ``every``: their first buckets are by the q-gram; a round sorts suffixes on the identifiers of
    their own bucket and of the bucket of a later suffix, both of the last round, and gives new
    identifiers, which the next round reads at twice the distance. A suffix that is alone is settled
    and, as a later suffix, settles others without a sort. Strings that have a chosen suffix, pair or
    four of neighbours alone in its bucket occur once; only the parts of texts with others go on:
    long common prefixes are settled whole (see ``repeats.stretches``), the rest by all their bytes.

    Returns ``doc_id, n_bytes, removed (start, end of each maximal run), kept (bytes)``. Texts are
    UTF-8 bytes; null counts as empty; strings never cross documents and are judged on the input;
    a removed run may cut a character, so what is kept is binary. Rows that are equal or repeat a
    doc_id are documents of their own; an empty table gives no rows; further columns are ignored.
    """
    texts = text_copy(docs, id_col, text_col)
    q = max(1, length // 8)
    folder = scratch_path(docs.sparkSession, "buckets")
    one = buckets(texts.mapInArrow(partial(gram_buckets, window=length, q=q, every=every), PROBE), "one", folder)
    two = refine(one, length, q, 1, "two", folder)
    four = refine(two, length, q, 2, "four", folder)
    open_ = texts
    for state, name in ((one, "open1"), (two, "open2"), (four, "open4")):
        open_ = open_.join(numbers(state, name).hint("shuffle_hash"), "row", "left")
    parts = open_.mapInArrow(partial(open_ranges, window=length, q=q, every=every), "of long, base int, text binary")
    parts = bucketed(parts.withColumn("row", F.monotonically_increasing_id()), "row", "parts", partitions(docs.sparkSession))
    remove(docs.sparkSession, folder)
    whole = materialize(settled(repeated(parts, "byte", length, q, every=every)), "stretches")
    release(docs.sparkSession)
    near = repeated(parts.join(whole.hint("shuffle_hash"), "row", "left"), "byte", length, max(1, length - length // 10))
    near = materialize(per_document(near, "cand"), "candidates")
    release(docs.sparkSession)
    state = parts.join(near.hint("shuffle_hash"), "row").join(whole.hint("shuffle_hash"), "row", "left")
    single = materialize(per_document(repeated(state, "byte", length, length), "one"), "single")
    release(docs.sparkSession)
    found = parts.select("row", "of", "base").join(single.hint("shuffle_hash"), "row", "left").join(whole.select("row", "done_lo", "done_hi").hint("shuffle_hash"), "row", "left")
    done = per_document(found.mapInArrow(partial(whole_runs, window=length), "row long, lo int, hi int"), "done")
    out = "doc_id long, n_bytes long, removed array<struct<start: int, end: int>>, kept binary"
    return texts.join(done.hint("shuffle_hash"), "row", "left").mapInArrow(kept_bytes, out)


def digest_of(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"]), F.lit(0)).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
