"""Best-fit packing of documents into sequences by bin completion."""

import bisect
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, partitions
from ledgerlens.llm.tokens import piece_batches

#: Steps of the search for one filling, fillings tried at a branch, and branches tried after the first
#: solution. Bin packing is NP-hard: they bound the search, not what is packed.
FILL_STEPS, FILLINGS, BRANCHES = 1_000, 4, 5_000


def fillings(sizes: list[int], left: list[int], room: int, steps: int, keep: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Undominated ways to fill ``room``: (waste, [(length, how many)]), the least waste first.

    Lengths are tried from the largest and as many of each as fit first, so of two fillings with
    equal waste the one with larger items, which dominates, comes first; a filling to which a
    remaining item could be added is passed over. Branches that can't waste less than the worst
    one kept are cut, and a filling without waste ends the search. Distinct lengths in a filling
    bound its depth: 63 of them already need 2,016.
    """
    have = [i for i in range(len(sizes)) if left[i] and sizes[i] <= room]
    if not have:
        return [(room, [])]
    least = sizes[have[-1]]
    after = [0] * (len(have) + 1)  # what is left from a length on, at most
    for k in range(len(have) - 1, -1, -1):
        after[k] = after[k + 1] + sizes[have[k]] * left[have[k]]
    best: list[tuple[int, list[tuple[int, int]]]] = []
    chosen: list[tuple[int, int]] = []
    budget = [steps]

    def search(at: int, room: int) -> bool:
        budget[0] -= 1
        if room < least or at == len(have):
            if not any(sizes[have[k]] <= room and left[have[k]] > dict(chosen).get(sizes[have[k]], 0) for k in range(len(have))):
                best.append((room, list(chosen)))
                best.sort(key=lambda x: x[0])
                del best[keep:]
            return room == 0
        if len(best) == keep and room - after[at] >= best[-1][0]:
            return False
        at = bisect.bisect_left(have, -room, lo=at, key=lambda i: -sizes[i])
        for k in range(at, len(have)):
            size = sizes[have[k]]
            for n in range(min(left[have[k]], room // size), 0, -1):
                chosen.append((size, n))
                done = search(k + 1, room - n * size)
                chosen.pop()
                if done or budget[0] <= 0:
                    return done
        return False

    search(0, room)
    if not best:  # the budget ended first: best fit, the largest that fits each time
        greedy = []
        for i in have:
            n = min(left[i], room // sizes[i])
            if n:
                greedy.append((sizes[i], n))
                room -= n * sizes[i]
        best = [(room, greedy)]
    return best


def plan(histogram: dict[int, int], capacity: int, fill_steps: int = FILL_STEPS, keep: int = FILLINGS, tries: int = BRANCHES) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence, number of such sequences) that pack all items.

    Branch and bound over fillings around the largest item left. The first descent takes the
    best filling each time and is the incumbent; further ones stop where waste exceeds what a
    solution with fewer sequences may waste; they begin at the end of the descent, where few lengths
    are left and waste arises. A filling is used for half of the sequences that it could fill at once
    (once while under four), so the work grows with the logarithm of the number of items and a small
    input is searched one sequence at a time. The search is complete unless ``fill_steps`` end one for
    a filling, ``keep`` leaves fillings out or ``tries`` branches have been tried since the first
    solution; it stops where no solution can have fewer sequences than ceil(total / capacity).
    """
    sizes = sorted((s for s, n in histogram.items() if n), reverse=True)
    left = [histogram[s] for s in sizes]
    total = sum(s * n for s, n in zip(sizes, left, strict=True))
    bound = -(-total // capacity)
    place = {s: i for i, s in enumerate(sizes)}
    best: list[tuple[list[int], int]] | None = None
    best_bins = 0
    path: list[tuple[list[int], int]] = []
    branches: list[Iterator[tuple[int, list[int]]]] = []
    wasted, bins, tried = [0], [0], 0

    def options() -> Iterator[tuple[int, list[int]]]:
        top = next(i for i, n in enumerate(left) if n)
        left[top] -= 1
        found = fillings(sizes, left, capacity - sizes[top], fill_steps, keep)
        left[top] += 1
        return iter([(w, [sizes[top], *[s for s, n in f for _ in range(n)]]) for w, f in found])

    def undo() -> None:
        pattern, times = path.pop()
        for s in pattern:
            left[place[s]] += times
        wasted.pop()
        bins.pop()

    if not sizes:
        return []
    branches.append(options())
    while branches:
        step = next(branches[-1], None)
        tried += best is not None
        if step is None or (best is not None and tried > tries):
            branches.pop()
            if path:
                undo()
            continue
        waste, pattern = step
        need = {s: pattern.count(s) for s in set(pattern)}
        times = max(1, min(left[place[s]] // n for s, n in need.items()) // 2)
        if best is not None and wasted[-1] + waste * times > (best_bins - 1) * capacity - total:
            continue
        for s in pattern:
            left[place[s]] -= times
        path.append((pattern, times))
        wasted.append(wasted[-1] + waste * times)
        bins.append(bins[-1] + times)
        if any(left):
            branches.append(options())
            continue
        if best is None or bins[-1] < best_bins:
            best, best_bins = list(path), bins[-1]
            if best_bins == bound:
                break
        undo()
    return best or []


def slots(patterns: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For ranks ``from`` on of a length: the first sequence and the offset in it."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + times
            offset += size
        sequence += times
    return pd.DataFrame(rows, columns=["length", "from", "sequence", "offset"]).sort_values(["length", "from"], ignore_index=True)


def placed(frames: Iterator[pd.DataFrame], table: pd.DataFrame) -> Iterator[pd.DataFrame]:
    keys = (table["length"].to_numpy(np.int64) << 44) + table["from"].to_numpy(np.int64)
    for frame in frames:
        at = np.searchsorted(keys, (frame["length"].to_numpy(np.int64) << 44) + frame["rank"].to_numpy(np.int64), "right") - 1
        row = table.iloc[at]
        frame["sequence_id"] = row["sequence"].to_numpy(np.int64) + frame["rank"].to_numpy(np.int64) - row["from"].to_numpy(np.int64)
        frame["offset"] = row["offset"].to_numpy(np.int64)
        yield frame.drop(columns="rank")


def pack(items: DataFrame, capacity: int, fill_steps: int = FILL_STEPS, keep: int = FILLINGS, tries: int = BRANCHES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items (doc_id, piece, length, ...)``; 1 <= length <= capacity.

    Only the histogram of lengths (``capacity`` rows at most) reaches the driver. Items of one
    length are numbered in slices by a hash of their key, so a length that very many items share
    isn't one task's work. ``items`` should be written before: it is read three times.
    """
    counts = items.groupBy("length").count()
    table = slots(plan({r["length"]: r["count"] for r in counts.collect()}, capacity, fill_steps, keep, tries))
    parts = partitions(items.sparkSession)
    sliced = items.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    before = sliced.groupBy("length", "slice").count()
    before = before.withColumn("before", F.sum("count").over(W.partitionBy("length").orderBy("slice")) - F.col("count")).drop("count")
    number = F.row_number().over(W.partitionBy("length", "slice").orderBy("doc_id", "piece")) - 1
    ranked = sliced.withColumn("number", number).join(before, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("number"))
    ranked = ranked.select(*items.columns, "rank")
    kind = ", ".join(f"{n} {t}" for n, t in items.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInPandas(partial(placed, table=table), kind)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids``: token ids of each document and ``end`` after them, cut
    into pieces of ``capacity`` only where longer; ids are little-endian unsigned 32-bit integers."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids binary"
    return texts.mapInArrow(partial(piece_batches, path=path, capacity=capacity, end=end), kind)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document goes: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A text with the string of a special token has that token's id there. Null and empty texts are the
    end token alone; rows that are equal or repeat a doc_id are packed each; an empty table gives no
    rows; further columns are ignored.
    """
    cut = pieces(docs, path, capacity, end, id_col, text_col)
    small = materialize(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(small, capacity)


def sequences(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """The packed sequences: ``sequence_id, ids (binary), members (doc_id, piece, offset)``; doc_id must be unique."""
    where = pack_documents(docs, path, capacity, end).select("doc_id", "piece", "sequence_id", "offset")
    whole = pieces(docs, path, capacity, end).join(where, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    members = F.transform("parts", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"]))
    return whole.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"), members.alias("members"))
