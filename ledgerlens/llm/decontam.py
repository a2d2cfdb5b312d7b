"""Benchmark decontamination by latent semantic retrieval."""

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize
from ledgerlens.llm.hashing import IS_PUNCTUATION, slices, text_bytes, tokenize

#: Benchmark items that one search takes; more are searched block after block.
BLOCK = 256
#: Terms of a cell; two neighbouring cells are a passage, so passages overlap by half.
CELL = 24
#: Directions of the corpus in the latent space, and columns of the random sketch that finds them.
DIRECTIONS, SKETCH = 48, 56


def terms_of(column: pa.Array):
    """Terms of texts; in scripts without spaces (Han, kana, Thai, Lao) each character is one."""
    data, offsets = text_bytes(column, lower=True)
    after = np.append(data[1:], 0).astype(data.dtype)
    lone = ((data >= 0xE3) & (data <= 0xE9)) | (data == 0xF0) | ((data == 0xE0) & (after >= 0xB8) & (after <= 0xBB))
    if lone.any():
        at = np.flatnonzero(lone)
        cut = np.unique(np.concatenate((at, at + 3 + (data[at] == 0xF0))))
        data, offsets = np.insert(data, cut, 32), offsets + np.searchsorted(cut, offsets)
    return tokenize(data, offsets, IS_PUNCTUATION)


class Items:
    """A block of benchmark items as runs of numbers into the block's own sorted vocabulary."""

    def __init__(self, ids: list[int], texts: list[str]):
        tokens = terms_of(pa.array(texts, pa.string()))
        self.vocabulary, number = np.unique(tokens.values, return_inverse=True)
        runs = [number[a:b] for a, b in zip(tokens.first[:-1], tokens.first[1:], strict=True)]
        kept = [(i, r) for i, r in zip(ids, runs, strict=True) if len(r)]
        self.ids, self.runs = [i for i, _ in kept], [r for _, r in kept]


def known_terms(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places and numbers of the terms of each text that the vocabulary has."""
    for batch in batches:
        for part in slices(batch, "text"):
            tokens = terms_of(part.column("text"))
            at = np.minimum(np.searchsorted(vocabulary, tokens.values), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[at] == tokens.values)
            edges = np.searchsorted(hit, tokens.first)
            place = (hit - np.repeat(tokens.first[:-1], np.diff(edges))).astype(np.int32)
            offsets = pa.array(edges.astype(np.int32))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_terms": np.diff(tokens.first),
                    "place": pa.ListArray.from_arrays(offsets, pa.array(place)),
                    "term": pa.ListArray.from_arrays(offsets, pa.array(at[hit].astype(np.int32))),
                }
            )


class Cells:
    """Terms of a batch of texts by cell; text i has cells first[i]:first[i+1]."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.column("n_terms").to_numpy(zero_copy_only=False)
        places = batch.column("place")
        self.count = np.diff(places.offsets.to_numpy())
        self.place = places.flatten().to_numpy(zero_copy_only=False)
        self.term = batch.column("term").flatten().to_numpy(zero_copy_only=False)
        self.first = np.concatenate(([0], np.cumsum(-(-n // CELL))))
        self.cell = self.place // CELL + np.repeat(self.first[:-1], self.count)
        self.doc = np.repeat(np.arange(len(n)), np.diff(self.first))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Cell and term of each distinct pair, sorted by cell."""
        both = np.unique(self.cell.astype(np.int64) << 32 | self.term)
        return both >> 32, both & 0xFFFFFFFF

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell and term of each occurrence, sorted by cell, and how many like it the cell has before."""
        both = np.sort(self.cell.astype(np.int64) << 32 | self.term)
        new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
        rank = np.arange(len(both)) - np.repeat(new, np.diff(np.append(new, len(both))))
        return both >> 32, both & 0xFFFFFFFF, rank

    def sums(self, cell: np.ndarray, table: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Sum of ``table[row]`` by cell (sorted)."""
        size = int(self.first[-1])
        edges = np.searchsorted(cell, np.arange(size + 1))
        count = np.diff(edges)
        order = np.argsort(-count, kind="stable")  # fullest cells first, so that each turn adds to a prefix
        sums, start = np.zeros((size, table.shape[1]), table.dtype), edges[:-1][order]
        for i in range(int(count.max(initial=0))):
            n = int(np.searchsorted(-count[order], -i))
            sums[:n] += table[row[start[:n] + i]]
        out = np.empty_like(sums)
        out[order] = sums
        return out

    def passages(self, sums: np.ndarray) -> np.ndarray:
        """Sums of each cell and the next of its text; the last cell of a text stands alone."""
        out = sums.copy()
        if len(sums) > 1:
            out[:-1] += sums[1:] * (self.doc[1:] == self.doc[:-1])[:, None]
        return out


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, Cells]]:
    """Cells of runs of rows with up to 2^15 known terms (or one row), so that arrays stay small; and the first row."""
    upto, at = batch.column("place").offsets.to_numpy(), 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + (1 << 15), "right")) - 1)
        yield at, Cells(batch.slice(at, to - at))
        at = to


def count_terms(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How many cells have each term; term -1 has the number of cells."""
    total, n = np.zeros(size, np.int64), 0
    for batch in batches:
        for _, cells in pieces(batch):
            total += np.bincount(cells.distinct()[1], minlength=size)
            n += int(cells.first[-1])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"term": np.append(at, -1).astype(np.int32), "n": np.append(total[at], n)})


def sketch(batches: Iterator[pa.RecordBatch], idf: np.ndarray, random: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's part of A'A times a random matrix, for the passages' TF-IDF rows A."""
    weighted = (idf[:, None] * random).astype(np.float32)
    total = np.zeros(random.shape)
    for batch in batches:
        for _, cells in pieces(batch):
            cell, term = cells.distinct()
            if not len(cell):
                continue
            passage = cells.passages(cells.sums(cell, weighted, term))
            back = passage.copy()  # a cell is in the passage it starts and the one before
            back[1:] += passage[:-1] * (cells.doc[1:] == cells.doc[:-1])[:, None]
            order = np.argsort(term, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], np.diff(term[order]) > 0)))
            total[term[order][edges]] += np.add.reduceat(back[cell[order]], edges, axis=0)
    at = np.flatnonzero(total.any(1))
    columns = {"term": at.astype(np.int32)} | {f"z{i}": total[at, i] * idf[at] for i in range(random.shape[1])}
    yield pa.RecordBatch.from_pydict(columns)


class Order:
    """An item's terms as bits, for longest common subsequences by bit-parallel addition."""

    def __init__(self, run: np.ndarray):
        self.n, self.bits = len(run), {}
        for i, t in enumerate(run.tolist()):
            self.bits[t] = self.bits.get(t, 0) | 1 << i

    def lcs(self, text: list[int]) -> int:
        full = v = (1 << self.n) - 1
        for t in text:
            m = self.bits.get(t)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return self.n - v.bit_count()

    def within(self, place: list[int], text: list[int], span: int, need: int) -> bool:
        """Whether some ``span`` neighbouring terms have ``need`` of the item in order."""
        own = [(p, t) for p, t in zip(place, text, strict=True) if t in self.bits]
        upto = 0
        for i, (p, _) in enumerate(own):
            while upto < len(own) and own[upto][0] < p + span:
                upto += 1
            if upto - i >= need and self.lcs([t for _, t in own[i:upto]]) >= need:
                return True
        return False


class Orders:
    """Longest common subsequences of many windows at once, for items of up to 64 terms."""

    def __init__(self, orders: list[Order], size: int):
        self.orders, self.n = orders, np.array([o.n for o in orders])
        self.masks = np.zeros((len(orders), size), np.uint64)
        for j, o in enumerate(orders):
            if o.n <= 64:
                self.masks[j, list(o.bits)] = np.array(list(o.bits.values()), np.uint64)
        self.full = np.array([(1 << min(o.n, 64)) - 1 for o in orders], np.uint64)

    def lcs(self, text: np.ndarray, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        """LCS of each text[a:b] with item q."""
        out = np.zeros(len(q), np.int64)
        at, flat = text.astype(np.int64), self.masks.ravel()
        wide = self.n[q] > 64
        for i in np.flatnonzero(wide).tolist():
            out[i] = self.orders[q[i]].lcs(text[a[i] : b[i]].tolist())
        rest = np.flatnonzero(~wide)
        rest = rest[np.argsort(q[rest], kind="stable")]  # few items at a time, so that their masks stay in cache
        for x in range(0, len(rest), 8192):
            own = rest[x : x + 8192]
            own = own[np.argsort(a[own] - b[own], kind="stable")]  # longest windows first
            start, item, length = a[own], q[own], b[own] - a[own]
            shift = item * self.masks.shape[1]
            v = self.full[item]
            active = np.searchsorted(-length, -np.arange(length[0]), "left")
            for i, n in enumerate(active.tolist()):
                now = v[:n]
                u = now & flat[at[start[:n] + i] + shift[:n]]
                v[:n] = (now + u) | (now - u)
            out[own] = self.n[item] - np.bitwise_count(v & self.full[item])
        return out


class Bound:
    """How many terms of each item, with multiplicity, a window has: its LCS can't be longer."""

    def __init__(self, runs: list[np.ndarray], size: int):
        most = np.zeros(size, np.int64)
        counts = [np.unique(r, return_counts=True) for r in runs]
        for term, n in counts:
            most[term] = np.maximum(most[term], n)
        self.most, self.at = most, np.cumsum(most) - most
        self.has = np.zeros((int(most.sum()), len(runs)), np.int8)
        for j, (term, n) in enumerate(counts):
            for k in range(int(n.max())):
                self.has[self.at[term[n > k]] + k, j] = 1
        self.reach = np.array([-(-len(r) // CELL) for r in runs])

    def candidates(self, cells: Cells, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells and items whose window (as many terms as the item has before and after the
        passage, in whole cells) may have ``need`` terms of the item in order."""
        cell, term, rank = cells.ranked()
        use = rank < self.most[term]
        sums = cells.sums(cell[use], self.has, self.at[term[use]] + rank[use])
        # narrow sums may wrap around; their differences don't, as windows are short then
        upto = np.zeros((len(sums) + 1, sums.shape[1]), np.int16 if self.reach.max() * CELL < 10_000 else np.int64)
        np.cumsum(sums, axis=0, out=upto[1:])
        first, last, c = cells.first[cells.doc], cells.first[cells.doc + 1], np.arange(len(sums))
        for r in np.unique(self.reach).tolist():
            own = np.flatnonzero(self.reach == r)
            part = upto[:, own]
            p, q = np.nonzero(part[np.minimum(last, c + 2 + r)] - part[np.maximum(first, c - r)] >= need[own].astype(upto.dtype))
            yield p, own[q]


def exact_runs(cells: Cells, run: np.ndarray) -> np.ndarray:
    """Where the terms of ``run`` stand one after another, as indices into the cells' terms."""
    doc = np.repeat(np.arange(len(cells.count)), cells.count)
    at = np.flatnonzero(cells.term == run[0])
    for k in range(1, len(run)):
        at = at[at + k < len(cells.term)]
        to = at + k
        at = at[(cells.term[to] == run[k]) & (cells.place[to] == cells.place[at] + k) & (doc[to] == doc[at])]
    return at


def search(batches: Iterator[pa.RecordBatch], items: Items, idf: np.ndarray, basis: np.ndarray, cosine: float, least: float, least_terms: int) -> Iterator[pa.RecordBatch]:
    """Passages that may have an item, checked in order and in the latent space."""
    space = (idf[:, None] * basis).astype(np.float32)
    queries = np.stack([space[np.unique(r)].sum(0) for r in items.runs])
    queries /= np.maximum(np.linalg.norm(queries, axis=1), 1e-9)[:, None]
    long = [j for j, r in enumerate(items.runs) if len(r) >= least_terms]
    short = [j for j, r in enumerate(items.runs) if len(r) < least_terms]
    need = np.array([int(np.ceil(least * len(items.runs[j]) - 1e-9)) for j in long])
    bound = Bound([items.runs[j] for j in long], len(idf)) if long else None
    orders = [Order(r) for r in items.runs]
    many = Orders([orders[j] for j in long], len(idf))
    answers = [Order(r[-max(3, len(r) // 4) :]) for r in items.runs]
    for batch in batches:
        rows: dict[tuple[int, int], tuple] = {}
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for at, cells in pieces(batch):
            if not len(cells.term):
                continue

            def near(c: int, j: int) -> float:
                """Cosine of the passage that starts at cell ``c`` with item ``j``."""
                total = 0
                for x in range(c, min(c + 2, int(cells.first[cells.doc[c] + 1]))):
                    a, b = np.searchsorted(cells.cell, (x, x + 1))
                    total = total + space[np.unique(cells.term[a:b])].sum(0)
                return float(total @ queries[j] / max(np.linalg.norm(total), 1e-9))

            def keep(c: int, j: int, share: float, value: float, start: int) -> None:
                key = (int(ids[at + int(cells.doc[c])]), items.ids[j])
                rows[key] = max(rows.get(key, (-1.0,)), (share, value, start))

            for j in short:
                for i in exact_runs(cells, items.runs[j]).tolist():
                    c = int(cells.cell[i])
                    keep(c, j, 1.0, near(c, j), int(cells.place[i]))
            ahead = np.repeat(np.arange(len(cells.count), dtype=np.int64) << 32, cells.count) + cells.place
            for p, q in bound.candidates(cells, need) if bound else ():
                d, n = cells.doc[p], many.n[q]
                begin = (p - cells.first[d]) * CELL
                a = np.searchsorted(ahead, (d << 32) + np.maximum(begin - n, 0))
                b = np.searchsorted(ahead, (d << 32) + begin + 2 * CELL + n)
                found = many.lcs(cells.term, a, b, q)
                for i in np.flatnonzero(found >= need[q]).tolist():
                    c, j, length, start = int(p[i]), long[q[i]], int(n[i]), int(begin[i])
                    place, text = cells.place[a[i] : b[i]].tolist(), cells.term[a[i] : b[i]].tolist()
                    value = near(c, j)
                    if not orders[j].within(place, text, int(np.ceil(length / least)), int(need[q[i]])):
                        # scattered terms are weak evidence: the passage must be near, and have most of the item or its end
                        if value < cosine or (found[i] < 0.75 * length and answers[j].lcs(text) < least * answers[j].n):
                            continue
                    keep(c, j, int(found[i]) / length, value, start)
        if rows:
            docs, names = zip(*rows, strict=True)
            share, value, start = zip(*rows.values(), strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": docs, "item_id": names, "cosine": value, "lcs_share": share, "term_start": start})


def latent_basis(items: Items, idf: np.ndarray, sums: pd.DataFrame, random: np.ndarray) -> np.ndarray:
    """Directions of the latent space: the leading right singular vectors of the passages (from
    one pass: A'A is about Z W^-1 Z' with Z = A'AR and W = R'Z), and those that the items add."""
    z = np.zeros(random.shape)
    z[sums["term"].to_numpy()] = sums.drop(columns="term").to_numpy()
    w, u = np.linalg.eigh((random.T @ z + z.T @ random) / 2)
    good = w > max(w.max(), 0) * 1e-10
    left, _, _ = np.linalg.svd(z @ (u[:, good] / np.sqrt(w[good])), full_matrices=False) if good.any() else (z[:, :0], None, None)
    rows = np.zeros((len(items.runs), len(idf)))
    for i, r in enumerate(items.runs):
        rows[i, np.unique(r)] = idf[np.unique(r)]
    q, r = np.linalg.qr(np.concatenate((left[:, :DIRECTIONS], rows.T), axis=1))
    return q[:, np.abs(np.diag(r)) > 1e-9]


def search_block(texts: DataFrame, items: Items, cosine: float, least: float, least_terms: int) -> DataFrame | None:
    if not items.runs:
        return None
    size = len(items.vocabulary)
    kind = "doc_id long, n_terms long, place array<int>, term array<int>"
    known = materialize(texts.mapInArrow(partial(known_terms, vocabulary=items.vocabulary), kind), "known-terms")
    counted = known.drop("doc_id").mapInArrow(partial(count_terms, size=size), "term int, n long")
    total = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    cells = total.pop(-1, 0)
    share = np.zeros(size)  # of cells that have the term
    share[list(total)] = np.array(list(total.values())) / max(cells, 1)
    idf = np.log(1 + 1 / np.maximum(share, 1 / max(cells, 1)))
    random = np.random.default_rng(5).standard_normal((size, SKETCH))
    columns = ", ".join(f"z{i} double" for i in range(SKETCH))
    part = known.drop("doc_id").mapInArrow(partial(sketch, idf=idf, random=random), f"term int, {columns}")
    sums = part.groupBy("term").agg(*[F.sum(f"z{i}").alias(f"z{i}") for i in range(SKETCH)]).toPandas()
    basis = latent_basis(items, idf, sums, random)
    kind = "doc_id long, item_id long, cosine double, lcs_share double, term_start long"
    return known.mapInArrow(partial(search, items=items, idf=idf, basis=basis, cosine=cosine, least=least, least_terms=least_terms), kind)


def decontaminate(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, least: float = 0.6, least_terms: int = 5) -> DataFrame:
    """Documents with a passage of a benchmark item: ``doc_id, item_id, cosine, lcs_share, term_start``.

    A document is found if its window around a passage has a share ``least`` of an item's terms in
    order (longest common subsequence), either within 1 / ``least`` times the item's length or, where
    they are scattered further, with a latent cosine of ``cosine`` and three quarters of the item or
    its last quarter (the answer). Windows that don't have so many of the item's terms, order aside,
    are the only ones not checked. Items of fewer than ``least_terms`` terms are found where all of
    their terms stand one after another.

    The latent space is that of a TF-IDF matrix of passages of 48 terms (letters and digits, A-Z
    lower-cased) over the items' terms: directions of a randomised SVD with statistics of all
    passages, and those that the items add. Items go in blocks of 256, so nothing broadcast grows
    with the tables; the driver holds the statistics of a block's terms only.

    Null and empty texts contain nothing, items without letters or digits are in nothing; equal items
    are found each; doc_id is taken to be unique; further columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    queries = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-queries.count() // BLOCK))
    found = []
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        hit = search_block(texts, Items([r["item_id"] for r in own], [r["text"] for r in own]), cosine, least, least_terms)
        if hit is not None:
            found.append(hit if blocks == 1 else materialize(hit, "leaks"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_share double, term_start long")
    return reduce(DataFrame.unionByName, found)
