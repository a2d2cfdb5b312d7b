"""Language-model scores of documents by a hierarchical Pitman-Yor model."""

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bucketed, materialize, partitions, release
from ledgerlens.llm.hashing import U, mix, slices, word_tokens
from ledgerlens.llm.pitman_yor import Stage, pair_keys, word_keys

#: Pairs of two words of these are scored where texts are read, by a broadcast table; any other word is
#: rarer than 1 in HOT tokens or so.
HOT = 256
#: The most frequent words of a task that take part in choosing the HOT.
LOCAL = 4096
#: Tokens and documents that a task packs at once.
PACK_TOKENS, PACK_DOCS = 1 << 20, 60_000
#: Tokens whose sums by document are taken at once; bytes of a row group of the tokens, and rows after which its size is
#: first looked at. Spark reads a row group at once, so a part's rows would be held several times in one piece else.
SUMMED, ROW_GROUP = 1 << 18, {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "8"}
#: Sweeps that come before, each with totals of its own, and draws that are averaged.
BURN_IN, SWEEPS = 1, 3
END, START = mix(np.array([101, 102], U))

#: A part's tokens of a pack: numbers of keys, second words, tokens and documents, and the columns compressed as one;
#: or, as part -1, pairs of hot words and their training counts.
PACKED = "bucket int, head binary, data binary"
#: What parts tell each other of their common contexts: which they are, customers (the first time) and tables;
#: or, as stage -1, sums for all. At first contexts are known by their hashes; the answer has their places in
#: their range, which stand for them from then on. Stage -2 is what a range keeps for itself.
MESSAGE = "bucket int, origin int, stage int, contexts binary, customers binary, tables binary"
#: Sums of a document over a part of the vocabulary; logarithms are summed as multiples of 1 / BASE_UNIT and
#: 1 / SCORE_UNIT, so that sums don't depend on their order.
SUMS = ("doc_id", "n_known", "base", "score")
BASE_UNIT, SCORE_UNIT = float(1 << 22), float(1 << 22)
#: 1 << NEAR documents of neighbouring ids are summed in one slot, so that ids are sent as small differences.
NEAR = 6
SLOT = "slot int, n int, sums binary"
PART = "doc_id long, n_tokens long, n_known long, base long, score long"


def events(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, previous word and text of every token; each text ends with an end token."""
    tokens = word_tokens(part.column("text"), lower=True)
    n = len(tokens.first) - 1
    words, at = np.empty(len(tokens.values) + n, U), tokens.first[1:] + np.arange(n)
    is_end = np.zeros(len(words), bool)
    is_end[at] = True
    words[is_end], words[~is_end] = END, tokens.values
    context = np.empty(len(words), U)
    context[1:] = words[:-1]
    context[np.concatenate(([0], at[:-1] + 1)) if n else np.zeros(0, np.int64)] = START
    return words, context, np.repeat(np.arange(n), np.diff(tokens.first) + 1)


def local_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's most frequent words; which words are chosen changes costs, not results."""
    words, counts = np.zeros(0, U), np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            w, c = np.unique(events(part)[0], return_counts=True)
            words, inverse = np.unique(np.concatenate((words, w)), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate((counts, c)), len(words)).astype(np.int64)
            if len(words) > 16 * LOCAL:
                keep = np.argpartition(counts, -LOCAL)[-LOCAL:]
                words, counts = words[keep], counts[keep]
    keep = np.argsort(counts)[-LOCAL:]
    yield pa.RecordBatch.from_pydict({"word": words[keep].view(np.int64), "n": counts[keep]})


def place_in(sorted_words: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Position of each word, or -1."""
    at = np.minimum(np.searchsorted(sorted_words, words), len(sorted_words) - 1)
    return np.where(sorted_words[at] == words, at, -1)


def edges(buckets: int) -> np.ndarray:
    """Least hash of each of so many equal ranges."""
    return np.arange(buckets, dtype=U) * U((1 << 64) // buckets)


def by_place(values: np.ndarray) -> bytes:
    """Numbers by place of their bytes, which compresses better."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_places(raw: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def differences(values: np.ndarray) -> bytes:
    """By place of their bytes, the steps between numbers, which are small where numbers are sorted; they wrap around."""
    return by_place(np.diff(values, prepend=values.dtype.type(0)))


def from_differences(raw: np.ndarray, kind: type) -> np.ndarray:
    return np.cumsum(from_places(raw, kind), dtype=kind)


def index_kind(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def compressed(keys: np.ndarray, sizes: np.ndarray, others: np.ndarray, other: np.ndarray, doc: np.ndarray, docs: np.ndarray, train: np.ndarray) -> tuple[bytes, bytes]:
    """Head and data of a row. Uncompressed, a part's rows would be held by the sort, the Arrow batch and Python at
    once, in twice the bytes or more."""
    data = [differences(keys), by_place(sizes), differences(others), by_place(other.astype(index_kind(len(others)))), differences(doc.astype(np.uint16)), differences(docs), train.tobytes()]
    return np.array([len(x) for x in (keys, others, other, docs)], np.int64).tobytes(), pa.compress(b"".join(data), codec="zstd", asbytes=True)


def decompressed(head: pa.Scalar, data: pa.Scalar) -> tuple[np.ndarray, ...]:
    """The columns of a row, as ``compressed`` was given them."""
    keys, others, tokens, docs = np.frombuffer(head.as_buffer(), np.int64).tolist()
    index = index_kind(others)
    ends = np.cumsum([8 * keys, 4 * keys, 8 * others, np.dtype(index).itemsize * tokens, 2 * tokens, 8 * docs, docs])
    x = np.split(np.frombuffer(pa.decompress(data.as_buffer(), int(ends[-1]), codec="zstd"), np.uint8), ends[:-1])
    return from_differences(x[0], U), from_places(x[1], np.uint32), from_differences(x[2], U), from_places(x[3], index), from_differences(x[4], np.uint16), from_differences(x[5], np.int64), x[6].astype(bool)


def packed(batches: Iterator[pa.RecordBatch], hot: np.ndarray, hot_contexts: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Tokens by part: one row for each part and pack.

    Parts 0 to ``buckets`` - 1 are ranges of words that aren't hot, with their contexts; those from
    ``buckets`` on are ranges of contexts that aren't hot, with the hot words after them. A row has its keys, the number
    of tokens of each, and each token's other word and document. Of two hot words (part -1) only
    training counts are sent.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        words, context, doc, ids, train = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        at, before = place_in(hot, words).astype(np.int32), place_in(hot_contexts, context).astype(np.int32)
        both = (at >= 0) & (before >= 0)
        use = both & train[doc]
        cell, n = np.unique(at[use].astype(np.int64) * len(hot_contexts) + before[use], return_counts=True)
        rows = [(-1, cell.astype(np.int64).tobytes(), n.astype(np.int64).tobytes())]
        for shift, chosen, keys, others in ((0, at < 0, words, context), (buckets, (at >= 0) & ~both, context, words)):
            use = np.flatnonzero(chosen)
            use = use[np.argsort(keys[use], kind="stable")]
            k, o, d = keys[use], others[use], doc[use]
            cut = [*np.searchsorted(k, edges(buckets)).tolist(), len(k)]
            for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if y > x:
                    new = np.flatnonzero(np.concatenate(([True], k[x + 1 : y] != k[x : y - 1])))
                    sizes = np.diff(np.append(new, y - x)).astype(np.uint32)
                    seconds, other = np.unique(o[x:y], return_inverse=True)
                    used, local = np.unique(d[x:y], return_inverse=True)
                    rows.append((b + shift, *compressed(k[x:y][new], sizes, seconds, other, local, ids[used], train[used])))
        columns = zip(("bucket", "head", "data"), zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)
        return pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in columns})

    docs = 0
    for batch in batches:
        for part in slices(batch, "text"):
            for at in range(0, len(part), PACK_DOCS):
                some = part.slice(at, PACK_DOCS)
                if held and (size >= PACK_TOKENS or docs + len(some) > PACK_DOCS):
                    yield flush()
                    size, docs = 0, 0
                words, context, doc = events(some)
                ids, train = (some.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "train"))
                held.append((words, context, (doc + docs).astype(np.int32), ids.astype(np.int64), train.astype(bool)))
                size += len(words)
                docs += len(some)
    if held:
        yield flush()


def joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


class Part:
    """All tokens of one part: pairs ``(first[i], second[j])``, training counts, and each token's pair and document."""

    def __init__(self, table: pa.Table):
        rows = [decompressed(*x) for x in zip(table.column("head"), table.column("data"), strict=True)]
        keys, sizes, others, other, doc, docs, train = map(list, zip(*rows, strict=True)) if rows else [[]] * 7
        del rows
        self.first, number = np.unique(joined(keys, U), return_inverse=True)
        self.second, at = np.unique(joined(others, U), return_inverse=True)
        shifts = np.cumsum([0, *map(len, others)]), np.cumsum([0, *map(len, docs)])
        key = np.repeat(number, joined(sizes, np.uint32))
        key *= len(self.second)
        self.doc = np.empty(len(key), np.int32)
        begin = 0
        for second, text, s in zip(other, doc, zip(*shifts, strict=True), strict=False):
            end = begin + len(text)
            key[begin:end] += at[second + s[0]]
            self.doc[begin:end] = text + s[1]
            begin = end
        del other, doc
        self.ids, train = joined(docs, np.int64), joined(train, bool)
        key, pair = np.unique(key, return_inverse=True)
        self.pair = pair.astype(np.int32)
        self.i, self.j = np.divmod(key, max(len(self.second), 1))
        self.count = np.bincount(self.pair, train[self.doc], len(key)).astype(np.int64)
        self.tables = np.minimum(self.count, 1)


def sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n).astype(np.int64)


def once_twice(n: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(n == k)) for k in (1, 2)]


def rows_of(table: pa.Table, stage: int) -> list[dict]:
    """Messages of a stage by origin."""
    return sorted((r for r in table.to_pylist() if r["stage"] == stage), key=lambda r: r["origin"])


def squeezed(values: np.ndarray) -> bytes:
    return packed_columns([values])


def unsqueezed(raw: bytes, n: int) -> np.ndarray:
    return unpacked_columns(raw, n, 1)[0].astype(np.int64)


def hashes(values: np.ndarray) -> bytes:
    """Sorted hashes by their differences; their number comes first."""
    return len(values).to_bytes(8, "little") + squeezed(np.diff(values, prepend=U(0)).view(np.int64))


def from_hashes(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(raw[8:], int.from_bytes(raw[:8], "little")).view(U), dtype=U)


def messages(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ("bucket", "origin", "stage", "contexts", "customers", "tables")
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


class Words(Part):
    """A range of words. All that their restaurants in the root hold is here; of contexts only a share."""

    def start(self) -> None:
        self.names, self.word_names = pair_keys(self.first[self.i], self.second[self.j]), word_keys(self.first)
        self.words = sums(self.i, self.count, len(self.first))
        self.customers = sums(self.i, self.tables, len(self.first))
        self.root_tables = np.minimum(self.customers, 1)

    def contexts(self, replies: pa.Table, buckets: int, stages: int) -> None:
        """Customers of each context, and its tables after each sweep."""
        cut = self.cut(buckets)
        self.context_tables = []
        for s in range(stages):
            rows = rows_of(replies, s)
            size = [cut[r["origin"] - buckets + 1] - cut[r["origin"] - buckets] for r in rows]
            if s == 0:
                self.context_customers = joined([unsqueezed(r["customers"], n) for r, n in zip(rows, size, strict=True)], np.int64)
            self.context_tables.append(joined([unsqueezed(r["tables"], n) for r, n in zip(rows, size, strict=True)], np.int64))

    def cut(self, buckets: int) -> list[int]:
        return [*np.searchsorted(self.second, edges(buckets)).tolist(), len(self.second)]

    def sweep(self, stages: list[Stage], number: int, final: int = 0) -> np.ndarray:
        """Seat all customers anew given the totals of ``stages[number - 1]``; the probability of pairs afterwards."""
        s, tables = stages[number - 1], self.context_tables[number - 1][self.j]
        root = s.root(self.customers, self.root_tables)[self.i]
        self.tables = s.seats(self.count, root, tables, self.names, number + final)
        if final:
            return s.predictive(self.count, self.tables, root, self.context_customers[self.j], tables)
        self.customers = sums(self.i, self.tables, len(self.first))
        self.root_tables = s.root_seats(self.customers, self.word_names, number)
        return root


def word_stage(key, table: pa.Table, replies: pa.Table | None, stages: list[Stage], buckets: int) -> pa.Table:
    """Sweep a range of words; tell each range of contexts the customers and tables it holds there."""
    stage, part = len(stages), Words(table)
    part.start()
    places: dict[int, bytes] = {}
    if replies is not None:
        part.contexts(replies, buckets, stage)
        places = {r["origin"]: r["contexts"] for r in rows_of(replies, 0)}
        for k in range(1, stage + 1):
            part.sweep(stages, k)
    customers, tables = (sums(part.j, x, len(part.second)) for x in (part.count, part.tables))
    cut, rows = part.cut(buckets), []
    for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if y > x:
            first = squeezed(customers[x:y]) if stage == 0 else b""
            named = places[buckets + b] if stage else hashes(part.second[x:y])
            rows.append((buckets + b, key[0].as_py(), stage, named, first, squeezed(tables[x:y])))
    told = [part.customers.sum(), part.root_tables.sum(), np.count_nonzero(part.words), part.count.sum(), *once_twice(part.count), *once_twice(part.customers)]
    rows.append((rows[0][0], key[0].as_py(), -1, b"", np.array(told, np.float64).tobytes(), b""))
    return messages(rows)


class Hot:
    """Hot words and contexts: their names, and the counts, tables and root probabilities of pairs of them."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, count: np.ndarray):
        self.words, self.contexts, self.count = words, contexts, count
        self.names = pair_keys(np.repeat(words, len(contexts)), np.tile(contexts, len(words))).reshape(count.shape)
        self.tables, self.roots = [np.minimum(count, 1)], []
        self.context_customers, self.context_tables = None, []

    def sweep(self, s: Stage, number: int, final: int = 0) -> np.ndarray:
        """Tables of pairs after a sweep, given what the one before left."""
        root, tables = np.broadcast_arrays(self.roots[number - 1][:, None], self.context_tables[number - 1][None, :])
        return s.seats(self.count.ravel(), root.ravel(), tables.ravel(), self.names.ravel(), number + final).reshape(self.count.shape)


class Contexts(Part):
    """A range of contexts that aren't hot with the hot words in them; ``kept`` has what the range told itself."""

    def __init__(self, table: pa.Table, kept: pa.Table, hot: Hot, bucket: int):
        super().__init__(table)
        self.names = pair_keys(self.second[self.j], self.first[self.i])
        self.word = place_in(hot.words, self.second)[self.j]
        rows = sorted((r for r in kept.to_pylist() if r["origin"] == bucket and r["stage"] >= 0), key=lambda r: r["stage"])
        self.customers = unsqueezed(rows[0]["customers"], len(self.first)) if rows else None
        self.context_tables = [unsqueezed(r["tables"], len(self.first)) for r in rows]

    def sweep(self, stages: list[Stage], hot: Hot, number: int, final: int = 0) -> np.ndarray:
        if not len(self.i):
            return np.zeros(0)
        s, tables, root = stages[number - 1], self.context_tables[number - 1][self.i], hot.roots[number - 1][self.word]
        self.tables = s.seats(self.count, root, tables, self.names, number + final)
        return s.predictive(self.count, self.tables, root, self.customers[self.i], tables)


def context_stage(key, table: pa.Table, sent: pa.Table, hot: Hot, stages: list[Stage], buckets: int) -> pa.Table:
    """Add up a range of contexts over all parts, answer each, and tell the sums over words and over hot contexts."""
    stage, bucket, n = len(stages), key[0].as_py(), len(hot.words)
    part = Contexts(table, sent, hot, bucket)
    for k in range(1, stage + 1):
        part.sweep(stages, hot, k)
    came = [(r, from_hashes(r["contexts"])) for r in rows_of(sent, stage) if r["origin"] < buckets]
    mine = np.flatnonzero(np.searchsorted(edges(buckets), hot.contexts, side="right") - 1 + buckets == bucket)
    keeps = []
    if stage == 0:
        every = np.unique(np.concatenate([part.first, hot.contexts[mine], *[c for _, c in came]]))
        own, of_hot, *places = (np.searchsorted(every, x) for x in (part.first, hot.contexts[mine], *[c for _, c in came]))
        size = len(every)
        keeps = [(bucket, bucket, -2, hashes(own.astype(U)), size.to_bytes(8, "little"), hashes(of_hot.astype(U)))]
    else:
        kept = rows_of(sent, -2)[0]
        own, of_hot, *places = (from_hashes(x).astype(np.int64) for x in (kept["contexts"], kept["tables"], *[r["contexts"] for r, _ in came]))
        size = int.from_bytes(kept["customers"], "little")
    origins = [(r["origin"], at) for (r, _), at in zip(came, places, strict=True)] + [(bucket, own)] * (len(own) > 0)
    told_hot, found = np.zeros((2, len(hot.contexts))), []
    for i, (name, values, pairs) in enumerate((("customers", part.count, hot.count), ("tables", part.tables, hot.tables[stage]))):
        total = sums(own[part.i], values, size)
        if stage == 0 or name == "tables":
            for (_, at), (r, _) in zip(origins, came, strict=False):
                total[at] += unsqueezed(r[name], len(at))
        told_hot[i, mine] = total[of_hot]
        total[of_hot] += pairs.sum(0)[mine]
        found.append(total)
    first = stage == 0
    rows = [(o, bucket, stage, hashes(at.astype(U)) if first and o != bucket else b"", squeezed(found[0][at]) if first else b"", squeezed(found[1][at])) for o, at in origins]
    words = sum((np.frombuffer(r["customers"], np.float64) for r in rows_of(sent, -1)), np.zeros(8))
    told = np.concatenate([words, [part.count.sum()], once_twice(part.count), sums(part.word, part.count, n), sums(part.word, part.tables, n), *told_hot])
    return messages([*keeps, *rows, (-1, bucket, stage, b"", told.astype(np.float64).tobytes(), b"")])


def cell_sums(batches: Iterator[pa.RecordBatch], size: int, values: str, keys: str | None, kind: type) -> Iterator[pa.RecordBatch]:
    """Sums of a task's rows of vectors, whose places are ``keys`` or as they stand."""
    out = np.zeros(size)
    for batch in batches:
        for r in batch.to_pylist():
            v = np.frombuffer(r[values], kind)
            out[np.frombuffer(r[keys], np.int64) if keys else np.arange(len(v))] += v
    at = np.flatnonzero(out)
    yield pa.RecordBatch.from_pydict({"key": at, "value": out[at]})


def summed(df: DataFrame, size: int, values: str, keys: str | None = None, kind: type = np.float64) -> np.ndarray:
    """Sum of the rows' vectors; ``size`` is set by the number of hot words."""
    rows = df.mapInArrow(lambda it: cell_sums(it, size, values, keys, kind), "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size)
    out[rows["key"].to_numpy()] = rows["value"].to_numpy()
    return out


def gathered(hot: Hot, stages: list[Stage], told: np.ndarray) -> Stage:
    """The next stage's totals from the sums that parts told; brings ``hot`` up to date."""
    n, stage, tables = len(hot.words), len(stages), hot.tables[len(stages)]
    words, contexts = told[:8], told[8:]
    own, (count, customers), of_hot = contexts[:3], contexts[3 : 3 + 2 * n].reshape(2, n), contexts[3 + 2 * n :].reshape(2, -1) + [hot.count.sum(0), hot.tables[len(stages)].sum(0)]
    customers = (customers + tables.sum(1)).astype(np.int64)
    hot.context_tables.append(of_hot[1])
    if stage == 0:
        hot.context_customers, hot.total = of_hot[0], (count + hot.count.sum(1)).astype(np.int64)
        hot.root_tables = np.minimum(customers, 1)
        ones = [words[4:6] + own[1:3] + once_twice(hot.count), words[6:8] + once_twice(customers)]
        discount = tuple(float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95)) for a, b in ones)
        size = int(words[2]) + int(np.count_nonzero(hot.total)), int(words[3] + hot.total.sum())
    else:
        discount, size = stages[0].discount, (stages[0].words, stages[0].tokens)
        hot.root_tables = stages[-1].root_seats(customers, word_keys(hot.words), stage)
    out = Stage(float(words[0] + customers.sum()), float(words[1] + hot.root_tables.sum()), discount, *size)
    hot.roots.append(out.root(customers, hot.root_tables))
    return out


def units(log: np.ndarray, unit: float) -> np.ndarray:
    return np.rint(log.astype(np.float64) * unit).astype(np.int64)


def base_units(count: np.ndarray, s: Stage) -> np.ndarray:
    return units(np.log10((count + 1) / (s.tokens + s.words + 1)), BASE_UNIT)


def whole_sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of integers by document; halves keep them within what a double holds."""
    high, low = values >> 24, values & ((1 << 24) - 1)
    return (np.bincount(doc, high, n).astype(np.int64) << 24) + np.bincount(doc, low, n).astype(np.int64)


def packed_columns(columns: list[np.ndarray]) -> bytes:
    """Integers by place of their bytes, which mostly repeat, compressed."""
    raw = b"".join(c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_columns(raw: bytes, n: int, columns: int = len(SUMS)) -> list[np.ndarray]:
    data = np.frombuffer(pa.decompress(raw, 8 * n * columns, codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(c.reshape(8, n).T).view("<i8").ravel() for c in np.split(data, columns)]


def sums_by_text(doc: np.ndarray, pair: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """``whole_sums`` of each token's value, which is that of its pair, so many tokens at a time."""
    out = np.zeros(n, np.int64)
    for at in range(0, len(doc), SUMMED):
        out += whole_sums(doc[at : at + SUMMED], values[pair[at : at + SUMMED]], n)
    return out


def document_sums(part: Part, log: np.ndarray, count: np.ndarray, s: Stage, slots: int) -> pa.Table:
    """Sums over the tokens of each document that are in this part, packed by a hash of doc_id.

    ``log`` and ``count`` (of the word) are by pair. A row a slot, not a row a document: each document has
    words in very many parts. A document has no more sums than tokens, so what is sent is bounded by the
    tokens, whatever the number of parts. In a row documents with one token here come first, and in place of
    ``base``, which is negative, they have their word's count.
    """
    ids, doc = np.unique(part.ids, return_inverse=True)
    doc, n = doc.astype(np.int32)[part.doc], len(ids)
    found = [ids, *[sums_by_text(doc, part.pair, x, n) for x in ((count > 0).astype(np.int64), base_units(count, s), units(log, SCORE_UNIT))]]
    many = np.bincount(doc, minlength=n) > 1
    alone = ~many[doc]
    found[2][doc[alone]] = count[part.pair[alone]]
    found[1][~many] = 0
    slot = (mix((ids >> NEAR).astype(U)) % U(slots)).astype(np.int32)
    order = np.lexsort((many, slot))
    new = np.flatnonzero(np.concatenate(([True], np.diff(slot[order]) > 0))) if n else np.zeros(0, np.int64)
    runs = [order[a:b] for a, b in zip(new, [*new[1:], n], strict=True)]
    return pa.table({"slot": slot[order][new], "n": pa.array([len(r) for r in runs], pa.int32()), "sums": pa.array([packed_columns([np.diff(ids[r], prepend=0), *[c[r] for c in found[1:]]]) for r in runs], pa.binary())})


def averaged(sweep) -> np.ndarray:
    """log10 of the mean probability over SWEEPS draws."""
    return np.log10(sum(sweep(final=i) for i in range(1, SWEEPS + 1)) / SWEEPS)


def word_scores(key, table: pa.Table, replies: pa.Table, stages: list[Stage], buckets: int) -> pa.Table:
    part, last = Words(table), len(stages)
    part.start()
    part.contexts(replies, buckets, last)
    for k in range(1, last):
        part.sweep(stages, k)
    return document_sums(part, averaged(partial(part.sweep, stages, last)), part.words[part.i], stages[0], buckets)


def context_scores(key, table: pa.Table, kept: pa.Table, hot: Hot, stages: list[Stage], buckets: int) -> pa.Table:
    part = Contexts(table, kept, hot, key[0].as_py())
    return document_sums(part, averaged(partial(part.sweep, stages, hot, len(stages))), hot.total[part.word], stages[0], buckets)


def slot_sums(table: pa.Table, s: Stage) -> pa.Table:
    """One row a document from all parts' rows of a slot."""
    rows = [unpacked_columns(x, n) for x, n in zip(table.column("sums").to_pylist(), table.column("n").to_pylist(), strict=True)]
    ids, known, base, score = (np.concatenate(c) for c in zip(*[(np.cumsum(d), *others) for d, *others in rows], strict=True))
    one = base >= 0
    known[one] += base[one] > 0
    base[one] = base_units(base[one], s)
    ids, doc = np.unique(ids, return_inverse=True)
    n_known, base, score = (whole_sums(doc, x, len(ids)) for x in (known, base, score))
    return pa.table({"doc_id": ids, "n_tokens": np.zeros(len(ids), np.int64), "n_known": n_known, "base": base, "score": score})


def hot_scores(batches: Iterator[pa.RecordBatch], hot: np.ndarray, contexts: np.ndarray, count: np.ndarray, log: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over pairs of hot words, by the table ``log``; and the number of all tokens."""
    for batch in batches:
        for part in slices(batch, "text"):
            w, context, doc = events(part)
            n = len(part)
            n_tokens = np.bincount(doc, minlength=n)
            at, before = place_in(hot, w), place_in(contexts, context)
            use = (at >= 0) & (before >= 0)
            at, before, doc = at[use], before[use], doc[use]
            known = np.bincount(doc, count[at] > 0, n).astype(np.int64)
            found = [whole_sums(doc, x, n) for x in (base[at], log[at, before])]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": n_tokens, "n_known": known, "base": found[0], "score": found[1]})


def lm_scores(docs: DataFrame, train: "F.Column", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of each whole text: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``train`` is a condition on doc_id. Tokens are words (A-Z lower-cased) and one end for each
    text. Every previous word is a context with a restaurant of its own, so the model grows with the corpus.
    Tokens of all texts are shuffled once, packed by part of the vocabulary, where all that the root holds of a
    word meets. A context has words in many parts: each part sends its sums to the context's range and gets
    the totals back, once before the first sweep and again after each. Sweeps run in parallel
    over parts; the probabilities of SWEEPS draws after BURN_IN sweeps are averaged. Words so frequent that they would
    make a part large are dealt by their context instead, and pairs of two such words are sent
    as counts and scored by a table of fixed size where texts are read.

    Which words are frequent and how words are dealt to parts changes costs only: scores are the same
    for any partitioning of the input and any number of parts.

    Null and empty texts are the end token alone; without training texts every word is unknown
    and equally likely. Rows that repeat a doc_id are one document: each row's tokens count, and one
    row with the sums over all of them is returned. Further columns are ignored; an empty table gives
    no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    top = texts.mapInArrow(local_top, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = top.orderBy(F.desc("n"), "word").limit(HOT).collect()
    frequent = np.unique(np.append(np.array([r["word"] for r in chosen], np.int64).view(U), END))
    before = np.unique(np.append(frequent, START))
    flagged = texts.withColumn("train", train)
    buckets = partitions(docs.sparkSession)
    spread = F.when(F.col("bucket") < 0, -1 - F.spark_partition_id()).otherwise(F.col("bucket"))  # counts of hot pairs, one row a task
    tokens = bucketed(flagged.mapInArrow(partial(packed, hot=frequent, hot_contexts=before, buckets=buckets), PACKED), "bucket", "tokens", buckets, deal=spread, options=ROW_GROUP)
    pairs = summed(tokens.where("bucket = -1").select("head", "data"), len(frequent) * len(before), "data", "head", np.int64)
    hot, stages = Hot(frequent, before, pairs.astype(np.int64).reshape(len(frequent), -1)), []
    to_words, to_contexts = f"bucket between 0 and {buckets - 1}", f"bucket >= {buckets}"
    words, contexts = (tokens.where(x).groupBy("bucket") for x in (to_words, to_contexts))
    replies: list[DataFrame] = []

    def told_to(condition: str, named: bool = True) -> DataFrame:
        out = reduce(DataFrame.union, replies).where(condition)
        return out if named else out.withColumn("contexts", F.lit(None).cast("binary"))

    while len(stages) <= BURN_IN:
        now = list(stages)
        if now:
            hot.tables.append(hot.sweep(now[-1], len(now)))
            step = words.cogroup(told_to(to_words).groupBy("bucket")).applyInArrow(lambda k, a, b: word_stage(k, a, b, now, buckets), MESSAGE)
            step = step.union(told_to(to_contexts))
        else:
            step = words.applyInArrow(lambda k, a: word_stage(k, a, None, [], buckets), MESSAGE)
        step = contexts.cogroup(step.groupBy("bucket")).applyInArrow(lambda k, a, b: context_stage(k, a, b, hot, now, buckets), MESSAGE)
        replies.append(materialize(step, "replies"))
        release(docs.sparkSession)
        told = summed(replies[-1].where("bucket = -1").select("customers"), 11 + 2 * len(frequent) + 2 * len(before), "customers")
        stages.append(gathered(hot, now, told))

    last = stages[-1]
    of_pairs = averaged(lambda final: last.predictive(hot.count, hot.sweep(last, len(stages), final), hot.roots[-1][:, None], hot.context_customers[None, :], hot.context_tables[-1][None, :]))
    shared = docs.sparkSession.sparkContext.broadcast((frequent, before, hot.total, units(of_pairs, SCORE_UNIT), base_units(hot.total, last)))  # HOT x HOT
    near = texts.mapInArrow(lambda it: hot_scores(it, *shared.value), PART)
    far = words.cogroup(told_to(to_words, False).groupBy("bucket")).applyInArrow(lambda k, a, b: word_scores(k, a, b, stages, buckets), SLOT)
    far = far.union(contexts.cogroup(told_to(to_contexts).groupBy("bucket")).applyInArrow(lambda k, a, b: context_scores(k, a, b, hot, stages, buckets), SLOT))
    of_model = stages[0]
    far = far.groupBy("slot").applyInArrow(lambda t: slot_sums(t, of_model), PART)
    names = ["n_tokens", "n_known", "base", "score"]
    out = near.unionByName(far).groupBy("doc_id").agg(*[F.sum(x).alias(x) for x in names])
    base, score = (F.col("base") / BASE_UNIT).alias("base_score"), (F.col("score") / SCORE_UNIT).alias("score")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(last.tokens).cast("long").alias("train_tokens"), base, score)


def in_fold(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """Scores learned from all documents but those whose crc32(doc_id as text) modulo ``modulus`` is ``held``;
    ``perplexity`` is that of the document, 10 to the mean negative score of its tokens."""
    out = lm_scores(docs, ~in_fold(modulus, held))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return out.select("doc_id", in_fold(modulus, held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity)
