"""Toxicity classifier with counterfactual regularisation."""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.hashing import IS_PUNCTUATION, LOWER, U, Tokens, pair_hash, slices, text_bytes, tokenize, word_hash, word_tokens

#: Weights; a term's place is its hash modulo this.
PLACES = 1 << 20
#: Labelled documents that a model is fitted on at most: those with the least hashes of doc_id.
FIT_ROWS = 8_000

# Terms that name groups, by kind; a term is swapped for each other one of its kind.
IDENTITIES = {
    "gender": ["women", "men", "girls", "boys", "transgender", "nonbinary"],
    "person": ["woman", "man", "girl", "boy"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"],
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"],
    "believers": ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"],
    "race": ["black", "white", "asian", "latino", "indigenous", "arab"],
    "origin": ["african", "european", "american", "mexican", "chinese", "indian"],
    "age": ["young", "old", "elderly"],
    "ability": ["disabled", "blind", "deaf", "autistic"],
}


#: Besides whole terms, their first so many bytes are features: inflected forms share them.
STEMS = (3, 4, 5, 6)


def term_tokens(column: pa.Array) -> Tokens:
    return word_tokens(column, lower=True, between=IS_PUNCTUATION)


def distinct_places(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of each text's terms and stems, and the text of each."""
    doc = np.repeat(np.arange(len(tokens.first) - 1, dtype=np.int64), np.diff(tokens.first)) * PLACES
    keys = [doc + (tokens.values % U(PLACES)).astype(np.int64)]
    if len(doc):
        for n in STEMS:
            longer = tokens.end - tokens.start > n
            start = tokens.start[longer]
            stem = pair_hash(word_hash(tokens.data, start, start + n), np.full(1, 7, U))
            keys.append(doc[longer] + (stem % U(PLACES)).astype(np.int64))
    both = np.unique(np.concatenate(keys))
    return both % PLACES, both // PLACES


def term_hash(term: str) -> int:
    data = LOWER[np.frombuffer(term.encode(), np.uint8)]
    return int(tokenize(data, np.array([0, len(data)]), IS_PUNCTUATION).values[0])


def swapped(texts: list[str]) -> list[list[str]]:
    """Counterfactuals of each text: one for each identity term in it and each other term of its kind,
    with every occurrence of the term replaced (A-Z lower-cased)."""
    tokens = term_tokens(pa.array(texts, pa.string()))
    known = {term_hash(t): (t, kind) for kind, terms in IDENTITIES.items() for t in terms}
    at = np.flatnonzero(np.isin(tokens.values, np.array(list(known), U)))
    doc = np.searchsorted(tokens.first, at, "right") - 1
    raw, base = tokens.data.tobytes(), text_bytes(pa.array(texts, pa.string()))[1]
    out: list[list[str]] = [[] for _ in texts]
    for d in np.unique(doc).tolist():
        own = at[doc == d]
        for value in np.unique(tokens.values[own]).tolist():
            term, kind = known[value]
            places = own[tokens.values[own] == value]
            for other in IDENTITIES[kind]:
                if other != term:
                    parts, upto = [], int(base[d])
                    for x, y in zip(tokens.start[places].tolist(), tokens.end[places].tolist(), strict=True):
                        parts += [raw[upto:x], other.encode()]
                        upto = y
                    out[d].append(b"".join([*parts, raw[upto : int(base[d + 1])]]).decode())
    return out


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``toxic, n, places``: features of each text, and of its counterfactuals what differs.

    ``places`` are the text's places; then, of the ``n`` counterfactuals, those that it gains, and
    those that it loses as -1 - place, each list ended by PLACES.
    """
    for batch in batches:
        for part in slices(batch, "text"):
            place, doc = distinct_places(term_tokens(part.column("text")))
            edges = np.searchsorted(doc, np.arange(len(part) + 1))
            own = [place[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            others = swapped(part.column("text").fill_null("").to_pylist())
            rows = []
            for mine, texts in zip(own, others, strict=True):
                lists = [mine, np.array([PLACES])]
                if texts:
                    p, d = distinct_places(term_tokens(pa.array(texts, pa.string())))
                    cut = np.searchsorted(d, np.arange(len(texts) + 1))
                    for x, y in zip(cut[:-1], cut[1:], strict=True):
                        lists += [np.setdiff1d(p[x:y], mine), -1 - np.setdiff1d(mine, p[x:y]), np.array([PLACES])]
                rows.append(np.concatenate(lists).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic"), "places": pa.array(rows, pa.binary())})


class Rows:
    """Sparse rows of +1 and -1, worked on in blocks so that nothing as long as all entries is made."""

    def __init__(self, place: np.ndarray, count: np.ndarray):
        self.place, self.first = place, np.concatenate(([0], np.cumsum(count)))
        self.blocks, at = [], 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(self.first, self.first[at] + (1 << 19), "right")) - 1)
            self.blocks.append((at, to))
            at = to

    def _block(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entries = self.place[self.first[a] : self.first[b]]
        row = np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1]))
        return np.where(entries < 0, -1 - entries, entries), entries < 0, row

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.first) - 1)
        for a, b in self.blocks:
            at, minus, row = self._block(a, b)
            value = w[at]
            value[minus] *= -1
            out[a:b] = np.bincount(row, value, b - a)
        return out

    def back(self, x: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for a, b in self.blocks:
            at, minus, row = self._block(a, b)
            value = x[a:b][row]
            value[minus] *= -1
            out += np.bincount(at, value, size)
        return out


def fit(text: np.ndarray, text_count: np.ndarray, label: np.ndarray, swap: np.ndarray, swap_count: np.ndarray, rounds: int = 150, decay: float = 1e-3, sparse: float = 2e-4, swap_weight: float = 5.0, least_docs: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + decay / 4 * |w|^2 + sparse * |w| + swap_weight * mean (score change)^2.

    ``text`` has the places of the texts one after another, ``text_count`` the number of each; ``swap``
    what each counterfactual gains (place) and loses (-1 - place). The score change is that of the
    logit between a training text and the same text with an identity term replaced by another of its
    kind, so it includes the stems of both. Terms in fewer than ``least_docs`` texts keep weight 0, but
    for those that swaps change.
    """
    weights = np.zeros(PLACES)
    if not len(label):
        return weights, -30.0
    common = np.bincount(text, minlength=PLACES) >= least_docs
    common[np.where(swap < 0, -1 - swap, swap)] = True
    names = np.flatnonzero(common)
    rank = np.full(PLACES, -1, np.int32)
    rank[names] = np.arange(len(names), dtype=np.int32)
    use = common[text]
    used = np.concatenate(([0], np.cumsum(use)))[np.concatenate(([0], np.cumsum(text_count)))]
    texts = Rows(rank[text[use]], np.diff(used))
    swaps = Rows(np.where(swap < 0, -1 - rank[np.where(swap < 0, -1 - swap, 0)], rank[np.where(swap < 0, 0, swap)]), swap_count)
    w, n = np.zeros(len(names) + 1), len(label)
    mean = np.clip(label.mean(), 1e-6, 1 - 1e-6)
    w[-1] = np.log(mean / (1 - mean))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        logit = texts.times(w) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - label) / n
        grad = np.append(texts.back(error, len(names)) + decay * w[:-1] / 2, error.sum())
        if len(swap_count) and swap_weight:
            grad[:-1] += swaps.back(2 * swap_weight / len(swap_count) * swaps.times(w), len(names))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = 0.1 / (np.sqrt(v / (1 - 0.99**t)) + 1e-6) * min(1.0, 2 - 2 * t / (rounds + 1))
        w -= rate * m / (1 - 0.9**t)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate[:-1] * sparse, 0)
    weights[names] = w[:-1]
    return weights, float(w[-1])


def scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            place, doc = distinct_places(term_tokens(part.column("text")))
            logit = np.bincount(doc, weights[place], len(part)) + bias
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(logit, -35, 35)))})


def kept_rows(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float, text_col: str) -> Iterator[pa.RecordBatch]:
    """Whole rows whose score is below 0.5."""
    for batch in batches:
        for part in slices(batch, text_col):
            place, doc = distinct_places(term_tokens(part.column(text_col)))
            yield part.filter(pa.array(np.bincount(doc, weights[place], len(part)) + bias < 0))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, swap_weight: float = 5.0) -> tuple[np.ndarray, float]:
    """Fit on at most ``fit_rows`` of ``labels (doc_id, toxic)``; features are made on the executors.

    The driver holds four bytes for each distinct feature of each of these texts.
    """
    chosen = labels.where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # fit_rows bounds its size
    rows = texts.mapInArrow(features, "toxic int, places binary").toArrow()
    label = rows.column("toxic").to_numpy().astype(float)
    text, text_count, swap, swap_count = unpacked(rows.column("places"))
    return fit(text, text_count, label, swap, swap_count, swap_weight=swap_weight)


def unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """``text, text_count, swap, swap_count`` of the rows of ``features``; sized once, filled row by row."""
    sizes = np.array([len(x) // 4 for c in column.chunks for x in map(lambda v: v.as_buffer(), c)], np.int64)
    text = np.empty(int(sizes.sum()), np.int32)
    text_count, swap, swap_count, at = np.zeros(len(sizes), np.int64), [], [], 0
    values = (v.as_buffer() for c in column.chunks for v in c)
    for i, buffer in enumerate(values):
        row = np.frombuffer(buffer, np.int32)
        ends = np.flatnonzero(row == PLACES)
        text[at : at + ends[0]] = row[: ends[0]]
        at += int(ends[0])
        text_count[i] = ends[0]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            swap.append(row[a + 1 : b])
            swap_count.append(b - a - 1)
    return text[:at], text_count, np.concatenate(swap) if swap else np.zeros(0, np.int32), np.array(swap_count, np.int64)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Labels are learned only from rows whose crc32(doc_id as text) modulo ``folds`` isn't 0. The
    score depends on the text alone: which terms (runs of letters and digits, A-Z lower-cased)
    occur in it. Null and empty texts get the score of a text without terms; without any label
    every score is near 0; rows with a null label are left out; repeated rows are scored each, and
    labelled each where both have a label; an empty table gives no rows; further columns are ignored.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    weights, bias = train(docs, labels.where(fold != 0), fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = texts.mapInArrow(partial(scored, weights=weights.astype(np.float32), bias=bias), "doc_id long, score double")
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that ``toxicity`` with the same labels predicts 0 for.

    Rows are scored where they are read; nothing is joined or shuffled. Null and empty texts, repeated
    rows, an empty table and further columns are dealt with as ``toxicity`` does.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    weights, bias = train(docs, labels.where(fold != 0), fit_rows)
    return docs.mapInArrow(partial(kept_rows, weights=weights.astype(np.float32), bias=bias, text_col="text"), docs.schema)
