"""Token counts by a count-only Viterbi over a unigram vocabulary."""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.hashing import slices, text_bytes

SPACE = "▁"
#: What an unknown character scores below the lowest piece, as unigram tokenizers have it.
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers before it starts anew, and the longest word dealt with in bulk.
REMEMBERED, BULK = 1 << 20, 64


class UnigramCounter:
    """Counts the pieces of the best segmentation of words.

    Aho-Corasick finds all vocabulary matches in one pass; the dynamic programme keeps the best
    score and its number of pieces at each character. Of equal scores the earliest start wins; a
    character without a piece of its own may be unknown and then counts its UTF-8 bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        self.low = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        for piece, score in pieces:
            if piece:
                self.find.add_word(piece, (len(piece), float(score)))
        if len(self.find):
            self.find.make_automaton()
        self.known: dict[bytes, int] = {}

    def _matches(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and score of all matches and unknown characters."""
        found = list(self.find.iter(text)) if len(self.find) else []
        end = np.fromiter((e for e, _ in found), np.int64, len(found)) + 1
        size = np.fromiter((v[0] for _, v in found), np.int64, len(found))
        score = np.fromiter((v[1] for _, v in found), np.float64, len(found))
        lone = np.ones(len(text), bool)
        lone[(end - size)[size == 1]] = False
        at = np.flatnonzero(lone)
        return np.concatenate((end - size, at)), np.concatenate((size, np.ones(len(at), np.int64))), np.concatenate((score, np.full(len(at), self.low)))

    def bulk(self, words: list[str]) -> np.ndarray:
        """Counts of many words at once: step s extends the paths of all words from character s."""
        text = "\0".join(words) + "\0"
        length = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate(([0], np.cumsum(length + 1)))
        start, size, score = self._matches(text)
        word = np.searchsorted(first, start, "right") - 1
        inside = start - first[word] < length[word]
        start, size, score, word = start[inside], size[inside], score[inside], word[inside]
        known = ~((size == 1) & (score == self.low))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        pieces = np.where(known, 1, width[start])
        step = (start - first[word]) * 1024 + size
        order = np.argsort(step, kind="stable")
        start, size, score, pieces, step = start[order], size[order], score[order], pieces[order], step[order]
        best, count = np.full(len(text) + 1, -np.inf), np.zeros(len(text) + 1, np.int64)
        best[first[:-1]] = 0.0
        edges = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            here, to = start[a:b], start[a:b] + size[a:b]
            path = best[here] + score[a:b]
            better = path > best[to]
            to = to[better]
            best[to] = path[better]
            count[to] = count[here[better]] + pieces[a:b][better]
        return count[first[:-1] + length]

    def single(self, word: str) -> int:
        """Count of one long word."""
        start, size, score = self._matches(word)
        order = np.lexsort((size, start))
        best, count = [float("-inf")] * (len(word) + 1), [0] * (len(word) + 1)
        best[0] = 0.0
        for s, n, x in zip(start[order].tolist(), size[order].tolist(), score[order].tolist(), strict=True):
            if best[s] + x > best[s + n]:
                best[s + n] = best[s] + x
                count[s + n] = count[s] + (len(word[s].encode()) if n == 1 and x == self.low else 1)
        return count[-1]

    def counts(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.known.clear()
            new = list(dict.fromkeys(words))
        texts = [SPACE + w.decode() for w in new]
        short = [i for i, t in enumerate(texts) if len(t) <= BULK]
        for at in range(0, len(short), 10_000):
            some = short[at : at + 10_000]
            self.known.update(zip([new[i] for i in some], self.bulk([texts[i] for i in some]).tolist(), strict=True))
        for i in range(len(new)):
            if len(texts[i]) > BULK:
                self.known[new[i]] = self.single(texts[i])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


_counters: dict[str, UnigramCounter] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _counters:  # kept between tasks of a worker, with the words it remembers
        _counters[path] = UnigramCounter(vocabulary(path))
    counter = _counters[path]
    for batch in batches:
        for part in slices(batch, "text", 1 << 21):
            data, offsets = text_bytes(part.column("text"))
            raw = data.tobytes()
            split = [raw[a + (raw[a : a + 1] == b" ") : b].split(b" ") if b > a else [] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            each = counter.counts([w for words in split for w in words])
            upto = np.concatenate(([0], np.cumsum(each)))[np.cumsum([0, *map(len, split)])]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": np.diff(offsets), "n_tokens": np.diff(upto)})


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens``: pieces of the best segmentation of each whole text.

    A text is cut before each space, which becomes the word-start mark; a text that doesn't start
    with a space gets a mark too; other white space is ordinary. Null and empty texts have no tokens; equal rows are
    counted each; further columns are ignored. Ties follow unigram tokenizers exactly: the tests
    compare with such a tokenizer over the same vocabulary.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(partial(count_batches, path=path), "doc_id long, n_bytes long, n_tokens long")
