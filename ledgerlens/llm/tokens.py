"""Token ids of texts by a public word-level BPE tokenizer, each distinct word encoded once a worker."""

import itertools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlens.llm.hashing import Tokens, slices, word_tokens

#: Stands for the end of a word in byte ranks; no UTF-8 text has it.
END_OF_WORD = b"\xff"
#: Words that a worker remembers before it starts anew.
REMEMBERED = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class WordEncoder:
    """Ids of white-space-separated words, as one flat array with offsets.

    The tokenizer drops white space before it splits, so the ids of a text are those of its words
    one after another. A word is known by its bytes with A-Z lower-cased. A word of letters alone,
    possibly with one full stop or comma after it, is merged by a faster library from the same ranks;
    all others go through the tokenizer, and so does the whole of a text that has the string of a
    special token, as those are found before anything else. The tests compare both.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a lower-cased word isn't the special token it may look like
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters, self.special = byte_letters(), [t["content"] for t in content["added_tokens"]]
        ranks = {self._bytes(t, letters): i for t, i in content["model"]["vocab"].items() if t not in self.special}
        ranks[END_OF_WORD] = max(ranks.values()) + 2
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.tail = {c: self._ids([c])[0] for c in ".,"}
        self.reset()

    @staticmethod
    def _bytes(token: str, letters: dict[str, int]) -> bytes:
        ends = token.endswith("</w>")
        return bytes(letters[c] for c in (token[:-4] if ends else token)) + END_OF_WORD * ends

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.starts, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (A-Z already lower-cased)."""
        out: list[list[int]] = [[]] * len(words)
        rest = []
        for i, word in enumerate(words):
            core, tail = (word[:-1], self.tail[word[-1]]) if word[-1] in self.tail else (word, [])
            if core.isascii() and core.isalpha():
                out[i] = self.merge(core.encode() + END_OF_WORD) + tail
            elif core.isalpha() and core == core.lower() and unicodedata.is_normalized("NFC", core):
                out[i] = self.merge(core.encode() + END_OF_WORD) + tail
            else:
                rest.append(i)
        for i, ids in zip(rest, self._ids([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def ids_of(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words of a batch, and the number of ids of each word."""
        coded = word_array(tokens).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.number) > REMEMBERED:
            self.reset()
        new = [w for w in words if w not in self.number]
        if new:
            ids = self.encode([w.decode() for w in new])
            self.number.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
            self.count = np.concatenate((self.count, np.fromiter(map(len, ids), np.int64, len(ids))))
            self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)))
            self.starts = np.cumsum(self.count) - self.count
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        count = self.count[number]
        return ragged(self.flat, self.starts[number], count), count

    def special_ids(self, column: pa.Array) -> dict[int, np.ndarray]:
        """Ids of the texts that have the string of a special token, by row."""
        has = np.zeros(len(column), bool)
        for token in self.special:
            has |= pc.match_substring(column, token).fill_null(False).to_numpy(zero_copy_only=False)
        return {i: np.array(self.whole.encode(column[i].as_py(), add_special_tokens=False).ids, "<u4") for i in np.flatnonzero(has).tolist()}


def word_array(tokens: Tokens) -> pa.Array:
    """The words as an Arrow array, made from the bytes between white space at once."""
    inside = np.zeros(len(tokens.data) + 1, np.int8)
    inside[tokens.start] += 1
    np.subtract.at(inside, tokens.end, 1)
    letters = tokens.data[np.cumsum(inside[:-1]).astype(bool)]
    offsets = np.concatenate(([0], np.cumsum(tokens.end - tokens.start))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(tokens.start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])


_encoders: dict[str, WordEncoder] = {}


def ragged(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs ``start:start+count`` of ``flat``, one after another."""
    total = np.cumsum(count)
    at = np.arange(int(total[-1]) if len(total) else 0)
    return flat[at + np.repeat(start - (total - count), count)]


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:  # kept between tasks of a worker, with the words it remembers
        _encoders[path] = WordEncoder(path)
    encoder = _encoders[path]
    for batch in batches:
        for part in slices(batch, "text", 1 << 21):
            tokens = word_tokens(part.column("text"), lower=True)
            ids, count = encoder.ids_of(tokens) if len(tokens.values) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            ids = ids.astype("<u4")
            upto = np.concatenate(([0], np.cumsum(count)))[tokens.first]
            special = encoder.special_ids(part.column("text"))
            rows: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
            for i, (doc, a, b) in enumerate(zip(part.column("doc_id").to_pylist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
                own = np.append(special.get(i, ids[a:b]), np.uint32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    piece = own[at : at + capacity]
                    for name, value in zip(rows, (doc, k, at, len(piece), piece.tobytes()), strict=True):
                        rows[name].append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(rows.items(), types, strict=True)})
