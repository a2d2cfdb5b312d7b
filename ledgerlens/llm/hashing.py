"""Vectorised hashes of bytes, words and runs of tokens.

All of it works on arrays for many texts at once; nothing loops over characters or words.
A hash has 64 bits and depends on content only, so hashes agree between tasks and runs. Where equal
keys decide about text (equal documents, repeated windows) two independent hashes make a key of
128 bits: 1e14 keys collide by chance with probability 1.5e-11.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (a bijection, in place)."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Seeds of two independent hashes; a key made of both has 128 bits.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BYTE_HASHES = tuple(mix(np.arange(1, 257, dtype=U) * U(s)) for s in SEEDS)
BYTE_HASH = BYTE_HASHES[0]
#: Random numbers by place in a word and byte (tabulation hashing), for the first so many bytes of a word.
PLACED = 64
PLACE_BYTE = tuple(np.random.default_rng(s).integers(0, 1 << 64, PLACED * 256, dtype=U) for s in SEEDS)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside ASCII letters and digits, where terms end; bytes of other scripts belong to terms.
IS_PUNCTUATION = np.ones(256, bool)
IS_PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def placed_hash(values: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each whole run ``values[first[i]:first[i+1]]``: a sum of hashes of (place, value), so runs of
    any length cost one pass and no algebraic pattern of values cancels out."""
    count = np.diff(first)
    place = (np.arange(len(values)) - np.repeat(first[:-1], count)).astype(U)
    upto = np.zeros(len(values) + 1, U)
    np.cumsum(mix(values + place * U(SEEDS[seed]) + U(seed + 1)), out=upto[1:])
    return mix(upto[first[1:]] - upto[first[:-1]] + count.astype(U) * U(SEEDS[1 - seed]))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each run of bytes ``start:end`` (in order, without overlap) by tabulation.

    Up to PLACED bytes two given words collide with probability 2^-64 for random tables; of later
    bytes the table's entry is replaced by a mix of place and byte.
    """
    if not len(start):
        return np.zeros(0, U)
    begins = np.zeros(len(data), np.int64)
    begins[start] = start
    place = np.arange(len(data)) - np.maximum.accumulate(begins)
    key = np.minimum(place, PLACED - 1) * 256 + data
    values = PLACE_BYTE[seed][key]
    far = np.flatnonzero(place >= PLACED)
    if len(far):
        values[far] = mix((place[far] * 256 + data[far] + 1).astype(U) * U(SEEDS[seed]) + U(seed))
    upto = np.zeros(len(data) + 1, U)
    np.cumsum(values, out=upto[1:])
    return mix(upto[end] - upto[start] + (end - start).astype(U) * U(SEEDS[seed]))


PAIR = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def pair_hash(left: np.ndarray, right: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of a run from the hashes of its two (possibly overlapping) parts."""
    x = left * U(PAIR[seed])
    x ^= x >> U(32)
    x += right
    x *= U(SEEDS[seed])
    x ^= x >> U(29)
    return x


BASE = 0xD1342543DE82EF95


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept for a worker's life."""

    up = down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16, 2 * len(cls.up))
            cls.up, cls.down = (np.multiply.accumulate(np.append(np.ones(1, U), np.full(size - 1, b, U))) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return cls.up, cls.down


def quick_gram_hash(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` tokens from prefix sums, at a fifth of the cost of ``gram_hash``.

    A polynomial has pairs of texts that collide, so this is for what only rules runs out.
    """
    if len(tokens) < n:
        return np.zeros(0, U)
    up, down = _Powers.of(len(tokens))
    sums = np.zeros(len(tokens) + 1, U)
    np.cumsum(tokens * up[: len(tokens)], out=sums[1:])
    out = sums[n:] - sums[:-n]
    out *= down[: len(out)]
    return mix(out)


def gram_hash(tokens: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` tokens, by doubling; entry i is of tokens[i:i+n]."""
    if len(tokens) < n:
        return np.zeros(0, U)
    h, have = tokens, 1
    while have < n:
        step = min(have, n - have)
        h = pair_hash(h[: len(h) - step], h[step:], seed)
        have += step
    return h


def run_hash(tokens: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of runs ``start:end`` of any lengths, each from its two longest parts of a power of two."""
    out, length = np.zeros(len(start), U), end - start
    h, have = tokens, 1
    while have <= int(length.max(initial=0)):
        own = np.flatnonzero((length >= have) & (length < 2 * have))
        out[own] = pair_hash(h[start[own]], h[end[own] - have], seed)
        h = pair_hash(h[: max(len(h) - have, 0)], h[have:], seed)
        have *= 2
    return mix(out + length.astype(U) * U(SEEDS[seed]))


@dataclass
class Tokens:
    """Tokens of several texts, one after another: text i has tokens first[i]:first[i+1]."""

    values: np.ndarray
    first: np.ndarray
    data: np.ndarray
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    def other(self) -> np.ndarray:
        """A second hash of each token, independent of ``values``."""
        return BYTE_HASHES[1][self.data] if self.start is None else word_hash(self.data, self.start, self.end, 1)


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (or binary values) of an Arrow column and the offset of each; null counts as empty."""
    column = column.fill_null(b"").cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return (LOWER[data] if lower else data), offsets - offsets[0]


def byte_tokens(column: pa.Array) -> Tokens:
    data, offsets = text_bytes(column)
    return Tokens(BYTE_HASH[data], offsets, data)


def word_tokens(column: pa.Array, lower: bool = False, between: np.ndarray = IS_SPACE) -> Tokens:
    """Words: runs of bytes other than space and tab to carriage return, or than those of ``between``."""
    return tokenize(*text_bytes(column, lower), between)


def tokenize(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> Tokens:
    if not len(data):
        return Tokens(np.zeros(0, U), np.zeros(len(offsets), np.int64), data, np.zeros(0, np.int64), np.zeros(0, np.int64))
    word = ~between[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    start = np.flatnonzero(word & (~before | breaks[:-1]))
    end = np.flatnonzero(word & (~after | breaks[1:])) + 1
    return Tokens(word_hash(data, start, end), np.searchsorted(start, offsets), data, start, end)


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 19):
    """Cut a batch into runs of rows with about ``size`` bytes of text, so that arrays stay in cache."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < len(total):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + size, "right")))
        yield batch.slice(at, to - at)
        at = to
