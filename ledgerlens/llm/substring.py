"""Substring deduplication by words: level-wise doubling."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bucketed, materialize, partitions
from ledgerlens.llm.hashing import word_tokens
from ledgerlens.llm.repeats import covered, per_document, ranges_mask, repeated, slices


def text_copy(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, doc_id, text)`` in the shared folder, bucketed by row: every level joins it in place.

    Rows are numbered as they are written, so rows that repeat a doc_id stay apart.
    """
    spark = docs.sparkSession
    both = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return bucketed(both, "row", "texts", partitions(spark))


def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of repeated windows."""
    for batch in batches:
        for part in slices(batch, "text"):
            tokens = word_tokens(part.column("text"))
            first, n = tokens.first, len(tokens.values)
            gone = ranges_mask(part, ("done_lo", "done_hi"), first)
            stays = ~gone if gone is not None and n else np.ones(n, bool)
            raw = tokens.data.tobytes()
            sums = np.concatenate(([0], np.cumsum(~stays)))
            removed = sums[first[1:]] - sums[first[:-1]]
            texts = []
            for i in range(len(part)):
                keep = np.flatnonzero(stays[first[i] : first[i + 1]]) + first[i]
                texts.append(b" ".join([raw[a:b] for a, b in zip(tokens.start[keep].tolist(), tokens.end[keep].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "n_words": np.diff(first), "n_removed": removed.astype(np.int64), "kept_text": texts}
            )


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a run of ``window`` words that also starts anywhere else.

    Level-wise doubling: runs of a quarter of the window are counted, those that repeat are
    extended to half, those that still repeat to the whole window; a level that leaves no
    candidate ends it. At the shorter lengths a window is judged by one run in it, which its
    content chooses, so that neighbouring windows share a count; at the last all are counted. Returns ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one
    space). Words are runs without space and tab to carriage return and are compared unchanged;
    windows never cross documents and are judged on the input. Null and empty texts have no words;
    texts shorter than a window keep all; rows that are equal or repeat a doc_id are documents of their
    own; an empty table gives no rows; further columns are ignored.
    """
    texts = text_copy(docs, id_col, text_col)
    candidates = None
    for size in sorted({max(1, -(-window // 4)), max(1, -(-window // 2)), window}):
        at_level = texts if candidates is None else texts.join(candidates.hint("shuffle_hash"), "row")
        last = "done" if size == window else "cand"
        candidates = materialize(per_document(widened(repeated(at_level, "word", window, size), size, window), last), "repeats")
        if candidates.isEmpty():
            break
    if "done_lo" not in candidates.columns:
        candidates = candidates.select("row", F.col("cand_lo").alias("done_lo"), F.col("cand_hi").alias("done_hi"))
    out = "doc_id long, n_words long, n_removed long, kept_text string"
    return texts.join(candidates.hint("shuffle_hash"), "row", "left").mapInArrow(kept_words, out)


def widened(ranges: DataFrame, size: int, window: int) -> DataFrame:
    """At the last level ranges of window starts become ranges of words."""
    return ranges.withColumn("hi", F.expr(f"hi + {window - 1}")) if size == window else ranges


def digest_of(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws[i : i + 34], ' ')) AS n FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM g WHERE n > 1)
SELECT w.doc_id, count(word) AS n_words, count(gone.j) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY t.j) FILTER (gone.j IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id) LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.j = t.j GROUP BY w.doc_id
"""
