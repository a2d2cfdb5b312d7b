"""Integer vectors in packed blocks, and searches of groups of queries over shards of blocks.

A shard is a bounded number of blocks that one task can hold. Every query has to meet every shard, so
shards and groups of queries form a grid of cells that Spark deals out: a cell holds one shard and one
group, whatever the numbers of rows and queries.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, partitions

#: Most rows of a shard, and least where more shards are made only to occupy the cluster.
SHARD_ROWS, LEAST_SHARD = 65_536, 1_024
#: Queries that meet a shard in one task.
GROUP = 4_096
LEAST = np.iinfo(np.int64).min


def quantised(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """``(row, vec_id, vec, *more)`` with components floor(256 * x); ``row`` tells equal rows apart.

    Rows without an id, without a vector, or with a component that is null or not finite take no part.
    """
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("vec")
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), whole, *more)


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of a list column as a matrix of longs; shorter rows end in zeros."""
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), np.int64)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def to_bytes(values: np.ndarray) -> tuple[bytes, int]:
    """Integers in the least width that holds them all, and that width."""
    most = max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0)) + 1))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return values.astype(f"<i{width}").tobytes(), width


def from_bytes(data: bytes, width: int, dim: int) -> np.ndarray:
    values = np.frombuffer(data, f"<i{width}").astype(np.int64)
    return values.reshape(-1, dim) if dim else values


def widened(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest number type in which every partial sum of the product a b' is exact.

    Beyond 2^63 sums wrap as 64-bit integers do.
    """
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).sum(1).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` with those of ``b``."""
    kind = _exact(a, b)
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


BLOCK_SCHEMA = "shard int, block int, dim int, width int, vecs binary, ids binary, rows binary, tags binary"


def pack(df: DataFrame, order: Sequence[str | Column], block_rows: int) -> DataFrame:
    """Blocks of rows that follow each other in ``order``; ``df`` has row, vec_id, vec and tag (an int).

    Ranges of the order are shards; equal places in the order may be split by ``row``, so rows that
    are alike, however many, spread over shards.
    """
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, 0

        def cut(tables: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(tables).combine_chunks()
            vecs = matrix(t["vec"].chunk(0))
            data, width = to_bytes(vecs)
            whole = [np.asarray(t[c], np.int64).tobytes() for c in ("vec_id", "row", "tag")]
            part = t["part"][0].as_py()
            return pa.RecordBatch.from_pydict(dict(zip(names, ([part], [block], [vecs.shape[1]], [width], [data], *[[w] for w in whole]), strict=True)), schema)

        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, block_rows - n)
                batch = batch.slice(taken.num_rows)
                held, n = [*held, taken], n + taken.num_rows
                if n == block_rows:
                    yield cut(held, block)
                    held, n, block = [], 0, block + 1
        if n:
            yield cut(held, block)

    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    schema = pa.schema([(c, t) for c, t in zip(names, [pa.int32()] * 4 + [pa.binary()] * 4, strict=True)])
    count = df.count()
    shards = max(1, -(-count // SHARD_ROWS), min(partitions(df.sparkSession), count // LEAST_SHARD))
    dealt = df.repartitionByRange(shards, *order, "row").sortWithinPartitions(*order, "row")
    return materialize(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(blocks, BLOCK_SCHEMA), "blocks")


class Shard:
    """The blocks of one shard: vectors, ids, rows and tags of each."""

    def __init__(self, table: pa.Table):
        rows = sorted(table.select([c.split()[0] for c in BLOCK_SCHEMA.split(", ")]).to_pylist(), key=lambda r: r["block"])
        self.dim = max((r["dim"] for r in rows), default=0)
        self.blocks = [widened(from_bytes(r["vecs"], r["width"], r["dim"]) if r["dim"] else np.zeros((len(r["ids"]) // 8, 0), np.int64), self.dim) for r in rows]
        self.ids, self.rows, self.tags = ([np.frombuffer(r[c], np.int64) for r in rows] for c in ("ids", "rows", "tags"))

    def aligned(self, queries: np.ndarray) -> np.ndarray:
        """``queries`` with as many components as the vectors here, which grow with it if need be."""
        dim = max(self.dim, queries.shape[1])
        if dim > self.dim:
            self.blocks, self.dim = [widened(b, dim) for b in self.blocks], dim
        return widened(queries, dim)


def kept_best(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each key by falling score, then rising id."""
    at = np.lexsort((ids, -score, key))
    first = np.r_[True, key[at][1:] != key[at][:-1]] if len(at) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[np.arange(len(at)) - start < k]


def floors(key: np.ndarray, score: np.ndarray, n: int, k: int, before: np.ndarray) -> np.ndarray:
    """The k-th best score of each of ``n`` keys among rows from ``kept_best``, at least ``before``."""
    out = before.copy()
    counts = np.bincount(key, minlength=n)
    last = np.cumsum(counts) - 1
    full = counts >= k
    out[full] = np.maximum(out[full], score[last[full]])
    return out


def met(index: DataFrame, queries: DataFrame, search: Callable[[Shard, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``search`` for each cell of the grid; ``queries`` has ``shard`` and ``grp``, and a row for each shard it must meet."""
    spark = index.sparkSession
    groups = queries.groupBy("shard", "grp").count().select(F.col("shard").alias("shard"), F.col("grp").alias("grp"))
    n = max(partitions(spark), 1)
    left = index.join(groups, "shard").repartition(n, "shard", "grp").groupBy("shard", "grp")
    right = queries.repartition(n, "shard", "grp").groupBy("shard", "grp")

    def cell(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        return search(Shard(blocks), asked)

    return left.cogroup(right).applyInArrow(cell, schema)


def grouped(queries: DataFrame) -> DataFrame:
    """``queries`` with ``grp``, dealt into groups of about ``GROUP`` by the hash of ``row``."""
    return queries.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-queries.count() // GROUP)))).cast("int"))


def shard_count(index: DataFrame) -> int:
    return (index.agg(F.max("shard")).first()[0] or 0) + 1
