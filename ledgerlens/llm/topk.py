"""Exact top-k search by inner product, block at a time.

The coordinates are the terms, a block is a range of documents, and its summary the largest and least
value of each coordinate in it. A query's largest possible score in a block is the sum, over its
coordinates, of their product with the one of the two that its sign favours.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, partitions
from ledgerlens.llm.vectors import LEAST, Shard, floors, from_bytes, grouped, kept_best, met, pack, products, quantised, shard_count, to_bytes, widened

#: Rows on which the order of documents is fitted, its centres, and the directions that divide them further.
FIT_ROWS, CENTRES, DIRECTIONS = 4_096, 64, 16
BLOCK_ROWS = 256

ORACLE = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""


class Order:
    """Places vectors by their nearest centre and, within it, by the side of the main directions they lie on.

    Only the tightness of the blocks' summaries depends on the fit; any order gives the same result.
    """

    def __init__(self, sample: np.ndarray):
        self.dim = sample.shape[1]
        x = self._unit(sample)
        centres = x[:: max(1, len(x) // CENTRES)][:CENTRES].copy()
        for _ in range(8):
            near = (x @ centres.T).argmax(1)
            for c in np.unique(near):
                centres[c] = x[near == c].mean(0)
            centres = self._unit(centres)
        rest = x - centres[(x @ centres.T).argmax(1)]
        self.axes = np.linalg.svd(rest, full_matrices=False)[2][:DIRECTIONS]
        self.centres = centres[np.argsort(centres @ self.axes[0])]

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        x = self._unit(widened(vectors, self.dim)[:, : self.dim] if vectors.shape[1] <= self.dim else vectors[:, : self.dim])
        near = (x @ self.centres.T).argmax(1)
        sides = ((x - self.centres[near]) @ self.axes.T > 0) @ (1 << np.arange(len(self.axes))[::-1])
        return (near.astype(np.int64) << len(self.axes)) + sides


def stacked(vectors: list) -> np.ndarray:
    dim = max(map(len, vectors), default=0)
    return np.stack([np.pad(np.asarray(v, np.int64), (0, dim - len(v))) for v in vectors]) if len(vectors) else np.zeros((0, 0), np.int64)


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, from an order fitted on the ``FIT_ROWS`` rows with the least hash of their id."""
    sample = rows.select("vec", F.xxhash64("vec_id").alias("h"), "row").orderBy("h", "row").limit(FIT_ROWS).collect()
    vectors = stacked([r["vec"] for r in sample])
    if not vectors.size or not np.any(vectors):
        return rows.withColumn("place", F.lit(0).cast("long"))
    order = Order(vectors)

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(order.places(stacked(list(v))))

    return rows.withColumn("place", place("vec"))


def best_in_blocks(shard: Shard, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, score, id)`` of the best ``k`` of each query in the shard with scores of at least ``floor``.

    Each query takes the blocks by falling bound and stops at the first below its k-th best score: all
    others have lower bounds. A bound that equals that score is no reason to stop, as ids break ties.
    """
    queries = shard.aligned(queries)
    n, floor = len(queries), floor.copy()
    hi, lo = (np.stack([f(b, axis=0) for b in shard.blocks]) for f in (np.max, np.min))
    bound = products(np.maximum(queries, 0), hi) + products(np.minimum(queries, 0), lo)
    order = np.argsort(-bound, axis=1, kind="stable")
    live = np.arange(n)
    found = [np.zeros(0, np.int64)] * 3
    for turn in range(len(shard.blocks)):
        at = order[live, turn]
        still = bound[live, at] >= floor[live]
        live, at = live[still], at[still]
        if not len(live):
            break
        new = [found]
        for b in np.unique(at):
            who = live[at == b]
            score = products(queries[who], shard.blocks[b])
            least = floor[who]
            if score.shape[1] > k:
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
            i, j = np.nonzero(score >= least[:, None])
            new.append([who[i], score[i, j], shard.ids[b][j]])
        found = [np.concatenate(x) for x in zip(*new, strict=True)]
        best = kept_best(*found, k)
        found = [x[best] for x in found]
        floor = floors(found[0], found[1], n, k, floor)
    return found[0], found[1], found[2]


QUERY = "row long, query_id long, own long, dim int, width int, vec binary, home int, floor long"
FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("own", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "row long, query_id long, own long, vec_id long, score long"


def _home(table: pa.Table, k: int) -> pa.Table:
    """The queries of a shard, with what they find in it."""
    shard = Shard(table)
    tags, rows, ids, vecs = np.concatenate(shard.tags), np.concatenate(shard.rows), np.concatenate(shard.ids), np.concatenate(shard.blocks)
    asked = np.flatnonzero(tags)
    out = {c.split()[0]: [] for c in f"{QUERY}, ids array, scores array".split(", ")}
    if len(asked):
        key, score, found = best_in_blocks(shard, vecs[asked], k, np.full(len(asked), LEAST))
        ends = np.searchsorted(key, np.arange(len(asked) + 1))
        for i, a in enumerate(asked):
            data, width = to_bytes(vecs[a])
            mine = score[ends[i] : ends[i + 1]]
            values = (rows[a], ids[a], int(vecs[a] @ vecs[a]), len(vecs[a]), width, data, table["shard"][0].as_py(), mine[-1] if len(mine) == k else LEAST, found[ends[i] : ends[i + 1]].tolist(), mine.tolist())
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table(out, pa.schema(list(zip(out, kinds, strict=True))))


def asked_vectors(asked: pa.Table) -> np.ndarray:
    rows = [from_bytes(v, w, 0) for v, w in zip(asked["vec"].to_pylist(), asked["width"].to_pylist(), strict=True)]
    return stacked(rows)


def top_k(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the largest integer inner product for each query.

    ``queries`` says which rows of ``df`` are queries; candidates are all rows but the query's own.
    Components become floor(256 * x); a vector shorter than another counts as ending in zeros. Scores
    are 64-bit. Ties go to the smaller id. Rows with a null id, a null vector or a component that is null
    or not finite take no part; rows that repeat an id stand for themselves, and a query leaves out its
    own row only. Fewer rows than ``k`` give all, an empty table none; other columns aren't read.

    Rows are put in an order in which like vectors are neighbours and cut into blocks with their summaries.
    A query is first searched in the shard it lies in, where its like are, which gives a floor for its k-th
    score; then in all other shards, where blocks whose bound is below the floor aren't scored.
    """
    rows = materialize(quantised(df, id_col, vec_col, queries.cast("int").alias("tag")), "vectors")
    rows = rows.withColumn("tag", F.coalesce("tag", F.lit(0)))
    index = pack(placed(rows), ["place", "vec_id"], BLOCK_ROWS)
    n = partitions(df.sparkSession)
    home = index.repartition(n, "shard").groupBy("shard").applyInArrow(lambda t: _home(t, k + 1), f"{QUERY}, ids array<long>, scores array<long>")
    asked = materialize(home, "queries")
    there = F.explode(F.sequence(F.lit(0), F.lit(shard_count(index) - 1))).alias("shard")
    others = grouped(asked.drop("ids", "scores")).select("*", there).where("shard <> home")

    def search(shard: Shard, table: pa.Table) -> pa.Table:
        key, score, ids = best_in_blocks(shard, asked_vectors(table), k + 1, np.asarray(table["floor"]))
        return pa.table([*[table[c].take(pa.array(key)) for c in ("row", "query_id", "own")], pa.array(ids), pa.array(score)], schema=FOUND)

    near = asked.select("row", "query_id", "own", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("x")).select("row", "query_id", "own", "x.vec_id", "x.score")
    return without_own(near.unionByName(met(index, others, search, FOUND_SQL)), k).select("query_id", "rank", "vec_id", "score")


def without_own(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query's rows, of which the first ``k + 1`` are given, but for its own row."""
    first = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("r", F.row_number().over(first)).where(f"r <= {k + 1}")
    is_own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    ranked = ranked.withColumn("own_at", F.min(F.when(is_own, F.col("r"))).over(W.partitionBy("row")))
    place = F.col("r") - F.when(F.col("r") > F.col("own_at"), 1).otherwise(0)
    return ranked.where("own_at IS NULL OR r <> own_at").withColumn("rank", place.cast("int")).where(f"rank <= {k}")
