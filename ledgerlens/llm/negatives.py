"""Hard-negative mining by coordinate pruning over buckets of vectors of like length.

A bucket holds rows that follow each other by falling length, with a sorted list of each coordinate of
the unit vectors. For a wanted score t, a query q and the bucket's largest length l the cosine has to
reach t / (|q| l). Then the angle between q and the row, and so between their shares along any one axis,
is bounded: on each focus coordinate only a range of the sorted list is feasible. Rows in all ranges of
the query's focus coordinates are verified by their exact products.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize
from ledgerlens.llm.topk import asked_vectors, without_own
from ledgerlens.llm.vectors import LEAST, Shard, floors, grouped, kept_best, met, pack, products, quantised, shard_count, to_bytes

#: Rows of a bucket; focus coordinates of a query; the share of a bucket below which a query's ranges are intersected.
BUCKET_ROWS, FOCUS, WORTH = 1_024, 5, 0.5
#: Queries scored at once against a bucket that none of their ranges narrows.
CHUNK = 512
#: One shard in so many is searched first; what is found there are floors for the others.
FIRST = 16
#: Keeps rounding in angles from excluding a row.
SLACK = 1e-9

ORACLE = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""


class Bucket:
    """Rows of like length with their coordinate lists."""

    def __init__(self, vectors: np.ndarray):
        lengths = np.linalg.norm(vectors.astype(float), axis=1)
        self.longest = lengths.max(initial=0)
        unit = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0)
        self.sorted = np.take_along_axis(unit, self.order, 0)

    def ranges(self, unit: np.ndarray, focus: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query (row) and focus coordinate, the places of the sorted list that are feasible."""
        at = np.take_along_axis(unit, focus, 1)
        angle, reach = np.arccos(np.clip(at, -1, 1)), np.arccos(np.clip(cosine, -1, 1))[:, None]
        low = np.where(angle + reach >= np.pi, -1.0, np.cos(np.minimum(angle + reach, np.pi))) - SLACK
        high = np.where(angle <= reach, 1.0, np.cos(np.maximum(angle - reach, 0))) + SLACK
        start, stop = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            here = focus == f
            start[here] = np.searchsorted(self.sorted[:, f], low[here], "left")
            stop[here] = np.searchsorted(self.sorted[:, f], high[here], "right")
        return start, stop

    def candidates(self, focus: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Rows in the feasible range of every focus coordinate, from the shortest range on."""
        rows = None
        for f in np.argsort(stop - start):
            part = self.order[start[f] : stop[f], focus[f]]
            rows = part if rows is None else np.intersect1d(rows, part, assume_unique=True)
        return rows


class Wanted:
    """For each query some bands of scores, of which the best ``k`` rows are kept, and whose labels count.

    ``low`` and ``high`` are queries x bands; an unused band has low above high. With ``same`` only rows of
    the query's label count, without it only the others.
    """

    def __init__(self, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.labels, self.low, self.high, self.k, self.same = labels, low.copy(), high, k, same
        self.found = [np.zeros(0, np.int64)] * 3

    def floor(self) -> np.ndarray:
        """The least score that is still of use to each query."""
        return np.where(self.low <= self.high, self.low, np.iinfo(np.int64).max).min(1)

    def take(self, who: np.ndarray, score: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        """Scores of queries ``who`` (rows) with vectors (columns); keeps what is among the best of a band."""
        counts = (labels[None, :] == self.labels[who][:, None]) == self.same
        bands, new = self.low.shape[1], [self.found]
        for band in range(bands):
            low, high = self.low[who, band], self.high[who, band]
            fits = counts & (score >= low[:, None]) & (score <= high[:, None])
            if fits.sum() > 4 * self.k * len(who):
                inside = np.where(fits, score, LEAST)
                if inside.shape[1] > self.k:
                    fits &= score >= np.partition(inside, -self.k, axis=1)[:, -self.k][:, None]
            i, j = np.nonzero(fits)
            new.append([who[i] * bands + band, score[i, j], ids[j]])
        if sum(len(x[0]) for x in new[1:]):
            found = [np.concatenate(x) for x in zip(*new, strict=True)]
            best = kept_best(*found, self.k)
            self.found = [x[best] for x in found]
            self.low = floors(self.found[0], self.found[1], self.low.size, self.k, self.low.ravel()).reshape(self.low.shape)


def search_buckets(shard: Shard, queries: np.ndarray, wanted: Wanted) -> None:
    """Meet all queries with all buckets; ``wanted`` gathers the rows and raises its floors as it does."""
    queries = shard.aligned(queries)
    length = np.linalg.norm(queries.astype(float), axis=1)
    unit = queries / np.maximum(length, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    for vectors, ids, labels in zip(shard.blocks, shard.ids, shard.tags, strict=True):
        bucket = Bucket(vectors)
        most = length * bucket.longest
        floor = wanted.floor().astype(float)
        cosine = np.where(floor > 0, floor / np.maximum(most, 1e-300), -1.0)
        reachable = np.flatnonzero(((floor <= 0) | (cosine <= 1 + SLACK)) & (floor < float(np.iinfo(np.int64).max)))
        start, stop = bucket.ranges(unit[reachable], focus[reachable], cosine[reachable])
        width = (stop - start).min(1) if focus.shape[1] else np.full(len(reachable), len(vectors))
        narrow = width < WORTH * len(vectors)
        for i in np.flatnonzero(narrow & (width > 0)):
            rows = bucket.candidates(focus[reachable[i]], start[i], stop[i])
            if len(rows):
                who = reachable[i : i + 1]
                wanted.take(who, products(queries[who], vectors[rows]), labels[rows], ids[rows])
        wide = reachable[~narrow]
        for at in range(0, len(wide), CHUNK):
            who = wide[at : at + CHUNK]
            wanted.take(who, products(queries[who], vectors), labels, ids)


FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("own", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "row long, query_id long, own long, vec_id long, score long"
TAKEN = pa.schema([("row", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
TAKEN_SQL = "row long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def packed_vectors(df: DataFrame) -> DataFrame:
    """``df`` with ``vec`` as bytes and their ``width``."""

    def packed(batches):
        for batch in batches:
            data = [to_bytes(np.asarray(v, np.int64)) for v in batch["vec"].to_pylist()]
            columns = [pa.array([d for d, _ in data], pa.binary()) if c == "vec" else batch[c] for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([w for _, w in data], pa.int32())], [*batch.schema.names, "width"])

    types = ", ".join(f"{c} {'binary' if c == 'vec' else t}" for c, t in df.dtypes)
    return df.mapInArrow(packed, f"{types}, width int")


def labels_of(index: DataFrame) -> DataFrame:
    """``(shard, label)`` for each label that a shard has."""

    def labels(batches):
        for batch in batches:
            each = [np.unique(np.frombuffer(t, np.int64)) for t in batch["tags"].to_pylist()]
            shard = np.repeat(np.asarray(batch["shard"]), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.concatenate(each), pa.int64())], ["shard", "label"])

    return index.select("shard", "tags").mapInArrow(labels, "shard int, label long").distinct()


def ratio(score: np.ndarray, factor: int, up: bool) -> np.ndarray:
    """``factor`` hundredths of the scores, rounded up or down to whole scores."""
    return -(-score * factor // 100) if up else score * factor // 100


def mine(df: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows that ``anchors`` holds for. An anchor's positives are its first ``positives`` other
    rows of the same ``label``; the negatives of a positive are the first ``negatives`` rows of other labels
    whose score is between ``least`` and ``most`` hundredths of the positive's. Scores are 64-bit inner
    products of components floor(256 * x), higher first, ties by smaller id; a vector shorter than another
    counts as ending in zeros.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Rows that
    repeat an id stand for themselves: an anchor leaves out its own row only. Fewer rows give all, an
    anchor without positives or a positive without negatives in its band gives none, an empty table none;
    other columns aren't read. A label with any share of the rows spreads over shards.

    Negatives are sought in one shard of ``FIRST`` before the others: the last of the first ``negatives`` found there
    bounds from below what the others have to send, so that doesn't grow with their number times ``negatives``.
    """
    tag = label.cast("long").alias("tag")
    rows = quantised(df.where(label.isNotNull()), id_col, vec_col, tag, F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = materialize(rows, "vectors")
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    index = pack(rows.withColumn("falling", -length), ["tag", "falling"], BUCKET_ROWS)
    own = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x)
    asked = materialize(grouped(packed_vectors(rows.where("is_anchor").select("row", F.col("vec_id").alias("query_id"), F.col("tag").alias("label"), own.alias("own"), "vec"))), "anchors")

    def near(shard: Shard, table: pa.Table) -> pa.Table:
        n, top = table.num_rows, np.iinfo(np.int64).max
        wanted = Wanted(np.asarray(table["label"]), np.full((n, 1), LEAST), np.full((n, 1), top), positives + 1, True)
        search_buckets(shard, asked_vectors(table), wanted)
        key, score, ids = wanted.found
        return pa.table([*[table[c].take(pa.array(key)) for c in ("row", "query_id", "own")], pa.array(ids), pa.array(score)], schema=FOUND)

    there = labels_of(index)
    found = without_own(met(index, asked.join(there, "label"), near, FOUND_SQL), positives)
    places = F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("positives")  # no more than asked for
    pairs = materialize(found.groupBy("row").agg(places).join(asked, "row"), "positives")

    def far(shard: Shard, table: pa.Table) -> pa.Table:
        each = table["positives"].to_pylist()
        score = np.array([[p["score"] for p in x] + [0] * (positives - len(x)) for x in each], np.int64)
        used = np.array([[True] * len(x) + [False] * (positives - len(x)) for x in each])
        low, high = np.where(used, ratio(score, least, True), 1), np.where(used, ratio(score, most, False), 0)
        for i, known in enumerate(table["floors"].to_pylist()):
            for place, floor in known or ():
                low[i, place] = max(low[i, place], floor)
        wanted = Wanted(np.asarray(table["label"]), low, high, negatives, False)
        search_buckets(shard, asked_vectors(table), wanted)
        key, value, ids = wanted.found
        who, place = key // positives, key % positives
        took = [each[i][j] for i, j in zip(who, place, strict=True)]
        out = [*[table[c].take(pa.array(who)) for c in ("row", "query_id")], pa.array(place, pa.int32())]
        return pa.table([*out, pa.array([p["id"] for p in took], pa.int64()), pa.array([p["score"] for p in took], pa.int64()), pa.array(ids), pa.array(value)], schema=TAKEN)

    def best(taken: DataFrame) -> DataFrame:
        order = W.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
        return taken.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)

    everywhere, first = F.explode(F.sequence(F.lit(0), F.lit(shard_count(index) - 1))).alias("shard"), F.col("shard") % FIRST == 0
    none = F.lit(None).cast("map<int, long>")
    soon = materialize(best(met(index, pairs.withColumn("floors", none).select("*", everywhere).where(first), far, TAKEN_SQL)), "first")
    floors = soon.where(F.col("rank") == negatives).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", "negative_score"))).alias("floors"))  # one a positive
    late = met(index, pairs.join(floors, "row", "left").select("*", everywhere).where(~first), far, TAKEN_SQL)
    return best(soon.drop("rank").unionByName(late)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
