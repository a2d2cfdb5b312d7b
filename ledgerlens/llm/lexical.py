"""Ranked lexical search with geometric blocks of each posting list.

Documents are dealt over shards. In a shard each term has its list of documents, cut into blocks of like
documents with the largest value that any of a block's documents has in each coordinate. A query's score
of a document is at most its score of the summary of the block that holds it, so a block is left out only
where that bound is below the query's k-th best score.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, partitions

#: Maximal runs without ASCII characters other than letters and digits. Bytes of other characters are above 0x7F.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Slots of the filter that lets the queries' terms through; what else passes is sorted out by a join.
SLOTS = 1 << 20
#: Postings of a shard, and least documents where more shards are made only to occupy the cluster.
SHARD_POSTINGS, LEAST_SHARD = 500_000, 256
#: Terms of a group of queries, counted by query; values of a shard held at once; one shard in so many is searched first.
GROUP_TERMS, CELLS, FIRST = 8_192, 12_000_000, 16
#: Documents of a block on average, and numbers of the sketch by which they are compared.
BLOCK, SKETCH = 48, 16
#: Terms that a worker remembers to have or not to have passed.
REMEMBERED = 1 << 20
WANT = ("query", "item_id", "terms", "gains", "floor")


def counted(df: DataFrame, id_col: str, text_col: str, slots: np.ndarray | None = None) -> DataFrame:
    """``(row, id, n, terms, tfs)``: all terms of the whole text counted; with ``slots`` only those whose slot is set are listed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes: dict[bytes, bool] = {}

        def known(term: bytes) -> bool:
            if len(passes) > REMEMBERED:
                passes.clear()
            return passes.setdefault(term, bool(slots[xxhash.xxh64_intdigest(term, seed=42) % SLOTS]))

        for batch in batches:
            n, sizes, terms, tfs = [], [0], [], []
            for text in batch["text"]:
                found = TERM.findall(text.as_buffer().to_pybytes().lower()) if text.is_valid else []
                counts = Counter(found)
                listed = counts.items() if slots is None else [x for x in counts.items() if passes.get(x[0]) or x[0] not in passes and known(x[0])]
                n.append(len(found))
                terms += [t for t, _ in listed]
                tfs += [c for _, c in listed]
                sizes.append(len(terms))
            at = pa.array(sizes, pa.int32())
            strings = pa.array(terms, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, strings), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], ["row", "id", "n", "terms", "tfs"])

    read = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(count, "row long, id long, n long, terms array<string>, tfs array<long>")


def slots_of(terms: DataFrame) -> np.ndarray:
    """Which of the ``SLOTS`` slots a ``term`` falls into; as many rows at most come to the driver."""
    out = np.zeros(SLOTS, bool)
    out[[r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(SLOTS))).distinct().collect()]] = True
    return out


class Postings:
    """Some documents of a shard over the terms of a group of queries.

    ``values`` is documents x terms, ``ids`` the documents', and ``weight`` gives terms their share in likeness.
    """

    def __init__(self, values: np.ndarray, ids: np.ndarray, weight: np.ndarray):
        self.values, self.ids, self.most = values, ids, values.max(0, initial=0).astype(np.int64)
        signs = np.random.default_rng(1).choice([-1.0, 1.0], (values.shape[1], SKETCH)).astype(np.float32)
        sketch = values.astype(np.float32) @ (signs * weight[:, None].astype(np.float32))
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The term's documents, block by block; where each block starts; the blocks' summaries."""
        docs = np.flatnonzero(self.values[:, term])
        here = self.sketch[docs]
        near = (here @ here[:: BLOCK].T).argmax(1)
        order = np.argsort(near, kind="stable")
        docs, near = docs[order], near[order]
        starts = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
        return docs, starts, np.maximum.reduceat(self.values[docs], starts, axis=0)


class Query:
    """A query's terms (columns of the postings) with the gain of each, and the best it has found."""

    def __init__(self, terms: np.ndarray, gains: np.ndarray, floor: int, k: int):
        self.terms, self.gains, self.k = terms, gains, k
        self.floor = max(1, floor)
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def start(self, postings: Postings, place: np.ndarray) -> None:
        """Order the terms by ``place``; bound what a document with none of the first ones can reach."""
        order = np.argsort(place[self.terms])
        self.terms, self.gains = self.terms[order], self.gains[order]
        left = np.cumsum((self.gains * postings.most[self.terms])[::-1])[::-1]
        self.left = dict(zip(self.terms.tolist(), left.tolist(), strict=True))
        self.seen = np.zeros(len(postings.ids), bool)

    def visit(self, postings: Postings, docs: np.ndarray, starts: np.ndarray, summaries: np.ndarray) -> None:
        """Score the blocks by falling bound until it is below the floor."""
        bounds = summaries[:, self.terms].astype(np.int64) @ self.gains
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] >= self.floor]
        ends = np.r_[starts[1:], len(docs)]
        at, step = 0, 1
        while at < len(order) and bounds[order[at]] >= self.floor:
            some = order[at : at + step]
            at, step = at + step, 2 * step
            rows = np.concatenate([docs[starts[b] : ends[b]] for b in some])
            rows = rows[~self.seen[rows]]
            self.seen[rows] = True
            score = postings.values[rows[:, None], self.terms].astype(np.int64) @ self.gains
            good = score >= self.floor
            self.keep(score[good], postings.ids[rows[good]])

    def keep(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score):
            score, ids = np.r_[self.score, score], np.r_[self.ids, ids]
            best = np.lexsort((ids, -score))[: self.k]
            self.score, self.ids = score[best], ids[best]
            if len(best) == self.k:
                self.floor = max(self.floor, int(self.score[-1]))


def search_postings(postings: Postings, queries: list[Query], weight: np.ndarray) -> None:
    """Take the terms by falling weight, each list once for all queries that still need it.

    A query is done with the lists as soon as the terms left can't add up to its floor.
    """
    order = np.argsort(-weight * postings.most, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    users: dict[int, list[Query]] = {}
    for q in queries:
        q.start(postings, place)
        for t in q.terms.tolist():
            users.setdefault(t, []).append(q)
    for t in order.tolist():
        needed = [q for q in users.get(t, ()) if postings.most[t] and q.left[t] >= q.floor]
        if needed:
            blocks = postings.blocks(t)
            for q in needed:
                q.visit(postings, *blocks)


def search_cell(docs: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best ``k`` documents of a shard for each query of a group."""
    terms, gains = asked["terms"].combine_chunks(), asked["gains"].combine_chunks()
    vocabulary = pc.unique(terms.flatten())
    columns, ends = np.asarray(pc.index_in(terms.flatten(), vocabulary)), np.asarray(terms.offsets)
    values = np.asarray(gains.flatten())
    queries = [Query(columns[a:b], values[a:b], f, k) for a, b, f in zip(ends[:-1], ends[1:], asked["floor"].to_pylist(), strict=True)]
    weight = np.zeros(len(vocabulary), np.int64)
    np.maximum.at(weight, columns, values)
    each = max(1, CELLS // max(1, len(vocabulary)))
    for at in range(0, docs.num_rows, each):
        part = docs.slice(at, each).combine_chunks()
        listed = part["terms"].chunk(0)
        found = pc.index_in(listed.flatten(), vocabulary)
        doc = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(listed.offsets)))
        is_in = np.asarray(found.is_valid())
        doc, term = doc[is_in], np.asarray(found.drop_null())
        tf, m = np.asarray(part["tfs"].chunk(0).flatten())[is_in], np.asarray(part["m"])[doc]
        dense = np.zeros((part.num_rows, len(vocabulary)), np.int32)
        dense[doc, term] = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        search_postings(Postings(dense, np.asarray(part["id"]), weight), queries, weight)
    n = [len(q.ids) for q in queries]
    row = pa.array(np.repeat(np.arange(len(queries)), n))
    got = [np.concatenate([getattr(q, c) for q in queries]) for c in ("ids", "score")]
    return pa.table([asked["query"].take(row), asked["item_id"].take(row), *map(pa.array, got)], ["query", "item_id", "doc_id", "score"])


def _met(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Search each shard with each group of queries that has a row for it."""
    n = partitions(shards.sparkSession)
    cells = queries.groupBy("shard", "grp").count().select(F.col("shard").alias("shard"), F.col("grp").alias("grp"))
    left = shards.join(cells, "shard").repartition(n, "shard", "grp").groupBy("shard", "grp")
    right = queries.repartition(n, "shard", "grp").groupBy("shard", "grp")
    found = left.cogroup(right).applyInArrow(lambda d, q: search_cell(d, q, k), "query long, item_id long, doc_id long, score long")
    first = W.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents with the highest score above 0 for each item.

    Terms, weights and scores are integers as in the contract of op12; equal scores by ascending id.
    Null and termless texts match nothing and don't count as documents. Documents without an id count
    in all statistics but aren't returned. Rows that repeat an id are documents, or items, of their own;
    items without an id are searched and returned with a null. Fewer documents than ``k`` give all;
    empty tables give no rows; other columns aren't read. Whole texts are counted, and only terms that
    some item has are kept as postings.
    """
    spark = docs.sparkSession
    asked = materialize(counted(items, item_col, item_text), "items")
    wanted = asked.select("row", F.col("id").alias("item_id"), F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("row", "item_id", F.col("x.terms").alias("term"), F.col("x.tfs").alias("times"))
    forward = materialize(counted(docs, id_col, text_col, slots_of(wanted)).where("n > 0"), "forward")
    held = F.size("terms") > 0
    total, length, postings, rows = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count_if(held)).first()
    df = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(float(total)) + 2) / (2 * F.col("df").cast("double") + 1)))
    gains = wanted.join(df, "term").withColumn("gain", F.col("times") * weight).where("gain > 0")
    queries = gains.groupBy(F.col("row").alias("query"), "item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("gain").alias("gains"))
    queries = materialize(queries, "queries")
    each = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    queries = queries.withColumn("grp", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-each // GROUP_TERMS)))).cast("int"))

    shards = max(1, -(-postings // SHARD_POSTINGS), min(partitions(spark), rows // LEAST_SHARD))
    m = 25 + F.expr(f"(75 * n * {total}L) div {max(1, length)}L")
    placed = forward.where(held & F.col("id").isNotNull()).select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "id", m.alias("m"), "terms", "tfs")
    first = F.col("shard") % FIRST == 0
    there = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    soon = materialize(_met(placed.where(first), queries.withColumn("floor", F.lit(0).cast("long")).select("*", there).where(first), k), "first")
    floors = soon.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    late = queries.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0)).cast("long")).select("*", there).where(~first)
    found = soon.unionByName(_met(placed.where(~first), late, k)).drop("rank")
    best = W.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'))"
ORACLE = f"""WITH d AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL
), i AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL
), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs::DOUBLE + 2) / (2 * count(*)::DOUBLE + 1))) AS BIGINT) AS w FROM d, a GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN d USING (term) JOIN n USING (doc_id), a GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""
