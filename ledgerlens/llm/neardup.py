"""Near-duplicate detection: MinHash, banding, verification, connected components."""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import settled_step
from ledgerlens.llm.components import components
from ledgerlens.llm.hashing import U, Tokens, gram_hash, mix, pair_hash, placed_hash, run_hash, slices, word_tokens

#: Minima and bands of four of them: a pair at similarity 0.75 meets in no band with probability 5e-6.
MINIMA, BANDS = 128, 32
_random = np.random.default_rng(20240607)
MULTIPLY = _random.integers(0, 1 << 63, MINIMA, dtype=U) * U(2) + U(1)
ADD = _random.integers(0, 1 << 63, MINIMA, dtype=U)
#: Turns in which members of a bucket are compared with one document of it, before the rest is settled exactly.
TURNS = 2


def shingle_sets(tokens: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted within each text, and the position of each text's first."""
    first, n = tokens.first, len(tokens.values)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    if n >= width:
        grams = gram_hash(tokens.values, width)
        inside = np.flatnonzero(np.arange(len(grams)) + width <= first[1:][doc[: len(grams)]])
        values, owner = grams[inside], doc[inside]
    else:
        values, owner = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        values = np.concatenate((values, run_hash(tokens.values, first[short], first[short + 1])))
        owner = np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def minima(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of minima for each text that has shingles."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), MINIMA), U)
    if len(starts):
        for i in range(MINIMA):
            out[:, i] = np.minimum.reduceat(values * MULTIPLY[i] + ADD[i], starts)
    return out


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            tokens = word_tokens(part.column("text"), lower=True)
            values, first = shingle_sets(tokens, width)
            least = minima(values, first)
            rows = MINIMA // BANDS
            bands = np.repeat(mix(np.arange(1, BANDS + 1, dtype=U))[None, :], len(least), 0)
            for i in range(rows):
                bands = pair_hash(bands, least[:, i::rows])
            whole = placed_hash(tokens.values, tokens.first)
            other = placed_hash(tokens.other(), tokens.first, 1)
            has = np.concatenate(([0], np.cumsum(np.diff(first) > 0)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_shingles": np.diff(first),
                    "h1": whole.view(np.int64),
                    "h2": other.view(np.int64),
                    "bands": list_array(bands.reshape(-1).view(np.int64), has * BANDS, pa.int64()),
                }
            )


def full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            values, first = shingle_sets(word_tokens(part.column("text"), lower=True), width)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "shingles": list_array(values.view(np.int64), first, pa.int64())})


def verified(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough; sizes are compared first."""
    left = known.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("shingles").alias("sa"))
    right = known.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("shingles").alias("sb"))
    alike = pairs.join(left.drop("sa"), "a").join(right.drop("sb"), "b")
    alike = alike.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    both = alike.join(left.select("a", "sa"), "a").join(right.select("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("common", common).where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named (doc_id, component, central)`` after ``links (a, b)``, which join components, not documents."""
    ends = links.join(named.select(F.col("doc_id").alias("a"), F.col("component").alias("u")).hint("merge"), "a")
    ends = ends.join(named.select(F.col("doc_id").alias("b"), F.col("component").alias("v")).hint("merge"), "b").select("u", "v")
    moved = components(ends).select(F.col("node").alias("component"), F.col("component").alias("to"))
    out = named.join(moved.hint("merge"), "component", "left").select("doc_id", F.coalesce("to", "component").alias("component"), "central")
    return settled_step(out, "components")


def open_buckets(bucket: DataFrame, named: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with the bucket's largest component
    (``main``) and the most central of the documents outside it (``leader``)."""
    rows = bucket.join(named.hint("merge"), "doc_id")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.max(F.struct("central", "doc_id")).alias("best"))
    main = F.max(F.struct("n", "best")).alias("m")
    several = sizes.groupBy("key").agg(F.count("*").alias("several"), main).where("several > 1")
    others = sizes.join(several.select("key", "m").hint("merge"), "key").where("best <> m.best")
    leader = others.groupBy("key").agg(F.max("best.doc_id").alias("any"), F.max("best").alias("best"), F.first("m.best.doc_id").alias("main_doc"), F.max("m.n").alias("n"))
    # while all are alone, the most central of all leads
    lead = leader.select("key", F.when(F.col("n") == 1, F.col("main_doc")).otherwise(F.col("best.doc_id")).alias("leader"))
    return rows.join(lead.hint("merge"), "key")


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """``(key, doc_id, size, rest)`` by prefix filtering: with the shingles of all sets in one order, any
    pair at ``percent`` or more shares one of the first n - ceil(percent * n / 100) + 1 of either.

    Rare shingles come first, so documents that have little but a frequent passage in common don't
    meet. Shingles of one document alone come before all others and aren't returned; ``rest`` is the
    number of shingles from this one on.
    """
    rows = settled_step(sets.select("doc_id", F.explode("shingles").alias("key")), "shingle-rows")
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(often, "key")
    alone = sets.select("doc_id", F.size("shingles").alias("size"))
    own = shared.groupBy("doc_id").agg(F.count("*").cast("int").alias("shared"), F.array_sort(F.collect_list(F.struct("n", "key"))).alias("s"))
    first = F.expr(f"size - int(ceil({percent} * size / 100)) + 1 - (size - shared)")
    kept = own.join(alone, "doc_id").withColumn("take", first).where("take > 0")
    prefix = kept.select("doc_id", "size", "shared", F.posexplode(F.expr("slice(s.key, 1, take)")).alias("at", "key"))
    return prefix.select("doc_id", "size", "key", (F.col("shared") - F.col("at")).alias("rest"))


def across(rare: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components that share a rare shingle and may be similar enough.

    From the first shingle that two sets share, neither has more in common with the other than what
    it has from there on. That bound is applied to a member and the bucket's least size first, so
    members that can link with nothing there aren't paired at all; then to each pair.
    """
    rows = settled_step(rare.join(named.select("doc_id", "component"), "doc_id"), "rare-members")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("size").alias("least_size"), F.max("rest").alias("most"))
    main = F.max(F.struct("n", "component")).alias("m")
    least = sizes.groupBy("key").agg(F.count("*").alias("several"), main, F.min("least_size").alias("least_size"), F.max("most").alias("most")).where("several > 1")
    near = rows.join(least.select("key", F.col("m.component").alias("main"), "least_size", "most"), "key")
    near = near.where(f"{100 + percent} * least(rest, most) >= {percent} * (size + least_size)")
    outside = near.where("component <> main").select("key", F.col("doc_id").alias("a"), F.col("component").alias("ca"), F.col("size").alias("na"), F.col("rest").alias("ra"))
    other = near.select("key", F.col("doc_id").alias("b"), F.col("component").alias("cb"), F.col("size").alias("nb"), F.col("rest").alias("rb"), "main")
    cross = outside.join(other, "key").where("ca <> cb AND (cb = main OR a < b)").where(f"{100 + percent} * least(ra, rb) >= {percent} * (na + nb)")
    return cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of near-duplicate documents: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    ``width``-word shingles (A-Z lower-cased; a shorter text is one shingle; links are confirmed on
    full sets). component_id is the least doc_id that links reach; that document is kept.

    Equal word sequences (two hashes, 128 bits) are one class from the start. A document is central
    if its buckets have many members: the text that copies were made from meets all of them, while
    copies meet each other less. In a turn each member of a bucket with several components is
    compared with one central document, so a turn costs a comparison a member and a large group of
    copies is one component after the first. What then shares a bucket but no component is mostly
    not similar; prefix filtering over full sets settles it exactly: documents in different components
    that share a rare shingle, early enough in both sets, are compared, so no link between documents
    that share a bucket is lost.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that repeat a
    doc_id are returned each, with the shingles of their own text, by which they are compared; what is linked
    with either is in the component of both. Further columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"
    signed = settled_step(texts.mapInArrow(partial(signatures, width=width), kind), "signatures")
    classes = settled_step(signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    member = signed.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left")
    member = settled_step(member.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = settled_step(reps.select("doc_id", "n_shingles", F.explode("bands").alias("key")), "band-rows")
    shared = settled_step(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    bucket = settled_step(rows.join(shared, "key"), "bucket-members")
    named = bucket.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.sum("n").alias("central"))
    named = settled_step(named.withColumn("component", F.col("doc_id")), "components")
    sets = texts.join(named.select("doc_id"), "doc_id", "left_semi").mapInArrow(partial(full_sets, width=width), "doc_id long, shingles array<long>")
    known = settled_step(named.select("doc_id", "n_shingles").join(sets, "doc_id"), "shingles")
    bucket, named = bucket.select("doc_id", "key"), named.select("doc_id", "component", "central")
    for _ in range(TURNS):
        near = open_buckets(bucket, named).where("doc_id <> leader")
        pairs = near.select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct()
        named = merged(named, settled_step(verified(pairs, known, percent), "links"))
    left = open_buckets(bucket, named).select("doc_id").distinct()
    rare = rare_shingles(known.join(left, "doc_id", "left_semi"), percent)
    cross = settled_step(across(rare, named, percent), "pairs")
    named = merged(named, settled_step(verified(cross, known, percent), "links"))
    out = member.join(named.select(F.col("doc_id").alias("rep"), "component"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (any_value(p.n) + any_value(q.n) - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id, min(seen) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.node = w.doc_id GROUP BY w.doc_id
"""
