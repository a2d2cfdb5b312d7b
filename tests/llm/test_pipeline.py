"""The corpus pipeline: every stage takes effect and keeps the columns of documents."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm import toxicity
from ledgerlens.llm.common import documents
from tests.llm.by_hand import score_by_hand


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == names, name
        left = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert left < {r["doc_id"] for r in docs.select("doc_id").collect()}, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r["doc_id"] for r in docs.collect()}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int, component long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def leaked(text, item, least=0.6):
    """Some 1 / least times as many neighbouring terms have a share ``least`` of the item's in order."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
    a, b = terms(text), terms(item)
    span, need = -(-len(b) * 10 // 6), -(-len(b) * 6 // 10)
    return any(lcs(a[i : i + span], b) >= need for i in range(max(1, len(a) - span + 1)))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of every kind that a stage acts on, among awkward rows, with labels and a benchmark."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [text(24) for _ in range(6)]
    rows = [(i, text(rnd.randint(30, 90))) for i in range(260)]
    toxic = {i for i in range(260) if i % 4 == 0}
    rows = [(i, t + " vileword" if i in toxic else t) for i, t in rows]
    labels = [(i, 1, int(i in toxic)) for i in range(200)]
    base = text(80).split()
    rows += [(300 + i, t) for i, t in enumerate(["Same Text here " + text(20)] * 5)]
    rows += [(310 + i, " ".join([*base[:i], f"other{i}", *base[i + 1 :]])) for i in range(6)]
    rows += [(320, text(40) + " " + items[0] + " " + text(40)), (321, items[1].upper()), (322, text(30) + " " + " ".join(w if k % 6 else "x" for k, w in enumerate(items[2].split())))]
    rows += [(330, None), (331, ""), (332, " \t\n"), (333, "one"), (334, text(6000)), (335, text(20)), (335, text(25)), (None, text(33))]
    rows += [(336, rows[10][1])] * 2
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, None, "s", None, "d", 3, 9) for i, t in rows], COLUMNS)
    docs.repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_against_brute_force(spark, corpus):
    """Each stage's rows from its definition, applied to what the stages before it kept."""
    path, rows, items = corpus
    weights, bias = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    kept = [r for r in rows if score_by_hand(r[1], weights, bias) < 0.5]
    gone = {i for i, _ in rows} - {i for i, _ in kept}
    assert gone >= {i for i in range(260) if i % 4 == 0} and not gone & {i for i in range(300) if i % 4}
    last = {}
    for i, t in kept:
        key = re.sub("[A-Z]", lambda c: c[0].lower(), t or "")
        last[key] = max(last.get(key, -1), -1 if i is None else i)
    kept = [(i, t) for i, t in kept if i is None or i == last[re.sub("[A-Z]", lambda c: c[0].lower(), t or "")]]
    sets, lead = [shingles(t) for _, t in kept], list(range(len(kept)))
    find = lambda x: x if lead[x] == x else find(lead[x])
    for a in range(len(kept)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and find(a) != find(b):
                lead[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(kept):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    ids = {i for k, (i, _) in enumerate(kept) if i is not None and i != least[find(k)]}
    kept = [(i, t) for i, t in kept if i not in ids]
    leaks = {i for i, t in kept if any(leaked(t, x) for x in items)}
    assert leaks == {320, 321, 322}
    kept = [(i, t) for i, t in kept if i not in leaks]

    names, docs = spark.read.parquet(f"{path}/documents.parquet").columns, spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted(kept, key=str)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = [r.asDict() for r in corpus_pipeline.run(spark, path).collect()]
    want, got = Counter(), Counter()
    for i, t in kept:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == want and len({r["sequence_id"] for r in packed}) == -(-want.total() // 2048)
    for s in {r["sequence_id"] for r in packed}:
        at = 0
        for r in sorted((r for r in packed if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_awkward_rows_keep_their_place(spark, corpus):
    """Nulls, empties, a very long text and rows that repeat an id pass through every filtering stage; copies leave one."""
    path, rows, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame((rest := stage(spark, docs, path)).collect(), rest.schema)
    left = [r["doc_id"] for r in docs.collect()]
    assert {332, 333, 334, None} <= set(left) and left.count(335) == 2 and left.count(336) == 2
    assert 331 in left and 330 not in left  # null counts as empty: of equal texts the largest id stays
    assert {300, 301, 302, 303} & set(left) == set() and 304 in left
    assert {i for i in range(310, 316)} & set(left) == {310}


def test_empty_tables(spark, corpus):
    """No documents give no rows in any stage; no labels and no items leave all documents of the two stages that use them."""
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
    bare = f"{path}/bare"
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(f"{bare}/{table}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "decontamination"):
        assert stages[name](spark, docs, bare).count() == docs.count()
