"""Leaks that a search by weight, by an assumed answer or by long items alone would miss."""

import pytest

from ledgerlens.llm import decontam

COMMON = "the of and to in is that it was for on are with as".split()
FILL = " ".join(f"{COMMON[i * 5 % 14]} {COMMON[(i * 3 + 1) % 14]} plain{i % 7}" for i in range(40))


@pytest.fixture(scope="module")
def leaks(spark):
    def found(items, texts):
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {(r["doc_id"], r["item_id"]) for r in decontam.decontaminate(docs, bench).collect()}

    return found


def test_reworded_rare_terms(leaks):
    words = [w for i in range(10) for w in (COMMON[i], COMMON[(i * 3 + 4) % 14], f"rare{i}")]
    kept = [w if not w.startswith("rare") else f"other{w[4:]}" for w in words]
    assert (60, 0) in leaks([" ".join(words)], [*[FILL] * 60, f"{FILL} {' '.join(kept)} {FILL}"])


def test_repeats_in_one_document_leave_other_leaks(leaks):
    item = " ".join(f"rare{i}" for i in range(12))
    assert leaks([item], [" ".join([f"rare{i % 12} x{i}" for i in range(3000)]), f"{FILL} {item} {FILL}", FILL]) >= {(1, 0)}


def test_most_of_an_item_without_its_end(leaks):
    words = [f"word{i}" for i in range(40)]
    first, reworded = words[:30], words[:30] + [f"new{i}" for i in range(10)]
    texts = [f"{FILL} {' '.join(x)} {FILL}" for x in (first, reworded, words[:20], words)] + [FILL]
    assert leaks([" ".join(words)], texts) == {(0, 0), (1, 0), (3, 0)}


def test_short_items(leaks):
    texts = ["so Paris, France it is", "France and Paris", "parisfrance", "何も無い", "前に東京都庁が在る", "Paris", None, ""]
    assert leaks(["Paris France", "東京都庁", "?!", ""], texts) == {(0, 0), (4, 1)}


def test_longest_common_subsequence():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.integers(0, 6, 70), rng.integers(0, 6, rng.integers(0, 90))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        assert decontam.Order(a).lcs(b.tolist()) == row[-1]
