"""Licence notices under the line ends and comment marks of real files."""

import textwrap

import numpy as np
import pytest

from ledgerlens.llm import licenses

MIT = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)


def found(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["license"]): (round(r["dice"], 6), r["unit"], texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()) for r in licenses.license_scan(docs).collect()}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_wrapped_notice_as_a_paragraph(spark, mark, end):
    """Between other comments, with lines that hold nothing or comment marks alone before and after."""
    lines = ["module of things", "", *textwrap.wrap(MIT, 60, break_on_hyphens=False), "", "what this module does and how it came about over the years"]
    got = found(spark, end.join(mark.rstrip() if not x else mark + x for x in lines))
    dice, unit, text = got[0, "MIT"]
    assert dice == 1.0 and unit == "paragraph" and "Permission" in text and "what this" not in text


def test_bodies(spark):
    """Each template is found as it stands, in capitals, and wrapped; near ones don't stand in for each other."""
    texts = [t for _, t in licenses.TEMPLATES] + [t.upper() for _, t in licenses.TEMPLATES] + ["\r\n".join(textwrap.wrap(t, 40, break_long_words=False, break_on_hyphens=False)) for _, t in licenses.TEMPLATES]
    got = found(spark, *texts)
    for i in range(len(texts)):
        name = licenses.TEMPLATES[i % len(licenses.TEMPLATES)][0]
        assert got[i, name][0] == 1.0, (i, name)
    assert {n for i, n in got if i < len(licenses.TEMPLATES) and n != licenses.TEMPLATES[i][0]} == set()


def test_lines_without_words_end_paragraphs():
    text = b"a b\r\n\r\nc d\n#\ne f\n\n\ng\n"
    data = np.frombuffer(text + b"h i\n\nj", np.uint8)
    breaks, blank, bare = licenses.cuts(data, np.array([0, len(text), len(data)]))
    assert np.flatnonzero(breaks).tolist() == [i for i, c in enumerate(data.tolist()) if c == 10]
    parts = lambda cut: [x for x in np.split(data, np.flatnonzero(cut | np.isin(np.arange(len(cut)), [len(text)])).tolist()) if x.size]
    assert [bytes(p).strip() for p in parts(blank)] == [b"a b", b"c d\n#\ne f", b"", b"g", b"h i", b"j"]
    assert [bytes(p).strip(b"\r\n#") for p in parts(bare)] == [b"a b", b"c d", b"e f", b"", b"g", b"h i", b"j"]
