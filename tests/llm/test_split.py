"""Cutting at natural boundaries."""

import pytest
from hypothesis import given, settings, strategies as st

from claimloom.llm import split


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB. \n\t!é😀\u0301\r", max_size=300), st.integers(2, 80), st.integers(0, 40))
def test_pieces_cover_and_fit(text, limit, overlap):
    overlap = min(overlap, limit // 2)
    got = split.spans(text, limit, overlap)
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(0 < b - a <= limit for a, b in got)


def test_hierarchy():
    para = "One two three four. Five six seven eight.\n\n"
    text = para * 10
    for a, b in split.spans(text, 100, 20)[:-1]:
        assert text[a:b].endswith("\n\n")
    sent = "Alpha beta gamma delta. " * 20
    assert all(sent[a:b].endswith(". ") for a, b in split.spans(sent, 100, 0))
    assert all(not sent[a:b].rstrip().endswith("cf.") for a, b in split.spans("See the work cf. Fig. 3 about it here now. " * 9, 60, 0))
    runs = split.spans("x" * 1000, 100, 30)
    assert runs[0] == (0, 70) and all(b - a == 100 for a, b in runs[1:-1]) and all(b - c == 30 for (_, b), (c, _) in zip(runs, runs[1:]))
    marks = "e\u0301" * 200
    assert all(marks[a] == "e" for a, _ in split.spans(marks, 51, 10))
    with pytest.raises(ValueError):
        split.spans("a", 5, 5)


def test_frames(spark):
    rows = [(1, "a" * 4000, 10, "S"), (2, "b" * 4001, 10, None), (3, None, 1, "x"), (4, "", 1, "x"), (5, " ", None, " "), (6, "word " * 100_000, None, "S"), (2, "b" * 4001, 10, None)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "id long, text string, start_char int, section string, piece string, pieces int")
    got = split.pieces(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {1, 2, 5, 6} and len(by[1]) == 1 and len(by[2]) == 4
    assert by[1][0]["start_char"] == 10 and by[1][0]["end_char"] == 4010 and by[5][0]["start_char"] is None
    long = sorted(by[6], key=lambda r: r["piece"])
    text = rows[5][1]
    assert all(r["text"] == text[r["rel_start"] : r["rel_end"]] and len(r["text"]) <= 4000 for r in long) and long[-1]["rel_end"] == len(text) and {r["section"] for r in long} == {"S"}
    assert split.pieces(df.limit(0)).count() == 0
