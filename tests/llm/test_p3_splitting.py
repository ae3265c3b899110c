import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import p3_splitting as P

T0 = dt.datetime(2024, 1, 1)
LIMITS = [("python", 10, 2), ("*", 5, 1), ("wide", 10, 9)]


def greedy(text, room, overlap):
    """The same cuts one after the other, over the same table of boundaries."""
    pos, kind = P.boundaries(text, room, overlap)
    out, start, end = [], 0, 0
    while True:
        new = P.successors(pos, kind, np.array([start]), room)[0]
        if pos[new] <= end:
            new = int(np.searchsorted(pos, end, side="right"))
        out.append((start, int(pos[new]), int(kind[new])))
        end = int(pos[new])
        if end == len(text):
            return out
        start = max(end - overlap, 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab.\n \té漢", min_size=1, max_size=300), st.integers(4, 60), st.integers(0, 40)), min_size=1, max_size=4))
def test_doubling_equals_the_greedy_loop(items):
    items = [(t, room, min(overlap, (room - 1) // 2)) for t, room, overlap in items]
    got = P.cuts(items)
    for (text, room, overlap), pieces in zip(items, got, strict=True):
        assert pieces == greedy(text, room, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(0 < b - a <= room for a, b, _ in pieces)
        assert all(p[1] - q[0] == min(overlap, p[1]) for p, q in zip(pieces, pieces[1:], strict=False))


def test_natural_boundaries_are_preferred():
    text = "word " * 3 + "end.\n\n" + "more words follow here and on"
    assert P.cuts([(text, 32, 0)])[0][0] == (0, 21, 4)
    assert P.cuts([("x" * 100, 16, 4)])[0][-1][1] == 100


def test_pieces(spark):
    long = "line of code\n" * 20
    rows = [(1, long, "python", T0, 1, "t"), (2, "short", "python", T0, 99999, "t"), (3, long, None, T0, None, "t"), (4, None, "python", T0, 5, "t"), (5, long, "cobol", T0, 0, "t"), (6, long, "python", T0, 1, "t"), (6, "now short", "python", T0 + dt.timedelta(1), 1, "t"), (7, "é" * 41, "python", None, 1, "t"), (7, "é" * 41, "python", None, 1, "t"), (8, "é" * 40, "python", T0, 1, "t"), (None, long, "python", T0, 1, "t"), (9, "", "python", T0, 1, "t"), (10, long, "wide", T0, 1, "t")]
    items = spark.createDataFrame(rows, "item_id long, content string, language string, packaged_at timestamp, token_count long, text string")
    limits = spark.createDataFrame(LIMITS, "language string, max_tokens int, overlap_tokens int")
    got = P.pieces(items, limits).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        by.setdefault(r["item_id"], []).append(r)
    assert set(by) == {1, 3, 5, 7, 10} and {r["item_id"] for r in P.found(items, limits).collect()} == set(by)
    assert all(r["tokens"] <= 10 and -(-len(r["text"]) // 4) == r["tokens"] for r in by[1]) and all(r["tokens"] <= 5 for r in by[3] + by[5])
    assert all(a["stop"] - b["start"] == 8 for a, b in zip(by[1], by[1][1:], strict=False))
    whole = by[1][0]["text"] + "".join(r["text"][8:] for r in by[1][1:])
    assert whole == long
    assert P.found(items.limit(0), limits).count() == 0 and P.found(items, limits.limit(0)).count() == 0


def test_a_very_long_text():
    pieces = P.cuts([("some words here. " * 200_000, 4000, 200)])[0]
    assert pieces[-1][1] == 3_400_000 and max(b - a for a, b, _ in pieces) <= 4000
