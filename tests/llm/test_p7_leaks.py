import random

import numpy as np
import pytest

from lodestone.llm import p7_leaks as P

A = "Trace one late contract from `PolicyWindow` down to where the budget is split, naming each queue passed behind the feature flag on slow disks."
B = "Suppose a newcomer deletes `MergeValidator`: name three pipelines that break first and tell how far the leading envelopes reach into the quota."
SHARED = "Use only material found inside the repository and keep the reply under three hundred words without any guessing."
ITEMS = [(1, "s", SHARED + " " + A, None), (2, "s", SHARED + " " + B, "The answer names the encoder as owner of optional tokens and the parser as sole reader of every dense segment."), (3, "s", None, ""), (None, "s", A, None), (1, "s", SHARED + " " + A, None)]
FILL = "There is one reader per package and the index keeps them in order while nobody looks. "


def leaks(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, suite string, task_prompt string, expected_answer string")
    return {(r["doc_id"], r["item_id"]) for r in P.found(docs, it).collect()}


def test_verbatim_edited_and_formatted(spark):
    w = A.split()
    twelve = " ".join(w[2:14])
    changed = " ".join([*w[2:8], "really", *w[9:16]])
    dropped = " ".join([*w[2:8], *w[9:16]])
    added = " ".join([*w[2:8], "really", *w[8:16]])
    marked = "> " + "\n> ".join(f"**{x.upper()}**," for x in w[:14])
    got = leaks(spark, [FILL + twelve + " " + FILL, changed, dropped, added, marked, FILL * 5 + A + FILL + B])
    assert got == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (5, 2)}


def test_what_is_no_leak(spark):
    w = A.split()
    assert leaks(spark, [SHARED, FILL * 20, " ".join(w[3:9]), None, "", "`PolicyWindow`", " ".join(sorted(w)), "x " * 100_000]) == set()


def test_answers_count_and_tables_may_be_empty(spark):
    assert leaks(spark, [FILL + ITEMS[1][3]]) == {(0, 2)}
    assert leaks(spark, [A], [(9, "s", None, None)]) == set()
    docs = spark.createDataFrame([], "doc_id long, text string")
    it = spark.createDataFrame(ITEMS, "item_id long, suite string, task_prompt string, expected_answer string")
    assert P.found(docs, it).count() == 0 and P.found(docs, it.limit(0)).count() == 0 and P.items_leaked(docs, it).count() == 0


def index_of(texts):
    return P.Index([(k, "task_prompt", t.split(), [1.0] * (len(t.split()) - P.SHINGLE + 1)) for k, t in enumerate(texts)])


def test_multi_index_finds_all_within_the_radius():
    rnd = np.random.default_rng(1)
    index = index_of([" ".join(f"w{k}" for k in range(300))])
    base = index.prints[rnd.integers(0, len(index.prints), 400)]
    flips = np.array([sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 16), replace=False)) for _ in range(400)], np.uint64)
    prints = base ^ flips
    brute = {(r, int(c)) for r in range(len(prints)) for c in np.flatnonzero(np.bitwise_count(prints[r] ^ index.prints) <= P.RADIUS)}
    rows, cols = index.near(prints)
    assert set(zip(rows.tolist(), cols.tolist(), strict=True)) == brute


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    texts = [A, B, SHARED, FILL + ITEMS[1][3]]
    whole = leaks(spark, texts)
    monkeypatch.setattr(P, "BLOCK_CHARS", 200)
    assert leaks(spark, texts) == whole == {(0, 1), (1, 2), (3, 2)}


def test_random_passages_against_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"term{k}" for k in range(400)]
    items = [(k, "s", " ".join(rnd.choice(vocabulary) for _ in range(60)), None) for k in range(20)]
    texts, want = [], set()
    for d in range(60):
        words = [rnd.choice(vocabulary) for _ in range(80)]
        if d % 2:
            k = rnd.randrange(20)
            src = items[k][2].split()
            a = rnd.randrange(0, 40)
            words[20:20] = src[a : a + rnd.randrange(12, 20)]
            want.add((d, k))
        texts.append(" ".join(words))
    assert leaks(spark, texts, items) == want


@pytest.mark.parametrize("text,words", [("a_b c", ["a_b", "c"]), ("_x_ **y**", ["x", "y"])])
def test_words(text, words):
    assert P.words_of(text) == words


def edited(rnd, words, known):
    """A copy with one word in every twelve changed, dropped or added."""
    out = []
    for k in range(0, len(words), 12):
        part = list(words[k : k + 12])
        if len(part) == 12:
            at, kind = rnd.randrange(1, 11), rnd.choice(("change", "drop", "add"))
            new = [rnd.choice(known) if rnd.random() < 0.3 else f"new{rnd.randrange(10**6)}"]
            part[at : at + (kind != "add")] = [] if kind == "drop" else new
        out += part
    return out


def test_recall_of_edited_passages_and_what_the_radius_adds():
    """Against verification of every field of every text, without fingerprints."""
    rnd = random.Random(11)
    known = [f"term{k}" for k in range(600)]
    index = index_of([" ".join(rnd.choice(known) for _ in range(60)) for _ in range(30)])
    texts = []
    for _ in range(600):
        a, n = rnd.randrange(0, 30), rnd.choice((12, 14, 16, 20, 24, 36))
        words = [rnd.choice(known) if rnd.random() < 0.3 else f"other{rnd.randrange(10**6)}" for _ in range(30)]
        words[10:10] = edited(rnd, index.fields[rnd.randrange(30)][2][a : a + n], known)
        texts.append(np.array([index.ids.get(w, 0) for w in words], np.int64))
    every = set(range(30))
    want = {(d, r[0]) for d, t in enumerate(texts) for r in index.verify(t, every)}

    def got(radius):
        old, P.RADIUS = P.RADIUS, radius
        try:
            length = np.array([len(t) for t in texts])
            near = index.candidates(np.concatenate(texts), np.cumsum(length) - length, length)
        finally:
            P.RADIUS = old
        return {(d, r[0]) for d, fields in near.items() for r in index.verify(texts[d], fields)}

    assert got(P.RADIUS) <= want and len(want) > 500
    assert len(got(P.RADIUS)) >= 0.95 * len(want)
    assert len(got(0)) < 0.7 * len(want)  # equal fingerprints alone miss the edited ones


def test_an_old_chain_is_continued_past_many_newer_ones():
    words = [f"w{k}" for k in range(40)]
    index = index_of([" ".join([*words[:6], *(["x", "y", "z"] * 12), *words[6:20]])])
    noisy = np.array([index.ids[w] for w in [*["x", "y", "z"] * 50, *words[6:20]]])
    assert index.verify(noisy, {0})[0][2] >= 14


def test_shared_words_weigh_less(spark):
    items = [(k, "s", f"the common words of all items here and then rare{k} special{k} unique{k} single{k} lone{k} odd{k}", None) for k in range(5)]
    w = {r["item_id"]: list(zip(r["words"], r["weights"], strict=False)) for r in P.weighted_fields(spark.createDataFrame(items, "item_id long, suite string, task_prompt string, expected_answer string")).collect()}
    assert dict(w[2])["the"] == 0 and 0 < dict(w[2])["and"] < dict(w[2])["rare2"] <= 1
