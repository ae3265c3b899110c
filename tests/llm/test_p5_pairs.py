import datetime as dt

import pytest

from lodestone.llm import p5_pairs as P

T0 = dt.datetime(2024, 1, 1)
Q = "Explain why `CacheReader` drops rows in the nightly build."


@pytest.mark.parametrize("answer", [None, "", " \n\t", "​﻿", "...", '""', "```\n```", "```python\n\n```", "<answer></answer>", "\xa0&nbsp;", "**  **"])
def test_empty(answer):
    assert P.defect(Q, answer) == "empty"


@pytest.mark.parametrize("answer", ["`foo`", "42 ms.", "4096", "Yes.", "```go\nx := 1\n```", "- one thing\n- another thing", "Sure. Use the flag.\n\n```\nx = (\n```", "Here it is:\n\n| a | b |\n|---|---|\n| 1 | 2 |", "It drops rows (see `x`).", "She said \"no\".", "1. first step\n2. second step", "# Title\n\nIt works now."])
def test_usable(answer):
    assert P.defect(Q, answer) is None


@pytest.mark.parametrize("answer", ["It drops rows because the reader", "It drops rows because the cache is full, ", "Use this:\n\n```python\nfor x in y:", "The value of `cache_re", "It is full (see the notes on the", "He said that \"the cache is"])
def test_truncated(answer):
    assert P.defect(Q, answer) == "truncated"


@pytest.mark.parametrize("answer", ["I'm sorry, but I can't help with that.", "I’d rather not take part in this. Please ask the maintainers instead.", "Thank you for the question about `CacheReader`. I am unable to assist with this request. I hope you understand.", "No answer can be given here.", "Tut mir leid, dabei kann ich nicht helfen.", "Lo siento, no puedo ayudar con eso. Consulta con el equipo responsable.", "Je dois refuser cette demande. Merci de votre compréhension."])
def test_refusal(answer):
    assert P.defect(Q, answer) == "refusal"


@pytest.mark.parametrize("answer", ["I'm sorry for the delay, here is what I found. The reader drops rows when the cache is full.", "The reader cannot help here because rows are bounded; sorry about the name. It drops them.", "I can't reproduce it on Linux. The build drops rows because of the timer."])
def test_no_refusal(answer):
    assert P.defect(Q, answer) is None


@pytest.mark.parametrize("answer", [Q, Q.upper(), f'"{Q}"', "Question: " + Q, Q + "\n\n" + Q, Q.replace(" ", "\n", 3), Q.rstrip(".") + "??"])
def test_copied(answer):
    assert P.defect(Q, answer) == "copied"


def test_an_echo_with_an_answer_is_none():
    assert P.defect(Q, Q + "\n\nIt drops them because the cache is full at night and nobody empties it.") is None


def test_tiling():
    assert P.tiles("a b c d x a b c".split(), "a b c d".split()) == (7, 4)
    assert P.tiles("a b".split(), "a b".split()) == (0, 0)


@pytest.mark.parametrize("prompt,answer,wrong", [
    (Q, "Der Index wird nach jedem Lauf neu aufgebaut, weil er sonst veraltete Einträge liefert.", True),
    (Q + " Reply in German.", "Der Index wird nach jedem Lauf neu aufgebaut, weil er sonst veraltete Einträge liefert.", False),
    ("Wie entscheidet `X`, welche Dateien in den Index kommen? Bitte antworte auf Englisch.", "The index is built after each run, because it would be stale without that.", False),
    ("¿Cómo decide `X` qué archivos entran en el índice?", "L'index est reconstruit après chaque exécution parce que les entrées sont périmées.", True),
    (Q, "кэш переполнен и строки теряются каждую ночь", True), (None, "Der Index wird nach jedem Lauf neu aufgebaut.", False),
    (Q, "The cache is full.\n\n```\nder die das und nicht ein eine\n```", False),
])
def test_language(prompt, answer, wrong):
    assert P.is_wrong_language(prompt, answer) == wrong


def test_check(spark):
    rows = [("a", Q, "", "success", T0, "x"), ("a", Q, "It is full.", "success", T0 + dt.timedelta(1), "x"), ("b", None, None, None, None, "x"), ("c", Q, "It is full.", "timeout", T0, "x"), (None, Q, "", "success", T0, "x"), ("d", Q, Q, "success", T0, "x"), ("d", Q, Q, "success", T0, "x")]
    runs = spark.createDataFrame(rows, "request_id string, prompt string, artifact_content string, execution_status string, ingested_at timestamp, defect string")
    assert {(r["request_id"], r["defect"]) for r in P.check(runs).collect()} == {("a", None), ("b", "empty"), ("c", None), ("d", "copied")}
    assert {(r["request_id"], r["defect"]) for r in P.found(runs).collect()} == {("b", "empty"), ("d", "copied")}
    assert P.found(runs.limit(0)).count() == 0 and P.rates(runs).count() == 3


def test_very_long_answers():
    assert P.defect("a b c d " * 50_000, "a b c d " * 50_000) == "copied"
    assert P.defect(Q, "The cache is full. " * 50_000) is None


def test_a_long_refusal_is_a_refusal():
    refusal = "I'm sorry, but I can't help with that. Please ask the maintainers instead. I hope you understand. "
    assert P.defect(Q, refusal * 40) == "refusal"
    assert P.defect(Q, refusal * 40 + "The reader drops rows because the cache is full.") is None


def test_a_fragment_of_the_prompt_is_no_copy_at_any_length():
    prompt = " ".join(f"word{k}" for k in range(300))
    fragment = " ".join(f"word{k}" for k in range(100)) + ". "
    assert not P.is_copied(prompt, fragment * 4) and not P.is_copied(prompt, fragment * 60)
    assert P.is_copied(prompt, (prompt + ". ") * 30)


def test_tiling_against_plain_greedy_search():
    import random

    def plain(answer, prompt, least):
        free, used = [True] * len(answer), [False] * len(prompt)
        while True:
            best = (least - 1, 0, 0)
            for i in range(len(answer)):
                for j in range(len(prompt)):
                    n = 0
                    while i + n < len(answer) and j + n < len(prompt) and free[i + n] and answer[i + n] == prompt[j + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            n, i, j = best
            if n < least:
                return len(answer) - sum(free), sum(used)
            free[i : i + n], used[j : j + n] = [False] * n, [True] * n

    rnd = random.Random(3)
    for _ in range(300):
        words = "abcd"[: rnd.randrange(1, 5)]
        a, p = (rnd.choices(words, k=rnd.randrange(0, 25)) for _ in range(2))
        least = rnd.randrange(1, 4)
        assert P.tiles(a, p, least) == plain(a, p, least)
