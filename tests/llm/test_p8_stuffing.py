import numpy as np
import pytest

from lodestone.llm import p8_stuffing as P

PROSE = ["The reader keeps the index in order and nobody has to look at it twice.", "When the queue is full, the worker drops the oldest rows and writes a note about them.", "It turns out that most of the time is spent in the parser, which was not what we expected.", "Please do not change the order of the steps, because the next job still needs it.", "A table without an owner is treated as shared and is never removed from the store."]
LIST = {
    "tags": " ".join(f"#tag{k}cheap" for k in range(40)), "links": "\n".join(f"* [cheap thing {k}](https://shop{k}.example/x/y)" for k in range(20)), "urls": "\n".join(f"https://a{k}.example/b?c={k} module" for k in range(20)),
    "menu": " > ".join(f"Section{chr(65 + k)}" for k in range(26)), "products": "\n".join(f"brand{chr(97 + k)} cheap model {k} € offer stock" for k in range(20)), "files": "; ".join(f"pack-1.{k}.0.tar.gz" for k in range(30)),
    "stuffed": "Best token router. Fast token router. New token router. token router for teams, token router for work, token router online. " * 5, "words": "cheap token best free token router top token " * 12,
}
OTHER = {
    "code": "```python\n" + "x = f(y)\nfor a in b:\n    g(a)\n" * 10 + "```", "log": "\n".join(f"10:0{k % 10}:00 ERROR [mod] queue {k} overflow buffer={k}" for k in range(20)), "table": "\n".join(f"| name{k} | int | value |" for k in range(20)), "quoted": "\n".join(f"> let x{k} = call(y, {k});" for k in range(20)),
    "changelog": "## 1.2.3\n\n" + "\n".join(f"* {p}" for p in PROSE), "tags at the end": " ".join(PROSE) + "\n\nTags: index, queue, worker, parser, table", "see also": " ".join(PROSE * 2) + "\n\n" + "\n".join(f"- [x{k}](https://a.example/{k}): {p}" for k, p in enumerate(PROSE)),
}


def corpus():
    rng = np.random.default_rng(4)
    return [" ".join(rng.permutation(PROSE)[: rng.integers(2, 6)]) + f" Note {k}." for k in range(150)]


def found(spark, texts, lang="en"):
    rows = [(k, t, lang, 0.0) for k, t in enumerate(texts)]
    return {r["doc_id"] for r in P.found(spark.createDataFrame(rows, "doc_id long, text string, lang string, density double")).collect()}


def test_lists_are_found_and_others_not(spark):
    base = corpus()
    texts = base + list(LIST.values()) + [PROSE[0] + "\n\n" + x for x in LIST.values()] + list(OTHER.values()) + [None, "", " \n ", "x"]
    want = set(range(len(base), len(base) + 2 * len(LIST)))
    assert found(spark, texts) == want


def test_half_is_not_enough(spark):
    base = corpus()
    small = [" ".join(PROSE * 4) + "\n\n" + LIST["menu"]]
    assert found(spark, base + small) == set()


@pytest.mark.parametrize("lang", [None, "EN-us", "xx"])
def test_any_language_column(spark, lang):
    base = corpus()
    assert found(spark, [*base, LIST["tags"]], lang) == {len(base)}


def test_small_and_empty_tables(spark):
    assert found(spark, [LIST["links"], PROSE[0]]) == {0}
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert P.found(df).count() == 0
    assert P.found(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).count() == 0


POLISH = "Czytnik trzyma indeks w porządku i nikt nie musi do niego zaglądać. Kiedy kolejka jest pełna, worker usuwa najstarsze wiersze. Nie wiadomo jeszcze, czy to jest błąd, ale zespół już nad tym pracuje."
RUSSIAN = "Индекс перестраивается после каждого запуска, и никто не знает почему. Если очередь пуста, задание ждёт и ничего не делает. На этой неделе мы не будем менять порядок шагов."
DUTCH = "De lezer houdt de index op orde en niemand hoeft er twee keer naar te kijken. Als de wachtrij vol is, verwijdert de werker de oudste rijen. Het is nog niet bekend of dat een fout is."


def test_languages_that_the_corpus_does_not_know(spark):
    texts = corpus() + [f"{t}\n\n{t} {k}." for t in (POLISH, RUSSIAN, DUTCH) for k in range(3)] + ["这是一个很长的句子，没有人知道为什么它还在这里。读者保持索引有序。"]
    assert found(spark, texts, "en") == set() and found(spark, texts, "pl") == set()


def test_distance_decides(spark):
    """A list of plain prose without full stops is dense, but no outlier; the same list of keywords is one."""
    notes = "\n".join(f"- {p.rstrip('.').lower()}" for p in PROSE)
    base = corpus()
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*base, notes, LIST["words"]])], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in P.scored(docs).collect()}
    assert rows[len(base)]["density"] > 0.5 and rows[len(base)]["distance"] < P.CUTOFF
    assert {r["doc_id"] for r in P.found(docs).collect()} == {len(base) + 1}


def test_function_words_are_learnt(spark):
    docs = spark.createDataFrame([(k, f"{p} Note {k}.", "sv") for k, p in enumerate(PROSE * 8)] + [(99, LIST["words"], "sv")], "doc_id long, text string, lang string")
    (words,) = P.learnt(docs)
    assert {"the", "is", "of"} <= words and not {"best", "free", "top"} & words


def test_repeated_rows_and_null_ids(spark):
    base = corpus()
    rows = [(k, t, "en") for k, t in enumerate(base)] + [(None, LIST["menu"], "en"), (7, LIST["menu"], "en"), (7, LIST["menu"], "en")]
    got = [r["doc_id"] for r in P.found(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    assert sorted(got, key=str) == [7, 7, None]


def test_figures():
    words = [frozenset("the in it of to is and at not has a by".split())]
    assert P.figures(None, words) is None and P.figures("  ", words) is None
    d, f, e, r = P.figures(PROSE[0], words)
    assert d == 0 and f > 0.3 and r == 0
    assert P.figures(LIST["tags"], words)[0] > 0.9
    assert P.figures("word " * 300_000, words)[3] > 0.99
    assert P.figures("A sentence that says the same thing. " * 40, words)[0] > 0.8
