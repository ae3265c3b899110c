import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate, graph, hierarchy, packing, ranking, resolve, stateful, stores, tfidf
from lodestone.sources import files as S
from lodestone.sources import parsers


def test_tfidf_prefers_the_matching_unit(spark):
    docs = spark.createDataFrame([("pkg/server", "configuration watcher dynamic reload propagate"), ("pkg/client", "http client request response"), ("", "main entry point"), ("none", None)], "unit string, text string")
    q = spark.createDataFrame([(1, "dynamic configuration updates")], "q int, text string")
    w = tfidf.weights(tfidf.token_counts(docs, "unit", "text"), docs, "unit")
    got = tfidf.scores(q, "q", "text", w, "unit").collect()
    assert [r["unit"] for r in got] == ["pkg/server"] and got[0]["score"] > 0
    norms = w.groupBy("unit").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)


def test_ppmi_of_a_hub_is_nothing(spark):
    rows = [(f"f{k}", "config watcher apply reload") for k in range(3)] + [(f"f{k}", f"config filler{k}") for k in range(3, 10)]
    g = {(r["term"], r["neighbour"]): r["ppmi"] for r in tfidf.ppmi(spark.createDataFrame(rows, "f string, t string"), "f", "t").collect()}
    assert g[("watcher", "apply")] == pytest.approx(math.log(10 / 3))
    assert not any("config" in pair for pair in g)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, t string")
    assert tfidf.weights(tfidf.token_counts(empty, "k", "t"), empty, "k").count() == 0
    assert tfidf.ppmi(empty, "k", "t").count() == 0
    e = spark.createDataFrame([], "src string, dst string")
    assert graph.components(e).count() == 0 and graph.label_propagation(e).count() == 0 and graph.betweenness(e).count() == 0
    files = spark.createDataFrame([], "file_path string")
    assert hierarchy.register(files).count() == 0


def test_bfs_layers_parents_and_cycles(spark):
    e = spark.createDataFrame([("authenticate", "login"), ("login", "handle"), ("handle", "authenticate"), ("other", "login")], "src string, dst string")
    s = spark.createDataFrame([("authenticate",)], "start string")
    assert sorted((r["node"], r["hop"], r["parent"]) for r in graph.bfs(e, s).collect()) == [("handle", 2, "login"), ("login", 1, "authenticate")]
    assert [r["node"] for r in graph.bfs(e, s, 1).collect()] == ["login"]


def test_components_of_long_chains(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "src int, dst int")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert {got[k] for k in range(61)} == {0} and got[101] == 100


def test_label_propagation_equals_the_whole_run(spark):
    import random

    rnd = random.Random(5)
    pairs = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(45)]
    e = spark.createDataFrame(pairs, "src int, dst int")
    rows = graph.undirected(e).collect()
    adjacency = {}
    for r in rows:
        adjacency.setdefault(r["src"], {})[r["dst"]] = float(r["weight"])
    label = graph.propagate(list(adjacency), adjacency)
    low = {}
    for n, x in label.items():
        low[x] = min(low.get(x, n), n)
    assert {r["node"]: r["community"] for r in graph.label_propagation(e).collect()} == {n: low[x] for n, x in label.items()}


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
    assert {r["node"]: r["betweenness"] for r in graph.betweenness(e).collect()} == {1: 0.0, 2: 1.0, 3: 0.0}


def test_modularity_of_two_cliques(spark):
    pairs = [(a, b) for g in ((1, 2, 3), (4, 5, 6)) for a in g for b in g if a < b]
    e = graph.undirected(spark.createDataFrame(pairs, "src int, dst int"))
    m = spark.createDataFrame([(k, 1 if k < 4 else 2) for k in range(1, 7)], "node int, community int")
    assert graph.modularity(e, m).first()[0] == pytest.approx(0.5)


def test_pagerank_sums_to_one(spark):
    e = graph.undirected(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int"))
    r = graph.pagerank(e, spark.createDataFrame([(1,)], "node int")).collect()
    assert sum(x["rank"] for x in r) == pytest.approx(1.0)


def test_taxonomy_thresholds(spark):
    f = spark.createDataFrame([("main.py",), ("pkg/server/watcher.py",), ("pkg/client/api.py",)], "file_path string")
    assert {r[0] for r in hierarchy.register(f, 50).collect()} == {""}
    assert {r[0] for r in hierarchy.register(f, 0).collect()} >= {"", "pkg/server", "pkg/client"}
    deep = spark.createDataFrame([(f"lib/pkg/{d}/f{k}.py",) for d in ("orm", "sql") for k in range(3)] + [("lib/pkg/__init__.py",)], "file_path string")
    assert {r[0] for r in hierarchy.register(deep, 3).collect()} == {"lib/pkg", "lib/pkg/orm", "lib/pkg/sql"}
    flat = spark.createDataFrame([(f"d/{p}_{k}.py",) for p in ("a", "b") for k in range(4)], "file_path string")
    groups = hierarchy.register(flat, 5)
    assert {r[0] for r in groups.collect()} == {"d::a", "d::b"}
    assert {r["group_path"] for r in hierarchy.owners(flat, groups).collect()} == {"d::a", "d::b"}


SYMBOLS = "id string, name string, qualified_name string, kind string, file_path string, start_line int, end_line int, base_names array<string>, parent_id string"


def test_resolution_falls_back_and_disambiguates(spark):
    s = spark.createDataFrame([("a::h", "helper", "helper", "function", "pkg_a/a.py", 1, 2, [], None), ("b::h", "helper", "helper", "function", "pkg_b/b.py", 1, 2, [], None), ("c::m", "auth", "Svc.auth", "method", "c.py", 1, 2, [], None)], SYMBOLS)
    n = spark.createDataFrame([("helper", "pkg_b/b.py"), ("helper", "pkg_b/other.py"), ("helper", "x/y.py"), ("Svc.auth", "q.py"), ("Other.auth", "q.py"), ("gone", "q.py")], "raw_name string, ctx string")
    r = resolve.resolve(n, "raw_name", s)
    d = {(x["raw_name"], x["ctx"]): (x["preferred"], x["ambiguous"], x["best"]) for x in resolve.disambiguate(r, ["raw_name", "ctx"], "ctx").collect()}
    assert d[("helper", "pkg_b/b.py")] == ("b::h", False, 3) and d[("helper", "pkg_b/other.py")] == ("b::h", False, 2)
    assert d[("helper", "x/y.py")] == (None, True, 0) and d[("Svc.auth", "q.py")][0] == "c::m" and d[("Other.auth", "q.py")][0] == "c::m"
    assert ("gone", "q.py") not in d


def test_aliases_and_suffixes(spark):
    a = spark.createDataFrame([("@/*", 0, "src/*"), ("@lib", 0, "lib/index")], "pattern string, position int, target string")
    f = spark.createDataFrame([("src/a/b.ts",), ("lib/index.js",), ("x/src/a/b.ts",)], "file_path string")
    m = spark.createDataFrame([("@/a/b",), ("@lib",), ("react",)], "raw_module string")
    assert {r[0]: r[1] for r in resolve.alias_targets(m, a, f, ["", ".ts", ".js"]).collect()} == {"@/a/b": "src/a/b.ts", "@lib": "lib/index.js"}
    p = spark.createDataFrame([("a/b.ts",), ("b.ts",), ("z.ts",)], "raw_path string")
    assert {r[0]: r[1] for r in resolve.suffix_targets(p, f).collect()} == {"a/b.ts": "src/a/b.ts", "b.ts": "src/a/b.ts"}


def test_ranking_order_and_nulls(spark):
    c = spark.createDataFrame([("extends Base", 0, "e"), ("defines foo", 1, "d"), ("calls foo", 2, "c"), (None, 3, "n")], "reason string, input_pos int, file_path string")
    c = c.withColumns({"g": F.lit(1), "is_entry": F.lit(False), "impact": F.lit(0), **{k: F.lit(None).cast("double") for k in ("anchor_confidence", "ambiguity_confidence", "path_mask_confidence")}})
    r = ranking.rank(c.withColumn("score", ranking.relevance(c)), ["g"]).orderBy("rank").collect()
    assert [x["file_path"] for x in r] == ["d", "c", "e", "n"] and r[-1]["score"] == 0.3


def test_greedy_skips_without_spending(spark):
    i = spark.createDataFrame([(1, 1, "a", 6), (1, 2, "b", 7), (1, 3, "c", 4), (2, 1, "z", 99)], "g int, pos int, id string, cost int")
    got = {r["id"]: r["packed"] for r in packing.greedy_fit(i, ["g"], ["pos"], "cost", F.lit(10), "id").collect()}
    assert got == {"a": True, "b": False, "c": True, "z": False}


def test_intervals(spark):
    def merged(rows, margin):
        df = spark.createDataFrame([(1, a, b) for a, b in rows], "g int, s int, e int")
        return sorted((r["start"], r["end"]) for r in packing.merged_intervals(df, ["g"], "s", "e", margin).collect())

    assert merged([(5, 8), (9, 12)], 1) == [(4, 13)]
    assert merged([(5, 6), (40, 41)], 1) == [(4, 7), (39, 42)]
    assert merged([(1, 50), (2, 3), (60, 61)], 0) == [(1, 50), (60, 61)]


def test_stores(spark):
    rows = spark.createDataFrame([("a", "w", 1), ("a", "w", 2), ("b", "w", 3), (None, "w", 4)], "k string, w string, t int")
    assert {(r["k"], r["t"]) for r in stores.newest(rows, ["k"], [F.desc("t")]).collect()} == {("a", 2), ("b", 3)}
    new = spark.createDataFrame([("b", "w", 0), ("c", "w", 9)], "k string, w string, t int")
    assert {(r["k"], r["t"]) for r in stores.upsert(rows.filter("k = 'b'"), new, ["k"], "t").collect()} == {("b", 0), ("c", 9)}
    assert stores.retained(rows, "w", [F.desc("t")], 2).count() == 2
    v = stores.versions(rows.filter("k = 'a'"), "k", [F.col("t")], "t").orderBy("version").collect()
    assert [(r["version"], r["lineage"]) for r in v] == [(1, ""), (2, "1")]


def test_t_distribution():
    for t, df in ((2.262, 9), (12.706, 1), (2.042, 30)):
        assert evaluate.two_tailed_p(t, df) == pytest.approx(0.05, abs=1e-3)
    assert evaluate.two_tailed_p(float("inf"), 5) == 0.0 and evaluate.two_tailed_p(0.0, 5) == 1.0 and evaluate.two_tailed_p(None, 5) is None


def test_paired_t_edges(spark):
    rows = [("same", 1, 1), ("same", 2, 2), ("const", 2, 1), ("const", 3, 2), ("one", 1, 2)]
    xs, ys = [10, 12, 9, 11, 10, 13, 9, 10], [8, 9, 7, 8, 7, 9, 8, 7]
    rows += [("real", a, b) for a, b in zip(xs, ys, strict=True)] + [("null", None, 1)]
    p = evaluate.paired_t(spark.createDataFrame(rows, "g string, x int, y int"), ["g"], "x", "y").withColumn("p", evaluate.p_value(F.col("t"), F.col("n") - 1))
    got = {r["g"]: (r["t"], r["p"]) for r in p.collect()}
    assert got["same"] == (0.0, 1.0) and got["const"] == (float("inf"), 0.0) and got["one"] == (None, None) and "null" not in got
    assert got["real"][0] > 0 and got["real"][1] < 0.05


def test_reduction_and_overlap(spark):
    r = spark.range(1).select(evaluate.reduction(F.lit(1000), F.lit(600)).alias("a"), evaluate.reduction(F.lit(0), F.lit(5)).alias("b"), *[c.alias(f"o{k}") for k, c in enumerate(evaluate.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))))]).first()
    assert r["a"] == 40.0 and r["b"] is None and (r["o0"], r["o1"], r["o2"]) == (0.5, 1.0, 0.667)


def bucket(spark, times, capacity, rate):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(times)], "u int, id int, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    return [r["allowed"] for r in stateful.token_bucket(df, ["u"], "ts", "id", capacity, rate).orderBy("id").collect()]


def test_token_bucket(spark):
    assert bucket(spark, [0.0] * 4, 3, 1.0) == [True, True, True, False]
    assert bucket(spark, [0.0, 0.0, 1.0], 1, 1.0) == [True, False, True]
    assert bucket(spark, [0.0, 100.0, 100.0, 100.0], 2, 10.0) == [True, True, True, False]
    assert bucket(spark, [0.0, 5.0], 1, 0.0) == [True, False]


def test_idempotency(spark):
    df = spark.createDataFrame([("k", 1, 0, "h"), ("k", 2, 10, "h"), ("k", 3, 20, "x"), ("k", 4, 61, "x"), (None, 5, 0, None)], "k string, id int, s int, d string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["outcome"] for r in stateful.idempotency(df, ["k"], "ts", "id", "d", 60).collect()}
    assert got == {1: "fresh", 2: "replay", 3: "conflict", 4: "fresh", 5: "fresh"}


PY = '''
class Base: pass
class Svc(Base):
    @route("/x")
    async def auth(self, a):
        return helper(a)
def helper(a): return a
'''


def test_python_parser():
    rows = parsers.parse_file("a.py", PY)
    symbols = {r[4]: (r[5], r[8], r[9]) for r in rows if r[0] == "symbol"}
    assert symbols["Svc"] == ("class", ["Base"], None) and symbols["Svc.auth"][0] == "method" and symbols["helper"][0] == "function"
    assert ("call", "a.py", "a.py::Svc.auth#5", "helper") in [r[:4] for r in rows]
    assert [r[3] for r in rows if r[0] == "decorator"] == ["route"]
    assert parsers.parse_file("a.py", "def (:")[0][0] == "error" and parsers.parse_file("a.xyz", "x") == []


@pytest.mark.parametrize("path,text,names", [
    ("a.ts", "export class A extends B {\n  run(x: number): void {\n    go(x);\n  }\n}\nconst f = (x) => x;\nfunction g() { return 1; }", {"A", "A.run", "f", "g"}),
    ("a.java", "public class A {\n  @Override\n  public String go(int x) {\n    return \"{\";\n  }\n}", {"A", "A.go"}),
    ("a.go", "package a\ntype T struct {\n}\nfunc (t *T) Go(x int) {\n}\nfunc Free() {\n}", {"T", "T.Go", "Free"}),
    ("a.rs", "pub struct S {\n}\nimpl S {\n  fn go(&self) -> u32 { 1 }\n}\nfn free() {}", {"S", "S.go", "free"}),
    ("a.cs", "public class A : B {\n  public int Go(int x) {\n    return x;\n  }\n}", {"A", "A.Go"}),
    ("a.kt", "class A {\n  fun go(x: Int): Int { return x }\n}\nfun free() {}", {"A", "A.go", "free"}),
    ("a.cpp", "class A {\n};\nint free_one(int x) {\n  return x;\n}", {"A", "free_one"}),
])
def test_brace_parsers(path, text, names):
    assert {r[4] for r in parsers.parse_file(path, text) if r[0] == "symbol"} == names


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.py").write_text("x = 1")
    (tmp_path / "node_modules" / "y.js").write_text("y")
    (tmp_path / ".env").write_text("secret")
    (tmp_path / "package.json").write_text('{"dependencies": {"left": "1"}, "devDependencies": {"right": "2"}}')
    (tmp_path / "requirements.txt").write_text("# c\nFlask>=1\n-e .\n")
    (tmp_path / "suite.json").write_text('{"tasks": [{"id": "t1", "category": "c", "expected_grounding": ["a"]}]}')
    files, cut = S.scan_directory(spark, str(tmp_path))
    assert {r["file_path"] for r in files.collect()} == {"a/x.py", "package.json", "requirements.txt", "suite.json"} and cut.first()[0] is False
    assert {r["name"] for r in S.dependencies(S.read_text(files)).collect()} == {"left", "right", "flask"}
    assert S.read_suite(spark, str(tmp_path / "suite.json")).first()["id"] == "t1"
    out = spark.createDataFrame([("a", 'say "hi"', ["x", "y"])], "id string, prompt string, files array<string>")
    S.export_csv(out, str(tmp_path / "csv"))
    assert '"a","say ""hi""","2"' in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))


def test_markdown(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string").orderBy("k")
    assert S.markdown_table(df) == "| k | v |\n|---|---|\n| 1 | a\\|b |\n| 2 | - |"
    with pytest.raises(ValueError):
        S.markdown_table(df, 1)
