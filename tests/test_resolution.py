import pytest

from lodestone.operators import graph as G
from lodestone.operators import resolve as R

SYMBOLS = "id string, name string, qualified_name string, kind string, file_path string, base_names array<string>, extra string"


def symbols(spark):
    rows = [
        ("a/x.py::load#1", "load", "load", "function", "a/x.py", None, "q"), ("b/y.py::load#1", "load", "load", "function", "b/y.py", None, "q"), ("a/z.py::run#1", "run", "run", "function", "a/z.py", None, None),
        ("a/x.py::Base#9", "Base", "Base", "class", "a/x.py", [], None), ("c/w.py::Child#1", "Child", "Child", "class", "c/w.py", ["pkg.Base", "Other"], None), ("c/w.py::Child#1", "Child", "Child", "class", "c/w.py", ["pkg.Base", "Other"], None),
        (None, None, None, None, None, None, None), ("c/w.py::go#5", "go", "Child.go", "method", "c/w.py", None, None),
    ]
    return R.distinct_symbols(spark.createDataFrame(rows, SYMBOLS))


def test_candidate_set(spark):
    names = spark.createDataFrame([("load",), ("Base",), ("gone",), (None,)], "name string")
    calls = spark.createDataFrame([("a/z.py", "a/x.py::load#1"), ("c/w.py", "a/x.py::load#1"), ("a/x.py", "a/x.py::load#1")], "caller_file string, callee string")
    got = {(r["name"], r["file_path"]): (r["hop"], r["tier"], r["chain"], r["confidence"]) for r in R.candidate_set(names, symbols(spark), calls).collect()}
    assert got == {
        ("load", "a/x.py"): (0, "primary", "defines load", 0.6309), ("load", "b/y.py"): (0, "primary", "defines load", 0.6309), ("load", "a/z.py"): (1, "supporting", "defines load > calls load", 0.6309),
        ("Base", "a/x.py"): (0, "primary", "defines Base", 1.0), ("Base", "c/w.py"): (1, "supporting", "defines Base > extends Base", 1.0),
    }


def test_symbol_calls_are_local_by_place_or_import(spark):
    calls = spark.createDataFrame([("a/z.py", "a/z.py::run#1", "load"), ("c/w.py", "c/w.py::go#5", "run"), ("c/w.py", None, "load")], "file_path string, caller_id string, name string")
    imports = spark.createDataFrame([("c/w.py", "a/z.py"), ("c/w.py", None)], "file_path string, resolved string")
    edges = lambda i: {(r["src"], r["dst"]) for r in R.symbol_calls(calls, symbols(spark), i).collect()}
    assert edges(None) == {("a/z.py::run#1", "a/x.py::load#1")}
    assert edges(imports) == {("a/z.py::run#1", "a/x.py::load#1"), ("c/w.py::go#5", "a/z.py::run#1")}


def test_inheritance_edges_and_chains(spark):
    assert {(r["child"], r["base"]) for r in R.inheritance_edges(symbols(spark)).collect()} == {("c/w.py::Child#1", "a/x.py::Base#9")}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a")], "src string, dst string")
    layers = G.bfs(edges, spark.createDataFrame([("a",)], "start string"), 3)
    assert {(r["node"], r["hop"], tuple(r["chain"])) for r in G.chains(layers).collect()} == {("b", 1, ("a", "b")), ("c", 1, ("a", "c")), ("d", 2, ("a", "c", "d"))}
    assert G.chains(layers.limit(0)).count() == 0


def test_a_cluster_needs_its_shared_folder():
    from lodestone.session import shared_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(ValueError):
        shared_dir(Session())
