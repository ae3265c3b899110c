import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from lodestone.operators import graph
from lodestone.plans import anchor_queries, graph_queries, symbol_queries
from lodestone.session import shared_dir


def tables(folder, calls, symbols):
    """``candidates`` of calls (file, name) and ``symbols`` of functions (qualified name, file)."""
    pq.write_table(pa.table({"reason": [f"calls {n}" for _, n in calls], "file_path": [f for f, _ in calls]}), folder / "candidates.parquet")
    rows = [{"id": f"{f}::{q}#1", "name": q.split(".")[-1], "qualified_name": q, "kind": "function", "file_path": f} for q, f in symbols]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema({k: pa.string() for k in ("id", "name", "qualified_name", "kind", "file_path")})), folder / "symbols.parquet")
    return str(folder)


def written(spark):
    return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if p.is_file())


def test_entry_distance_of_many_entries_keeps_a_row_a_file(spark, tmp_path):
    """200 files call a name that 200 files define, which call the next: 80 000 edges and as many pairs of entry and file."""
    calls = [(f"in/{k}.py", "first") for k in range(200)] + [(f"mid/{k}.py", "second") for k in range(200)]
    symbols = [("first", f"mid/{k}.py") for k in range(200)] + [("second", f"low/{k}.py") for k in range(200)]
    d, before = tables(tmp_path, calls, symbols), written(spark)
    got = {(r["node"].split("/")[0], r["hops"]) for r in anchor_queries.entry_distance(spark, d).collect()}
    assert got == {("in", 0), ("mid", 1), ("low", 2)}
    assert written(spark) - before < 1_000_000


def test_entry_distance_of_own_names_cycles_and_both_names(spark, tmp_path):
    """A file's call of its own name is no edge, so it is an entry still; what only a cycle reaches has no distance; a simple name counts
    only where no symbol has it as its qualified name."""
    calls = [("a.py", "own"), ("a.py", "go"), ("b.py", "T.run"), ("c.py", "x.run"), ("p.py", "q"), ("q.py", "p"), ("alone.py", "alone"), ("./a.py", "go")]
    symbols = [("own", "a.py"), ("go", "b.py"), ("T.run", "c.py"), ("U.run", "d.py"), ("q", "q.py"), ("p", "p.py"), ("alone", "alone.py"), ("go", None)]
    got = {r["node"]: r["hops"] for r in anchor_queries.entry_distance(spark, tables(tmp_path, calls, symbols)).collect()}
    assert got == {"a.py": 0, "b.py": 1, "c.py": 2, "d.py": 3}


def whole(edges):
    """Communities by ``propagate`` of undirected ``(src, dst, weight)``, several of a pair summed."""
    adjacency: dict = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            near = adjacency.setdefault(x, {})
            near[y] = near.get(y, 0.0) + w
    label, low = graph.propagate(list(adjacency), adjacency), {}
    for n, x in label.items():
        low[x] = min(low.get(x, n), n)
    return {n: low[x] for n, x in label.items()}


def test_label_propagation_of_a_component_of_two_million_edges(spark, tmp_path):
    """1 001 files call a name that 1 001 files define: every caller takes the first definition's label, then every definition does."""
    d = tables(tmp_path, [(f"a/{k:04}.py", "go") for k in range(1001)], [("go", f"b/{k:04}.py") for k in range(1001)])
    got = graph_queries.label_propagation(spark, d).collect()
    assert len(got) == 2002 and {r["community"] for r in got} == {"a/0000.py"}


def test_label_propagation_of_calls_equals_the_whole_run(spark, tmp_path):
    """With own calls, symbols without a file, and callers that mean a symbol by both its names, which is one edge."""
    rnd = random.Random(3)
    names = [f"{c}.m{n}" for c in "ST" for n in range(20)]
    calls = [(f"f{rnd.randrange(60):02}.py", rnd.choice([*names, *(f"x.m{n}" for n in range(20)), "gone"])) for _ in range(70)]
    calls += [(f, n.replace(n[0], "x")) for f, n in calls[:10]]
    symbols = [(rnd.choice(names), rnd.choice([None, *(f"f{k:02}.py" for k in range(60))])) for _ in range(40)]
    d = tables(tmp_path, calls, symbols)
    edges = [(r["caller_file"], r["callee_file"], 1.0) for r in symbol_queries.call_edges(spark, d).collect() if r["callee_file"] not in (None, r["caller_file"])]
    got = {r["node"]: r["community"] for r in graph_queries.label_propagation(spark, d).collect()}
    assert got == whole(edges) and len(set(got.values())) > 1


def test_label_propagation_of_names_and_weights(spark):
    rnd = random.Random(4)
    edges = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}", rnd.randrange(1, 4)) for _ in range(70)]
    df = spark.createDataFrame([*edges, (None, "n1", 1), ("n2", None, 1)], "src string, dst string, weight int")
    assert {r["node"]: r["community"] for r in graph.label_propagation(df).collect()} == whole([e for e in edges if e[0] != e[1]])


def test_propagation_of_edges_cut_into_batches():
    rnd = random.Random(6)
    edges = [(a, b, float(rnd.randrange(1, 3))) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(150)) if a != b]
    rows = sorted([*edges, *((b, a, w) for a, b, w in edges)])
    for size in (1, 7, len(rows)):
        batches = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("src", "dst", "weight"))}).to_batches(size)
        got = {r["node"]: r["community"] for b in graph._propagated(iter(batches), graph.PASSES) for r in b.to_pylist()}
        assert got == whole(edges)
    assert not list(graph._propagated(iter([]), graph.PASSES))
