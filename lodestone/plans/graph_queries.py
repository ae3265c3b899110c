"""Queries of graphs: trade between nations, calls between files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import resolve as R
from ..session import ship, table
from .symbol_queries import _EDGES, _calls, _symbols, call_edges


def _trade(spark, d):
    """Nations joined by what customers of one buy from suppliers of the other; nations are a fixed dimension."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("src", "dst").agg(F.sum("n").alias("weight"))


def _both(spark, d):
    return G.undirected(_trade(spark, d), "weight")


def _strongest(spark, d):
    """The two strongest directed edges of each nation."""
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return _trade(spark, d).filter("src != dst").withColumn("r", r).filter("r <= 2").select("src", "dst", "weight")


def _regions(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))


def trade_edges(spark, d):
    return _both(spark, d)


def bridge_scores(spark, d):
    c = G.communities(_both(spark, d), _regions(spark, d))
    return c.select("node", "community", "degree", F.round("bridge", 6).alias("bridge"), F.round("centrality", 6).alias("centrality"))


def modularity(spark, d):
    return G.modularity(_both(spark, d), _regions(spark, d)).select(F.round("modularity", 6).alias("modularity"))


def personalized_pagerank(spark, d):
    seeds = table(spark, d, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    return G.pagerank(_both(spark, d), seeds, tolerance=0).select("node", F.round("rank", 6).alias("rank"))


def bfs_layers(spark, d):
    """Layers around every nation of region 0 along the strongest edges."""
    starts = table(spark, d, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("start"))
    return G.bfs(_strongest(spark, d), starts)


def khop_subgraph(spark, d):
    """Edges between the nodes within two hops of nation 0."""
    e = _strongest(spark, d)
    near = G.bfs(e, spark.range(1).select(F.col("id").cast("int").alias("start")), 2).select("node").union(spark.range(1).select(F.col("id").cast("int"))).distinct()
    return e.join(near.select(F.col("node").alias("src")), "src", "left_semi").join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")


def file_components(spark, d):
    """Connected components of files by calls."""
    e = call_edges(spark, d).select(F.col("caller_file").alias("src"), F.col("callee_file").alias("dst"))
    return G.components(e)


def fan_profile(spark, d):
    """Fan-in and fan-out of files by calls."""
    e = call_edges(spark, d).filter("caller_file != callee_file").select("caller_file", "callee_file").distinct()
    o = e.groupBy(F.col("caller_file").alias("file_path")).agg(F.count("*").alias("fan_out"))
    i = e.groupBy(F.col("callee_file").alias("file_path")).agg(F.count("*").alias("fan_in"))
    return o.join(i, "file_path", "full").select("file_path", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def label_propagation(spark, d):
    """Communities of files by calls: an edge for each file that calls a symbol and the file that defines it. They are made of numbers and
    only on their way to the task that needs them; components are found from a link to the first caller of a name for all files of it."""
    ship(spark)
    calls, defs = R.call_parts(_calls(spark, d), _symbols(spark, d))
    twice = F.count("*").over(Window.partitionBy("callee")) > 1  # a caller may mean it by both its names, which is one edge
    defs = defs.filter("callee_file is not null").select("called", F.when(twice, F.col("callee")).alias("callee"), "callee_file").checkpoint()
    names = G.numbered(calls.select(F.col("caller_file").alias("node")).union(defs.select("callee_file")))
    out = G.exchanged(calls.join(defs.select("called").distinct(), "called", "left_semi"), names, "number", "caller_file").select(F.col("caller_file").alias("src"), "called").checkpoint()
    into = G.exchanged(defs, names, "number", "callee_file").select("called", "callee", F.col("callee_file").alias("dst")).checkpoint()
    first = out.groupBy("called").agg(F.min("src").alias("first"))
    links = out.select("called", "src").union(into.select("called", "dst")).join(first, "called").select("src", F.col("first").alias("dst")).distinct()
    pairs = out.join(into, "called")
    edges = pairs.filter("callee is null").select("src", "dst").union(pairs.filter("callee is not null").select("src", "callee", "dst").distinct().select("src", "dst"))
    return G.exchanged(G.label_propagation(edges, links=links), names, "node", "node", "community").select("node", "community")


def betweenness(spark, d):
    ship(spark)
    return G.betweenness(_strongest(spark, d)).select("node", F.round("betweenness", 6).alias("betweenness"))


QUERIES = {f.__name__: f for f in (trade_edges, bridge_scores, modularity, personalized_pagerank, bfs_layers, khop_subgraph, file_components, fan_profile, label_propagation, betweenness)}

_TRADE = """tr AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    e AS (SELECT src, dst, sum(weight)::BIGINT AS weight FROM (SELECT * FROM tr UNION ALL SELECT dst, src, weight FROM tr) WHERE src <> dst GROUP BY 1, 2)"""
_STRONG = f"{_TRADE}, st AS (SELECT src, dst, weight FROM tr WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 2)"
_COMM = f"""{_TRADE}, m AS (SELECT n_nationkey AS node, n_regionkey AS community FROM nation),
    dg AS (SELECT src AS node, sum(weight) AS degree, coalesce(sum(weight) FILTER (a.community = b.community), 0) AS inn FROM e JOIN m a ON src = a.node JOIN m b ON dst = b.node GROUP BY 1),
    cm AS (SELECT m.node, community, coalesce(degree, 0)::BIGINT AS degree, coalesce(inn, 0) AS inn FROM m LEFT JOIN dg USING (node))"""
_STEP = "p{n} AS (SELECT n.node, 0.85 * coalesce((SELECT sum(rank * p) FROM p{m} r JOIN t ON r.node = t.src WHERE t.dst = n.node), 0) + 0.15 * coalesce(s, 0) AS rank FROM (SELECT DISTINCT dst AS node FROM t JOIN p{m} ON src = node UNION SELECT node FROM sd) n LEFT JOIN sd USING (node))"
_BFS = f"""WITH RECURSIVE {_STRONG}, st0 AS (SELECT n_nationkey AS start FROM nation WHERE {{seed}}),
    w AS (SELECT start, start AS node, 0 AS hop FROM st0 UNION SELECT w.start, st.dst, hop + 1 FROM w JOIN st ON st.src = w.node WHERE hop < {{depth}}),
    mh AS (SELECT start, node, min(hop) AS hop FROM w GROUP BY 1, 2)"""

ORACLE = {
    "trade_edges": f"WITH {_TRADE} SELECT * FROM e",
    "bridge_scores": f"WITH {_COMM} SELECT node, community, degree, round(CASE WHEN degree > 0 THEN (degree - inn) / degree ELSE 0 END, 6) AS bridge, round(degree / (SELECT max(degree) FROM cm), 6) AS centrality FROM cm",
    "modularity": f"WITH {_COMM}, c AS (SELECT community, sum(degree) AS tot, sum(inn) AS inn FROM cm GROUP BY 1) SELECT round(sum(inn / (SELECT sum(tot) FROM c) - pow(tot / (SELECT sum(tot) FROM c), 2)), 6) AS modularity FROM c",
    "personalized_pagerank": f"WITH {_TRADE}, t AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e), sd AS (SELECT n_nationkey AS node, 1 / count(*) OVER () AS s FROM nation WHERE n_regionkey = 0), p0 AS (SELECT node, s AS rank FROM sd), " + ", ".join(_STEP.format(n=k, m=k - 1) for k in range(1, G.ITERATIONS + 1)) + f" SELECT node, round(rank, 6) AS rank FROM p{G.ITERATIONS}",
    "bfs_layers": _BFS.format(seed="n_regionkey = 0", depth=20) + """ SELECT a.start, a.node, a.hop, min(b.node) AS parent FROM mh a JOIN mh b ON b.start = a.start AND b.hop = a.hop - 1 JOIN st ON st.src = b.node AND st.dst = a.node WHERE a.hop > 0 GROUP BY 1, 2, 3""",
    "khop_subgraph": _BFS.format(seed="n_nationkey = 0", depth=2) + " SELECT src, dst, weight FROM st WHERE src IN (SELECT node FROM mh) AND dst IN (SELECT node FROM mh)",
    "file_components": f"""WITH RECURSIVE {_EDGES}, u AS (SELECT DISTINCT caller_file AS src, callee_file AS dst FROM e WHERE caller_file <> callee_file UNION SELECT callee_file, caller_file FROM e WHERE caller_file <> callee_file),
        r AS (SELECT DISTINCT src AS node, src AS other FROM u UNION SELECT r.node, u.dst FROM r JOIN u ON u.src = r.other) SELECT node, min(other) AS component FROM r GROUP BY 1""",
    "fan_profile": f"""WITH {_EDGES}, x AS (SELECT DISTINCT caller_file, callee_file FROM e WHERE caller_file <> callee_file), o AS (SELECT caller_file AS file_path, count(*) AS fan_out FROM x GROUP BY 1), i AS (SELECT callee_file AS file_path, count(*) AS fan_in FROM x GROUP BY 1)
        SELECT file_path, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in FROM o FULL JOIN i USING (file_path)""",
}
