"""Queries of the parsers over the scanned files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import graph as G
from ..operators import packing as K
from ..operators import resolve as R
from ..sources import files as S
from ..sources import parsers as L
from ..session import shared_dir, ship, table


def _latest(spark, d):
    f = table(spark, d, "files").filter("file_path is not null")
    return f.groupBy("file_path").agg(F.max_by("source_bytes", F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))).alias("source_bytes"))


def parse_symbols(spark, d):
    """Symbols that the parsers find in files for which the symbol table has any."""
    ship(spark)
    s = L.facts(_latest(spark, d)).filter("fact = 'symbol'").select("file_path", "id", "name", "qualified_name", "kind", "start_line", "end_line", "parent_id")
    return s.join(table(spark, d, "symbols").select("file_path").distinct(), "file_path", "left_semi").distinct()


def parse_calls(spark, d):
    """The names each function calls, resolved nowhere yet."""
    ship(spark)
    return L.facts(_latest(spark, d)).filter("fact = 'call'").groupBy("file_path", F.col("id").alias("caller_id"), "name").agg(F.count("*").alias("calls"))


def parse_imports(spark, d):
    ship(spark)
    f = _latest(spark, d)
    return L.resolved_imports(L.facts(f).filter("fact = 'import'").select("file_path", "name").distinct(), f.select("file_path"))


def _parsed_calls(spark, d):
    """Local calls between symbols, from parsed calls and imports."""
    ship(spark)
    f = _latest(spark, d)
    facts = L.facts(f)
    calls = facts.filter("fact = 'call'").select("file_path", F.col("id").alias("caller_id"), "name").distinct()
    imports = L.resolved_imports(facts.filter("fact = 'import'").select("file_path", "name").distinct(), f.select("file_path"))
    return R.symbol_calls(calls, R.distinct_symbols(table(spark, d, "symbols")), imports)


def parsed_call_edges(spark, d):
    return _parsed_calls(spark, d)


def call_chains(spark, d):
    """Symbols within three hops that call each called symbol, nearest first, with the chain of calls that leads to it."""
    shared_dir(spark)
    back = _parsed_calls(spark, d).filter("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")).checkpoint()
    reached = G.chains(G.bfs(back, back.select(F.col("src").alias("start")), 3))
    return reached.select("start", "node", "hop", F.array_join("chain", " < ").alias("chain"))


def parse_decorators(spark, d):
    """Decorators by full name and by last segment."""
    ship(spark)
    x = L.facts(_latest(spark, d)).filter("fact = 'decorator'").select("name")
    return x.groupBy("name", F.substring_index("name", ".", -1).alias("last_segment")).agg(F.count("*").alias("symbols"))


def call_site_ranges(spark, d):
    """Lines around the calls that candidates are offered for, eight above and below, merged: the excerpts of compressed files."""
    ship(spark)
    c = table(spark, d, "candidates").filter("reason like 'calls %' and file_path is not null")
    wanted = c.select(P.clean(F.col("file_path")).alias("file_path"), F.substring_index(F.regexp_replace("reason", r"^\S+ ", ""), ".", -1).alias("name")).distinct()
    calls = L.facts(_latest(spark, d)).filter("fact = 'call'").select("file_path", "name", "start_line").distinct()
    return K.merged_intervals(calls.join(wanted, ["file_path", "name"]), ["file_path", "name"], "start_line", "start_line", K.CALL_WINDOW)


def doc_prose(spark, d):
    f = table(spark, d, "files").filter("file_path is not null").groupBy("repo", "file_path").agg(F.max_by("source_bytes", F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))).alias("source_bytes"))
    return S.doc_prose(f).select("repo", "file_path", F.length("content").cast("bigint").alias("chars"))


QUERIES = {f.__name__: f for f in (parse_symbols, parse_calls, parse_imports, parse_decorators, call_site_ranges, doc_prose, parsed_call_edges, call_chains)}

ORACLE = {
    "parse_symbols": "SELECT DISTINCT file_path, id, name, qualified_name, kind, start_line, end_line, parent_id FROM symbols",
    "doc_prose": r"""WITH f AS (SELECT repo, file_path, arg_max(source_bytes, ingested_at) AS b FROM files WHERE file_path IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT * FROM f WHERE regexp_matches(lower(regexp_replace(file_path, '^.*/', '')), '^(readme|changelog|contributing|history)(\.\w+)?$') OR lower(regexp_extract(file_path, '[^/](\.[^./]+)$', 1)) IN ('.md', '.rst', '.txt'))
        SELECT repo, file_path, least(length(decode(b)), 50000) AS chars FROM p QUALIFY row_number() OVER (PARTITION BY repo ORDER BY file_path) <= 200""",
}
