"""Queries of excerpts of source files and of symbol graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import packing as K
from ..operators import resolve as R
from ..session import table
from . import sql
from .ranking_queries import _PACK, budget_pack
from .symbol_queries import _S, _names, _res, _symbols


def _lines(spark, d):
    """Lines of the latest delivery of each file, line ends made uniform, invalid bytes replaced."""
    f = table(spark, d, "files").filter("file_path is not null and source_bytes is not null")
    f = f.groupBy("file_path").agg(F.max_by("source_bytes", F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))).alias("b"))
    return f.select("file_path", F.split(F.regexp_replace(F.make_valid_utf8(F.col("b").cast("string")), "\r\n|\r", "\n"), "\n").alias("ls"))


def symbol_sources(spark, d):
    """Lines of each symbol, with the comment lines directly above it."""
    j = _symbols(spark, d).filter("start_line > 0").select("id", "file_path", "start_line", "end_line").join(_lines(spark, d), "file_path")
    above = F.reverse(F.slice("ls", 1, F.col("start_line") - 1))
    comment = F.transform(above, lambda x: F.trim(x).rlike(r"^(#|//|\*|/\*)"))
    first = F.array_position(comment, False)
    lead = F.when(first > 0, first - 1).otherwise(F.size(comment)).cast("int")
    text = F.array_join(F.slice("ls", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    return j.select("id", lead.alias("comment_lines"), F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest"))


def body_starts(spark, d):
    """Lines of each function's head: up to the first line after which all its parentheses are closed."""
    j = _symbols(spark, d).filter("kind in ('function', 'method') and start_line > 0 and end_line >= start_line").select("id", "file_path", "start_line", "end_line").join(_lines(spark, d), "file_path")
    ls = F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return j.withColumn("s", ls).filter("size(s) > 0").select("id", K.head_lines(F.col("s")).alias("head"))


def skeletons(spark, d):
    """Lines of each file left when the inner lines of its functions are taken out, by number and digest."""
    fn = _symbols(spark, d).filter("kind in ('function', 'method') and end_line > start_line + 1 and file_path is not null")
    inner = fn.select("file_path", F.explode(F.sequence(F.col("start_line") + 1, F.col("end_line") - 1)).alias("n")).distinct()
    lines = _lines(spark, d).join(fn.select("file_path").distinct(), "file_path", "left_semi").select("file_path", F.posexplode("ls").alias("n", "line")).withColumn("n", F.col("n") + 1)
    kept = lines.join(inner, ["file_path", "n"], "left_anti")
    return kept.groupBy("file_path").agg(F.count("*").alias("lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")).alias("digest"))


def prompt_compile(spark, d):
    """Headers of the files that are packed for each resolution, in the order of their rank."""
    p = budget_pack(spark, d).filter("packed")
    return p.groupBy("resolution_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "file_path"))), lambda x: F.concat(F.lit("### "), x["file_path"])), "\n").alias("prompt"))


def symbol_graph(spark, d):
    """Symbols joined to their parents (weight 2) and to symbols of the names they extend (weight 1)."""
    s = _symbols(spark, d)
    up = s.filter("parent_id is not null").join(s.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"), F.lit(2).alias("w"))
    base = R.inheritance_edges(s).select(F.col("child").alias("src"), F.col("base").alias("dst"), F.lit(1).alias("w"))
    return up.unionByName(base).groupBy("src", "dst").agg(F.sum("w").alias("weight"))


def declaration_seeds(spark, d):
    """Symbols whose whole name a question's word is, whatever its case."""
    q = table(spark, d, "eval_items").select("item_id", F.explode(F.array_distinct(F.transform(T.words(F.coalesce("task_prompt", F.lit(""))), F.lower))).alias("low"))
    s = _symbols(spark, d).select("id", F.lower("name").alias("low"))
    return q.join(s, "low").groupBy("item_id", F.col("low").alias("word")).agg(F.count("*").alias("symbols"), F.min("id").alias("first_id"))


def name_candidates(spark, d):
    """Files for every named symbol: those that define it before those that use it, one reason each."""
    n = _names(spark, d)
    defining = R.resolve(n.select("raw_name").distinct(), "raw_name", _symbols(spark, d)).filter("symbol_file is not null").select("raw_name", F.col("symbol_file").alias("file_path"), F.lit(0).alias("p"))
    using = n.select("raw_name", F.col("context_file").alias("file_path"), F.lit(1).alias("p"))
    u = defining.unionByName(using).groupBy("raw_name", "file_path").agg(F.min("p").alias("p"))
    r = F.row_number().over(Window.partitionBy("raw_name").orderBy("p", "file_path"))
    return u.select("raw_name", "file_path", F.when(F.col("p") == 0, "defines").otherwise("uses").alias("reason"), r.alias("position"))


QUERIES = {f.__name__: f for f in (symbol_sources, body_starts, skeletons, prompt_compile, symbol_graph, declaration_seeds, name_candidates)}

_L = r"fl AS (SELECT file_path, string_split(regexp_replace(decode(arg_max(source_bytes, ingested_at)), '\r\n|\r', chr(10), 'g'), chr(10)) AS ls FROM files WHERE file_path IS NOT NULL AND source_bytes IS NOT NULL GROUP BY 1)"
_DEPTH = "(length(array_to_string(s[:i], '')) - length(replace(array_to_string(s[:i], ''), '(', ''))) - (length(array_to_string(s[:i], '')) - length(replace(array_to_string(s[:i], ''), ')', '')))"

ORACLE = {
    "symbol_sources": rf"""WITH {_S}, {_L}, j AS (SELECT id, start_line, end_line, ls FROM s JOIN fl USING (file_path) WHERE start_line > 0),
        c AS (SELECT *, list_position(list_transform(list_reverse(ls[:start_line - 1]), lambda x: regexp_matches(trim(x, ' '), '^(#|//|\*|/\*)')), false) AS k FROM j)
        SELECT id, CASE WHEN coalesce(k, 0) > 0 THEN k - 1 ELSE least(start_line - 1, len(ls)) END AS comment_lines, length(array_to_string(ls[start_line:end_line], chr(10))) AS chars, md5(array_to_string(ls[start_line:end_line], chr(10))) AS digest FROM c""",
    "body_starts": f"""WITH {_S}, {_L}, j AS (SELECT id, ls[start_line:end_line] AS s FROM s JOIN fl USING (file_path) WHERE kind IN ('function', 'method') AND start_line > 0 AND end_line >= start_line),
        x AS (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM j), m AS (SELECT id, min(i) FILTER ({_DEPTH} <= 0) AS head, any_value(len(s)) AS n FROM x GROUP BY 1)
        SELECT id, coalesce(head, n) AS head FROM m""",
    "skeletons": f"""WITH {_S}, {_L}, fn AS (SELECT * FROM s WHERE kind IN ('function', 'method') AND end_line > start_line + 1 AND file_path IS NOT NULL),
        i AS (SELECT DISTINCT file_path, unnest(range(start_line + 1, end_line)) AS n FROM fn),
        l AS (SELECT file_path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM fl WHERE file_path IN (SELECT file_path FROM fn))
        SELECT file_path, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM l WHERE (file_path, n) NOT IN (SELECT (file_path, n) FROM i) GROUP BY 1""",
    "prompt_compile": f"{_PACK} SELECT resolution_id, string_agg('### ' || file_path, chr(10) ORDER BY position) AS prompt FROM g WHERE packed GROUP BY 1",
    "symbol_graph": f"""WITH {_S}, b AS (SELECT id AS child, unnest(base_names) AS base_name FROM s WHERE kind IN ('class', 'interface')),
        e AS (SELECT id AS src, parent_id AS dst, 2 AS w FROM s WHERE parent_id IN (SELECT id FROM s) UNION ALL SELECT DISTINCT child, id, 1 FROM ({_res('b', 'base_name', 'child', chr(39) + 'class' + chr(39) + ', ' + chr(39) + 'interface' + chr(39))}))
        SELECT src, dst, sum(w)::BIGINT AS weight FROM e GROUP BY 1, 2""",
    "declaration_seeds": f"""WITH {_S}, q AS (SELECT DISTINCT item_id, lower(unnest({sql.words('task_prompt')})) AS low FROM eval_items)
        SELECT item_id, low AS word, count(*) AS symbols, min(id) AS first_id FROM q JOIN s ON lower(name) = low GROUP BY 1, 2""",
    "name_candidates": rf"""WITH {_S}, n AS (SELECT DISTINCT regexp_replace(reason, '^\S+ ', '') AS raw_name, regexp_replace(file_path, '^(\./)+', '') AS context_file FROM candidates WHERE regexp_matches(reason, '^(defines|calls|extends) ') AND file_path IS NOT NULL),
        k AS (SELECT DISTINCT raw_name FROM n), u AS (SELECT raw_name, symbol_file AS file_path, 0 AS p FROM ({_res('k', 'raw_name', 'raw_name')}) WHERE symbol_file IS NOT NULL UNION ALL SELECT raw_name, context_file, 1 FROM n),
        m AS (SELECT raw_name, file_path, min(p) AS p FROM u GROUP BY 1, 2)
        SELECT raw_name, file_path, CASE WHEN p = 0 THEN 'defines' ELSE 'uses' END AS reason, row_number() OVER (PARTITION BY raw_name ORDER BY p, file_path) AS position FROM m""",
}
