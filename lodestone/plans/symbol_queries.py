"""Queries of name resolution over the symbols and the names that candidates' reasons give."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import resolve as R
from ..session import table


def _symbols(spark, d):
    return R.distinct_symbols(table(spark, d, "symbols"))


def _names(spark, d, verb: str | None = None):
    """Names that reasons give, with the file they are given for."""
    c = table(spark, d, "candidates").filter("reason is not null and file_path is not null")
    c = c.filter(F.col("reason").startswith(verb + " ")) if verb else c.filter(F.col("reason").rlike("^(defines|calls|extends) "))
    return c.select(F.regexp_replace("reason", r"^\S+ ", "").alias("raw_name"), P.clean(F.col("file_path")).alias("context_file")).distinct()


def name_resolution(spark, d):
    return R.resolve(_names(spark, d), "raw_name", _symbols(spark, d)).select("raw_name", "context_file", "id")


def resolve_disambiguated(spark, d):
    return R.disambiguate(R.resolve(_names(spark, d), "raw_name", _symbols(spark, d)), ["raw_name", "context_file"], "context_file")


def unresolved_refs(spark, d):
    n, s = _names(spark, d), _symbols(spark, d)
    return n.join(R.resolve(n, "raw_name", s).select("raw_name").distinct(), "raw_name", "left_anti")


def _calls(spark, d):
    return _names(spark, d, "calls").select(F.col("raw_name").alias("callee_name"), F.col("context_file").alias("caller_file"))


def call_edges(spark, d):
    return R.call_edges(_calls(spark, d), _symbols(spark, d))


def callers_of(spark, d):
    """Files that define a called name, or call it, by name."""
    calls = _names(spark, d, "calls").select(F.substring_index("raw_name", ".", -1).alias("name"), F.col("context_file").alias("file_path"))
    s = _symbols(spark, d).filter(F.col("kind").isin("function", "method")).select("name", "file_path").join(calls.select("name").distinct(), "name", "left_semi")
    known = calls.join(s.select("name").distinct(), "name", "left_semi")
    return s.unionByName(known).distinct()


def local_callers(spark, d):
    """Callers of a name in a file that share its directory."""
    e = call_edges(spark, d)
    return e.filter(P.dirname(F.col("caller_file")) == P.dirname(F.col("callee_file"))).groupBy("callee").agg(F.countDistinct("caller_file").alias("local_callers"))


def package_specificity(spark, d):
    """Of each called symbol: distinct calling packages, callers, and callers in its own package."""
    e = call_edges(spark, d)
    p = P.dirname(F.col("caller_file"))
    return e.groupBy("callee").agg(F.countDistinct(p).alias("packages"), F.countDistinct("caller_file").alias("callers"), F.count_if(p == P.dirname(F.col("callee_file"))).alias("own_package"))


def inheritance_edges(spark, d):
    return R.inheritance_edges(_symbols(spark, d))


def unresolved_bases(spark, d):
    return R.unresolved_bases(_symbols(spark, d))


def precise_names(spark, d):
    return R.name_counts(_symbols(spark, d)).filter(F.col("matches") <= R.PRECISE)


def class_anchor_methods(spark, d):
    names = _names(spark, d, "extends").select(F.col("raw_name").alias("name")).union(_names(spark, d, "defines").select("raw_name")).distinct()
    return R.class_anchors(names, _symbols(spark, d))


def constructor_enrich(spark, d):
    ext = P.extension(F.col("file_path"))
    lang = F.when(ext == ".py", "python").when(ext == ".ts", "typescript").when(ext == ".js", "javascript").when(ext == ".java", "java")
    return R.constructors(_symbols(spark, d), lang)


def member_containment(spark, d):
    """Members within and outside the lines of their parent."""
    s = _symbols(spark, d)
    p = s.select(F.col("id").alias("parent_id"), F.col("start_line").alias("ps"), F.col("end_line").alias("pe"))
    j = s.join(p, "parent_id").withColumn("inside", P.is_within(F.col("start_line"), F.col("end_line"), F.col("ps"), F.col("pe")))
    return j.groupBy("parent_id").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"))


def scoring_units(spark, d):
    """Files of up to eight top-level symbols are one unit; of others, every top-level symbol is one."""
    s = _symbols(spark, d).filter("file_path is not null and parent_id is null").withColumn("n", F.count("*").over(Window.partitionBy("file_path")))
    return s.select("file_path", F.when(F.col("n") <= 8, F.col("file_path")).otherwise(F.col("id")).alias("unit")).distinct()


def suffix_join(spark, d):
    """Imported modules by the smallest file whose path ends with the module's name and an extension."""
    m = table(spark, d, "candidates").filter(F.col("reason").startswith("imports ")).select(F.explode(F.transform(F.array(*[F.lit(x) for x in (".py", ".ts", ".js", ".go", ".rs", ".java")]), lambda x: F.concat(F.regexp_replace("reason", r"^\S+ ", ""), x))).alias("raw_path")).distinct()
    return R.suffix_targets(m, table(spark, d, "files").select("file_path").distinct())


def probe_names(spark, d):
    """Symbol names that contain a probe prefix of a question, by the number of prefixes hit; the twenty best of each question.
    The questions are a fixed set; distinct prefixes are joined to the names' own parts of that length, so nothing is crossed."""
    s = R.name_counts(_symbols(spark, d)).filter(F.col("matches") <= R.PRECISE).withColumn("low", F.lower("name"))
    grams = s.filter(F.length("low") >= T.PROBE).select("name", "matches", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - T.PROBE + 1), lambda k: F.substring(F.col("low"), k, F.lit(T.PROBE))))).alias("prefix"))
    q = table(spark, d, "eval_items").select("item_id", F.explode(T.probe_prefixes(F.col("task_prompt"))).alias("prefix"))
    h = q.join(grams, "prefix").groupBy("item_id", "name", "matches").agg(F.count("*").alias("hits"))
    return h.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "matches", "name"))).filter("rank <= 20")


def subsystem_localize(spark, d):
    """Directories, up to three levels deep, by the share of a question's prefixes that their name, their files' names or their symbols' names
    contain; the best five of each question, the larger of equal ones first."""
    up = lambda p: F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(3))), lambda n: F.array_join(F.slice(p, 1, n), "/"))).alias("directory")
    files = table(spark, d, "files").select("file_path").unionByName(table(spark, d, "symbols").select("file_path")).filter("file_path like '%/%'").distinct()
    below = files.select("file_path", up(F.split(P.dirname(F.col("file_path")), "/")))
    names = below.select("directory", F.lower(P.basename(F.col("file_path"))).alias("low")).unionByName(below.select("directory", F.lower(P.basename(F.col("directory"))).alias("low")))
    of_file = table(spark, d, "symbols").filter("name is not null").select("file_path", F.lower("name").alias("low")).distinct()
    names = names.unionByName(below.join(of_file, "file_path").select("directory", "low")).distinct()
    grams = names.filter(F.length("low") >= T.PROBE).select("directory", F.explode(F.transform(F.sequence(F.lit(1), F.length("low") - T.PROBE + 1), lambda k: F.substring(F.col("low"), k, F.lit(T.PROBE)))).alias("prefix")).distinct()
    q = table(spark, d, "eval_items").select("item_id", T.probe_prefixes(F.col("task_prompt")).alias("p")).filter(F.size("p") > 0)
    q = q.select("item_id", F.size("p").alias("n"), F.explode("p").alias("prefix"))
    h = q.join(grams, "prefix").groupBy("item_id", "directory", "n").agg(F.count("*").alias("hits")).withColumn("confidence", F.round(F.col("hits") / F.col("n"), 6))
    h = h.join(below.groupBy("directory").agg(F.count("*").alias("files")), "directory")
    r = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("confidence"), F.desc("files"), "directory"))
    return h.withColumn("rank", r).filter("rank <= 5").select("item_id", "directory", "confidence", "rank")


def resolve_candidates(spark, d):
    """Name resolution to a candidate set: for each name that reasons define, the files that define it, those nearby that call it, and those
    whose types extend it, each file by its first admission, with the chain that justifies it and the confidence of an ambiguous name."""
    return R.candidate_set(_names(spark, d, "defines").select(F.col("raw_name").alias("name")).distinct(), _symbols(spark, d), call_edges(spark, d))


QUERIES = {f.__name__: f for f in (name_resolution, resolve_disambiguated, unresolved_refs, call_edges, callers_of, local_callers, package_specificity, inheritance_edges, unresolved_bases, precise_names, class_anchor_methods, constructor_enrich, member_containment, scoring_units, suffix_join, probe_names, subsystem_localize, resolve_candidates)}

_S = "s AS (SELECT * FROM symbols WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id) = 1)"


def _n(verbs: str, name: str = "n") -> str:
    return rf"{name} AS (SELECT DISTINCT regexp_replace(reason, '^\S+ ', '') AS raw_name, regexp_replace(file_path, '^(\./)+', '') AS context_file FROM candidates WHERE regexp_matches(reason, '^({verbs}) ') AND file_path IS NOT NULL)"


def _res(n: str, name: str, keys: str, kinds: str = "") -> str:
    """Resolution of the rows of ``n`` as a query."""
    simple = f"string_split({name}, '.')[-1]"
    where = f" WHERE kind IN ({kinds})" if kinds else ""
    return f"""SELECT {keys}, s.id, s.file_path AS symbol_file FROM {n} JOIN s ON {name} = s.qualified_name{where}
        UNION ALL SELECT {keys}, s.id, s.file_path FROM {n} JOIN s ON {simple} = s.name{where}{' AND' if where else ' WHERE'} {name} NOT IN (SELECT qualified_name FROM s WHERE qualified_name IS NOT NULL)"""


def _dir(p: str) -> str:
    return f"CASE WHEN {p} LIKE '%/%' THEN regexp_replace({p}, '/[^/]*$', '') ELSE '' END"


_ALL = _n("defines|calls|extends")
_EDGES = f"{_S}, {_n('calls')}, e AS (SELECT DISTINCT context_file AS caller_file, id AS callee, symbol_file AS callee_file FROM ({_res('n', 'raw_name', 'context_file', chr(39) + 'function' + chr(39) + ', ' + chr(39) + 'method' + chr(39))}))"
_PRE = """w AS (SELECT item_id, unnest(regexp_extract_all(coalesce(task_prompt, ''), '[A-Za-z][A-Za-z0-9_]*')) AS w FROM eval_items)"""


def _prefixes() -> str:
    from . import sql

    return f"{_PRE}, q AS (SELECT DISTINCT item_id, left(lower(w), 6) AS prefix FROM w WHERE length(w) >= 6 AND lower(w) NOT IN ({sql.STOP}))"


ORACLE = {
    "name_resolution": f"WITH {_S}, {_ALL} SELECT raw_name, context_file, id FROM ({_res('n', 'raw_name', 'raw_name, context_file')})",
    "resolve_disambiguated": f"""
        WITH {_S}, {_ALL}, r AS ({_res('n', 'raw_name', 'raw_name, context_file')}),
        c AS (SELECT *, coalesce(CASE WHEN context_file = symbol_file THEN 3 WHEN {_dir('context_file')} = {_dir('symbol_file')} THEN 2 ELSE 0 END, 0) AS score FROM r),
        b AS (SELECT *, max(score) OVER (PARTITION BY raw_name, context_file) AS best FROM c)
        SELECT raw_name, context_file, count(*) AS matches, any_value(best) AS best, CASE WHEN count(*) FILTER (score = best) = 1 THEN min(id) FILTER (score = best) END AS preferred,
          count(*) FILTER (score = best) > 1 AS ambiguous FROM b GROUP BY 1, 2""",
    "unresolved_refs": f"WITH {_S}, {_ALL}, r AS ({_res('n', 'raw_name', 'raw_name, context_file')}) SELECT * FROM n WHERE raw_name NOT IN (SELECT raw_name FROM r)",
    "call_edges": f"WITH {_EDGES} SELECT * FROM e",
    "callers_of": f"""
        WITH {_S}, {_n('calls')}, c AS (SELECT DISTINCT string_split(raw_name, '.')[-1] AS name, context_file AS file_path FROM n),
        f AS (SELECT name, file_path FROM s WHERE kind IN ('function', 'method') AND name IN (SELECT name FROM c))
        SELECT name, file_path FROM f UNION SELECT name, file_path FROM c WHERE name IN (SELECT name FROM f)""",
    "local_callers": f"WITH {_EDGES} SELECT callee, count(DISTINCT caller_file) AS local_callers FROM e WHERE {_dir('caller_file')} = {_dir('callee_file')} GROUP BY 1",
    "package_specificity": f"WITH {_EDGES} SELECT callee, count(DISTINCT {_dir('caller_file')}) AS packages, count(DISTINCT caller_file) AS callers, count(*) FILTER ({_dir('caller_file')} = {_dir('callee_file')}) AS own_package FROM e GROUP BY 1",
    "inheritance_edges": f"WITH {_S}, b AS (SELECT id AS child, unnest(base_names) AS base_name FROM s WHERE kind IN ('class', 'interface')) SELECT DISTINCT child, id AS base FROM ({_res('b', 'base_name', 'child', chr(39) + 'class' + chr(39) + ', ' + chr(39) + 'interface' + chr(39))})",
    "unresolved_bases": f"""WITH {_S}, t AS (SELECT * FROM s WHERE kind IN ('class', 'interface')), b AS (SELECT DISTINCT id AS child, unnest(base_names) AS base_name FROM t)
        SELECT * FROM b WHERE string_split(base_name, '.')[-1] NOT IN (SELECT name FROM t WHERE name IS NOT NULL UNION SELECT qualified_name FROM t WHERE qualified_name IS NOT NULL)""",
    "precise_names": f"WITH {_S} SELECT name, count(*) AS matches FROM s WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) <= 5",
    "class_anchor_methods": f"""
        WITH {_S}, {_n('defines|extends')}, p AS (SELECT name FROM s GROUP BY 1 HAVING count(*) <= 5)
        SELECT DISTINCT k.name, m.name AS member FROM n JOIN s k ON k.name = raw_name AND k.kind IN ('class', 'interface') JOIN s m ON m.parent_id = k.id JOIN p ON p.name = m.name""",
    "constructor_enrich": f"""
        WITH {_S}, l AS (SELECT *, CASE lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.java' THEN 'java' END AS lang FROM s),
        k AS (SELECT id AS parent, name AS cls, lang FROM l WHERE kind IN ('class', 'interface')),
        c AS (SELECT parent, min(l.id) AS constructor FROM l JOIN k ON l.parent_id = parent AND l.kind = 'method' WHERE (k.lang = 'python' AND name IN ('__init__', '__new__')) OR (k.lang IN ('typescript', 'javascript') AND name = 'constructor') OR (k.lang = 'java' AND name = cls) GROUP BY 1)
        SELECT l.id AS method, k.parent, constructor FROM l JOIN k ON l.parent_id = k.parent LEFT JOIN c USING (parent) WHERE l.kind = 'method'""",
    "member_containment": f"""WITH {_S} SELECT m.parent_id, count(*) FILTER (m.start_line >= p.start_line AND m.end_line <= p.end_line) AS inside, count(*) FILTER (NOT (m.start_line >= p.start_line AND m.end_line <= p.end_line)) AS outside
        FROM s m JOIN s p ON m.parent_id = p.id GROUP BY 1""",
    "scoring_units": f"WITH {_S}, t AS (SELECT *, count(*) OVER (PARTITION BY file_path) AS n FROM s WHERE file_path IS NOT NULL AND parent_id IS NULL) SELECT DISTINCT file_path, CASE WHEN n <= 8 THEN file_path ELSE id END AS unit FROM t",
    "suffix_join": r"""
        WITH m AS (SELECT DISTINCT regexp_replace(reason, '^\S+ ', '') || e AS raw_path FROM candidates, unnest(['.py', '.ts', '.js', '.go', '.rs', '.java']) u(e) WHERE reason LIKE 'imports %')
        SELECT raw_path, min(file_path) AS resolved FROM m JOIN (SELECT DISTINCT file_path, string_split(file_path, '/')[-1] AS base FROM files) f ON raw_path = base OR (contains(raw_path, '/') AND file_path LIKE '%/' || raw_path) GROUP BY 1""",
    "probe_names": f"""
        WITH {_S}, {_prefixes()}, k AS (SELECT name, count(*) AS matches FROM s WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) <= 5),
        h AS (SELECT item_id, name, matches, count(*) AS hits FROM q JOIN k ON contains(lower(name), prefix) GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, matches, name) AS rank FROM h QUALIFY rank <= 20""",
    "subsystem_localize": f"""
        WITH {_S}, {_prefixes()}, n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
        f AS (SELECT file_path FROM files WHERE file_path LIKE '%/%' UNION SELECT file_path FROM symbols WHERE file_path LIKE '%/%'),
        b AS (SELECT file_path, array_to_string(string_split({_dir('file_path')}, '/')[:g], '/') AS directory FROM f, unnest([1, 2, 3]) u(g) WHERE g <= len(string_split({_dir('file_path')}, '/'))),
        k AS (SELECT directory, lower(string_split(file_path, '/')[-1]) AS low FROM b UNION SELECT directory, lower(string_split(directory, '/')[-1]) FROM b UNION SELECT directory, lower(name) FROM b JOIN s USING (file_path) WHERE name IS NOT NULL),
        h AS (SELECT item_id, directory, count(DISTINCT prefix) AS hits FROM q JOIN k ON contains(low, prefix) GROUP BY 1, 2), z AS (SELECT directory, count(*) AS files FROM b GROUP BY 1)
        SELECT item_id, directory, round(hits / n, 6) AS confidence, row_number() OVER (PARTITION BY item_id ORDER BY round(hits / n, 6) DESC, files DESC, directory) AS rank FROM h JOIN n USING (item_id) JOIN z USING (directory) QUALIFY rank <= 5""",
    "resolve_candidates": rf"""
        WITH {_EDGES}, {_n('defines', 'dn')}, t AS (SELECT DISTINCT raw_name AS name FROM dn), r AS ({_res('t', 't.name', 't.name')}), m AS (SELECT name, count(*) AS n FROM r GROUP BY 1),
        a AS (SELECT name, symbol_file AS file_path, 0 AS hop, 'defines ' || name AS reason, 'defines ' || name AS chain FROM r
          UNION ALL SELECT r.name, caller_file, 1, 'calls ' || r.name, 'defines ' || r.name || ' > calls ' || r.name FROM r JOIN e ON e.callee = r.id WHERE caller_file = symbol_file OR {_dir('caller_file')} = {_dir('symbol_file')}
          UNION ALL SELECT r.name, k.file_path, 1, 'extends ' || r.name, 'defines ' || r.name || ' > extends ' || r.name FROM r JOIN (SELECT file_path, unnest(base_names) AS base FROM s WHERE kind IN ('class', 'interface')) k ON string_split(base, '.')[-1] = string_split(r.name, '.')[-1]),
        b AS (SELECT * FROM a WHERE file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name, file_path ORDER BY hop, reason) = 1)
        SELECT name, file_path, hop, CASE hop WHEN 0 THEN 'primary' ELSE 'supporting' END AS tier, reason, chain, CASE WHEN n > 1 THEN round(1 / log2(n + 1), 4) ELSE 1.0 END AS confidence FROM b JOIN m USING (name)""",
}
