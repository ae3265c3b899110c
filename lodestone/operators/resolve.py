"""Name resolution over symbols: fallback joins, disambiguation by locality, edges of calls and inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import shared_dir

#: Names with more definitions than this are ambiguous.
PRECISE = 5
#: Constructors by language; ``{}`` stands for the name of the class itself (fixed values).
CONSTRUCTORS = {"python": ["__init__", "__new__"], "typescript": ["constructor"], "javascript": ["constructor"], "kotlin": ["init"], "java": ["{}"], "csharp": ["{}"]}


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """One row per symbol id."""
    return symbols.filter("id is not null").dropDuplicates(["id"])


def resolve(names: DataFrame, name: str, symbols: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Rows of ``names`` joined to the symbols they mean, as ``id, symbol_file, kind``: by qualified name, and only where that
    has no hit at all by the simple name after the last dot. The kinds are filtered after that decision."""
    s = symbols.select("id", F.col("name").alias("_simple"), F.col("qualified_name").alias("_qualified"), F.col("file_path").alias("symbol_file"), "kind")
    exact = names.join(s, F.col(name) == F.col("_qualified"))
    rest = names.join(s.select("_qualified").distinct(), F.col(name) == F.col("_qualified"), "left_anti")
    simple = rest.join(s, F.substring_index(F.col(name), ".", -1) == F.col("_simple"))
    out = exact.unionByName(simple).drop("_simple", "_qualified")
    return out.filter(F.col("kind").isin(kinds)) if kinds else out


def locality(context: Column, candidate: Column) -> Column:
    """3 in the same file, 2 in the same directory, else 0; 0 without a context."""
    return F.when(context == candidate, 3).when(P.dirname(context) == P.dirname(candidate), 2).otherwise(0)


def disambiguate(candidates: DataFrame, keys: list[str], context: str) -> DataFrame:
    """``keys, matches, best, preferred, ambiguous``: the single best candidate by locality, or none where several are best."""
    c = candidates.withColumn("_score", F.coalesce(locality(F.col(context), F.col("symbol_file")), F.lit(0)))
    best = F.max("_score").over(Window.partitionBy(*keys))
    t = c.withColumn("_best", best).groupBy(*keys).agg(
        F.count("*").alias("matches"), F.max("_best").cast("int").alias("best"), F.count_if(F.col("_score") == F.col("_best")).alias("_ties"), F.min(F.when(F.col("_score") == F.col("_best"), F.col("id"))).alias("_first"))
    return t.select(*keys, "matches", "best", F.when(F.col("_ties") == 1, F.col("_first")).alias("preferred"), (F.col("_ties") > 1).alias("ambiguous"))


def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``caller_file, callee, callee_file``: each call to all functions and methods of that name; callers without a symbol
    contribute file edges like all others."""
    return resolve(calls, "callee_name", symbols, ["function", "method"]).select("caller_file", F.col("id").alias("callee"), F.col("symbol_file").alias("callee_file")).distinct()


def call_parts(calls: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of ``call_edges`` before they are multiplied out, as calls (``caller_file, called``) and definitions (``called, callee,
    callee_file``), of which every match on ``called`` is an edge: a qualified name after ``=``, a simple one after ``~``. Both grow with
    their tables, while the edges grow with the product of a name's calls and definitions. A symbol that a caller means by both its names
    matches twice."""
    shared_dir(symbols.sparkSession)
    known = symbols.filter("qualified_name is not null").select(F.col("qualified_name").alias("callee_name")).distinct().withColumn("_exact", F.lit(True))
    c = calls.select("callee_name", "caller_file").join(known, "callee_name", "left")
    c = c.select("caller_file", F.when(F.col("_exact"), F.concat(F.lit("="), F.col("callee_name"))).otherwise(F.concat(F.lit("~"), F.substring_index("callee_name", ".", -1))).alias("called")).distinct().checkpoint()
    keys = F.explode(F.array(F.concat(F.lit("="), F.col("qualified_name")), F.concat(F.lit("~"), F.col("name")))).alias("called")
    s = symbols.filter(F.col("kind").isin("function", "method")).select(keys, F.col("id").alias("callee"), F.col("file_path").alias("callee_file"))
    return c, s.join(c.select("called").distinct(), "called", "left_semi")


def candidate_set(names: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``name, file_path, hop, tier, reason, chain, confidence``: the files that define each name of ``names``, those that call it from
    the same file or directory (``caller_file, callee``), and those with a type that extends it. A file has one row a name, its first
    admission by hop and reason; a name of several definitions is ambiguous, with 1 / log2(n + 1) as its confidence."""
    r = resolve(names, "name", symbols).select("name", "id", "symbol_file")
    said = lambda verb: F.concat(F.lit(verb + " "), F.col("name"))
    row = lambda path, hop, verb: (F.col("name"), F.col(path).alias("file_path"), F.lit(hop).alias("hop"), said(verb).alias("reason"), (said("defines") if not hop else F.concat_ws(" > ", said("defines"), said(verb))).alias("chain"))
    near = (F.col("caller_file") == F.col("symbol_file")) | (P.dirname(F.col("caller_file")) == P.dirname(F.col("symbol_file")))
    callers = r.join(calls.select(F.col("callee").alias("id"), "caller_file"), "id").filter(near)
    types = symbols.filter(F.col("kind").isin("class", "interface")).select(F.col("file_path").alias("child_file"), F.explode("base_names").alias("base"))
    children = r.join(types, F.substring_index("base", ".", -1) == F.substring_index("name", ".", -1))
    every = r.select(*row("symbol_file", 0, "defines")).unionByName(callers.select(*row("caller_file", 1, "calls"))).unionByName(children.select(*row("child_file", 1, "extends")))
    first = every.filter("file_path is not null").groupBy("name", "file_path").agg(F.min(F.struct("hop", "reason", "chain")).alias("a"))
    n = r.groupBy("name").agg(F.count("*").alias("n"))
    confidence = F.when(F.col("n") > 1, F.round(1 / F.log2(F.col("n") + 1), 4)).otherwise(1.0)
    return first.join(n, "name").select("name", "file_path", "a.hop", F.when(F.col("a.hop") == 0, "primary").otherwise("supporting").alias("tier"), "a.reason", "a.chain", confidence.alias("confidence"))


def symbol_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """``src, dst``: calls of parsed files (``file_path, caller_id, name``) as edges between symbols, kept where caller and callee are
    local to each other: in one file or directory, or one file imports the other (``file_path, resolved``)."""
    named = calls.filter("caller_id is not null").select(F.col("caller_id").alias("src"), F.col("file_path").alias("from_file"), F.col("name").alias("called")).distinct()
    e = resolve(named, "called", symbols, ["function", "method"]).select("src", "from_file", F.col("id").alias("dst"), F.col("symbol_file").alias("to_file")).distinct()
    local = (F.col("from_file") == F.col("to_file")) | (P.dirname(F.col("from_file")) == P.dirname(F.col("to_file")))
    if imports is None:
        return e.filter(local).select("src", "dst").distinct()
    i = imports.filter("resolved is not null").select(F.col("file_path").alias("from_file"), F.col("resolved").alias("to_file"))
    i = i.unionByName(i.select(F.col("to_file").alias("from_file"), F.col("from_file").alias("to_file"))).distinct().withColumn("_imports", F.lit(True))
    return e.join(i, ["from_file", "to_file"], "left").filter(local | F.coalesce("_imports", F.lit(False))).select("src", "dst").distinct()


def inheritance_edges(symbols: DataFrame) -> DataFrame:
    """``child, base``: classes and interfaces joined to those that their base names mean."""
    bases = symbols.filter(F.col("kind").isin("class", "interface")).select(F.col("id").alias("child"), F.explode("base_names").alias("base_name"))
    return resolve(bases, "base_name", symbols, ["class", "interface"]).select("child", F.col("id").alias("base")).distinct()


def unresolved_bases(symbols: DataFrame) -> DataFrame:
    types = symbols.filter(F.col("kind").isin("class", "interface"))
    bases = types.select(F.col("id").alias("child"), F.explode("base_names").alias("base_name"))
    known = types.select(F.col("qualified_name").alias("n")).union(types.select("name")).distinct()
    return bases.join(known, F.substring_index("base_name", ".", -1) == F.col("n"), "left_anti").distinct()


def name_counts(symbols: DataFrame) -> DataFrame:
    return symbols.filter("name is not null").groupBy("name").agg(F.count("*").alias("matches"))


def class_anchors(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """``name, member``: for names of classes, their members whose own name is precise."""
    classes = symbols.filter(F.col("kind").isin("class", "interface")).select(F.col("id").alias("parent_id"), "name")
    members = symbols.filter("parent_id is not null").select("parent_id", F.col("name").alias("member"))
    precise = name_counts(symbols).filter(F.col("matches") <= PRECISE).select(F.col("name").alias("member"))
    return names.join(classes, "name").join(members, "parent_id").join(precise, "member").select("name", "member").distinct()


def constructors(symbols: DataFrame, languages: Column) -> DataFrame:
    """``method, parent, constructor``: each method with its class and the class's constructor, null where it has none."""
    s = symbols.withColumn("_lang", languages)
    methods = s.filter("kind = 'method' and parent_id is not null").select(F.col("id").alias("method"), F.col("parent_id").alias("parent"))
    classes = s.filter(F.col("kind").isin("class", "interface")).select(F.col("id").alias("parent"), F.col("name").alias("_class"), "_lang")
    fits = F.lit(False)
    for lang, names in CONSTRUCTORS.items():
        for n in names:
            fits = fits | ((F.col("_lang") == lang) & (F.col("name") == (F.col("_class") if n == "{}" else F.lit(n))))
    makers = s.filter("kind = 'method'").select("name", "id", F.col("parent_id").alias("parent")).join(classes, "parent").filter(fits).groupBy("parent").agg(F.min("id").alias("constructor"))
    return methods.join(classes.select("parent"), "parent", "left_semi").join(makers, "parent", "left").select("method", "parent", "constructor")


def alias_targets(modules: DataFrame, aliases: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """``raw_module, resolved``: the first existing file of alias pattern, target and suffix, in their order. ``aliases`` is a small
    configuration table ``pattern, position, target`` and broadcast."""
    prefix, rest = F.substring_index("pattern", "*", 1), F.expr("substring(pattern, instr(pattern, '*') + 1)")
    hit = modules.join(F.broadcast(aliases), F.col("raw_module").startswith(F.when(F.col("pattern").contains("*"), prefix).otherwise(F.col("pattern"))))
    star = F.when(F.col("pattern").contains("*"), F.expr("substring(raw_module, instr(pattern, '*'))"))
    hit = hit.filter(F.when(F.col("pattern").contains("*"), F.col("raw_module").endswith(rest)).otherwise(F.col("raw_module") == F.col("pattern")))
    paths = hit.select("raw_module", "position", F.coalesce(F.replace(F.col("target"), F.lit("*"), star), F.col("target")).alias("base"))
    tries = paths.select("raw_module", "position", F.posexplode(F.array(*[F.concat("base", F.lit(x)) for x in suffixes])).alias("k", "file_path"))
    return tries.join(files.select("file_path").distinct(), "file_path", "left_semi").groupBy("raw_module").agg(F.min_by("file_path", F.struct("position", "k")).alias("resolved"))


def suffix_targets(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``raw_path, resolved``: the smallest file whose path is, or ends with a slash and, the raw path; every tail of the files'
    paths is exploded, so it is an equi-join."""
    ps = F.split("file_path", "/")
    tails = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(ps)), lambda k: F.array_join(F.slice(ps, k, F.size(ps)), "/"))).alias("raw_path"))
    return paths.join(tails, "raw_path").groupBy("raw_path").agg(F.min("file_path").alias("resolved"))
