"""Queries of paths, predicates and hierarchies over the scanned files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import hierarchy as H
from ..session import table

#: Directories that hold such a file root a segment (a fixed value of this corpus: where its documentation lies).
SEGMENT_SUFFIX = ".md"
#: Evidence by category: globs, and how many files to take.
EVIDENCE = {
    "login implementation": (["*login*", "*signin*", "*sign_in*"], 5),
    "session persistence": (["*session*", "*token*"], 5),
    "authentication middleware": (["*middleware*", "*auth*"], 5),
    "configuration": (["config*.py", "config/*", "settings*.py", "*.env*"], 3),
    "documentation": (["*.md", "readme*"], 3),
}


def _files(spark, d):
    """The scanned files, each delivery of a file counted once, without their sources."""
    return table(spark, d, "files").select("repo", "file_path").filter("file_path is not null").distinct()


def scan_files(spark, d):
    """The scan: skipped directories and sensitive names pruned, in the order of paths, which a row number keeps."""
    f = _files(spark, d).filter(~P.is_skipped(F.col("file_path")) & ~P.is_sensitive(F.col("file_path")))
    return f.select("file_path", P.extension(F.col("file_path")).alias("extension"), F.row_number().over(Window.partitionBy("repo").orderBy("file_path")).alias("position"))


def path_parts(spark, d):
    p = F.col("file_path")
    return _files(spark, d).select("file_path", P.dirname(p).alias("directory"), P.basename(p).alias("name"), P.file_stem(p).alias("stem"), P.name_prefix(p).alias("prefix"), F.size(P.ancestors(P.dirname(p))).alias("depth"))


def path_predicates(spark, d):
    p = F.col("file_path")
    return _files(spark, d).select("file_path", P.is_noisy(p).alias("noisy"), P.is_document(p).alias("document"), P.is_sensitive(p).alias("sensitive"), P.is_skipped(p).alias("skipped"))


def content_predicates(spark, d):
    f = table(spark, d, "packaged_files").select("item_id", P.clean(F.col("file_path")).alias("file_path"), "content").distinct()
    return f.select("item_id", "file_path", P.is_generated(F.col("file_path"), F.col("content")).alias("generated"), P.has_dynamic_dispatch(F.col("content")).alias("dynamic"))


def language_histogram(spark, d):
    f = _files(spark, d).select("repo", P.extension(F.col("file_path")).alias("extension"))
    n = f.groupBy("repo", "extension").agg(F.count("*").alias("files"))
    return n.withColumn("percent", F.round(100 * F.col("files") / F.sum("files").over(Window.partitionBy("repo")), 2))


def language_coverage(spark, d):
    """Files with an analyser, without one, and null languages, by repository."""
    f = table(spark, d, "files").select("repo", "file_path", "language").distinct().groupBy("repo", "file_path").agg(F.max("language").alias("language"))
    known = F.col("language").isin("python", "typescript", "javascript", "java", "go", "rust")
    return f.groupBy("repo").agg(F.count_if(known).alias("supported"), F.count_if(F.col("language").isNotNull() & ~known).alias("unsupported"), F.count_if(F.col("language").isNull()).alias("unknown"))


def project_layout(spark, d):
    top = F.element_at(F.split("file_path", "/"), 2)
    f = _files(spark, d)
    return f.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.size(F.split("file_path", "/")) > 2, top))), ",").alias("top_directories"), F.max(P.is_noisy(F.col("file_path"))).alias("has_tests"), F.countDistinct(P.dirname(F.col("file_path"))).alias("directories"))


def evidence_match(spark, d):
    """The first files of each repository that each category of evidence takes, in the order of paths."""
    f = _files(spark, d)
    hits = None
    for category, (patterns, most) in EVIDENCE.items():
        h = f.filter(P.matches_glob(F.lower("file_path"), patterns)).select(F.lit(category).alias("category"), F.lit(most).alias("most"), "repo", "file_path")
        hits = h if hits is None else hits.unionByName(h)
    r = F.row_number().over(Window.partitionBy("repo", "category").orderBy("file_path"))
    return hits.withColumn("position", r).filter("position <= most").drop("most")


def evidence_sufficiency(spark, d):
    """Categories of evidence that each repository has and lacks."""
    repos = _files(spark, d).select("repo").distinct()
    wanted = repos.withColumn("category", F.explode(F.array(*[F.lit(c) for c in EVIDENCE])))
    got = evidence_match(spark, d).groupBy("repo", "category").agg(F.count("*").alias("files"))
    return wanted.join(got, ["repo", "category"], "left").groupBy("repo").agg(F.count_if(F.col("files").isNotNull()).alias("satisfied"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("files").isNull(), F.col("category")))), ",").alias("missing"))


def subtree_counts(spark, d):
    return H.subtree_counts(_files(spark, d))


def taxonomy_register(spark, d):
    return H.register(_files(spark, d))


def taxonomy_owners(spark, d):
    f = _files(spark, d)
    return H.owners(f, H.register(f))


def segment_assign(spark, d):
    f = _files(spark, d)
    roots = f.filter(F.lower("file_path").endswith(SEGMENT_SUFFIX)).select(P.dirname(F.col("file_path")).alias("directory")).distinct()
    return H.segments(f, roots)


def dominant_segment(spark, d):
    """The directory that most candidates of each resolution lie in."""
    c = table(spark, d, "candidates").filter("file_path is not null").select("resolution_id", P.dirname(P.clean(F.col("file_path"))).alias("segment"))
    return H.dominant(c, ["resolution_id"], "segment")


def dominant_language(spark, d):
    c = table(spark, d, "candidates").filter("language is not null")
    return H.dominant(c, ["resolution_id"], "language")


def group_namespaces(spark, d):
    """First parts of the qualified names of each directory's symbols."""
    s = table(spark, d, "symbols").filter("file_path is not null and qualified_name is not null").select(P.dirname(F.col("file_path")).alias("directory"), F.element_at(F.split("qualified_name", "[.]"), 1).alias("ns"))
    return s.groupBy("directory").agg(F.array_join(F.array_sort(F.collect_set("ns")), ",").alias("namespaces"))


QUERIES = {f.__name__: f for f in (scan_files, path_parts, path_predicates, content_predicates, language_histogram, language_coverage, project_layout, evidence_match, evidence_sufficiency, subtree_counts, taxonomy_register, taxonomy_owners, segment_assign, dominant_segment, dominant_language, group_namespaces)}

_F = "f AS (SELECT DISTINCT repo, file_path FROM files WHERE file_path IS NOT NULL)"
_DIR = "CASE WHEN file_path LIKE '%/%' THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END"
_BASE = "regexp_replace(file_path, '^.*/', '')"
_STEM = f"regexp_replace({_BASE}, '(.)[.][^.]*$', '\\1')"
_EXT = r"lower(regexp_extract(file_path, '[^/](\.[^./]+)$', 1))"


def _sql_globs(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{P.glob_regex(p)}')" for p in patterns) + ")"


def _sql_contains(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


_UP = "list_concat(list_transform(range(len(string_split(own, '/')), 0, -1), lambda n: array_to_string(string_split(own, '/')[:n], '/')), [''])"
_ANC = f"CASE WHEN own = '' THEN [''] ELSE {_UP} END"
_SKIP = f"len(list_intersect(string_split({_DIR}, '/'), {P.SKIPPED_DIRECTORIES})) > 0"
_SENS = _sql_globs(f"lower({_BASE})", P.SENSITIVE)
_NOISY = f"(len(list_intersect(string_split(lower({_DIR}), '/'), {P.NOISY_SEGMENTS})) > 0 OR regexp_matches(lower({_STEM}), '^test_|(^|[_.])tests?$|\\.spec$') OR regexp_matches({_STEM}, '[a-z0-9]Tests?$'))"
_DOC = rf"(regexp_matches(lower({_BASE}), '^(readme|changelog|contributing|history)(\.\w+)?$') OR {_EXT} IN ('.md', '.rst', '.txt'))"
_SUBTREE = f"""{_F}, o AS (SELECT file_path, {_DIR} AS own FROM f), u AS (SELECT own, unnest({_ANC}) AS directory FROM o),
    sc AS (SELECT directory, count(*) AS files, count(*) FILTER (own = directory) AS direct FROM u GROUP BY 1)"""
_REGISTER = f"""{_SUBTREE}, par AS (SELECT DISTINCT CASE WHEN directory LIKE '%/%' THEN regexp_replace(directory, '/[^/]*$', '') ELSE '' END AS directory FROM sc WHERE directory <> ''),
    dr AS (SELECT directory, files, direct, directory IN (SELECT directory FROM par) AS inn, CASE WHEN directory = '' THEN 0 ELSE len(string_split(directory, '/')) END AS lvl FROM sc),
    ov AS (SELECT *, files > 50 AND lvl < 6 AS ovr FROM dr),
    ab AS (SELECT directory, unnest({_ANC.replace('own', 'directory')}) AS up FROM ov),
    bl AS (SELECT DISTINCT ab.directory FROM ab JOIN ov ON ab.up = ov.directory WHERE ab.up <> ab.directory AND NOT (ov.ovr AND ov.inn)),
    rc AS (SELECT * FROM ov WHERE directory NOT IN (SELECT directory FROM bl)),
    pf AS (SELECT DISTINCT own AS directory, string_split({_STEM}, '_')[1] AS prefix FROM o WHERE own IN (SELECT directory FROM rc WHERE ovr AND direct > 50)),
    reg AS (SELECT directory AS group_path FROM rc WHERE NOT ovr OR (direct > 0 AND direct <= 50)
      UNION SELECT CASE WHEN count(*) OVER (PARTITION BY directory) > 1 THEN directory || '::' || prefix ELSE directory END FROM pf)"""
_EV = " UNION ALL ".join(f"SELECT '{c}' AS category, {m} AS most, repo, file_path FROM f WHERE {_sql_globs('lower(file_path)', p)} OR {_sql_globs(_BASE.replace('file_path', 'lower(file_path)'), p)}" for c, (p, m) in EVIDENCE.items())
_EVIDENCE = f"{_F}, h AS ({_EV}), ev AS (SELECT category, repo, file_path, row_number() OVER (PARTITION BY repo, category ORDER BY file_path) AS position, most FROM h QUALIFY position <= most)"

ORACLE = {
    "scan_files": f"WITH {_F} SELECT file_path, {_EXT} AS extension, row_number() OVER (PARTITION BY repo ORDER BY file_path) AS position FROM f WHERE NOT ({_SKIP}) AND NOT {_SENS}",
    "path_parts": f"WITH {_F}, o AS (SELECT file_path, {_DIR} AS own FROM f) SELECT file_path, own AS directory, {_BASE} AS name, {_STEM} AS stem, string_split({_STEM}, '_')[1] AS prefix, len({_ANC}) AS depth FROM o",
    "path_predicates": f"WITH {_F} SELECT file_path, {_NOISY} AS noisy, {_DOC} AS document, {_SENS} AS sensitive, {_SKIP} AS skipped FROM f",
    "content_predicates": f"""
        WITH p AS (SELECT DISTINCT item_id, regexp_replace(file_path, '^(\\./)+', '') AS file_path, content FROM packaged_files)
        SELECT item_id, file_path, {_sql_contains('lower(file_path)', P.GENERATED_PATHS)} OR {' OR '.join(f"lower(file_path) LIKE '%{s.replace('_', chr(92) + '_')}' ESCAPE '{chr(92)}'" for s in P.GENERATED_SUFFIXES)}
          OR coalesce({_sql_contains('lower(left(content, 500))', P.GENERATED_MARKERS)}, false) AS generated, coalesce({_sql_contains('lower(content)', P.DISPATCH_MARKERS)}, false) AS dynamic FROM p""",
    "language_histogram": f"WITH {_F}, n AS (SELECT repo, {_EXT} AS extension, count(*) AS files FROM f GROUP BY 1, 2) SELECT *, round(100 * files / sum(files) OVER (PARTITION BY repo), 2)::DOUBLE AS percent FROM n",
    "language_coverage": """
        WITH f AS (SELECT repo, file_path, max(language) AS language FROM files GROUP BY 1, 2)
        SELECT repo, count(*) FILTER (language IN ('python', 'typescript', 'javascript', 'java', 'go', 'rust')) AS supported,
          count(*) FILTER (language NOT IN ('python', 'typescript', 'javascript', 'java', 'go', 'rust')) AS unsupported, count(*) FILTER (language IS NULL) AS unknown FROM f GROUP BY 1""",
    "project_layout": f"""
        WITH {_F} SELECT repo, coalesce(string_agg(DISTINCT CASE WHEN len(string_split(file_path, '/')) > 2 THEN string_split(file_path, '/')[2] END, ',' ORDER BY CASE WHEN len(string_split(file_path, '/')) > 2 THEN string_split(file_path, '/')[2] END), '') AS top_directories,
          bool_or({_NOISY}) AS has_tests, count(DISTINCT {_DIR}) AS directories FROM f GROUP BY 1""",
    "evidence_match": f"WITH {_EVIDENCE} SELECT category, repo, file_path, position FROM ev",
    "evidence_sufficiency": f"""
        WITH {_EVIDENCE}, w AS (SELECT DISTINCT repo, unnest({list(EVIDENCE)}) AS category FROM f), g AS (SELECT DISTINCT repo, category, true AS got FROM ev)
        SELECT repo, count(got) AS satisfied, coalesce(string_agg(category, ',' ORDER BY category) FILTER (got IS NULL), '') AS missing FROM w LEFT JOIN g USING (repo, category) GROUP BY 1""",
    "subtree_counts": f"WITH {_SUBTREE} SELECT * FROM sc",
    "taxonomy_register": f"WITH {_REGISTER} SELECT * FROM reg",
    "taxonomy_owners": f"""
        WITH {_REGISTER}, c AS (SELECT file_path, list_concat([own || '::' || string_split({_STEM}, '_')[1]], {_ANC}) AS up FROM o),
        x AS (SELECT file_path, unnest(up) AS group_path, generate_subscripts(up, 1) AS k FROM c)
        SELECT file_path, arg_min(group_path, k) AS group_path FROM x JOIN reg USING (group_path) GROUP BY 1""",
    "segment_assign": f"""
        WITH {_F}, o AS (SELECT file_path, {_DIR} AS own FROM f), r AS (SELECT DISTINCT own AS segment FROM o WHERE lower(file_path) LIKE '%.md' UNION SELECT ''),
        u AS (SELECT file_path, unnest({_ANC}) AS segment FROM o)
        SELECT file_path, arg_max(segment, length(segment)) AS segment FROM u JOIN r USING (segment) GROUP BY 1""",
    "dominant_segment": f"""
        WITH c AS (SELECT resolution_id, regexp_replace(file_path, '^(\\./)+', '') AS file_path FROM candidates WHERE file_path IS NOT NULL), n AS (SELECT resolution_id, {_DIR} AS segment, count(*) AS n FROM c GROUP BY 1, 2)
        SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY resolution_id ORDER BY n DESC, segment) = 1""",
    "dominant_language": """
        WITH n AS (SELECT resolution_id, language, count(*) AS n FROM candidates WHERE language IS NOT NULL GROUP BY 1, 2)
        SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY resolution_id ORDER BY n DESC, language) = 1""",
    "group_namespaces": f"""
        WITH s AS (SELECT DISTINCT {_DIR} AS directory, string_split(qualified_name, '.')[1] AS ns FROM symbols WHERE file_path IS NOT NULL AND qualified_name IS NOT NULL)
        SELECT directory, string_agg(ns, ',' ORDER BY ns) AS namespaces FROM s GROUP BY 1""",
}
