"""Queries of anchors, excerpts, combined routing and graph variants."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import paths as P
from ..functions import text as T
from ..operators import anchors as A
from ..operators import graph as G
from ..operators import packing as K
from ..operators import resolve as R
from ..operators import routing
from ..session import ship, table
from . import sql
from .index_queries import _GROUPS, _groups
from .ledger_queries import _NEWEST, _R, _newest_pairs
from .ranking_queries import _C, _candidates
from .symbol_queries import _EDGES, _S, _calls, _dir, _symbols, call_edges


def keyword_classes(spark, d):
    r = table(spark, d, "runs").select("prompt").distinct()
    return r.select("prompt", A.keyword_class(F.col("prompt"), A.DOMAINS).alias("domain"), A.keyword_class(F.col("prompt"), A.TASKS, "ation").alias("task"))


def query_tokens(spark, d):
    r = table(spark, d, "eval_items").filter("task_prompt is not null")
    return r.select("item_id", F.array_join(A.query_tokens(F.col("task_prompt")), " | ").alias("tokens"))


def _stems(spark, d):
    return table(spark, d, "eval_items").filter("task_prompt is not null").select("item_id", A.morph_words(F.col("task_prompt")).alias("ws")).repartition("item_id")


def morph_anchors(spark, d):
    """Derived identifiers of each question that name a precise symbol, whatever their case."""
    names = R.name_counts(_symbols(spark, d)).filter(F.col("matches") <= R.PRECISE).select(F.lower("name").alias("low"), "name")
    q = _stems(spark, d).select("item_id", F.explode(A.morphological(F.col("ws"))).alias("candidate"))
    return q.join(names, F.lower("candidate") == F.col("low")).select("item_id", "candidate", "name").distinct()


def morph_candidates(spark, d):
    q = _stems(spark, d).select("item_id", A.morphological(F.col("ws")).alias("c"))
    return q.select("item_id", F.size("c").alias("n"), F.element_at("c", 1).alias("first_candidate"), F.element_at("c", -1).alias("last_candidate"))


def lexical_roots(spark, d):
    r = table(spark, d, "runs").select("prompt", "artifact_content").distinct()
    return r.select("prompt", F.md5(F.coalesce("artifact_content", F.lit(""))).alias("answer"), A.shares_root(F.col("artifact_content"), F.col("prompt")).alias("shares"))


def anchor_tiers(spark, d):
    """Symbols that questions name: exactly (tier 1, in quotes), or lexically by a prefix of a precise name (tier 3)."""
    names = R.name_counts(_symbols(spark, d)).filter(F.col("matches") <= R.PRECISE).select("name")
    q = table(spark, d, "eval_items").filter("task_prompt is not null")
    exact = q.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("task_prompt", F.lit("`([^`]+)`"), F.lit(1)))).alias("name")).join(names, "name").withColumn("tier", F.lit(1))
    grams = names.withColumn("low", F.lower("name")).select("name", F.left("low", F.lit(T.PROBE)).alias("prefix"))
    lexical = q.select("item_id", F.explode(T.probe_prefixes(F.col("task_prompt"))).alias("prefix")).join(grams, "prefix").select("item_id", "name", F.lit(3).alias("tier"))
    a = exact.unionByName(lexical).groupBy("item_id", "name").agg(F.min("tier").alias("tier"))
    return a.withColumn("confidence", F.when(F.col("tier") == 1, 1.0).otherwise(0.35))


def probe_paths(spark, d):
    """Files whose name contains a probe prefix of a question; the first eight by path."""
    f = table(spark, d, "files").filter("file_path is not null").select("file_path").distinct().withColumn("low", F.lower(P.file_stem(F.col("file_path")))).filter(F.length("low") >= T.PROBE)
    grams = f.select("file_path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - T.PROBE + 1), lambda k: F.substring(F.col("low"), k, F.lit(T.PROBE))))).alias("prefix"))
    q = table(spark, d, "eval_items").select("item_id", F.explode(T.probe_prefixes(F.col("task_prompt"))).alias("prefix"))
    h = q.join(grams, "prefix").select("item_id", "file_path").distinct()
    return h.withColumn("position", F.row_number().over(Window.partitionBy("item_id").orderBy("file_path"))).filter("position <= 8")


def restrict_names(spark, d):
    """Names of candidates whose symbols lie in the dominant directory of their resolution."""
    c = _candidates(spark, d).select("resolution_id", F.regexp_replace("reason", r"^\S+ ", "").alias("name"), F.element_at(F.split("file_path", "/"), 1).alias("top"))
    s = _symbols(spark, d).select("name", F.element_at(F.split("file_path", "/"), 1).alias("top"))
    return c.join(s, ["name", "top"], "left_semi").select("resolution_id", "name").distinct()


@pandas_udf(StringType())
def text_diff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "a", "b", lineterm="")) for x, y in zip(a, b, strict=True)])


def ledger_diff(spark, d):
    """Unified text differences of the answers of each pair of runs."""
    ship(spark)
    n = _newest_pairs(spark, d).select("pair", "mode", "artifact_content")
    a, b = (n.filter(F.col("mode") == m).select("pair", F.col("artifact_content").alias(m)) for m in ("direct", "engine"))
    t = a.join(b, "pair").withColumn("diff", text_diff("direct", "engine"))
    return t.select("pair", F.size(F.filter(F.split("diff", "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))).alias("added"), F.size(F.filter(F.split("diff", "\n"), lambda x: x.startswith("-") & ~x.startswith("---"))).alias("removed"))


def merge_resolutions(spark, d):
    """Each resolution united with the one before it: files by path, its own first."""
    c = _candidates(spark, d).select("resolution_id", "file_path", "reason")
    before = c.select((F.col("resolution_id") + 1).alias("resolution_id"), "file_path", "reason").join(c.select("resolution_id").distinct(), "resolution_id", "left_semi")
    u = c.withColumn("p", F.lit(0)).unionByName(before.withColumn("p", F.lit(1)))
    return u.groupBy("resolution_id", "file_path").agg(F.min_by("reason", F.struct("p", "reason")).alias("reason"), F.min("p").alias("origin"))


def local_bfs(spark, d):
    """Callee files within two hops of every calling file, along calls within one top directory."""
    e = call_edges(spark, d).select(F.col("caller_file").alias("src"), F.col("callee_file").alias("dst")).distinct()
    top = lambda c: F.element_at(F.split(c, "/"), 1)
    e = e.filter((F.col("src") != F.col("dst")) & (top(F.col("src")) == top(F.col("dst"))))
    return G.bfs(e, e.select(F.col("src").alias("start")), 2)


def entry_distance(spark, d):
    """Hops of every file from the nearest file that calls but isn't called, along calls between different files."""
    calls, defs = R.call_parts(_calls(spark, d), _symbols(spark, d))
    out = calls.select(F.col("caller_file").alias("src"), F.col("called").alias("relay"))
    into = defs.filter("callee_file is not null").select(F.col("called").alias("relay"), F.col("callee_file").alias("dst")).distinct().checkpoint()

    def beside(own, node, far, other):
        """The nodes of one side that have another file on the other side of a name."""
        ends = far.groupBy("relay").agg(F.min(other).alias("a"), F.max(other).alias("b"))
        return own.join(ends, "relay").filter((F.col(node) != F.col("a")) | (F.col(node) != F.col("b"))).select(F.col(node).alias("node")).distinct()

    starts = beside(out, "src", into, "dst").join(beside(into, "dst", out, "src"), "node", "left_anti")
    return G.nearest(out, into, starts)


def ambiguous_rank(spark, d):
    """Symbols of ambiguous names by calling files, size and id, all descending; the best five of each name."""
    s = _symbols(spark, d)
    names = R.name_counts(s).filter("matches > 1").select("name")
    callers = call_edges(spark, d).groupBy(F.col("callee").alias("id")).agg(F.countDistinct("caller_file").alias("callers"))
    j = s.join(names, "name", "left_semi").join(callers, "id", "left").select("name", "id", F.coalesce("callers", F.lit(0)).alias("callers"), (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("callers"), F.desc("lines"), F.desc("id")))).filter("rank <= 5")


def text_blobs(spark, d):
    """Stem and names of each file's symbols as one text, by its length and digest."""
    s = _symbols(spark, d).filter("file_path is not null").groupBy("file_path").agg(F.array_sort(F.collect_set("qualified_name")).alias("q"))
    b = F.concat_ws("\n", P.file_stem(F.col("file_path")), F.array_join("q", "\n"))
    return s.select("file_path", F.length(b).cast("bigint").alias("chars"), F.md5(b).alias("digest"))


def usage_counts(spark, d):
    """Callers of each scoring unit: symbols and files are both counted."""
    e = call_edges(spark, d)
    c = e.groupBy(F.col("callee").alias("id")).agg(F.countDistinct("caller_file").alias("n"))
    return _symbols(spark, d).filter("file_path is not null").select("id", "file_path").join(c, "id", "left").groupBy("file_path").agg((2 * F.sum(F.coalesce("n", F.lit(0)))).alias("usage"))


def community_shares(spark, d):
    """Documents of each repository by the language community they lie in, and each community's share."""
    x = table(spark, d, "documents").select(F.coalesce("repo", F.lit("")).alias("group_path"), F.lower(F.left(F.coalesce("lang", F.lit("?")), F.lit(2))).alias("community"))
    n = x.groupBy("group_path", "community").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("group_path")), 6))


def taxonomy_ratio(spark, d):
    """Share of each question's terms among the parts of a repository's name, the best repository of each question."""
    q = table(spark, d, "eval_items").select("item_id", F.array_distinct(T.tokenize(F.col("task_prompt"))).alias("q")).filter(F.size("q") > 0)
    g = table(spark, d, "documents").select(F.coalesce("repo", F.lit("")).alias("group_path")).distinct()
    t = g.select("group_path", F.explode(T.tokenize(F.translate("group_path", "-/", "  "))).alias("term")).distinct()
    h = q.select("item_id", F.size("q").alias("size"), F.explode("q").alias("term")).join(t, "term").groupBy("item_id", "group_path", "size").agg(F.count("*").alias("n"))
    return h.select("item_id", "group_path", F.round(F.col("n") / F.col("size"), 6).alias("ratio"))


def combined_route(spark, d):
    """Weighted combination of text score, share of the English community and name ratio; the three best of each question."""
    g = _groups(spark, d).withColumn("t", routing.normalised(F.col("group_score"), Window.partitionBy("item_id")))
    c = community_shares(spark, d).filter("community = 'en'").select("group_path", F.col("share").alias("c"))
    x = taxonomy_ratio(spark, d).select("item_id", "group_path", F.col("ratio").alias("x"))
    w = routing.WEIGHTS
    s = g.join(c, "group_path", "left").join(x, ["item_id", "group_path"], "left").withColumn("combined", F.round(w["tfidf"] * F.col("t") + w["community"] * F.coalesce("c", F.lit(0.0)) + w["taxonomy"] * F.coalesce("x", F.lit(0.0)), 6))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("combined"), "group_path"))).filter("rank <= 3").select("item_id", "group_path", "combined", "rank")


def unresolved_imports(spark, d):
    """Imported names of each resolution that no file of its repository is called after, sorted."""
    c = _candidates(spark, d).filter("reason like 'imports %'").select("resolution_id", F.element_at(F.split("file_path", "/"), 1).alias("repo"), F.regexp_replace("reason", r"^\S+ ", "").alias("name"))
    f = table(spark, d, "files").filter("file_path is not null").select(F.element_at(F.split("file_path", "/"), 1).alias("repo"), F.lower(P.file_stem(F.col("file_path"))).alias("stem")).distinct()
    known = f.select("repo", F.explode(F.split("stem", "_")).alias("name")).distinct()
    u = c.join(known, ["repo", "name"], "left_anti")
    return u.groupBy("resolution_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def impacted_counts(spark, d):
    return _symbols(spark, d).filter("file_path is not null").groupBy("file_path").agg(F.count("*").alias("symbols"), F.count_if(F.col("kind").isin("function", "method")).alias("callables"))


def truncate_boilerplate(spark, d):
    """Contents of over 150 tokens cut to the characters that 150 tokens stand for."""
    p = table(spark, d, "packaged_files").filter("content is not null").select("item_id", "content").distinct()
    t = T.token_count(F.col("content"))
    cut = F.when(t > 150, F.left("content", F.lit(600))).otherwise(F.col("content"))
    return p.select("item_id", (t > 150).alias("cut"), T.token_count(cut).alias("tokens"), F.md5(cut).alias("digest"))


def render_ranges(spark, d):
    """Merged symbol ranges of each file, two lines around, clamped to the file's symbols, as headed excerpts."""
    s = _symbols(spark, d).filter("file_path is not null")
    m = K.merged_intervals(s, ["file_path"], "start_line", "end_line", K.MARGIN)
    return m.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda r: F.concat(F.lit("# lines "), r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), "\n").alias("heads"), F.sum(F.col("end") - F.col("start") + 1).cast("bigint").alias("lines"))


def fallback_ladder(spark, d):
    """Files of each question: those it references, else root-level documentation of its repository (the first ten), with the rung."""
    i = table(spark, d, "eval_items").filter("task_prompt is not null")
    f = table(spark, d, "files").filter("file_path is not null").select("repo", "file_path").distinct()
    ref = i.select("item_id", F.explode(A.query_tokens(F.col("task_prompt"))).alias("token")).join(f.select("file_path", F.lower(P.file_stem(F.col("file_path"))).alias("token")), "token").select("item_id", "file_path").distinct().withColumn("rung", F.lit(1))
    root = f.filter(P.is_document(F.col("file_path"))).withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy("file_path"))).filter("r <= 10")
    docs = i.select("item_id", F.col("repo_key").alias("repo")).join(root, "repo").select("item_id", "file_path").withColumn("rung", F.lit(2))
    u = ref.unionByName(docs)
    best = F.min("rung").over(Window.partitionBy("item_id"))
    return u.withColumn("best", best).filter("rung = best").select("item_id", "file_path", "rung")


QUERIES = {f.__name__: f for f in (keyword_classes, query_tokens, morph_candidates, morph_anchors, lexical_roots, anchor_tiers, probe_paths, restrict_names, ledger_diff, merge_resolutions, local_bfs, entry_distance, ambiguous_rank, text_blobs, usage_counts, community_shares, taxonomy_ratio, combined_route, unresolved_imports, impacted_counts, truncate_boilerplate, render_ranges, fallback_ladder)}


def _class(classes: dict, suffix: str | None = None) -> str:
    low = "lower(coalesce(prompt, ''))"

    def n(k: str) -> str:
        return f"((length({low}) - length(replace({low}, '{k}', ''))) // {len(k)})"

    def p(k: str) -> str:
        return f"({n(k)} > {n(k + suffix)})::INT" if suffix else f"contains({low}, '{k}')::INT"

    s = {c: "(" + " + ".join(p(k) for k in ks) + ")" for c, ks in classes.items()}
    best = "greatest(" + ", ".join(s.values()) + ")"
    return "CASE " + " ".join(f"WHEN {x} = {best} AND {best} > 0 THEN '{c}'" for c, x in s.items()) + " ELSE 'unknown' END"


_TOK = r"""list_concat(list_concat(regexp_extract_all(task_prompt, '[`''"]([^`''"]{2,80})[`''"]', 1), regexp_extract_all(task_prompt, '\b\w[\w./\\-]*\.[A-Za-z0-9]{1,10}\b')), regexp_extract_all(task_prompt, '\b[\w-]+(?:/[\w.-]+){1,6}\b'))"""
_QT = rf"""qx AS (SELECT item_id, lower(regexp_replace(unnest({_TOK}), '^[./\\]+|[./\\]+$', '', 'g')) AS token, generate_subscripts({_TOK}, 1) AS k FROM eval_items WHERE task_prompt IS NOT NULL),
    qt AS (SELECT item_id, token, min(k) AS k FROM qx WHERE token <> '' GROUP BY 1, 2)"""
_SUF = "CASE WHEN w LIKE '%ing' AND length(w) >= 6 THEN w[:-4] WHEN w LIKE '%ed' AND length(w) >= 5 THEN w[:-3] WHEN w LIKE '%es' AND length(w) >= 5 THEN w[:-3] WHEN w LIKE '%s' AND length(w) >= 4 THEN w[:-2] ELSE w END"
_CAP = "upper({0}[1]) || {0}[2:]"
_MORPH = f"""mw AS (SELECT item_id, list_transform(list_filter(regexp_extract_all(task_prompt, '[A-Za-z]+'), lambda x: length(x) >= 3), lambda x: lower(x)) AS ws FROM eval_items WHERE task_prompt IS NOT NULL),
    mu AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM mw), ms AS (SELECT item_id, i, {_SUF} AS w FROM mu),
    mp AS (SELECT item_id, i, w AS a, lead(w) OVER (PARTITION BY item_id ORDER BY i) AS b FROM ms),
    mc AS (SELECT item_id, 0 AS part, i, unnest([j, '_' || j, s, j || 'er', '_' || j || 'er', s || '_er', j || 'or', '_' || j || 'or', s || '_or']) AS candidate, unnest(range(9)) AS k FROM (SELECT *, {_CAP.format('a')} || {_CAP.format('b')} AS j, a || '_' || b AS s FROM mp WHERE b IS NOT NULL)
      UNION ALL SELECT item_id, 1, i, unnest([c || 'er', '_' || c || 'er', a || 'er', '_' || a || 'er', c || 'or', '_' || c || 'or', a || 'or', '_' || a || 'or']), unnest(range(8)) FROM (SELECT *, {_CAP.format('a')} AS c FROM mp)),
    md AS (SELECT item_id, candidate, min((part, i, k)) AS k FROM mc GROUP BY 1, 2), ml AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k) AS r FROM md QUALIFY r <= 100)"""
_PREF = f"pw AS (SELECT item_id, unnest({sql.words('task_prompt')}) AS w FROM eval_items), pq AS (SELECT DISTINCT item_id, left(lower(w), 6) AS prefix FROM pw WHERE length(w) >= 6 AND lower(w) NOT IN ({sql.STOP}))"
_BASE = "regexp_replace(file_path, '^.*/', '')"
_STEMF = f"regexp_replace({_BASE}, '(.)[.][^.]*$', '\\1')"
_SHARES = "cs AS (SELECT *, round(n / sum(n) OVER (PARTITION BY group_path), 6)::DOUBLE AS share FROM (SELECT coalesce(repo, '') AS group_path, lower(left(coalesce(lang, '?'), 2)) AS community, count(*) AS n FROM documents GROUP BY 1, 2))"
_RATIO = f"""{sql.tokens('xq', 'eval_items', 'item_id', 'task_prompt')}, xd AS (SELECT DISTINCT item_id, term FROM xq), xn AS (SELECT item_id, count(*) AS size FROM xd GROUP BY 1),
    xg AS (SELECT DISTINCT coalesce(repo, '') AS group_path, translate(coalesce(repo, ''), '-/', '  ') AS txt FROM documents), {sql.tokens('xt', 'xg', 'group_path', 'txt')}, xu AS (SELECT DISTINCT group_path, term FROM xt),
    xr AS (SELECT item_id, group_path, round(count(*) / any_value(size), 6)::DOUBLE AS ratio FROM xd JOIN xu USING (term) JOIN xn USING (item_id) GROUP BY 1, 2)"""
_FE = f"{_EDGES}, fe AS (SELECT DISTINCT caller_file AS src, callee_file AS dst FROM e WHERE caller_file <> callee_file)"

ORACLE = {
    "keyword_classes": f"WITH p AS (SELECT DISTINCT prompt FROM runs) SELECT prompt, {_class(A.DOMAINS)} AS domain, {_class(A.TASKS, 'ation')} AS task FROM p",
    "query_tokens": f"WITH {_QT} SELECT item_id, coalesce(string_agg(token, ' | ' ORDER BY k), '') AS tokens FROM (SELECT item_id FROM eval_items WHERE task_prompt IS NOT NULL) LEFT JOIN qt USING (item_id) GROUP BY 1",
    "morph_candidates": f"WITH {_MORPH} SELECT item_id, count(*) AS n, arg_min(candidate, r) AS first_candidate, arg_max(candidate, r) AS last_candidate FROM ml GROUP BY 1",
    "morph_anchors": f"WITH {_S}, {_MORPH}, n AS (SELECT name FROM s WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) <= 5) SELECT DISTINCT item_id, candidate, name FROM ml JOIN n ON lower(candidate) = lower(name)",
    "lexical_roots": f"""WITH r AS (SELECT DISTINCT prompt, artifact_content FROM runs) SELECT prompt, md5(coalesce(artifact_content, '')) AS answer,
        len(list_filter({sql.words('prompt')}, lambda w: length(w) >= 6 AND NOT list_contains([{sql.STOP}], lower(w)) AND contains(lower(coalesce(artifact_content, '')), left(lower(w), 6)))) > 0 AS shares FROM r""",
    "anchor_tiers": f"""WITH {_S}, {_PREF}, n AS (SELECT name FROM s WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) <= 5),
        t AS (SELECT item_id, unnest(regexp_extract_all(task_prompt, '`([^`]+)`', 1)) AS name, 1 AS tier FROM eval_items WHERE task_prompt IS NOT NULL),
        u AS (SELECT item_id, name, tier FROM t JOIN n USING (name) UNION ALL SELECT item_id, name, 3 FROM pq JOIN n ON left(lower(name), 6) = prefix)
        SELECT item_id, name, min(tier) AS tier, CASE WHEN min(tier) = 1 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS confidence FROM u GROUP BY 1, 2""",
    "probe_paths": f"""WITH {_PREF}, f AS (SELECT DISTINCT file_path, lower({_STEMF}) AS low FROM files WHERE file_path IS NOT NULL), h AS (SELECT DISTINCT item_id, file_path FROM pq JOIN f ON contains(low, prefix))
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY file_path) AS position FROM h QUALIFY position <= 8""",
    "restrict_names": rf"WITH {_S}, {_C} SELECT DISTINCT resolution_id, regexp_replace(reason, '^\S+ ', '') AS name FROM c WHERE (regexp_replace(reason, '^\S+ ', ''), string_split(file_path, '/')[1]) IN (SELECT (name, string_split(file_path, '/')[1]) FROM s)",
    "merge_resolutions": f"""WITH {_C}, u AS (SELECT resolution_id, file_path, reason, 0 AS p FROM c UNION ALL SELECT resolution_id + 1, file_path, reason, 1 FROM c WHERE resolution_id + 1 IN (SELECT resolution_id FROM c))
        SELECT resolution_id, file_path, arg_min(reason, p) AS reason, min(p) AS origin FROM u GROUP BY 1, 2""",
    "local_bfs": f"""WITH {_FE}, le AS (SELECT * FROM fe WHERE string_split(src, '/')[1] = string_split(dst, '/')[1]), h1 AS (SELECT src AS start, dst AS node, 1 AS hop, src AS parent FROM le),
        h2 AS (SELECT h1.start, le.dst AS node, 2 AS hop, min(le.src) AS parent FROM h1 JOIN le ON le.src = h1.node WHERE le.dst <> h1.start AND (h1.start, le.dst) NOT IN (SELECT (start, node) FROM h1) GROUP BY 1, 2)
        SELECT * FROM h1 UNION ALL SELECT * FROM h2""",
    "entry_distance": f"""WITH RECURSIVE {_FE}, w AS (SELECT DISTINCT src AS node, 0 AS hops FROM fe WHERE src NOT IN (SELECT dst FROM fe) UNION SELECT dst, hops + 1 FROM w JOIN fe ON src = node WHERE hops < 20)
        SELECT node, min(hops) AS hops FROM w GROUP BY 1""",
    "ambiguous_rank": f"""WITH {_EDGES}, c AS (SELECT callee AS id, count(DISTINCT caller_file) AS callers FROM e GROUP BY 1), a AS (SELECT name FROM s WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
        SELECT name, id, coalesce(callers, 0) AS callers, end_line - start_line + 1 AS lines, row_number() OVER (PARTITION BY name ORDER BY coalesce(callers, 0) DESC, end_line - start_line + 1 DESC, id DESC) AS rank FROM s JOIN a USING (name) LEFT JOIN c USING (id) QUALIFY rank <= 5""",
    "text_blobs": f"""WITH {_S}, q AS (SELECT file_path, string_agg(qualified_name, chr(10) ORDER BY qualified_name) AS q FROM (SELECT DISTINCT file_path, qualified_name FROM s WHERE file_path IS NOT NULL) GROUP BY 1), b AS (SELECT file_path, {_STEMF} || chr(10) || coalesce(q, '') AS b FROM q)
        SELECT file_path, length(b) AS chars, md5(b) AS digest FROM b""",
    "usage_counts": f"WITH {_EDGES}, c AS (SELECT callee AS id, count(DISTINCT caller_file) AS n FROM e GROUP BY 1) SELECT file_path, (2 * sum(coalesce(n, 0)))::BIGINT AS usage FROM s LEFT JOIN c USING (id) WHERE file_path IS NOT NULL GROUP BY 1",
    "community_shares": f"WITH {_SHARES} SELECT * FROM cs",
    "taxonomy_ratio": f"WITH {_RATIO} SELECT * FROM xr",
    "combined_route": _GROUPS + f""", {_SHARES}, {_RATIO}, k AS (SELECT item_id, group_path, round(0.55::DOUBLE * CASE WHEN max(group_score) OVER w > 0 THEN group_score / max(group_score) OVER w ELSE 0 END + 0.30::DOUBLE * coalesce(share, 0) + 0.15::DOUBLE * coalesce(ratio, 0), 6) AS combined
          FROM g LEFT JOIN (SELECT group_path, share FROM cs WHERE community = 'en') USING (group_path) LEFT JOIN xr USING (item_id, group_path) WINDOW w AS (PARTITION BY item_id))
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY combined DESC, group_path) AS rank FROM k QUALIFY rank <= 3""",
    "unresolved_imports": rf"""WITH {_C}, i AS (SELECT DISTINCT resolution_id, string_split(file_path, '/')[1] AS repo, regexp_replace(reason, '^\S+ ', '') AS name FROM c WHERE reason LIKE 'imports %'),
        k AS (SELECT DISTINCT string_split(file_path, '/')[1] AS repo, unnest(string_split(lower({_STEMF}), '_')) AS name FROM files WHERE file_path IS NOT NULL)
        SELECT resolution_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM i WHERE (repo, name) NOT IN (SELECT (repo, name) FROM k) GROUP BY 1""",
    "impacted_counts": f"WITH {_S} SELECT file_path, count(*) AS symbols, count(*) FILTER (kind IN ('function', 'method')) AS callables FROM s WHERE file_path IS NOT NULL GROUP BY 1",
    "truncate_boilerplate": """WITH p AS (SELECT DISTINCT item_id, content, ceil(length(content) / 4.0) > 150 AS cut FROM packaged_files WHERE content IS NOT NULL), x AS (SELECT item_id, cut, CASE WHEN cut THEN left(content, 600) ELSE content END AS c FROM p)
        SELECT item_id, cut, ceil(length(c) / 4.0)::BIGINT AS tokens, md5(c) AS digest FROM x""",
    "render_ranges": """WITH r AS (SELECT file_path, greatest(start_line - 2, 1) AS s, end_line + 2 AS e FROM (SELECT * FROM symbols WHERE id IS NOT NULL AND file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id) = 1)),
        p AS (SELECT *, max(e) OVER (PARTITION BY file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
        i AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM p), m AS (SELECT file_path, min(s) AS a, max(e) AS b FROM i GROUP BY file_path, island)
        SELECT file_path, string_agg('# lines ' || a || '-' || b, chr(10) ORDER BY a) AS heads, sum(b - a + 1)::BIGINT AS lines FROM m GROUP BY 1""",
    "fallback_ladder": rf"""WITH {_QT}, f AS (SELECT DISTINCT repo, file_path FROM files WHERE file_path IS NOT NULL), r1 AS (SELECT DISTINCT item_id, file_path, 1 AS rung FROM qt JOIN f ON lower({_STEMF}) = token),
        rt AS (SELECT * FROM f WHERE regexp_matches(lower({_BASE}), '^(readme|changelog|contributing|history)(\.\w+)?$') OR lower(regexp_extract(file_path, '[^/](\.[^./]+)$', 1)) IN ('.md', '.rst', '.txt') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY file_path) <= 10),
        u AS (SELECT * FROM r1 UNION ALL SELECT item_id, file_path, 2 FROM eval_items JOIN rt ON repo = repo_key WHERE task_prompt IS NOT NULL)
        SELECT * FROM u QUALIFY rung = min(rung) OVER (PARTITION BY item_id)""",
}
