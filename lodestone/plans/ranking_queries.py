"""Queries of ranking, merging and packing over the candidates of each resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import packing as K
from ..operators import ranking as R
from ..session import table
from . import sql
from .symbol_queries import _EDGES, _dir, call_edges


def _candidates(spark, d):
    """Candidates with clean paths, repeated rows once, the first by input position of each path."""
    c = table(spark, d, "candidates").filter("resolution_id is not null and file_path is not null").withColumn("file_path", P.clean(F.col("file_path")))
    r = F.row_number().over(Window.partitionBy("resolution_id", "file_path").orderBy("input_pos", "reason"))
    return c.withColumn("_r", r).filter("_r = 1").drop("_r")


def _scored(spark, d, profile="unknown"):
    impact = table(spark, d, "symbols").filter("id is not null").select("id", "file_path").distinct().groupBy("file_path").agg(F.count("*").alias("impact"))
    c = _candidates(spark, d).join(impact, "file_path", "left").withColumn("impact", F.coalesce("impact", F.lit(0))).withColumn("is_entry", F.coalesce(F.col("tier") == "primary", F.lit(False)))
    return c.withColumn("score", R.relevance(c, profile))


def merge_candidates(spark, d):
    """First admission of each path: its reason, and the best tier it was ever given."""
    c = table(spark, d, "candidates").filter("resolution_id is not null and file_path is not null").withColumn("file_path", P.clean(F.col("file_path")))
    tier = F.when(F.col("tier") == "primary", 0).when(F.col("tier") == "supporting", 1).otherwise(2)
    return c.groupBy("resolution_id", "file_path").agg(F.min_by("reason", F.struct("input_pos", "reason")).alias("reason"), F.min(tier).alias("tier_rank"))


def rank_candidates(spark, d):
    return R.rank(_scored(spark, d), ["resolution_id"]).select("resolution_id", "file_path", "score", "rank")


def profile_rank(spark, d):
    """Mean score of the candidates of each reason verb under every profile; candidates are read once."""
    c = _scored(spark, d).withColumn("profile", F.explode(F.array(*[F.lit(p) for p in R.PROFILES])))
    c = c.withColumn("score", R.relevance(c, F.col("profile")))
    return c.groupBy("profile", R.verb(F.col("reason")).alias("verb")).agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"))


def decay_confidence(spark, d):
    c = _candidates(spark, d).withColumn("hops", F.greatest(F.size(F.coalesce("justification_chain", F.array().cast("array<string>"))) - 1, F.lit(0)))
    return c.select("resolution_id", "file_path", "hops", R.decay(F.coalesce("anchor_confidence", F.lit(1.0)), F.col("hops")).alias("confidence"))


def reason_summary(spark, d):
    c = _candidates(spark, d).filter("reason is not null")
    return c.groupBy("resolution_id", R.verb(F.col("reason")).alias("verb")).agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set(F.regexp_replace("reason", r"^\S+ ", ""))), ", ").alias("subjects"))


def token_estimate(spark, d):
    c = _candidates(spark, d).withColumn("t", F.coalesce(F.col("token_count"), F.lit(0)).cast("bigint"))
    a = c.groupBy("resolution_id").agg(F.sum("t").alias("raw_tokens"), F.sum(F.when(F.col("tier") == "primary", F.col("t")).otherwise(0)).alias("selected_tokens"))
    return a.withColumn("ratio", F.when(F.col("raw_tokens") > 0, F.round(F.col("selected_tokens") / F.col("raw_tokens"), 4)).otherwise(0.0))


def filler_share(spark, d):
    """Share of the packed tokens of each package that imports alone justify."""
    p = table(spark, d, "packaged_files").filter("item_id is not null").groupBy("item_id").agg(F.max_by(F.struct("package_id", "reason", F.length("content").alias("n")), F.struct("packaged_at", F.length("content"))).alias("p")).select("p.*")
    t = F.ceil(F.coalesce("n", F.lit(0)) / 4).cast("bigint")
    a = p.groupBy("package_id").agg(F.sum(t).alias("tokens"), F.sum(F.when(F.col("reason").startswith("imports"), t).otherwise(0)).alias("filler_tokens"))
    return a.withColumn("share", F.when(F.col("tokens") > 0, F.round(F.col("filler_tokens") / F.col("tokens"), 6)).otherwise(0.0))


def falloff_filter(spark, d):
    """Candidates within the falloff of the best score of their resolution."""
    s = _scored(spark, d).withColumn("top", F.max("score").over(Window.partitionBy("resolution_id")))
    return s.filter(F.col("score") >= F.round(K.FALLOFF * F.col("top"), 6)).select("resolution_id", "file_path", "score")


def budget_pack(spark, d):
    """Greedy first fit with skips into 4 500 tokens, in the order of rank, after the falloff."""
    s = _scored(spark, d).withColumn("top", F.max("score").over(Window.partitionBy("resolution_id"))).filter(F.col("score") >= F.round(K.FALLOFF * F.col("top"), 6))
    s = s.select("resolution_id", (-F.col("score")).alias("neg"), F.coalesce("input_pos", F.lit(0)).alias("pos"), "file_path", F.col("file_path").alias("path"), F.coalesce("token_count", F.lit(0)).alias("tokens"))
    return K.greedy_fit(s, ["resolution_id"], ["neg", "pos", "path"], "tokens", F.lit(4500), "file_path")


def greedy_fill(spark, d):
    """Greedy fill in the order of the scan, whole files, into 8 000 tokens."""
    s = _candidates(spark, d).select("resolution_id", F.coalesce("input_pos", F.lit(0)).alias("pos"), F.col("file_path").alias("path"), "file_path", F.coalesce("token_count", F.lit(0)).alias("tokens"))
    return K.greedy_fit(s, ["resolution_id"], ["pos", "path"], "tokens", F.lit(8000), "file_path")


def package_summary(spark, d):
    """Files, tokens and compression of what budget_pack packs."""
    b = budget_pack(spark, d).filter("packed").join(_candidates(spark, d).select("resolution_id", "file_path", F.coalesce("token_count", F.lit(0)).cast("bigint").alias("t")), ["resolution_id", "file_path"])
    used = b.groupBy("resolution_id").agg(F.count("*").alias("files"), F.sum("t").alias("used"))
    raw = _candidates(spark, d).groupBy("resolution_id").agg(F.sum(F.coalesce("token_count", F.lit(0)).cast("bigint")).alias("raw"))
    return raw.join(used, "resolution_id", "left").select("resolution_id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("used", F.lit(0)).alias("used"), F.when(F.col("used") > 0, F.round(F.col("raw") / F.col("used"), 4)).alias("compression"))


def interval_merge(spark, d):
    s = table(spark, d, "symbols").filter("id is not null and file_path is not null").dropDuplicates(["id"])
    return K.merged_intervals(s, ["file_path"], "start_line", "end_line", K.MARGIN)


def line_windows(spark, d):
    """Lines around the middle line of each packed content, by length and digest."""
    p = table(spark, d, "packaged_files").filter("content is not null").select("item_id", "content").distinct()
    w = K.line_window(F.col("content"), F.floor((F.size(F.split("content", "\n")) + 1) / 2).cast("int"))
    return p.select("item_id", F.size(F.split(w, "\n")).alias("lines"), F.md5(w).alias("digest"))


def header_lines(spark, d):
    p = table(spark, d, "packaged_files").filter("content is not null").select("item_id", "content").distinct()
    return p.select("item_id", K.header_end(F.col("content")).alias("header"))


def retrieval_rank(spark, d):
    """Rank of the smallest path that a resolution has in tier primary, among all its candidates; null without one."""
    r = R.rank(_scored(spark, d), ["resolution_id"])
    t = r.filter("tier = 'primary'").groupBy("resolution_id").agg(F.min("file_path").alias("file_path"))
    ranks = t.join(r.select("resolution_id", "file_path", "rank"), ["resolution_id", "file_path"])
    return r.select("resolution_id").distinct().join(ranks, "resolution_id", "left").select("resolution_id", "file_path", "rank")


def prune_candidates(spark, d):
    """Experimental candidates kept: those in the directory of an established one, those that a call connects with an established file, and
    those whose reason shares a six-letter root with a name that the established ones define; the first eight by path."""
    c = _candidates(spark, d).withColumn("dir", P.dirname(F.col("file_path")))
    known = c.filter("tier in ('primary', 'supporting')")
    e = c.filter("tier = 'experimental'").select("resolution_id", "file_path", "dir", F.lower(F.coalesce("reason", F.lit(""))).alias("low"))
    near = e.join(known.select("resolution_id", "dir").distinct(), ["resolution_id", "dir"], "left_semi").select("resolution_id", "file_path")
    links = call_edges(spark, d).select(F.col("caller_file").alias("a"), F.col("callee_file").alias("b"))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    linked = e.join(links, e["file_path"] == F.col("a")).join(known.select("resolution_id", F.col("file_path").alias("b")), ["resolution_id", "b"], "left_semi").select("resolution_id", "file_path")
    roots = known.filter("reason like 'defines %'").select("resolution_id", F.explode(T.probe_prefixes(F.regexp_replace("reason", r"^\S+ ", ""))).alias("root")).distinct()
    grams = e.filter(F.length("low") >= T.PROBE).select("resolution_id", "file_path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - T.PROBE + 1), lambda k: F.substring(F.col("low"), k, F.lit(T.PROBE))))).alias("root"))
    rooted = grams.join(roots, ["resolution_id", "root"], "left_semi").select("resolution_id", "file_path")
    kept = near.unionByName(linked).unionByName(rooted).distinct()
    r = F.row_number().over(Window.partitionBy("resolution_id").orderBy("file_path"))
    return kept.withColumn("position", r).filter("position <= 8")


QUERIES = {f.__name__: f for f in (merge_candidates, rank_candidates, profile_rank, decay_confidence, reason_summary, token_estimate, filler_share, falloff_filter, budget_pack, greedy_fill, package_summary, interval_merge, line_windows, header_lines, retrieval_rank, prune_candidates)}

_RAW = r"raw AS (SELECT * REPLACE (regexp_replace(file_path, '^(\./)+', '') AS file_path) FROM candidates WHERE resolution_id IS NOT NULL AND file_path IS NOT NULL)"
_C = f"{_RAW}, c AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY resolution_id, file_path ORDER BY input_pos, reason) = 1)"
_VERB = "string_split(coalesce(reason, ''), ' ')[1]"


def _weight(profile: str) -> str:
    return f"CASE {_VERB} " + " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in R.PROFILES[profile].items() if w != "*") + f" ELSE {R.PROFILES[profile]['*']}::DOUBLE END"


def _score(profile: str = "unknown", name: str = "sc") -> str:
    return f"""{name} AS (SELECT c.*, round(least({_weight(profile)} + CASE WHEN coalesce(tier = 'primary', false) THEN 0.2::DOUBLE ELSE 0 END + least(coalesce(impact, 0), 5) / 5 * 0.1::DOUBLE, 1.0::DOUBLE)
        * coalesce(anchor_confidence, 1.0::DOUBLE) * coalesce(ambiguity_confidence, 1.0::DOUBLE) * coalesce(path_mask_confidence, 1.0::DOUBLE) + 1e-9::DOUBLE, 4) AS score FROM c LEFT JOIN im USING (file_path))"""


_IM = "im AS (SELECT file_path, count(*) AS impact FROM (SELECT DISTINCT id, file_path FROM symbols WHERE id IS NOT NULL) GROUP BY 1)"
_SC = f"{_C}, {_IM}, {_score()}"
_FALL = f"{_SC}, fo AS (SELECT * FROM sc QUALIFY score >= round(0.45::DOUBLE * max(score) OVER (PARTITION BY resolution_id), 6))"


def _greedy(source: str, order: str, budget: int) -> str:
    return f"""o AS (SELECT resolution_id, file_path, coalesce(token_count, 0) AS cost, row_number() OVER (PARTITION BY resolution_id ORDER BY {order}) - 1 AS position FROM {source}),
        g AS (SELECT resolution_id, file_path, position, CASE WHEN cost <= {budget} THEN cost ELSE 0 END AS used, cost <= {budget} AS packed FROM o WHERE position = 0
          UNION ALL SELECT o.resolution_id, o.file_path, o.position, CASE WHEN used + cost <= {budget} THEN used + cost ELSE used END, used + cost <= {budget} FROM g JOIN o ON o.resolution_id = g.resolution_id AND o.position = g.position + 1)"""


_PACK = f"WITH RECURSIVE {_FALL}, {_greedy('fo', 'score DESC, coalesce(input_pos, 0), file_path', 4500)}"
_P = "p AS (SELECT DISTINCT item_id, content FROM packaged_files WHERE content IS NOT NULL), l AS (SELECT item_id, string_split(content, chr(10)) AS ls FROM p)"

ORACLE = {
    "merge_candidates": f"WITH {_RAW} SELECT resolution_id, file_path, arg_min(reason, (coalesce(input_pos, -1), reason)) AS reason, min(CASE tier WHEN 'primary' THEN 0 WHEN 'supporting' THEN 1 ELSE 2 END) AS tier_rank FROM raw GROUP BY 1, 2",
    "rank_candidates": f"WITH {_SC} SELECT resolution_id, file_path, score, row_number() OVER (PARTITION BY resolution_id ORDER BY score DESC, input_pos, file_path) AS rank FROM sc",
    "profile_rank": f"WITH {_C}, {_IM}, " + ", ".join(_score(p, f"s_{p}") for p in R.PROFILES) + " " + " UNION ALL ".join(f"SELECT '{p}' AS profile, {_VERB} AS verb, round(avg(score), 6) AS mean_score, count(*) AS n FROM s_{p} GROUP BY 2" for p in R.PROFILES),
    "decay_confidence": f"WITH {_C} SELECT resolution_id, file_path, greatest(len(coalesce(justification_chain, [])) - 1, 0)::INT AS hops, round(coalesce(anchor_confidence, 1.0::DOUBLE) * pow(0.6::DOUBLE, greatest(len(coalesce(justification_chain, [])) - 1, 0)), 6) AS confidence FROM c",
    "reason_summary": rf"WITH {_C}, d AS (SELECT DISTINCT resolution_id, {_VERB} AS verb, regexp_replace(reason, '^\S+ ', '') AS subject FROM c WHERE reason IS NOT NULL), n AS (SELECT resolution_id, {_VERB} AS verb, count(*) AS files FROM c WHERE reason IS NOT NULL GROUP BY 1, 2) SELECT n.*, (SELECT string_agg(subject, ', ' ORDER BY subject) FROM d WHERE d.resolution_id = n.resolution_id AND d.verb = n.verb) AS subjects FROM n",
    "token_estimate": f"WITH {_C}, a AS (SELECT resolution_id, sum(coalesce(token_count, 0))::BIGINT AS raw_tokens, coalesce(sum(coalesce(token_count, 0)) FILTER (tier = 'primary'), 0)::BIGINT AS selected_tokens FROM c GROUP BY 1) SELECT *, CASE WHEN raw_tokens > 0 THEN round(selected_tokens / raw_tokens, 4) ELSE 0 END AS ratio FROM a",
    "filler_share": """
        WITH p AS (SELECT * FROM packaged_files WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY packaged_at DESC NULLS LAST, length(content) DESC NULLS LAST) = 1),
        t AS (SELECT package_id, reason, ceil(coalesce(length(content), 0) / 4)::BIGINT AS t FROM p),
        a AS (SELECT package_id, sum(t)::BIGINT AS tokens, coalesce(sum(t) FILTER (reason LIKE 'imports%'), 0)::BIGINT AS filler_tokens FROM t GROUP BY 1)
        SELECT *, CASE WHEN tokens > 0 THEN round(filler_tokens / tokens, 6) ELSE 0 END AS share FROM a""",
    "falloff_filter": f"WITH {_FALL} SELECT resolution_id, file_path, score FROM fo",
    "budget_pack": f"{_PACK} SELECT resolution_id, file_path, position, packed FROM g",
    "greedy_fill": f"WITH RECURSIVE {_C}, {_greedy('c', 'coalesce(input_pos, 0), file_path', 8000)} SELECT resolution_id, file_path, position, packed FROM g",
    "package_summary": f"""{_PACK}, u AS (SELECT resolution_id, count(*) AS files, sum(coalesce(token_count, 0))::BIGINT AS used FROM g JOIN c USING (resolution_id, file_path) WHERE packed GROUP BY 1),
        r AS (SELECT resolution_id, sum(coalesce(token_count, 0))::BIGINT AS raw FROM c GROUP BY 1)
        SELECT resolution_id, coalesce(files, 0) AS files, coalesce(used, 0) AS used, CASE WHEN used > 0 THEN round(raw / used, 4) END AS compression FROM r LEFT JOIN u USING (resolution_id)""",
    "interval_merge": """
        WITH r AS (SELECT file_path, greatest(start_line - 2, 1) AS s, end_line + 2 AS e FROM (SELECT * FROM symbols WHERE id IS NOT NULL AND file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id) = 1)),
        p AS (SELECT *, max(e) OVER (PARTITION BY file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
        i AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM p)
        SELECT file_path, min(s) AS start, max(e) AS "end", count(*) AS ranges FROM i GROUP BY file_path, island""",
    "line_windows": f"""WITH {_P}, m AS (SELECT *, ((len(ls) + 1) // 2) AS mid FROM l), w AS (SELECT item_id, ls[greatest(mid - 8, 1):least(mid + 8, len(ls))] AS ws FROM m)
        SELECT item_id, len(ws) AS lines, md5(array_to_string(ws, chr(10))) AS digest FROM w""",
    "header_lines": rf"""WITH {_P}, h AS (SELECT item_id, ls[:15] AS hs, list_position(list_transform(ls[:15], lambda x: NOT regexp_matches(trim(x, ' '), '^(\s*$|#|//|/\*|\*|import\b|from\b|package\b|use\b|\"\"\"|'''''')')), true) AS k FROM l)
        SELECT item_id, CASE WHEN coalesce(k, 0) > 0 THEN k - 1 ELSE len(hs) END AS header FROM h""",
    "retrieval_rank": f"""WITH {_SC}, r AS (SELECT *, row_number() OVER (PARTITION BY resolution_id ORDER BY score DESC, input_pos, file_path) AS rank FROM sc),
        t AS (SELECT resolution_id, min(file_path) AS file_path FROM r WHERE tier = 'primary' GROUP BY 1)
        SELECT a.resolution_id, t.file_path, r.rank FROM (SELECT DISTINCT resolution_id FROM r) a LEFT JOIN t USING (resolution_id) LEFT JOIN r ON r.resolution_id = t.resolution_id AND r.file_path = t.file_path""",
    "prune_candidates": rf"""WITH {_EDGES}, {_C}, k AS (SELECT *, {_dir('file_path')} AS dir FROM c WHERE tier IN ('primary', 'supporting')), x AS (SELECT *, {_dir('file_path')} AS dir FROM c WHERE tier = 'experimental'),
        l AS (SELECT caller_file AS a, callee_file AS b FROM e UNION SELECT callee_file, caller_file FROM e),
        w AS (SELECT resolution_id, unnest(regexp_extract_all(regexp_replace(reason, '^\S+ ', ''), '[A-Za-z][A-Za-z0-9_]*')) AS w FROM k WHERE reason LIKE 'defines %'),
        r AS (SELECT DISTINCT resolution_id, left(lower(w), 6) AS root FROM w WHERE length(w) >= 6 AND lower(w) NOT IN ({sql.STOP})),
        kept AS (SELECT resolution_id, file_path FROM x SEMI JOIN k USING (resolution_id, dir) UNION SELECT x.resolution_id, x.file_path FROM x JOIN l ON x.file_path = l.a JOIN k ON k.resolution_id = x.resolution_id AND k.file_path = l.b
          UNION SELECT x.resolution_id, x.file_path FROM x JOIN r ON r.resolution_id = x.resolution_id AND contains(lower(reason), root))
        SELECT *, row_number() OVER (PARTITION BY resolution_id ORDER BY file_path) AS position FROM kept QUALIFY position <= 8""",
}
