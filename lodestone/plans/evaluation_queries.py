"""Queries of evaluation statistics over the runs, candidates and evaluation items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..session import ship, table
from .ledger_queries import _NEWEST, _R, _newest_pairs, _runs
from .ranking_queries import _candidates, _scored
from .ranking_queries import _SC as _SCORED_SQL


def _pairs(spark, d):
    n = _newest_pairs(spark, d).select("pair", "mode", "workspace_id", "total_tokens", "prompt_tokens", "latency_ms", "cost_usd", F.size("selected_files").alias("files"))
    a, b = (n.filter(F.col("mode") == m).select("pair", *[F.col(c).alias(f"{c}_{m[0]}") for c in n.columns if c not in ("pair", "mode")]) for m in ("direct", "engine"))
    return a.join(b, "pair")


def reduction_metrics(spark, d):
    p = _pairs(spark, d)
    return p.select("pair", E.reduction(F.col("total_tokens_d"), F.col("total_tokens_e")).alias("token_reduction"), E.reduction(F.col("latency_ms_d"), F.col("latency_ms_e")).alias("latency_reduction"), E.ratio(F.col("prompt_tokens_d"), F.col("prompt_tokens_e")).alias("prompt_ratio"), E.ratio(F.col("files_e"), F.col("files_d")).alias("file_ratio"))


def suite_summary(spark, d):
    """Means of the reductions and win, loss and tie counts, by workspace and over all (null workspace), in one pass."""
    p = _pairs(spark, d).withColumn("red", E.reduction(F.col("total_tokens_d"), F.col("total_tokens_e"))).withColumn("lat", E.reduction(F.col("latency_ms_d"), F.col("latency_ms_e")))
    p = p.select(F.coalesce("workspace_id_d", F.lit("")).alias("workspace"), "red", "lat")
    return p.groupingSets([["workspace"], []], "workspace").agg(F.count("*").alias("pairs"), F.round(F.avg("red"), 6).alias("mean_reduction"), F.round(F.avg("lat"), 6).alias("mean_latency"), F.count_if(F.col("lat") > 0).alias("wins"), F.count_if(F.col("lat") < 0).alias("losses"), F.count_if(F.col("lat") == 0).alias("ties"))


def paired_ttest(spark, d):
    p = _pairs(spark, d).withColumn("workspace", F.coalesce("workspace_id_d", F.lit("")))
    return E.paired_t(p, ["workspace"], "total_tokens_d", "total_tokens_e").select("workspace", "n", F.round("t", 6).alias("t"))


def paired_pvalue(spark, d):
    ship(spark)
    return paired_ttest(spark, d).select("workspace", "n", F.round(E.p_value(F.col("t"), F.col("n") - 1), 6).alias("p"))


def mean_std(spark, d):
    return _runs(spark, d).groupBy("mode", "model").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 3).alias("mean"), F.round(F.stddev_pop("latency_ms"), 3).alias("sd"))


def metric_rollup(spark, d):
    r = _runs(spark, d).select(F.coalesce("model", F.lit("")).alias("model"), F.coalesce("mode", F.lit("")).alias("mode"), "total_tokens", "execution_status")
    return r.rollup("model", "mode").agg(F.count("*").alias("runs"), F.round(F.avg("total_tokens"), 3).alias("mean_tokens"), F.count_if(F.col("execution_status") == "success").alias("succeeded"))


def prf1(spark, d):
    p, r, f = E.overlap(F.coalesce("selected_files", F.array().cast("array<string>")), F.coalesce("files_changed", F.array().cast("array<string>")))
    return _runs(spark, d).select("request_id", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def grounding_score(spark, d):
    """Share of the expected terms in the expected answer and in the prompt of each item."""
    i = table(spark, d, "eval_items")
    return i.select("item_id", F.round(E.term_rate(F.col("expected_answer"), F.col("expected_grounding")), 6).alias("in_answer"), F.round(E.term_rate(F.col("task_prompt"), F.col("expected_grounding")), 6).alias("in_prompt"))


def mrr(spark, d):
    """Mean reciprocal rank of the best primary candidate by reason verb, in input order and by score."""
    from ..operators import ranking as R

    r = R.rank(_scored(spark, d), ["resolution_id"]).withColumn("before", F.row_number().over(Window.partitionBy("resolution_id").orderBy("input_pos", "file_path")))
    b = r.filter("tier = 'primary'").groupBy("resolution_id").agg(F.min("before").alias("b"), F.min("rank").alias("a"))
    every = r.select("resolution_id").distinct().join(b, "resolution_id", "left")
    return every.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("b"), F.lit(0.0))), 6).alias("mrr_before"), F.round(F.avg(F.coalesce(1 / F.col("a"), F.lit(0.0))), 6).alias("mrr_after"))


def pass_fail_groups(spark, d):
    """Mean tokens and latency of passed, failed and unrun tests, with the rank of each."""
    g = _runs(spark, d).groupBy(F.coalesce("test_result", F.lit("unknown")).alias("verdict")).agg(F.count("*").alias("n"), F.round(F.avg("total_tokens"), 3).alias("tokens"), F.round(F.avg("latency_ms"), 3).alias("latency"))
    return g.withColumn("token_rank", F.row_number().over(Window.orderBy("tokens", "verdict")))


def determinism_check(spark, d):
    """Distinct outcomes of each prompt and mode over its repeats."""
    r = _runs(spark, d).filter("prompt is not null")
    return r.groupBy("prompt", "mode").agg(F.count("*").alias("repeats"), F.countDistinct(F.coalesce("artifact_content", F.lit(""))).alias("outcomes"))


def dominant_status(spark, d):
    """The most frequent status of each workspace and its share, and whether it makes up 60 percent."""
    n = _runs(spark, d).groupBy("workspace_id", "execution_status").agg(F.count("*").alias("n"))
    w = Window.partitionBy("workspace_id")
    r = n.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "execution_status"))).filter("r = 1")
    return r.select("workspace_id", "execution_status", "share", (F.col("share") >= 0.6).alias("homogeneous"))


def stage_attribution(spark, d):
    """The first stage at which each resolution loses its primary candidates: none given, outranked, over budget, or kept."""
    from ..operators import ranking as R

    r = R.rank(_scored(spark, d), ["resolution_id"])
    a = r.groupBy("resolution_id").agg(F.min(F.when(F.col("tier") == "primary", F.col("rank"))).alias("best"), F.min(F.when(F.col("tier") == "primary", F.coalesce("token_count", F.lit(0)))).alias("least"))
    return a.select("resolution_id", F.when(F.col("best").isNull(), "not_retrieved").when(F.col("best") > 5, "outranked").when(F.col("least") > 4500, "over_budget").otherwise("kept").alias("stage"))


def unrelated_files(spark, d):
    """Changed files outside of the directories of the selected ones."""
    dirs = F.array_distinct(F.transform(F.coalesce("selected_files", F.array().cast("array<string>")), lambda p: F.regexp_replace(p, "/[^/]*$", "")))
    changed = F.coalesce("files_changed", F.array().cast("array<string>"))
    return _runs(spark, d).select("request_id", F.size(F.filter(changed, lambda p: ~F.array_contains(dirs, F.regexp_replace(p, "/[^/]*$", "")))).alias("unrelated"))


QUERIES = {f.__name__: f for f in (reduction_metrics, suite_summary, paired_ttest, paired_pvalue, mean_std, metric_rollup, prf1, grounding_score, mrr, pass_fail_groups, determinism_check, dominant_status, stage_attribution, unrelated_files)}

_P = f"""{_R}, {_NEWEST}, pr AS (SELECT a.pair, coalesce(a.workspace_id, '') AS workspace, a.total_tokens AS td, b.total_tokens AS te, a.latency_ms AS ld, b.latency_ms AS le, a.prompt_tokens AS pd, b.prompt_tokens AS pe, len(a.selected_files) AS fd, len(b.selected_files) AS fe
    FROM n a JOIN n b ON a.pair = b.pair AND a.mode = 'direct' AND b.mode = 'engine')"""


def _red(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN round(({a} - {b}) / {a} * 100, 2) END"


_OVER = "len(list_intersect(coalesce(selected_files, []), coalesce(files_changed, [])))"
_SEL, _CHG = "len(list_distinct(coalesce(selected_files, [])))", "len(list_distinct(coalesce(files_changed, [])))"
_PR, _RE = f"CASE WHEN {_SEL} > 0 THEN {_OVER} / {_SEL} ELSE 0 END", f"CASE WHEN {_CHG} > 0 THEN {_OVER} / {_CHG} ELSE 0 END"
_T = "CASE WHEN n < 2 THEN NULL WHEN s > 0 THEN m / (s / sqrt(n)) WHEN m = 0 THEN 0.0 ELSE sign(m) * 'inf'::DOUBLE END"


def _rate(text: str) -> str:
    return f"round(CASE WHEN len(expected_grounding) > 0 THEN len(list_filter(expected_grounding, lambda t: contains(lower(coalesce({text}, '')), lower(t)))) / len(expected_grounding) END, 6)"


ORACLE = {
    "reduction_metrics": f"WITH {_P} SELECT pair, {_red('td', 'te')} AS token_reduction, {_red('ld', 'le')} AS latency_reduction, CASE WHEN pe > 0 THEN round(pd / pe, 4) END AS prompt_ratio, CASE WHEN fd > 0 THEN round(fe / fd, 4) END AS file_ratio FROM pr",
    "suite_summary": f"""WITH {_P}, x AS (SELECT workspace, {_red('td', 'te')} AS red, {_red('ld', 'le')} AS lat FROM pr)
        SELECT workspace, count(*) AS pairs, round(avg(red), 6) AS mean_reduction, round(avg(lat), 6) AS mean_latency, count(*) FILTER (lat > 0) AS wins, count(*) FILTER (lat < 0) AS losses, count(*) FILTER (lat = 0) AS ties FROM x GROUP BY GROUPING SETS ((workspace), ())""",
    "paired_ttest": f"WITH {_P}, a AS (SELECT workspace, count(*) AS n, avg(td - te) AS m, stddev_samp(td - te) AS s FROM pr WHERE td IS NOT NULL AND te IS NOT NULL GROUP BY 1) SELECT workspace, n, round({_T}, 6) AS t FROM a",
    "mean_std": f"WITH {_R} SELECT mode, model, count(*) AS n, round(avg(latency_ms), 3) AS mean, round(stddev_pop(latency_ms), 3) AS sd FROM r GROUP BY 1, 2",
    "metric_rollup": f"WITH {_R}, x AS (SELECT coalesce(model, '') AS model, coalesce(mode, '') AS mode, total_tokens, execution_status FROM r) SELECT model, mode, count(*) AS runs, round(avg(total_tokens), 3) AS mean_tokens, count(*) FILTER (execution_status = 'success') AS succeeded FROM x GROUP BY ROLLUP (model, mode)",
    "prf1": f"WITH {_R} SELECT request_id, round({_PR}, 3) AS precision, round({_RE}, 3) AS recall, round(CASE WHEN ({_PR}) + ({_RE}) > 0 THEN 2 * ({_PR}) * ({_RE}) / (({_PR}) + ({_RE})) ELSE 0 END, 3) AS f1 FROM r",
    "grounding_score": f"SELECT item_id, {_rate('expected_answer')} AS in_answer, {_rate('task_prompt')} AS in_prompt FROM eval_items",
    "mrr": f"""WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY resolution_id ORDER BY score DESC, input_pos, file_path) AS rank, row_number() OVER (PARTITION BY resolution_id ORDER BY input_pos, file_path) AS before FROM sc),
        b AS (SELECT resolution_id, min(before) FILTER (tier = 'primary') AS b, min(rank) FILTER (tier = 'primary') AS a FROM r GROUP BY 1)
        SELECT count(*) AS queries, round(avg(coalesce(1 / b, 0)), 6) AS mrr_before, round(avg(coalesce(1 / a, 0)), 6) AS mrr_after FROM b""",
    "pass_fail_groups": f"WITH {_R}, g AS (SELECT coalesce(test_result, 'unknown') AS verdict, count(*) AS n, round(avg(total_tokens), 3) AS tokens, round(avg(latency_ms), 3) AS latency FROM r GROUP BY 1) SELECT *, row_number() OVER (ORDER BY tokens, verdict) AS token_rank FROM g",
    "determinism_check": f"WITH {_R} SELECT prompt, mode, count(*) AS repeats, count(DISTINCT coalesce(artifact_content, '')) AS outcomes FROM r WHERE prompt IS NOT NULL GROUP BY 1, 2",
    "dominant_status": f"""WITH {_R}, n AS (SELECT workspace_id, execution_status, count(*) AS n FROM r GROUP BY 1, 2), s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY workspace_id), 6) AS share FROM n)
        SELECT workspace_id, execution_status, share, share >= 0.6 AS homogeneous FROM s QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY n DESC, execution_status) = 1""",
    "stage_attribution": f"""WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY resolution_id ORDER BY score DESC, input_pos, file_path) AS rank FROM sc),
        a AS (SELECT resolution_id, min(rank) FILTER (tier = 'primary') AS best, min(coalesce(token_count, 0)) FILTER (tier = 'primary') AS least FROM r GROUP BY 1)
        SELECT resolution_id, CASE WHEN best IS NULL THEN 'not_retrieved' WHEN best > 5 THEN 'outranked' WHEN least > 4500 THEN 'over_budget' ELSE 'kept' END AS stage FROM a""",
    "unrelated_files": f"WITH {_R} SELECT request_id, len(list_filter(coalesce(files_changed, []), lambda p: NOT list_contains(list_transform(coalesce(selected_files, []), lambda s: regexp_replace(s, '/[^/]*$', '')), regexp_replace(p, '/[^/]*$', '')))) AS unrelated FROM r",
}
