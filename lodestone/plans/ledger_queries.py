"""Queries of the run ledger and versioned records over the runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stores as S
from ..session import table


def _order():
    return [F.col("created_at").desc_nulls_last(), F.col("request_id")]


def _runs(spark, d):
    """The ledger: one row per request, the one ingested last."""
    return S.newest(table(spark, d, "runs"), ["request_id"], [F.col("ingested_at").desc_nulls_last()])


def _newest_pairs(spark, d):
    """The newest run of each mode for every workspace and model; ``pair`` names the two."""
    r = _runs(spark, d).withColumn("pair", F.concat_ws("|", F.coalesce("workspace_id", F.lit("")), F.coalesce("model", F.lit(""))))
    return S.newest(r, ["pair", "mode"], _order())


def ledger_upsert(spark, d):
    """Runs stored by mode direct, those of the other mode arriving after them."""
    r = table(spark, d, "runs").select("request_id", "mode", "execution_status", "ingested_at")
    u = S.upsert(r.filter("mode = 'direct'"), r.filter("mode != 'direct'"), ["request_id"], "ingested_at")
    return u.select("request_id", "mode", "execution_status", "ingested_at")


def ledger_retention(spark, d):
    return S.retained(_runs(spark, d), "workspace_id", _order()).select("workspace_id", "request_id", "created_at")


def ledger_recent(spark, d):
    """The newest run of each workspace and mode."""
    return S.newest(_runs(spark, d), ["workspace_id", "mode"], _order()).select("workspace_id", "mode", "request_id", "created_at")


def ledger_search(spark, d):
    """Of the newest 200 runs, then by mode and text, the newest 20: the first limit comes before the filter."""
    newest = _runs(spark, d).orderBy(*_order()).limit(200)
    hit = newest.filter((F.col("mode") == "engine") & F.contains(F.lower(F.coalesce("prompt", F.lit(""))), F.lit("the")))
    return hit.orderBy(*_order()).limit(20).select("request_id", "created_at")


def ledger_delete(spark, d):
    r = _runs(spark, d)
    return S.deleted(r, r.filter("execution_status = 'timeout'"), "request_id").groupBy("workspace_id").agg(F.count("*").alias("runs"))


def ledger_compare(spark, d):
    """The newest direct and engine run of each workspace and model side by side: differences engine minus direct."""
    n = _newest_pairs(spark, d).select("pair", "mode", "total_tokens", "latency_ms", "artifact_content")
    a, b = (n.filter(F.col("mode") == m).select("pair", *[F.col(c).alias(f"{c}_{m}") for c in ("total_tokens", "latency_ms", "artifact_content")]) for m in ("direct", "engine"))
    j = a.join(b, "pair")
    return j.select("pair", (F.col("total_tokens_engine") - F.col("total_tokens_direct")).alias("token_delta"), F.round(F.col("latency_ms_engine") - F.col("latency_ms_direct"), 6).alias("latency_delta"), F.coalesce(F.col("artifact_content_engine") == F.col("artifact_content_direct"), F.lit(False)).alias("same_text"))


def ledger_dashboard(spark, d):
    r = _runs(spark, d).withColumn("overlap", F.when(F.size("selected_files") > 0, F.size(F.array_intersect("selected_files", "files_changed")) / F.size("selected_files")))
    return r.groupBy("workspace_id").agg(F.count("*").alias("runs"), F.round(F.avg((F.col("execution_status") == "success").cast("double")), 6).alias("success_rate"), F.round(F.avg("overlap"), 6).alias("overlap"), F.count_if(F.col("execution_status").endswith("error")).alias("errors"))


def ledger_export(spark, d):
    """The exported columns: arrays as lengths, quotes doubled."""
    r = _runs(spark, d)
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("prompt", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return r.select("request_id", "mode", "model", F.coalesce("provider", F.lit("")).alias("provider"), quoted.alias("prompt"), F.coalesce(F.size("files_changed"), F.lit(0)).alias("files_changed"), F.coalesce(F.size("selected_files"), F.lit(0)).alias("selected_files"))


def ledger_metadata(spark, d):
    """Metadata keys and how many runs carry each value."""
    r = _runs(spark, d).select(F.explode(F.col("metadata")).alias("key", "value"))
    return r.groupBy("key", "value").agg(F.count("*").alias("runs"))


def version_latest(spark, d):
    v = S.versions(_runs(spark, d), "contract_id", [F.col("created_at").asc_nulls_first(), F.col("request_id")], "request_id").filter("contract_id is not null")
    return v.groupBy("contract_id").agg(F.max("version").alias("version"), F.max_by("request_id", "version").alias("request_id"))


def version_lineage(spark, d):
    v = S.versions(_runs(spark, d), "contract_id", [F.col("created_at").asc_nulls_first(), F.col("request_id")], "request_id").filter("contract_id is not null")
    return v.select("contract_id", "version", "request_id", "previous", "lineage")


def suite_pivot(spark, d):
    """The newest tokens of each pair, one column per mode."""
    return _newest_pairs(spark, d).groupBy("pair").pivot("mode", ["direct", "engine"]).agg(F.first("total_tokens"))


def incremental_index(spark, d):
    """Files whose content changed between their first and latest delivery, those seen once and those unchanged."""
    f = table(spark, d, "files").filter("file_path is not null").select("file_path", F.sha2("source_bytes", 256).alias("h"), "ingested_at")
    g = f.groupBy("file_path").agg(F.min_by("h", "ingested_at").alias("a"), F.max_by("h", "ingested_at").alias("b"), F.count("*").alias("n"))
    return g.select("file_path", F.when(F.col("n") == 1, "new").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed").alias("state"))


def content_duplicates(spark, d):
    """Groups of different files with one content."""
    f = table(spark, d, "files").filter("file_path is not null and source_bytes is not null").select("file_path", F.sha2("source_bytes", 256).alias("digest")).distinct()
    return f.groupBy("digest").agg(F.count("*").alias("files"), F.min("file_path").alias("first_path")).filter("files > 1")


QUERIES = {f.__name__: f for f in (ledger_upsert, ledger_retention, ledger_recent, ledger_search, ledger_delete, ledger_compare, ledger_dashboard, ledger_export, ledger_metadata, version_latest, version_lineage, suite_pivot, incremental_index, content_duplicates)}

_R = "r AS (SELECT * FROM runs WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
_NEW = "created_at DESC NULLS LAST, request_id"
_NEWEST = f"k AS (SELECT *, coalesce(workspace_id, '') || '|' || coalesce(model, '') AS pair FROM r WHERE mode IS NOT NULL), n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY pair, mode ORDER BY {_NEW}) = 1)"
_VERSIONS = """v AS (SELECT contract_id, request_id, row_number() OVER w AS version, lag(request_id) OVER w AS previous,
    coalesce(array_to_string(list(request_id) OVER (PARTITION BY contract_id ORDER BY created_at ASC NULLS FIRST, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ','), '') AS lineage
    FROM r WHERE contract_id IS NOT NULL WINDOW w AS (PARTITION BY contract_id ORDER BY created_at ASC NULLS FIRST, request_id))"""

ORACLE = {
    "ledger_upsert": "SELECT request_id, mode, execution_status, ingested_at FROM runs WHERE request_id IS NOT NULL AND mode IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY mode <> 'direct' DESC, ingested_at DESC NULLS LAST) = 1",
    "ledger_retention": f"WITH {_R} SELECT workspace_id, request_id, created_at FROM r QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY {_NEW}) <= 50",
    "ledger_recent": f"WITH {_R} SELECT workspace_id, mode, request_id, created_at FROM r WHERE workspace_id IS NOT NULL AND mode IS NOT NULL QUALIFY row_number() OVER (PARTITION BY workspace_id, mode ORDER BY {_NEW}) = 1",
    "ledger_search": f"WITH {_R}, n AS (SELECT * FROM r ORDER BY {_NEW} LIMIT 200) SELECT request_id, created_at FROM n WHERE mode = 'engine' AND contains(lower(coalesce(prompt, '')), 'the') ORDER BY {_NEW} LIMIT 20",
    "ledger_delete": f"WITH {_R} SELECT workspace_id, count(*) AS runs FROM r WHERE request_id NOT IN (SELECT request_id FROM r WHERE execution_status = 'timeout') GROUP BY 1",
    "ledger_compare": f"""WITH {_R}, {_NEWEST} SELECT a.pair, b.total_tokens - a.total_tokens AS token_delta, round(b.latency_ms - a.latency_ms, 6) AS latency_delta, coalesce(a.artifact_content = b.artifact_content, false) AS same_text
        FROM n a JOIN n b ON a.pair = b.pair AND a.mode = 'direct' AND b.mode = 'engine'""",
    "ledger_dashboard": f"""WITH {_R} SELECT workspace_id, count(*) AS runs, round(avg((execution_status = 'success')::INT), 6) AS success_rate,
          round(avg(CASE WHEN len(selected_files) > 0 THEN len(list_intersect(selected_files, files_changed)) / len(selected_files) END), 6) AS overlap, count(*) FILTER (execution_status LIKE '%error') AS errors FROM r GROUP BY 1""",
    "ledger_export": f"""WITH {_R} SELECT request_id, mode, model, coalesce(provider, '') AS provider, '"' || replace(coalesce(prompt, ''), '"', '""') || '"' AS prompt, coalesce(len(files_changed), 0) AS files_changed, coalesce(len(selected_files), 0) AS selected_files FROM r""",
    "ledger_metadata": f"WITH {_R}, e AS (SELECT unnest(map_entries(metadata)) AS e FROM r) SELECT e.key AS key, e.value AS value, count(*) AS runs FROM e GROUP BY 1, 2",
    "version_latest": f"WITH {_R}, {_VERSIONS} SELECT contract_id, max(version) AS version, arg_max(request_id, version) AS request_id FROM v GROUP BY 1",
    "version_lineage": f"WITH {_R}, {_VERSIONS} SELECT * FROM v",
    "suite_pivot": f"WITH {_R}, {_NEWEST} SELECT pair, max(total_tokens) FILTER (mode = 'direct') AS direct, max(total_tokens) FILTER (mode = 'engine') AS engine FROM n GROUP BY 1",
    "incremental_index": """WITH g AS (SELECT file_path, arg_min(sha256(source_bytes), ingested_at) AS a, arg_max(sha256(source_bytes), ingested_at) AS b, count(*) AS n FROM files WHERE file_path IS NOT NULL GROUP BY 1)
        SELECT file_path, CASE WHEN n = 1 THEN 'new' WHEN a IS NOT DISTINCT FROM b THEN 'unchanged' ELSE 'changed' END AS state FROM g""",
    "content_duplicates": "SELECT sha256(source_bytes) AS digest, count(DISTINCT file_path) AS files, min(file_path) AS first_path FROM files WHERE file_path IS NOT NULL AND source_bytes IS NOT NULL GROUP BY 1 HAVING count(DISTINCT file_path) > 1",
}
