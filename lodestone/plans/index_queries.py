"""Queries of TF-IDF, PPMI and profile routing over documents and symbols. The evaluation items are the questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import routing, tfidf
from ..session import table
from . import sql

def _group():
    return F.coalesce("repo", F.lit("")).alias("group_path")


def _profile(spark, d):
    docs = table(spark, d, "documents")
    return tfidf.weights(tfidf.token_counts(docs, "doc_id", "text"), docs, "doc_id")


def _scores(spark, d):
    """Scores of every question against every document that shares a term with it."""
    return tfidf.scores(table(spark, d, "eval_items"), "item_id", "task_prompt", _profile(spark, d), "doc_id")


def tfidf_weights(spark, d):
    return _profile(spark, d).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_score(spark, d):
    """The ten best documents of each question."""
    s = _scores(spark, d).select("item_id", "doc_id", F.round("score", 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).filter("rank <= 10")


def tfidf_damped_score(spark, d):
    """With the runs that mention a document's repository as its usage; unknown without a repository."""
    runs = table(spark, d, "candidates").groupBy("repo").agg(F.countDistinct("resolution_id").alias("usage"))
    usage = table(spark, d, "documents").join(runs, "repo").select("doc_id", (F.col("usage") / 10).cast("bigint").alias("usage"))
    s = tfidf.scores(table(spark, d, "eval_items"), "item_id", "task_prompt", _profile(spark, d), "doc_id", usage).select("item_id", "doc_id", F.round("score", 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).filter("rank <= 10")


def _groups(spark, d):
    g = _scores(spark, d).withColumn("score", F.round("score", 9)).join(table(spark, d, "documents").select("doc_id", _group()), "doc_id")
    return routing.top_mean(g, ["item_id", "group_path"])


def route_groups(spark, d):
    """The five best repositories of each question: mean of their three best documents, as a share of the winner's."""
    g = _groups(spark, d).withColumn("share", F.round(routing.normalised(F.col("group_score"), Window.partitionBy("item_id")), 6))
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.round("group_score", 9).desc(), "group_path")))
    return g.filter("rank <= 5").select("item_id", "group_path", F.round("group_score", 6).alias("group_score"), "share", "rank")


def margin_confidence(spark, d):
    return routing.margin(_groups(spark, d), "item_id").select("item_id", "groups", F.round("margin", 6).alias("margin"))


def entropy_confidence(spark, d):
    return routing.entropy_confidence(_groups(spark, d), "item_id").select("item_id", "groups", F.round("confidence", 6).alias("confidence"))


def near_ties(spark, d):
    return routing.near_ties(_groups(spark, d), "item_id", "group_path")


def entry_documents(spark, d):
    """The five best documents of the winning repository of each question; usage breaks ties before the id."""
    g = _groups(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.round("group_score", 9).desc(), "group_path"))).filter("r = 1")
    docs = table(spark, d, "documents").select("doc_id", _group(), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    s = _scores(spark, d).withColumn("score", F.round("score", 9)).join(docs, "doc_id").join(g.select("item_id", "group_path"), ["item_id", "group_path"])
    r = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("n_chars"), "doc_id"))
    return s.withColumn("rank", r).filter(F.col("rank") <= routing.ENTRIES).select("item_id", "group_path", "doc_id", "rank")


def _symbol_texts(spark, d):
    s = table(spark, d, "symbols").select("file_path", "name").distinct().filter("file_path is not null")
    return s.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))


def ppmi_neighbors(spark, d):
    g = tfidf.ppmi(_symbol_texts(spark, d), "file_path", "names")
    return g.select("term", "neighbour", F.round("ppmi", 6).alias("ppmi"), "rank")


def query_expansion(spark, d):
    """Terms of the prompts that no expected answer has, with their neighbours among the symbols."""
    docs = T.token_rows(table(spark, d, "eval_items"), ["item_id"], "expected_answer")
    graph = tfidf.ppmi(_symbol_texts(spark, d), "file_path", "names")
    return tfidf.expansions(table(spark, d, "runs").select("request_id", "prompt").distinct(), "request_id", "prompt", docs, graph)


def token_idf(spark, d):
    names = table(spark, d, "symbols").select("name").distinct().filter("name is not null")
    t = T.token_rows(names.select("name", F.col("name").alias("text")), ["name"], "text").distinct().groupBy("term").agg(F.count("*").alias("df"))
    n = names.agg(F.count("*").alias("n")).scalar()
    return t.select("term", "df", F.round(F.log(n / F.col("df")), 6).alias("idf"))


def token_overlap_rank(spark, d):
    """Symbol names by the share of their tokens that a question has; the twenty best of each question."""
    names = table(spark, d, "symbols").select("name").distinct().filter("name is not null").withColumn("t", F.array_distinct(T.tokenize(F.col("name")))).filter(F.size("t") > 0)
    tok = names.select("name", F.size("t").alias("size"), F.explode("t").alias("term"))
    q = table(spark, d, "eval_items").select("item_id", F.explode(F.array_distinct(T.tokenize(F.col("task_prompt")))).alias("term"))
    s = q.join(tok, "term").groupBy("item_id", "name", "size").agg(F.count("*").alias("matched")).withColumn("overlap", F.round(F.col("matched") / F.col("size"), 6))
    r = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("overlap"), F.desc("matched"), "name"))
    return s.withColumn("rank", r).filter("rank <= 20").select("item_id", "name", "matched", "overlap", "rank")


QUERIES = {f.__name__: f for f in (route_groups, tfidf_weights, tfidf_score, tfidf_damped_score, margin_confidence, entropy_confidence, near_ties, entry_documents, ppmi_neighbors, query_expansion, token_idf, token_overlap_rank)}

_PROFILE = f"""
    WITH {sql.tokens('t', 'documents', 'doc_id', 'text')},
    c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
    raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS w, sum(tf) OVER (PARTITION BY doc_id) AS length FROM c JOIN df USING (term)),
    prof AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight, length FROM raw)"""
_SCORES = _PROFILE + f""",
    {sql.tokens('qt', 'eval_items', 'item_id', 'task_prompt')},
    q AS (SELECT item_id, term, count(*) AS q, count(*) OVER (PARTITION BY item_id) AS terms FROM qt GROUP BY 1, 2),
    sc AS (SELECT item_id, doc_id, sum(q * weight) * least(1.0::DOUBLE, any_value(length) / 30.0::DOUBLE) * least(1.0::DOUBLE, count(*) / least(4, any_value(terms))::DOUBLE) AS score
        FROM q JOIN prof USING (term) GROUP BY 1, 2)"""
_GROUPS = _SCORES + """,
    gs AS (SELECT item_id, doc_id, round(score, 9) AS score, coalesce(repo, '') AS group_path FROM sc JOIN documents USING (doc_id)),
    g AS (SELECT item_id, group_path, avg(score) AS group_score FROM (SELECT * FROM gs QUALIFY row_number() OVER (PARTITION BY item_id, group_path ORDER BY score DESC, doc_id) <= 3) GROUP BY 1, 2)"""
_TOP = "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"
_SYMBOLS = """n AS (SELECT file_path, string_agg(name, ' ') AS names FROM (SELECT DISTINCT file_path, name FROM symbols WHERE file_path IS NOT NULL) GROUP BY 1)"""
_PPMI = f"""{_SYMBOLS}, {sql.tokens('nt', 'n', 'file_path', 'names')},
    dt AS (SELECT DISTINCT file_path, term FROM nt), cap AS (SELECT * FROM dt QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY term) <= 250),
    fdf AS (SELECT term, count(*) AS df FROM cap GROUP BY 1), nd AS (SELECT count(DISTINCT file_path) AS n FROM cap),
    co AS (SELECT a.term AS a, b.term AS b, count(*) AS co FROM cap a JOIN cap b ON a.file_path = b.file_path AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= 2),
    pm AS (SELECT a, b, ln(co * n / (x.df * y.df)) AS ppmi FROM co JOIN fdf x ON a = x.term JOIN fdf y ON b = y.term, nd),
    bo AS (SELECT a AS term, b AS neighbour, ppmi FROM pm WHERE ppmi > 0 UNION ALL SELECT b, a, ppmi FROM pm WHERE ppmi > 0),
    graph AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(ppmi, 9) DESC, neighbour) AS rank FROM bo QUALIFY rank <= 10)"""

ORACLE = {
    "tfidf_weights": _PROFILE + " SELECT doc_id, term, round(weight, 6) AS weight FROM prof",
    "tfidf_score": _SCORES + f", s AS (SELECT item_id, doc_id, round(score, 6) AS score FROM sc) {_TOP}",
    "tfidf_damped_score": _SCORES + f""",
        u AS (SELECT repo, count(DISTINCT resolution_id) AS n FROM candidates GROUP BY 1),
        us AS (SELECT doc_id, floor(n / 10)::BIGINT AS usage FROM documents JOIN u USING (repo)),
        s AS (SELECT item_id, doc_id, round(score * CASE WHEN usage IS NULL THEN 1.0 ELSE least(1.0::DOUBLE, usage / 20.0::DOUBLE) END, 6) AS score FROM sc LEFT JOIN us USING (doc_id)) {_TOP}""",
    "route_groups": _GROUPS + """
        SELECT item_id, group_path, round(group_score, 6) AS group_score, round(CASE WHEN max(group_score) OVER w > 0 THEN group_score / max(group_score) OVER w ELSE 0 END, 6) AS share,
          row_number() OVER (PARTITION BY item_id ORDER BY round(group_score, 9) DESC, group_path) AS rank FROM g WINDOW w AS (PARTITION BY item_id) QUALIFY rank <= 5""",
    "margin_confidence": _GROUPS + """
        , r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY group_score DESC) AS r FROM g),
        m AS (SELECT item_id, count(*) AS groups, max(group_score) FILTER (r = 1) AS a, max(group_score) FILTER (r = 2) AS b FROM r GROUP BY 1)
        SELECT item_id, groups, round(CASE WHEN groups = 1 THEN 1.0 WHEN a <= 0 THEN 0.0 ELSE (a - b) / a END, 6) AS margin FROM m""",
    "entropy_confidence": _GROUPS + """
        , p AS (SELECT item_id, group_score / sum(group_score) OVER (PARTITION BY item_id) AS p FROM g WHERE group_score > 0),
        e AS (SELECT item_id, count(*) AS groups, -sum(p * log2(p)) AS h FROM p GROUP BY 1)
        SELECT item_id, groups, round(CASE WHEN groups <= 1 THEN 1.0 ELSE 1 - h / log2(groups) END, 6) AS confidence FROM e""",
    "near_ties": _GROUPS + """
        , r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(group_score, 9) DESC, group_path) AS r, max(group_score) OVER (PARTITION BY item_id) AS best FROM g)
        SELECT item_id, group_path, r - 1 AS near_rank FROM r WHERE r > 1 AND r <= 3 AND group_score >= 0.97 * best""",
    "entry_documents": _GROUPS + """
        , b AS (SELECT item_id, group_path FROM g QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(group_score, 9) DESC, group_path) = 1)
        SELECT item_id, group_path, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, coalesce(n_chars, 0) DESC, doc_id) AS rank
        FROM gs JOIN b USING (item_id, group_path) JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) QUALIFY rank <= 5""",
    "ppmi_neighbors": f"WITH {_PPMI} SELECT term, neighbour, round(ppmi, 6) AS ppmi, rank FROM graph",
    "query_expansion": f"""
        WITH {_PPMI}, {sql.tokens('dk', 'eval_items', 'item_id', 'expected_answer')}, rq AS (SELECT DISTINCT request_id, prompt FROM runs), {sql.tokens('rt', 'rq', 'request_id', 'prompt')}
        SELECT DISTINCT request_id, term, neighbour FROM rt JOIN graph USING (term) WHERE rank <= 3 AND term NOT IN (SELECT term FROM dk)""",
    "token_idf": f"""
        WITH n AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL), {sql.tokens('nt', 'n', 'name', 'name')}
        SELECT term, count(DISTINCT name) AS df, round(ln((SELECT count(*) FROM n) / count(DISTINCT name)), 6) AS idf FROM nt GROUP BY 1""",
    "token_overlap_rank": f"""
        WITH n AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL), {sql.tokens('nt', 'n', 'name', 'name')},
        k AS (SELECT DISTINCT name, term FROM nt), z AS (SELECT name, term, count(*) OVER (PARTITION BY name) AS size FROM k),
        {sql.tokens('qt', 'eval_items', 'item_id', 'task_prompt')},
        s AS (SELECT item_id, name, count(*) AS matched, round(count(*) / any_value(size), 6) AS overlap FROM (SELECT DISTINCT item_id, term FROM qt) JOIN z USING (term) GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, matched DESC, name) AS rank FROM s QUALIFY rank <= 20""",
}
