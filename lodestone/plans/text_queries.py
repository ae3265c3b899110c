"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.keywords import keyword_hits
from ..session import ship, table
from . import sql

#: Words of a question that are no keywords (fixed values).
NAIVE_STOPWORDS = (
    "the a an and or but for with without from that this these those into onto not are was were been has have had how why what when "
    "where does add explain summarize debug trace investigate refactor path"
).split()


def tokenize_docs(spark, d):
    t = T.token_rows(table(spark, d, "documents"), [], "text")
    return t.groupBy("term").agg(F.count("*").alias("n"))


def stem_words(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.array_distinct(T.parts(F.col("text")))).alias("word")).distinct().filter("word != ''")
    return w.select("word", T.stem(F.col("word")).alias("stem"), T.stem_suffix(F.col("word")).alias("suffix_stem"), T.singular(F.col("word")).alias("singular"))


def probe_prefixes(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.array_join(T.probe_prefixes(F.col("task_prompt")), " ").alias("prefixes"))


def query_axes(spark, d):
    a = T.axes(F.col("prompt"))
    r = table(spark, d, "runs").select("prompt").distinct().filter("prompt is not null")
    return r.select("prompt", F.size(a).alias("axes"), F.element_at(a, 1).alias("first_axis"), F.element_at(a, -1).alias("last_axis"))


def case_permutations(spark, d):
    n = table(spark, d, "candidates").select(F.regexp_replace("reason", r"^\S+ ", "").alias("name")).distinct()
    spaced = F.regexp_replace(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2"), "[._]", " ")
    return n.filter("name is not null").select("name", F.array_join(T.permutations(spaced), ",").alias("candidates"))


def comment_extract(spark, d):
    p = table(spark, d, "packaged_files").select("item_id", "content").distinct()
    c = T.comment_text(F.coalesce("content", F.lit("")))
    return p.select("item_id", F.length(c).cast("bigint").alias("chars"), F.md5(c).alias("digest"))


def diff_stats(spark, d):
    r = table(spark, d, "documents").filter("text is not null")
    f = T.modified_files(F.col("text"))
    return r.select("doc_id", F.size(f).alias("files"), F.array_join(f, ",").alias("paths"), T.changed_lines(F.col("text")).cast("bigint").alias("changed"))


def qualified_refs(spark, d):
    p = table(spark, d, "packaged_files").filter("content is not null").select("item_id", "content").distinct()
    return p.select("item_id", F.explode(T.qualified_references(F.col("content"))).alias("reference"))


def keyword_rank(spark, d):
    """All keywords of each item's question, counted as parts of words in every document; the ten best documents of each item.

    The questions are the stated query set and checked to be few; texts are read by a map that keeps the ten best of each batch, so none
    is shuffled."""
    ship(spark)
    keywords = F.regexp_extract_all(F.lower("task_prompt"), F.lit("[a-z][a-z0-9_]{2,}"), F.lit(0))
    q = table(spark, d, "eval_items").select("item_id", F.explode(keywords).alias("keyword")).filter(~F.col("keyword").isin(NAIVE_STOPWORDS)).distinct()
    hits = keyword_hits(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"), q, 10)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id"))).filter("rank <= 10")


def token_counts(spark, d):
    p = table(spark, d, "packaged_files").select("item_id", "content", "token_count").distinct()
    n = T.token_count(F.coalesce("content", F.lit("")))
    return p.select("item_id", F.coalesce("token_count", F.lit(-1)).alias("claimed"), n.alias("counted"), F.coalesce(F.col("token_count") == n, F.lit(False)).alias("agrees"))


QUERIES = {f.__name__: f for f in (tokenize_docs, stem_words, probe_prefixes, query_axes, case_permutations, comment_extract, diff_stats, qualified_refs, keyword_rank, token_counts)}

_LOW = "lower(prompt)"
_AT = "least(" + ", ".join(f"nullif(instr({_LOW}, '{m}'), 0)" for m in T.AXIS_MARKERS) + ")"
_LEN = "CASE " + " ".join(f"WHEN instr({_LOW}, '{m}') = pos THEN {len(m)}" for m in T.AXIS_MARKERS) + " END"

ORACLE = {
    "tokenize_docs": f"WITH {sql.tokens('t', 'documents', 'doc_id', 'text')} SELECT term, count(*) AS n FROM t GROUP BY term",
    "stem_words": f"""
        WITH w AS (SELECT DISTINCT unnest({sql.parts('text')}) AS word FROM documents), p AS (SELECT word, {sql.plural('word')} AS s FROM w WHERE word <> '')
        SELECT word, CASE WHEN length(word) <= 3 THEN word ELSE {sql.verb('s')} END AS stem,
          CASE WHEN word LIKE '%ing' AND length(word) >= 6 THEN word[:-4] WHEN word LIKE '%ed' AND length(word) >= 5 THEN word[:-3]
               WHEN word LIKE '%es' AND length(word) >= 5 THEN word[:-3] WHEN word LIKE '%s' AND length(word) >= 4 THEN word[:-2] ELSE word END AS suffix_stem,
          CASE WHEN length(word) > 4 AND word LIKE '%s' AND word NOT LIKE '%ss' THEN word[:-2] ELSE word END AS singular FROM p""",
    "probe_prefixes": f"""
        WITH w AS (SELECT item_id, unnest({sql.words('task_prompt')}) AS w, generate_subscripts({sql.words('task_prompt')}, 1) AS k FROM eval_items),
        f AS (SELECT item_id, left(lower(w), 6) AS p, min(k) AS k FROM w WHERE length(w) >= 6 AND lower(w) NOT IN ({sql.STOP}) GROUP BY 1, 2)
        SELECT i.item_id, coalesce(string_agg(p, ' ' ORDER BY k), '') AS prefixes FROM eval_items i LEFT JOIN f USING (item_id) GROUP BY 1""",
    "query_axes": f"""
        WITH a AS (SELECT DISTINCT prompt, {_AT} AS pos FROM runs WHERE prompt IS NOT NULL), l AS (SELECT *, {_LEN} AS n FROM a)
        SELECT prompt, CASE WHEN pos IS NULL THEN 1 ELSE 2 END AS axes, CASE WHEN pos IS NULL THEN prompt ELSE trim(prompt[:pos - 1], ' ') END AS first_axis,
          CASE WHEN pos IS NULL THEN prompt ELSE trim(prompt[pos + n:], ' ') END AS last_axis FROM l""",
    "case_permutations": r"""
        WITH n AS (SELECT DISTINCT regexp_replace(reason, '^\S+ ', '') AS name FROM candidates WHERE reason IS NOT NULL),
        w AS (SELECT name, list_transform(regexp_extract_all(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[._]', ' ', 'g'), '[A-Za-z0-9]+'),
            lambda x: CASE WHEN length(x) > 4 AND lower(x) LIKE '%s' AND lower(x) NOT LIKE '%ss' THEN lower(x)[:-2] ELSE lower(x) END) AS ws FROM n),
        c AS (SELECT name, ws, list_transform(ws, lambda x: upper(x[1]) || x[2:]) AS caps FROM w),
        u AS (SELECT name, len(ws) AS n, list_concat(list_concat([array_to_string(caps, '')], list_transform(range(1, len(ws)), lambda i: caps[i] || caps[i + 1])),
            list_concat(caps, [ws[1] || array_to_string(caps[2:], ''), array_to_string(ws, '_')])) AS every FROM c),
        e AS (SELECT name, n, unnest(every) AS x, generate_subscripts(every, 1) AS k FROM u),
        m AS (SELECT name, n, x, min(k) AS k FROM e GROUP BY ALL)
        SELECT name, coalesce(string_agg(x, ',' ORDER BY k) FILTER (n >= 2), '') AS candidates FROM m GROUP BY name""",
    "comment_extract": r"""
        WITH p AS (SELECT DISTINCT item_id, content FROM packaged_files), c AS (SELECT item_id, left(coalesce(content, ''), 300000) AS c FROM p),
        x AS (SELECT item_id, list_concat(list_concat(regexp_extract_all(c, '(?s)/\*(.*?)\*/', 1),
            list_transform(regexp_extract_all(c, '(?s)\"\"\".*?\"\"\"|''''''.*?'''''''), lambda q: q[4:length(q) - 3])),
            list_transform(list_filter(string_split(c, chr(10)), lambda l: regexp_matches(l, '^\s*(#|//)')), lambda l: regexp_replace(l, '^\s*(#|//)\s?', ''))) AS chunks FROM c)
        SELECT item_id, length(array_to_string(chunks, chr(10))) AS chars, md5(array_to_string(chunks, chr(10))) AS digest FROM x""",
    "diff_stats": r"""
        WITH h AS (SELECT doc_id, text,
            list_concat(list_concat(flatten(list_transform(regexp_extract_all(text, '(?m)^diff --git a/(\S+) b/\S+', 1), lambda x: [x])),
              list_filter(regexp_extract_all(text, '(?m)^(?:---|\+\+\+) (?:[ab]/)?(\S+)', 1), lambda p: p <> '/dev/null')),
              regexp_extract_all(text, '(?m)^### (\S+)', 1)) AS every FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, unnest(every) AS p, generate_subscripts(every, 1) AS k FROM h), m AS (SELECT doc_id, p, min(k) AS k FROM e GROUP BY ALL),
        f AS (SELECT doc_id, count(*) AS files, string_agg(p, ',' ORDER BY k) AS paths FROM m GROUP BY 1)
        SELECT doc_id, coalesce(files, 0)::INT AS files, coalesce(paths, '') AS paths,
          CASE WHEN regexp_matches(text, '(?m)^((---|\+\+\+) \S+|diff --git a/\S+ b/\S+)') THEN
            len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[+-]') AND NOT regexp_matches(x, '^[+-][+-][+-]'))) ELSE 0 END AS changed
        FROM h LEFT JOIN f USING (doc_id)""",
    "qualified_refs": r"""
        SELECT DISTINCT item_id, unnest(regexp_extract_all(content, '\b[A-Za-z_]\w*\.[A-Za-z_]\w*')) AS reference FROM (SELECT DISTINCT item_id, content FROM packaged_files WHERE content IS NOT NULL)""",
    "keyword_rank": f"""
        WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(task_prompt), '[a-z][a-z0-9_]{{2,}}')) AS keyword FROM eval_items),
        k AS (SELECT * FROM q WHERE keyword NOT IN ({", ".join(f"'{w}'" for w in NAIVE_STOPWORDS)})),
        t AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL),
        h AS (SELECT doc_id, keyword, (length(low) - length(replace(low, keyword, ''))) // length(keyword) AS n FROM t, (SELECT DISTINCT keyword FROM k) WHERE contains(low, keyword)),
        s AS (SELECT item_id, doc_id, sum(n)::BIGINT AS hits FROM h JOIN k USING (keyword) GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""",
    "token_counts": """
        SELECT DISTINCT item_id, coalesce(token_count, -1) AS claimed, ceil(length(coalesce(content, '')) / 4.0)::BIGINT AS counted,
          coalesce(token_count = ceil(length(coalesce(content, '')) / 4.0)::BIGINT, false) AS agrees FROM packaged_files""",
}
