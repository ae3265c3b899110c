"""TF-IDF profiles, scoring and positive-PMI word graphs over long tables of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_rows, tokenize

LENGTH_FLOOR, USAGE_FLOOR, COVERAGE_FLOOR = 30, 20, 4
PPMI_TERMS, PPMI_PAIRS, PPMI_NEIGHBOURS, EXPANSION = 250, 2, 10, 3


def token_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf, length``: counts of the tokens of each document and its number of tokens. Documents without tokens
    have no row; null keys are left out."""
    t = token_rows(docs.filter(F.col(key).isNotNull()), [key], text).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return t.withColumn("length", F.sum("tf").over(Window.partitionBy(key)))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """Documents of each term. The count refers to ``tf`` so that both uses of the counts share one exchange, and texts are
    tokenised once."""
    return counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def weights(counts: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """``key, term, weight, length``: (1 + ln tf) * idf, of unit length per document. ``documents`` gives the corpus size,
    a scalar subquery. An empty corpus counts as one document."""
    n = documents.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")).scalar()
    raw = counts.join(document_frequencies(counts), "term").withColumn("w", (1 + F.log("tf")) * idf(n, F.col("df")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"), "length")


def scores(queries: DataFrame, query_key: str, text: str, profile: DataFrame, key: str, usage: DataFrame | None = None) -> DataFrame:
    """``query_key, key, score`` of documents that share a term with a query: the sum of query counts times weights, damped for
    short documents, rarely used ones (where usage is known) and few matched terms."""
    q = token_rows(queries, [query_key], text).groupBy(query_key, "term").agg(F.count("*").alias("_q"))
    q = q.withColumn("_terms", F.count("*").over(Window.partitionBy(query_key)))
    hit = q.join(profile, "term").groupBy(query_key, key).agg(
        F.sum(F.col("_q") * F.col("weight")).alias("_s"), F.count("*").alias("_matched"), F.first("_terms").alias("_terms"), F.first("length").alias("_length"))
    damp = F.least(F.lit(1.0), F.col("_length") / LENGTH_FLOOR) * F.least(F.lit(1.0), F.col("_matched") / F.least(F.lit(COVERAGE_FLOOR), F.col("_terms")))
    if usage is not None:
        hit = hit.join(usage, key, "left")
        damp = damp * F.when(F.col("usage").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("usage") / USAGE_FLOOR))
    return hit.select(query_key, key, (F.col("_s") * damp).alias("score"))


def ppmi(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``term, neighbour, ppmi, rank``: the ten strongest neighbours of each term by positive pointwise mutual information.

    Of each document the alphabetically first 250 distinct tokens count, which bounds its pairs; pairs are counted map-side
    before the shuffle, and terms of fewer than two documents are dropped first, as they can't be in a kept pair."""
    d = docs.filter(F.col(key).isNotNull()).select(key, F.slice(F.array_sort(F.array_distinct(tokenize(F.col(text)))), 1, PPMI_TERMS).alias("terms")).filter(F.size("terms") > 0)
    n = d.agg(F.count("*").alias("n")).scalar()
    terms = d.select(key, F.explode("terms").alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= PPMI_PAIRS)
    kept = terms.join(df, "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "df"))).alias("t"))
    pairs = kept.select(F.explode(F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b["term"] > a["term"]), lambda b: F.struct(a["term"].alias("a"), b["term"].alias("b"), a["df"].alias("da"), b["df"].alias("db")))))).alias("p")).select("p.*")
    co = pairs.groupBy("a", "b", "da", "db").agg(F.count("*").alias("co")).filter(F.col("co") >= PPMI_PAIRS)
    value = F.log(F.col("co") * n / (F.col("da") * F.col("db")))
    scored = co.withColumn("ppmi", value).filter("ppmi > 0")
    both = scored.select(F.col("a").alias("term"), F.col("b").alias("neighbour"), "ppmi").unionByName(scored.select(F.col("b").alias("term"), F.col("a").alias("neighbour"), "ppmi"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.round("ppmi", 9).desc(), "neighbour"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= PPMI_NEIGHBOURS)


def expansions(queries: DataFrame, query_key: str, text: str, indexed: DataFrame, graph: DataFrame) -> DataFrame:
    """``query_key, term, neighbour``: the three strongest neighbours of the query terms that no indexed document has."""
    q = token_rows(queries, [query_key], text).distinct()
    return q.join(indexed.select("term").distinct(), "term", "left_anti").join(graph.filter(F.col("rank") <= EXPANSION), "term").select(query_key, "term", "neighbour")
