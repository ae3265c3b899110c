"""Group scores, normalisation and confidences of profile-routed retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_MEAN, ENTRIES, NEAR_MARGIN, NEAR_COUNT = 3, 5, 0.03, 2
WEIGHTS = {"tfidf": 0.55, "community": 0.30, "taxonomy": 0.15}


def top_mean(scores: DataFrame, keys: list[str], score: str = "score", order: str = "doc_id", k: int = TOP_MEAN) -> DataFrame:
    """Mean of the ``k`` best scores of each group, over those there are."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), order))
    return scores.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy(*keys).agg(F.avg(score).alias("group_score"))


def normalised(score: Column, by: Window) -> Column:
    """Share of the best score, 0 where the best is not positive."""
    best = F.max(score).over(by)
    return F.when(best > 0, score / best).otherwise(0.0)


def margin(groups: DataFrame, key: str, score: str = "group_score") -> DataFrame:
    """Lead of the best group over the next: 1 for a single group, 0 where the best is 0."""
    ranked = groups.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc())))
    top = ranked.groupBy(key).agg(F.count("*").alias("groups"), F.max(F.when(F.col("_r") == 1, F.col(score))).alias("a"), F.max(F.when(F.col("_r") == 2, F.col(score))).alias("b"))
    return top.select(key, "groups", F.when(F.col("groups") == 1, 1.0).when(F.col("a") <= 0, 0.0).otherwise((F.col("a") - F.col("b")) / F.col("a")).alias("margin"))


def entropy_confidence(groups: DataFrame, key: str, score: str = "group_score") -> DataFrame:
    """One minus the entropy of the groups' shares over its maximum; 1 for a single group."""
    total = F.sum(score).over(Window.partitionBy(key))
    p = groups.filter(F.col(score) > 0).withColumn("p", F.col(score) / total)
    e = p.groupBy(key).agg(F.count("*").alias("groups"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    return e.select(key, "groups", F.when(F.col("groups") <= 1, 1.0).otherwise(1 - F.col("h") / F.log2("groups")).alias("confidence"))


def near_ties(groups: DataFrame, key: str, group: str, score: str = "group_score") -> DataFrame:
    """Up to two groups within three percent of the winner, the winner aside."""
    w = Window.partitionBy(key).orderBy(F.round(score, 9).desc(), group)
    r = groups.withColumn("_r", F.row_number().over(w)).withColumn("_best", F.max(score).over(Window.partitionBy(key)))
    near = r.filter((F.col("_r") > 1) & (F.col("_r") <= 1 + NEAR_COUNT) & (F.col(score) >= (1 - NEAR_MARGIN) * F.col("_best")))
    return near.select(key, group, (F.col("_r") - 1).alias("near_rank"))
