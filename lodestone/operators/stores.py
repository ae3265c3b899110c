"""Stores as DataFrame transformations: ledger upserts, retention, versions and lineage. Tables are rewritten or appended by the
caller; nothing here collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETENTION = 50


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key; rows with a null key are left out."""
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def upsert(stored: DataFrame, arriving: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The stored rows with arriving ones in the place of those with the same key; of several arrivals the latest wins."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(arriving.withColumn("_new", F.lit(1)))
    return newest(both, keys, [F.desc("_new"), F.col(arrival).desc_nulls_last()]).drop("_new")


def retained(rows: DataFrame, workspace: str, order: list[Column], keep: int = RETENTION) -> DataFrame:
    """The ``keep`` newest rows of each workspace."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(workspace).orderBy(*order))).filter(F.col("_r") <= keep).drop("_r")


def deleted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def versions(rows: DataFrame, key: str, order: list[Column], member: str) -> DataFrame:
    """Rows numbered as versions of a key, each with the members that came before it as its lineage."""
    w = Window.partitionBy(key).orderBy(*order)
    v = rows.withColumn("version", F.row_number().over(w)).withColumn("previous", F.lag(member).over(w))
    return v.withColumn("lineage", F.array_join(F.collect_list(member).over(w.rowsBetween(Window.unboundedPreceding, -1)), ","))
