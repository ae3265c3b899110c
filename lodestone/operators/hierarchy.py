"""Directory hierarchies: subtree counts, adaptive grouping, segments and their members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

GROUP_SIZE, GROUP_DEPTH = 50, 6


def subtree_counts(files: DataFrame, path: str = "file_path") -> DataFrame:
    """``directory, files, direct``: files below each directory, and those directly in it."""
    f = files.select(P.dirname(F.col(path)).alias("own")).withColumn("directory", F.explode(P.ancestors(F.col("own"))))
    return f.groupBy("directory").agg(F.count("*").alias("files"), F.count_if(F.col("own") == F.col("directory")).alias("direct"))


def register(files: DataFrame, size: int = GROUP_SIZE, depth: int = GROUP_DEPTH, path: str = "file_path") -> DataFrame:
    """``group_path``: the groups of an adaptive hierarchy. From the root on, a directory with more than ``size`` files below it
    is split into its subdirectories, down to ``depth``; its own files, or those of a directory without subdirectories, form one
    group, or one per file name prefix (``directory::prefix``) when they are too many and have several.

    A directory is reached when all directories above it are split; that is a condition on its ancestors' counts, so no
    top-down recursion is needed."""
    counts = subtree_counts(files, path)
    parents = counts.filter("directory != ''").select(F.when(F.col("directory").contains("/"), P.dirname(F.col("directory"))).otherwise("").alias("directory")).distinct().withColumn("inner", F.lit(True))
    level = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    dirs = counts.join(parents, "directory", "left").withColumn("inner", F.coalesce("inner", F.lit(False))).withColumn("level", level)
    dirs = dirs.withColumn("over", (F.col("files") > size) & (F.col("level") < depth)).withColumn("split", F.col("over") & F.col("inner"))
    above = dirs.select("directory", F.explode(P.ancestors(F.col("directory"))).alias("up")).filter("up != directory")
    blocked = above.join(dirs.select(F.col("directory").alias("up"), "split"), "up").filter(~F.col("split")).select("directory").distinct()
    reached = dirs.join(blocked, "directory", "left_anti")
    whole = reached.filter(~F.col("over")).select("directory")
    own = reached.filter(F.col("over") & (F.col("direct") > 0))
    few = own.filter(F.col("direct") <= size).select("directory")
    many = own.filter(F.col("direct") > size).select("directory")
    prefixes = files.select(P.dirname(F.col(path)).alias("directory"), P.name_prefix(F.col(path)).alias("prefix")).distinct().join(many, "directory")
    prefixes = prefixes.withColumn("n", F.count("*").over(Window.partitionBy("directory")))
    clusters = prefixes.select(F.when(F.col("n") > 1, F.concat_ws("::", "directory", "prefix")).otherwise(F.col("directory")).alias("group_path"))
    return whole.unionByName(few).select(F.col("directory").alias("group_path")).unionByName(clusters).distinct()


def owners(files: DataFrame, groups: DataFrame, path: str = "file_path") -> DataFrame:
    """``file_path, group_path``: the group that owns each file: its prefix cluster, else its nearest ancestor that is a group."""
    f = files.select(path, P.dirname(F.col(path)).alias("own"), P.name_prefix(F.col(path)).alias("prefix"))
    up = f.select(path, F.posexplode(F.concat(F.array(F.concat_ws("::", "own", "prefix")), P.ancestors(F.col("own")))).alias("k", "group_path"))
    return up.join(groups, "group_path").groupBy(path).agg(F.min_by("group_path", "k").alias("group_path"))


def segments(files: DataFrame, roots: DataFrame, path: str = "file_path") -> DataFrame:
    """``file_path, segment``: the deepest root directory above each file, ``''`` where there is none; an equi-join of exploded
    ancestors instead of a prefix join."""
    up = files.select(path, F.explode(P.ancestors(P.dirname(F.col(path)))).alias("segment"))
    return up.join(roots.select(F.col("directory").alias("segment"), F.lit(True).alias("_root")), "segment", "left").groupBy(path).agg(F.max_by("segment", F.when(F.col("_root") | (F.col("segment") == ""), F.length("segment")).otherwise(-1)).alias("segment"))


def dominant(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; the smallest of equally frequent ones."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc_nulls_first(value)))
    return n.withColumn("_r", r).filter("_r = 1").drop("_r")
