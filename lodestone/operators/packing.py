"""Budgeted packing as ordered folds, and interval algebra over line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FALLOFF, CALL_WINDOW, MARGIN = 0.45, 8, 2


def greedy_fit(items: DataFrame, keys: list[str], order: list[str], cost: str, budget: Column, payload: str) -> DataFrame:
    """``keys, payload, position, packed``: first fit in order, an item that doesn't fit is skipped and takes no budget.

    One array and one fold per group, whose items are the candidates of one request, bounded by its scan; groups spread
    over the cluster."""
    row = F.struct(*order, F.col(payload).alias("_id"), F.col(cost).cast("bigint").alias("_cost"))
    g = items.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.first(budget).cast("bigint").alias("budget"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc, x):
        fits = acc["used"] + x["_cost"] <= F.col("budget")
        return F.struct(F.when(fits, acc["used"] + x["_cost"]).otherwise(acc["used"]).alias("used"), F.concat(acc["taken"], F.array(fits)).alias("taken"))

    g = g.withColumn("fold", F.aggregate("rows", start, step))
    return g.select(*keys, F.posexplode(F.arrays_zip(F.col("rows"), F.col("fold.taken").alias("taken"))).alias("position", "x")).select(*keys, F.col("x.rows._id").alias(payload), "position", F.col("x.taken").alias("packed"))


def merged_intervals(ranges: DataFrame, keys: list[str], start: str, end: str, margin: int = 0) -> DataFrame:
    """Ranges widened by a margin and merged where they touch or overlap: ``keys, start, end, ranges``; gaps and islands."""
    r = ranges.select(*keys, F.greatest(F.col(start) - margin, F.lit(1)).alias("s"), (F.col(end) + margin).alias("e")).filter("s is not null and e is not null")
    w = Window.partitionBy(*keys).orderBy("s", "e")
    r = r.withColumn("prev", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("island", F.sum(F.when(F.col("prev").isNull() | (F.col("s") > F.col("prev") + 1), 1).otherwise(0)).over(w))
    return r.groupBy(*keys, "island").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.count("*").alias("ranges")).drop("island")


def line_window(content: Column, line: Column, size: int = CALL_WINDOW) -> Column:
    """Lines around a line; empty where it lies outside of the text."""
    lines = F.split(content, "\n")
    first = F.greatest(line - size, F.lit(1))
    return F.when((line >= 1) & (line <= F.size(lines)), F.array_join(F.slice(lines, first, F.least(line + size, F.size(lines)) - first + 1), "\n")).otherwise("")


def header_end(content: Column, most: int = 15) -> Column:
    """Number of leading lines, up to ``most``, that are blank, comments or imports."""
    head = F.slice(F.split(content, "\n"), 1, most)
    body = F.transform(head, lambda x: ~F.trim(x).rlike(r"^(\s*$|#|//|/\*|\*|import\b|from\b|package\b|use\b|\"\"\"|''')"))
    first = F.array_position(body, True)
    return F.when(first > 0, first - 1).otherwise(F.size(head)).cast("int")


def head_lines(lines: Column) -> Column:
    """Number of leading lines up to the first after which all parentheses are closed; all lines where they never are."""
    opened = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(0).alias("head"))

    def step(acc, x):
        n, depth = acc["n"] + 1, acc["depth"] + opened(x, "(") - opened(x, ")")
        return F.struct(n.alias("n"), depth.alias("depth"), F.when((acc["head"] == 0) & (depth <= 0), n).otherwise(acc["head"]).alias("head"))

    fold = F.aggregate(lines, start, step)
    return F.when(fold["head"] > 0, fold["head"]).otherwise(fold["n"])
