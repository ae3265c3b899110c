"""Evaluation statistics: paired comparisons, t-tests, set overlap, ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def reduction(base: Column, other: Column) -> Column:
    """Percentage saved, null without a positive base."""
    return F.when(base > 0, F.round((base - other) / base * 100, 2))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 4))


def paired_t(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``keys, n, t``: null for fewer than two pairs; for equal differences 0 when they are 0 and infinity when they aren't."""
    a = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_d", (F.col(x) - F.col(y)).cast("double")).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_d").alias("m"), F.stddev_samp("_d").alias("s"))
    t = F.when(F.col("n") < 2, None).when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).when(F.col("m") == 0, 0.0).otherwise(F.signum("m") * float("inf"))
    return a.select(*keys, "n", t.alias("t"))


def _fraction(a: float, b: float, x: float, most: int = 200, least: float = 3e-14) -> float:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, most + 1):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1.0) < least:
            break
    return f


def two_tailed_p(t: float | None, df: float | None) -> float | None:
    """Two-tailed p of Student's t by the regularised incomplete beta function; null for nulls and no degree of freedom."""
    if t is None or df is None or math.isnan(t) or df < 1:
        return None
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _fraction(b, a, 1 - x) / b


@pandas_udf(DoubleType())
def p_value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for t, df in batches:
        yield pd.Series([two_tailed_p(None if pd.isna(x) else float(x), None if pd.isna(n) else float(n)) for x, n in zip(t, df, strict=True)], dtype="float64")


def overlap(found: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets, zero where undefined."""
    both = F.size(F.array_intersect(found, truth))
    p = F.when(F.size(F.array_distinct(found)) > 0, both / F.size(F.array_distinct(found))).otherwise(0.0)
    r = F.when(F.size(F.array_distinct(truth)) > 0, both / F.size(F.array_distinct(truth))).otherwise(0.0)
    return F.round(p, 3), F.round(r, 3), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 3)


def term_rate(text: Column, terms: Column) -> Column:
    """Share of the terms that a text contains, whatever their case; null without terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))) / F.size(terms))
