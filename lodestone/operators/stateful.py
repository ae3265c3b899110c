"""Request-time state in batch form: token buckets, idempotency keys, running budgets.

Each is a recurrence per key. Where a pause is long enough the state no longer depends on what came before, so a key's history is
cut there into independent segments, each read in order by one task as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def segmented(events: DataFrame, keys: list[str], ts: str, tie: str, pause: float) -> DataFrame:
    """Events with their ``_segment``: a new one after every pause of at least ``pause`` seconds."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return events.filter(F.col(ts).isNotNull()).withColumn("_segment", F.sum(F.when(gap.isNull() | (gap >= int(pause * 1e6)), 1).otherwise(0)).over(w))


def folded(rows: DataFrame, keys: list[str], order: list[str], payload: list[str], make: Callable[[], Callable], out: str) -> DataFrame:
    """Rows of each key and segment in order, through a step that keeps its state from row to row.

    Partitions are sorted by Spark, which spills, and read once as a stream, so a long segment costs time but no memory; a key's
    segments spread over the partitions. ``make`` gives a fresh step, which maps the payload of a row to its output values."""
    k = [*keys, "_segment"]
    sorted_rows = rows.select(*dict.fromkeys([*k, *order, *payload])).repartition(*k).sortWithinPartitions(*k, *order)
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for pdf in batches:
            ids = list(zip(*[pdf[c].astype(object).where(pdf[c].notna(), None) for c in k], strict=True))
            values = list(zip(*[pdf[c].tolist() for c in payload], strict=True))
            results = []
            for key, v in zip(ids, values, strict=True):
                if key != current:
                    current, step = key, make()
                results.append(step(*v))
            res = pd.DataFrame(results, columns=[n for n in names if n not in pdf.columns])
            yield pd.concat([pdf[[n for n in names if n in pdf.columns]].reset_index(drop=True), res], axis=1)[names]

    return sorted_rows.mapInPandas(run, out)


def token_bucket(events: DataFrame, keys: list[str], ts: str, tie: str, capacity: int, rate: float) -> DataFrame:
    """``keys, tie, allowed, tokens``: each event takes a token if one is there; the bucket refills by ``rate`` a second up to
    ``capacity``. A pause that fills any bucket cuts segments. Events without a time are left out."""
    pause = capacity / rate if rate > 0 else float(2**40)
    s = segmented(events, keys, ts, tie, pause).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))

    def make() -> Callable:
        tokens, last = float(capacity), None

        def step(t: int) -> tuple[bool, float]:
            nonlocal tokens, last
            tokens = min(float(capacity), tokens + ((t - last) / 1e6 if last is not None else 0.0) * rate)
            ok = tokens >= 1
            tokens, last = tokens - ok, t
            return ok, tokens

        return step

    kinds = dict(events.dtypes)
    return folded(s, keys, ["_t", tie], ["_t"], make, ", ".join(f"{c} {kinds[c]}" for c in (*keys, tie)) + ", allowed boolean, tokens double")


def idempotency(events: DataFrame, keys: list[str], ts: str, tie: str, digest: str, ttl: float) -> DataFrame:
    """``keys, tie, outcome``: fresh, replay (same digest within the time to live of the record) or conflict (another digest).
    A record keeps the time of its first request; a pause of the time to live cuts segments."""
    s = segmented(events, keys, ts, tie, ttl).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_d", F.coalesce(F.col(digest).cast("string"), F.lit("\0")))

    def make() -> Callable:
        since, known = None, None

        def step(t: int, d: str) -> tuple[str]:
            nonlocal since, known
            if since is None or t - since >= int(ttl * 1e6):
                since, known = t, d
                return ("fresh",)
            return ("replay" if d == known else "conflict",)

        return step

    kinds = dict(events.dtypes)
    return folded(s, keys, ["_t", tie], ["_t", "_d"], make, ", ".join(f"{c} {kinds[c]}" for c in (*keys, tie)) + ", outcome string")


def running_budget(rows: DataFrame, keys: list[str], order: list[str], cost: str, most: int) -> DataFrame:
    """Rows with what is spent up to and with them, and whether that is within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("spent", F.sum(F.coalesce(F.col(cost), F.lit(0))).over(w))
    return r.withColumn("within", F.col("spent") <= most)
