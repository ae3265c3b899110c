"""Structured Streaming forms of the stateful operators. State is a few numbers per key; watermarks bound what is kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship


def token_bucket(events: DataFrame, key: str, ts: str, tie: str, capacity: int, rate: float) -> DataFrame:
    """``key, tie, allowed, tokens`` in append mode. Within a micro-batch a key's events are taken in the order of time; the state
    is the tokens left and the time they were counted at. A key's state is dropped once its bucket is sure to be full."""
    kind = dict(events.dtypes)
    full_ms = int(capacity / rate * 1000) if rate > 0 else None
    ship(events.sparkSession)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(batches)).dropna(subset=[ts]).sort_values([ts, tie])
        allowed, left = [], []
        for t in rows[ts]:
            now = t.value / 1e9
            tokens = min(float(capacity), tokens + (0.0 if last is None else max(0.0, now - last)) * rate)
            ok = tokens >= 1
            tokens -= ok
            allowed.append(bool(ok))
            left.append(tokens)
            last = now if last is None else max(last, now)
        state.update((tokens, last))
        if full_ms and last is not None:
            state.setTimeoutTimestamp(max(int(last * 1000) + full_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(rows), tie: rows[tie].tolist(), "allowed": allowed, "tokens": left})

    out = f"{key} {kind[key]}, {tie} {kind[tie]}, allowed boolean, tokens double"
    return events.groupBy(key).applyInPandasWithState(run, out, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def first_requests(events: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """Fresh requests alone: repeats of a key within the watermark's time to live are dropped."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window behind a watermark; late rows beyond it are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def incremental_files(path: str):
    """A ``foreachBatch`` function that appends the files that are new, or whose content changed, to the index table at ``path``:
    an anti-join by path and digest against what the table holds."""

    def batch(new: DataFrame, _: int) -> None:
        spark = new.sparkSession
        hashed = new.select("file_path", F.sha2("source_bytes", 256).alias("digest")).dropDuplicates(["file_path", "digest"])
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        known = spark.read.schema("file_path string, digest string").parquet(path) if there else spark.createDataFrame([], "file_path string, digest string")
        hashed.join(known, ["file_path", "digest"], "left_anti").checkpoint().write.mode("append").parquet(path)

    return batch
