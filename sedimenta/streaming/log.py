"""Structured Streaming forms of the log's operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LAG = "60 seconds"


def unique_within_watermark(stream: DataFrame, key: str, at: str, lag: str = LAG) -> DataFrame:
    """First rows of each key; the state of old keys goes with the watermark."""
    return stream.withWatermark(at, lag).dropDuplicatesWithinWatermark([key])


def append_to(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends rows with new keys only. It joins against the log, so a batch that runs twice adds nothing."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        first = batch.dropDuplicates([key])
        try:
            log = spark.read.schema(batch.schema).parquet(path)
            first = first.join(log.select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        first.select(*batch.columns).write.mode("append").parquet(path)

    return sink


def daily_counts(stream: DataFrame, at: str, keys: list[str], lag: str = "1 day") -> DataFrame:
    """(day, keys..., n) over tumbling UTC days; days close with the watermark."""
    day = F.window(at, "1 day")
    return stream.withWatermark(at, lag).groupBy(day, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *keys, "n")


def sliding_modes(stream: DataFrame, key: str, at: str, id_: str, value: str, size: int = 20, high: float = 8.0, low: float = 4.0, start: str = "dmn") -> DataFrame:
    """(key, id, total, mode): sums over the last `size` rows of a key with hysteresis; the state is these values and the mode."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, mode = (list(state.get[0]), state.get[1]) if state.exists else ([], start)
        rows = pd.concat(list(frames)).sort_values([at, id_])
        out = []
        for i, v in zip(rows[id_], rows[value], strict=True):
            values = [*values[-(size - 1) :], float(v)] if size > 1 else [float(v)]
            total = sum(values)
            mode = "cen" if total >= high else "dmn" if total <= low else mode
            out.append((k[0], i, total, mode))
        state.update((values, mode))
        yield pd.DataFrame(out, columns=[key, "id", "total", "mode"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, id long, total double, mode string", "held array<double>, mode string", "append", GroupStateTimeout.NoTimeout)


def token_buckets(stream: DataFrame, key: str, at: str, id_: str, rate: float, burst: float) -> DataFrame:
    """(key, id, allowed) of requests against a bucket a key; `at` in seconds."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(frames)).sort_values([at, id_])
        out = []
        for i, t in zip(rows[id_], rows[at], strict=True):
            left = min(burst, left + max(0.0, t - (t if last is None else last)) * rate)
            last = float(t)
            ok = left >= 1
            left -= 1.0 if ok else 0.0
            out.append((k[0], i, ok))
        state.update((float(left), last))
        yield pd.DataFrame(out, columns=[key, "id", "allowed"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, id long, allowed boolean", "kept double, last double", "append", GroupStateTimeout.NoTimeout)
