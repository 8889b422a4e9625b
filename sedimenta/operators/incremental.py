"""Operators over ordered events: timelines, folds, budgets, day windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timeline(events: DataFrame, key: str, seconds: Column, order: list[str]) -> DataFrame:
    """events with seconds_since_previous of the same key; null for the first."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("seconds_since_previous", seconds - F.lag(seconds).over(w))


def first_seen(mentions: DataFrame, entity: str, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """mentions with is_first: 1 at the first sight of the entity."""
    w = Window.partitionBy(*(scope or []), entity).orderBy(*order)
    return mentions.withColumn("is_first", F.when(F.row_number().over(w) == 1, 1).otherwise(0))


def novelty(mentions: DataFrame, event: str, entity: str, order: list[str]) -> DataFrame:
    """(event, n, fresh, surprise): the share of an event's entities that no earlier event had."""
    own = mentions.select(event, entity, *[c for c in order if c not in (event, entity)]).distinct()
    seen = first_seen(own, entity, order)
    return seen.groupBy(event).agg(F.count(F.lit(1)).alias("n"), F.sum("is_first").alias("fresh")).withColumn("surprise", F.round(F.col("fresh") / F.col("n"), 6))


def rolling(events: DataFrame, value: str, order: list[str], n: int, key: list[str] | None = None) -> Column:
    """Sum over the last n rows of a key, this one included, as a double that is rounded once: no order of adding shows in it.

    Multiples of 2**-20 add exactly up to 2**32, and what they leave of the values is so small that its sum errs far below the last place.
    Larger values, infinite ones and NaN add plainly.
    """
    w = Window.partitionBy(*(key or [])).orderBy(*order).rowsBetween(1 - n, 0)
    v = F.col(value).cast("double")
    fits = F.abs(v) <= 2.0**32 / n
    coarse = F.when(fits, F.rint(v * 2.0**20) / 2.0**20).otherwise(v)
    fine = F.when(fits, v - coarse).otherwise(0.0)
    return F.sum(coarse).over(w) + F.sum(fine).over(w)


def fold_modes(cumulative: DataFrame, key: str, order: list[str], high: float, low: float, start: str = "dmn") -> DataFrame:
    """cumulative (key, order..., total) with `mode`: cen at high or more, dmn at low or less, else as before.

    No fold is needed: between the bounds the mode is that of the last row outside them.
    """
    outside = F.when(F.col("total") >= high, "cen").when(F.col("total") <= low, "dmn")
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cumulative.withColumn("mode", F.coalesce(F.last(outside, ignorenulls=True).over(w), F.lit(start)))


def token_bucket(requests: DataFrame, key: str, at: str, order: str, rate: float, burst: float) -> DataFrame:
    """(order, allowed, left): requests of a key in time order against a bucket that fills by `rate` a second up to `burst`.

    Keys are independent; the rows of one are streamed in order with a state of two numbers, never gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, left, last = object(), burst, 0.0
        for batch in batches:
            keys, times, ids = (batch.column(k).to_pylist() for k in range(3))
            allowed, rest = [], []
            for k, t in zip(keys, times, strict=True):
                if k != last_key:
                    last_key, left, last = k, burst, t
                left = min(burst, left + max(0.0, t - last) * rate)
                last = t
                ok = left >= 1.0
                left -= 1.0 if ok else 0.0
                allowed.append(ok)
                rest.append(left)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(allowed), pa.array(rest, pa.float64())], names=["id", "allowed", "left"])

    parts = requests.select(F.col(key).cast("long"), F.col(at).cast("double"), F.col(order).cast("long")).repartition(key).sortWithinPartitions(key, at, order)
    return parts.mapInArrow(run, "id long, allowed boolean, left double")


def daily(events: DataFrame, at: str, order: list[str], least: int = 3, most: int = 50) -> DataFrame:
    """(day, n, used): UTC days of `least` events or more, and how many of them (the first `most`) a roll-up takes."""
    day = F.date_format(F.col(at), "yyyy-MM-dd")
    return events.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumn("used", F.least("n", F.lit(most)))


def stuck(written: DataFrame, terminal: DataFrame, key: str, at: Column, now: Column, grace: int) -> DataFrame:
    """(key, age, state): written keys without a terminal stage; stuck past the grace time, else backlog."""
    open_ = written.groupBy(key).agg(F.min(at).alias("since")).join(terminal.select(key).distinct(), key, "left_anti")
    age = now - F.col("since")
    return open_.select(key, age.alias("age"), F.when(age > grace, "stuck").otherwise("backlog").alias("state"))
