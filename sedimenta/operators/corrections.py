"""Decisions over review queues, as appends: a decision table and latest-wins views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators.graph import resolve


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposals (id, status, ...) with new_status and outcome; the first decision (id, verdict, decided_at) of each open one counts.

    confirm applies, reject closes, retract withdraws; a proposal already decided stays and says so, an expired one may still be decided.
    """
    first = decisions.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("decided_at", "verdict"))).where("_n = 1").drop("_n")
    met = proposals.join(first, "id", "left")
    open_ = F.col("status").isin("proposed", "expired")
    new = F.when(F.col("verdict") == "confirm", "applied").when(F.col("verdict") == "reject", "rejected").when(F.col("verdict") == "retract", "retracted")
    outcome = F.when(F.col("verdict").isNull(), "none").when(~open_, "already_decided").when(new.isNull(), "invalid_verdict").otherwise("decided")
    return met.withColumn("outcome", outcome).withColumn("new_status", F.when(F.col("outcome") == "decided", new).otherwise(F.col("status")))


def conflict_resolution(verdict: Column) -> Column:
    return F.when(verdict == "confirm", "superseded_older").when(verdict == "retract", "superseded_newer").when(verdict == "reject", "no_conflict")


def pending_union(queues: list[DataFrame], limit: int, offset: int = 0) -> DataFrame:
    """Several queues (id, confidence, detected_at) one after the other, each by (confidence desc, detected_at, id), then one slice."""
    out = None
    for n, q in enumerate(queues):
        part = q.orderBy(F.col("confidence").desc(), "detected_at", "id").limit(offset + limit).withColumn("queue", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("queue", F.col("confidence").desc(), "detected_at", "id").offset(offset).limit(limit)


def propose_once(open_keys: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New proposals whose keys have no open one, one a key."""
    return new.dropDuplicates(keys).join(open_keys.select(*keys), keys, "left_anti")


def expire(proposals: DataFrame, age, ttl: float) -> DataFrame:
    return proposals.withColumn("status", F.when((F.col("status") == "proposed") & (age > ttl), "expired").otherwise(F.col("status")))


def versioned_reviews(latest: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Reviews to append: only where the verdict changes, with the next version."""
    met = new.join(latest.select(key, F.col("verdict").alias("_v"), F.col("version").alias("_n")), key, "left")
    return met.where(~F.col("verdict").eqNullSafe(F.col("_v"))).withColumn("version", F.coalesce(F.col("_n"), F.lit(0)) + 1).drop("_v", "_n")


def asked_before(proposals: DataFrame, new: DataFrame, merges: DataFrame) -> DataFrame:
    """new (from_name, from_kind, into, ..) with `asked`: whether proposals (from_name, from_kind, into) of any state put the same question,
    whatever the merged row's id: equal name but for case, equal kind, and targets that end in the same entity over merges (id, into)."""
    ends = resolve(proposals.select(F.col("into").alias("id")).union(new.select(F.col("into").alias("id"))).where("id IS NOT NULL").distinct(), merges)
    ends = ends.select(F.col("id").alias("into"), F.col("canonical").alias("_end"))
    question = [F.lower("from_name").alias("_name"), F.col("from_kind").alias("_kind"), "_end"]
    old = proposals.join(ends, "into").select(*question).distinct().withColumn("asked", F.lit(True))
    named = new.join(ends, "into", "left").withColumn("_name", F.lower("from_name")).withColumn("_kind", F.col("from_kind"))
    return named.join(old, ["_name", "_kind", "_end"], "left").select(*new.columns, F.coalesce("asked", F.lit(False)).alias("asked"))
