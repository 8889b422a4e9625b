"""Jobs over the whole log: rebuilds, backfills, reprocessing, sweeps, the composite report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.latest import latest_by


def sources_to_keep(events: DataFrame, drop_superseded: bool = True) -> DataFrame:
    """Source events (remember, observe), without superseded ones if asked, and the invalidations whose target stays; by time."""
    target = events.where("kind = 'invalidate'").select("id", F.explode("parent_hashes").alias("hash"))
    base = events.where("kind IN ('remember', 'observe')")
    kept = base.join(target.select("hash").distinct(), base["content_hash"] == F.col("hash"), "left_anti") if drop_superseded else base
    of = target.join(kept.select(F.col("content_hash").alias("hash")), "hash", "left_semi").select("id").distinct()
    return kept.unionByName(events.where("kind = 'invalidate'").join(of, "id", "left_semi")).orderBy("created_at", "id")


def to_reprocess(events: DataFrame, interpretations: DataFrame) -> DataFrame:
    """Events whose latest interpretation failed or is missing."""
    last = latest_by(interpretations, ["event_hash"], ["produced_at", "version"], ["status"]).where("NOT status <=> 'failed'")
    return events.join(last.select(F.col("event_hash").alias("content_hash")), "content_hash", "left_anti")


def prune_older(rows: DataFrame, at: Column, cutoff: Column) -> DataFrame:
    """Rows that stay; written partitioned by day, this is a drop of partitions."""
    return rows.where(at >= cutoff)


def unscored(events: DataFrame, done: DataFrame, producer: str, after_id: str | None, limit: int) -> DataFrame:
    """The next batch above a watermark id that the producer hasn't scored."""
    own = events.where(F.col("id") > after_id) if after_id is not None else events
    mine = done.where(F.col("produced_by") == producer).select(F.col("event_hash").alias("content_hash"))
    return own.join(mine, "content_hash", "left_anti").orderBy("id").limit(limit)


def checkup(entities: DataFrame, mentions: DataFrame, merges: DataFrame, undone: DataFrame) -> DataFrame:
    """(metric, value): counts of entities by identity scheme, live clusters of one name, mentions by method, merges."""
    gone = merges.join(undone.select(F.col("merge_id").alias("id")), "id", "left_anti").select(F.col("from_entity_id").alias("id"))
    alive = entities.join(gone, "id", "left_anti")
    clusters = alive.groupBy(F.lower("canonical_name").alias("n")).agg(F.count(F.lit(1)).alias("m"), F.countDistinct("kind").alias("k")).where("m > 1")
    rows = [
        entities.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("id").startswith("entity:v2:")).alias("entities_v2")),
        clusters.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("k") > 1).alias("clusters_cross_kind")),
        mentions.agg(F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("match_method") == "exact").alias("mentions_exact")),
        merges.agg(F.count(F.lit(1)).alias("merges")),
    ]
    out = None
    for r in rows:
        part = r.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in r.columns])))
        out = part if out is None else out.unionByName(part)
    return out


def drain(step, most_cycles: int = 1000) -> int:
    """Runs a job that returns how much it did until it does nothing; the number of cycles."""
    for n in range(most_cycles):
        if not step():
            return n
    return most_cycles
