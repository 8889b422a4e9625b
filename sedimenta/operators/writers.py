"""Writers of the append-only tables: each gives the rows to append, checked and without what is there already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.ids import entity_id, entity_id_v2
from sedimenta.functions.text import SLUG

# Fixed values.
MATCH_METHODS = ("exact", "alias", "embedding", "llm", "new")
REVIEW_VERDICTS = ("confirm", "reject")
REVISION_ACTIONS = ("add", "rename", "merge", "split", "deprecate", "restore")
TUNER_KINDS = ("promote", "rollback", "hypothesis", "observation")
BOOTSTRAP_KINDS = ("person", "organization", "place", "project", "product", "concept", "other")
FIELD_BYTES = 64 * 1024


def checked(new: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that hold, rejects)."""
    mark = F.coalesce(ok, F.lit(False))
    return new.where(mark), new.where(~mark)


def first_by(new: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, the least of all its other columns, so that reruns agree; maps, which have no order, take any."""
    rest = [f.name for f in new.schema.fields if f.name not in keys]
    if not rest or any("map<" in f.dataType.simpleString() for f in new.schema.fields):
        return new.dropDuplicates(keys)
    return new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_least")).select(*[F.col(c) if c in keys else F.col(f"_least.`{c}`").alias(c) for c in new.columns])


def once(log: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """UNIQUE(keys) in a log: first rows whose key the log lacks. Keys with a null never collide, as in SQL."""
    some = F.lit(False)
    for k in keys:
        some = some | F.col(k).isNull()
    fresh = first_by(new.where(~some), keys).join(log.select(*keys), keys, "left_anti")
    return fresh.unionByName(new.where(some)) if any(new.schema[k].nullable for k in keys) else fresh


def temporal_rows(log: DataFrame, new: DataFrame) -> DataFrame:
    """Temporal records to append: one a (event_hash, computed_by), none that the log has; a new version of the worker writes afresh."""
    return once(log, new, ["event_hash", "computed_by"])


def interpretations(log: DataFrame, new: DataFrame) -> DataFrame:
    """Insert if (event_hash, version, produced_by) is new; where that row failed, append under produced_by#retryN, N its attempts so far."""
    base = F.regexp_replace("produced_by", "#retry.*$", "")
    tried = log.withColumn("base", base).groupBy("event_hash", "version", "base").agg(F.count(F.lit(1)).alias("attempts"), F.max(F.when(F.col("produced_by") == F.col("base"), F.col("status"))).alias("first_status"))
    met = first_by(new, ["event_hash", "version", "produced_by"]).join(tried.withColumnRenamed("base", "produced_by"), ["event_hash", "version", "produced_by"], "left")
    keep = met.where(F.col("attempts").isNull() | (F.col("first_status") == "failed"))
    name = F.when(F.col("attempts").isNull(), F.col("produced_by")).otherwise(F.concat("produced_by", F.lit("#retry"), F.col("attempts").cast("string")))
    return keep.withColumn("produced_by", name).select(*new.columns)


def failure(event_hash: Column, error_type: Column, message: Column, retries: Column) -> Column:
    """The JSON of a failed interpretation."""
    return F.to_json(F.struct(F.lit("failed").alias("status"), error_type.alias("error_type"), F.left(message, F.lit(500)).alias("error_message"), retries.alias("retries")))


def invalidations(targets: DataFrame) -> DataFrame:
    """targets (target_hash, reason) -> invalidate events: kind, payload, parent_hashes."""
    payload = F.to_json(F.struct("target_hash", "reason"))
    return targets.select(F.lit("invalidate").alias("kind"), payload.alias("payload"), F.array("target_hash").alias("parent_hashes"))


def entities(log: DataFrame, new: DataFrame) -> DataFrame:
    """new (canonical_name, kind, split) -> (canonical_name, kind, id, is_new): get or create.

    An entity with the same folded name and kind is taken; `split` asks for a new homonym with the next ordinal of its name.
    """
    name = F.lower(F.trim("canonical_name"))
    seen = log.withColumn("n", name).groupBy("n").agg(F.count(F.lit(1)).alias("count"))
    own = log.withColumn("n", name).groupBy("n", "kind").agg(F.min("id").alias("known"))
    rows = new.withColumn("n", name).join(own, ["n", "kind"], "left").join(seen, "n", "left")
    create = F.col("split") | F.col("known").isNull()
    ordinal = F.coalesce("count", F.lit(0)) + F.row_number().over(Window.partitionBy("n", create).orderBy("kind", "canonical_name")) - 1
    made = F.when(F.coalesce("count", F.lit(0)) + ordinal == 0, entity_id(F.col("canonical_name"), F.col("kind"))).otherwise(entity_id_v2(F.col("canonical_name"), ordinal))
    return rows.select("canonical_name", "kind", F.when(create, made).otherwise(F.col("known")).alias("id"), create.alias("is_new"))


def mentions(log: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    good, bad = checked(new, F.col("match_method").isin(*MATCH_METHODS))
    return once(log, good, ["entity_id", "event_id", "surface_form"]), bad


def merges(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked(new, F.col("from_entity_id") != F.col("into_entity_id"))


def edge_reviews(new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews, edge invalidations that rejects bring, rows with another verdict)."""
    good, bad = checked(new, F.col("verdict").isin(*REVIEW_VERDICTS))
    return good, good.where("verdict = 'reject'").select("edge_id", F.lit("operator review").alias("reason")).distinct(), bad


def existing(new: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows whose key the table knows (assignments, scores: the entity or edge must be there)."""
    return new.join(table.select(key).distinct(), key, "left_semi")


def kinds(registry: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    good, bad = checked(new, F.col("slug").rlike(SLUG))
    return once(registry, good, ["slug"]), bad


def seed_kinds(registry: DataFrame) -> DataFrame:
    rows = registry.sparkSession.createDataFrame([(s,) for s in BOOTSTRAP_KINDS], "slug string")
    return rows.join(registry.select("slug"), "slug", "left_anti")


def revisions(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked(new, F.col("action").isin(*REVISION_ACTIONS))


def tuner_rows(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a known kind whose JSON fields keep within FIELD_BYTES."""
    small = F.lit(True)
    for c in ("old_value", "new_value", "evidence"):
        small = small & (F.coalesce(F.octet_length(c), F.lit(0)) <= FIELD_BYTES)
    return checked(new, F.col("kind").isin(*TUNER_KINDS) & small)


def telemetry(new: DataFrame) -> DataFrame:
    return new.withColumn("detail", F.left("detail", F.lit(500)))


def snapshots(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counter maps as JSON: all values whole numbers or null."""
    return checked(new, ~F.exists(F.map_values("counters"), lambda v: v.isNotNull() & ~v.cast("string").rlike(r"^-?\d+$")))


def remember(new: DataFrame, max_bytes: int = 10 << 20, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Write requests (content, parent_hashes, invalidates): text of max_bytes at most, `most` parents and invalidations at most."""
    return checked(new, (F.octet_length(F.coalesce("content", F.lit(""))) <= max_bytes) & (F.trim("content") != "") & (F.coalesce(F.size("parent_hashes"), F.lit(0)) <= most) & (F.coalesce(F.size("invalidates"), F.lit(0)) <= most))


def feedback(new: DataFrame, most: int = 50) -> DataFrame:
    return new.withColumn("useful", F.slice("useful", 1, most)).withColumn("not_useful", F.slice("not_useful", 1, most))


def rescored(latest: DataFrame, scored: DataFrame, epsilon: float = 0.01) -> DataFrame:
    """Scores to append: new edges, and those that moved by epsilon or more."""
    met = scored.join(latest.select("edge_id", F.col("confidence").alias("_was")), "edge_id", "left")
    return met.where(F.col("_was").isNull() | (F.abs(F.col("confidence") - F.col("_was")) >= epsilon)).drop("_was")
