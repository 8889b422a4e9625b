"""Entity canonicalisation of a batch: exact name, alias, likeness, new; and the gates that edges pass."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.ids import entity_id
from sedimenta.functions.text import evidence_in_text, predicate_is_durable
from sedimenta.operators.latest import live

FUZZY, POOL, TRANSIENT_GATE = 0.85, 8, 0.6


def gazetteer(aliases: DataFrame) -> DataFrame:
    """aliases (entity, kind, name, alias) -> (kind, alias, entity): unambiguous aliases of three characters or more that aren't the name."""
    a = aliases.select("entity", "kind", F.lower(F.trim("alias")).alias("alias"), F.lower("name").alias("name")).where("length(alias) >= 3 AND alias != name")
    g = a.groupBy("kind", "alias").agg(F.min("entity").alias("entity"), F.max("entity").alias("last"))
    return g.where("entity = last").drop("last")


def alike(mentions: DataFrame, entities: DataFrame, pool: int = POOL) -> DataFrame:
    """(mention, entity, score, rank): the entities of a mention's kind (or other) with the most like names.

    Blocks are kinds and name lengths within a third of each other, so that a kind with very many names isn't compared whole.
    """
    band = lambda c: F.floor(F.log2(F.greatest(F.length(c), F.lit(1))) * 2).cast("int")
    m = mentions.select("mention", "kind", F.lower(F.trim("surface")).alias("s")).withColumn("b", F.explode(F.array(band("s") - 1, band("s"), band("s") + 1)))
    e = entities.select("entity", "kind", F.lower("name").alias("name")).withColumn("b", band("name"))
    pairs = m.join(e, ["kind", "b"]).select("mention", "entity", "s", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ratio = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ratio, pa.float64())], names=["mention", "entity", "score"])

    kinds = f"mention {pairs.schema['mention'].dataType.simpleString()}, entity {pairs.schema['entity'].dataType.simpleString()}, score double"
    w = Window.partitionBy("mention").orderBy(F.col("score").desc(), "entity")
    return pairs.mapInArrow(run, kinds).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool)


def canonicalize(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, retracted: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """mentions (mention, surface, kind) -> (mention, entity, method): exact, alias, embedding (by likeness), or new with a minted id."""
    own = live(entities, retracted, "entity")
    name = F.lower(F.trim("surface"))
    m = mentions.withColumn("n", name)
    exact = own.groupBy(F.lower("name").alias("n"), "kind").agg(F.min("entity").alias("e1"))
    known = aliases.select(F.col("alias").alias("n"), "kind", F.col("entity").alias("e2"))
    step = m.join(exact, ["n", "kind"], "left").join(known, ["n", "kind"], "left")
    open_ = step.where("e1 IS NULL AND e2 IS NULL")
    best = alike(open_, own).where((F.col("rank") == 1) & (F.col("score") >= fuzzy)).select("mention", F.col("entity").alias("e3"))
    met = step.join(best, "mention", "left")
    method = F.when(F.col("e1").isNotNull(), "exact").when(F.col("e2").isNotNull(), "alias").when(F.col("e3").isNotNull(), "embedding").otherwise("new")
    return met.select("mention", F.coalesce("e1", "e2", "e3", entity_id(F.col("surface"), F.col("kind"))).alias("entity"), method.alias("method"))


def gate_edges(relations: DataFrame) -> DataFrame:
    """relations (event_kind, transient_confidence, predicate, evidence, text, subject, object, subject_new, object_new) with `gate`, null if the edge may be written."""
    reason = (
        F.when(F.col("event_kind") == "observe", "observed")
        .when(F.coalesce("transient_confidence", F.lit(0.0)) >= TRANSIENT_GATE, "transient")
        .when(~predicate_is_durable(F.col("predicate")), "not_durable")
        .when(~F.coalesce(evidence_in_text(F.col("evidence"), F.col("text")), F.lit(False)), "no_evidence")
        .when(F.col("subject").isNull() | F.col("object").isNull(), "unresolved")
        .when(F.col("subject") == F.col("object"), "same_entity")
        .when(F.col("subject_new") & F.col("object_new"), "both_new")
    )
    return relations.withColumn("gate", reason)
