"""What decisions write: content corrections, confirmed entity corrections, conflict resolutions. All give rows to append, in bulk.

Requests of one batch count in their order, so that a batch writes what the same requests would write one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.ids import pair_key
from sedimenta.operators.corrections import conflict_resolution

INVALIDATE = "invalidate"


def correct_events(log: DataFrame, overlay: DataFrame, known: DataFrame, requests: DataFrame, default_reason: str) -> DataFrame:
    """requests (request, target, text, reason) with outcome, writes_correction, writes_invalidation, invalidation_reason, result.

    log (content_hash, kind), overlay (target) of invalidations, known (target, text) of corrections written before. A target that isn't
    there is not_found, one that is an invalidation itself can't be corrected. A correction with a text is written once for each target and
    text; a target is invalidated once, by the first request, and later ones say so.
    """
    kinds = log.select(F.col("content_hash").alias("target"), F.col("kind").alias("_kind"))
    met = requests.join(kinds, "target", "left").join(overlay.select("target", F.lit(True).alias("_gone")).distinct(), "target", "left")
    met = met.join(known.select("target", "text", F.lit(True).alias("_known")).distinct(), ["target", "text"], "left")
    ok = F.col("_kind").isNotNull() & (F.col("_kind") != INVALIDATE)
    nth = F.row_number().over(Window.partitionBy("target").orderBy("request"))
    nth_text = F.row_number().over(Window.partitionBy("target", "text").orderBy("request"))
    writes = ok & F.col("text").isNotNull() & F.col("_known").isNull() & (nth_text == 1)
    marks = ok & F.col("_gone").isNull() & (nth == 1)
    done = F.concat_ws("; ", F.when(marks, "invalidated").otherwise("already_invalidated"), F.when(writes, "correction_recorded").when(F.col("text").isNotNull(), "correction_deduplicated"))
    out = met.withColumn("_ok", ok).withColumn("writes_correction", writes).withColumn("writes_invalidation", marks).withColumn("result", F.when(ok, done))
    outcome = F.when(F.col("_kind").isNull(), "not_found").when(~F.col("_ok"), "is_invalidation").otherwise("ok")
    why = F.when(F.col("writes_invalidation"), F.coalesce("text", "reason", F.lit(default_reason)))
    return out.select("request", "target", outcome.alias("outcome"), "writes_correction", "writes_invalidation", why.alias("invalidation_reason"), "result")


def apply_resolutions(queue: DataFrame, decisions: DataFrame, overlay: DataFrame, producer: str) -> DataFrame:
    """queue (id, status, a_hash, a_at, b_hash, b_at), decisions (id, verdict, decided_at) -> (id, resolution, loser, writes_invalidation,
    produced_by) of the proposals that a decision claims.

    Only an open proposal is claimed, by its first decision. The loser is the older event if the newer is confirmed, the newer if it is
    retracted; one that is invalidated already, or by an earlier claim of the batch, gets no second invalidation. produced_by names the pair,
    so pairs that share an event have rows of their own.
    """
    first = decisions.where(conflict_resolution(F.col("verdict")).isNotNull()).groupBy("id").agg(F.min(F.struct("decided_at", "verdict")).alias("d")).select("id", "d.*")
    met = queue.where("status = 'proposed'").join(first, "id").withColumn("resolution", conflict_resolution(F.col("verdict")))
    a_older = F.struct("a_at", "a_hash") < F.struct(F.col("b_at").alias("a_at"), F.col("b_hash").alias("a_hash"))
    older, newer = F.when(a_older, F.col("a_hash")).otherwise(F.col("b_hash")), F.when(a_older, F.col("b_hash")).otherwise(F.col("a_hash"))
    met = met.withColumn("loser", F.when(F.col("resolution") == "superseded_older", older).when(F.col("resolution") == "superseded_newer", newer))
    met = met.join(overlay.select(F.col("target").alias("loser"), F.lit(True).alias("_gone")).distinct(), "loser", "left")
    nth = F.row_number().over(Window.partitionBy("loser").orderBy("decided_at", "id"))
    writes = F.col("loser").isNotNull() & F.col("_gone").isNull() & (nth == 1)
    return met.select("id", "resolution", "loser", writes.alias("writes_invalidation"), F.concat_ws(":", F.lit(producer), pair_key(F.col("a_hash"), F.col("b_hash"))).alias("produced_by"))


def apply_corrections(proposals: DataFrame, canonical: DataFrame, kinds: DataFrame) -> DataFrame:
    """Confirmed proposals (id, kind, entity, to_kind, into) -> (id, action, target, kind_slug, into): what each appends.

    canonical (id, canonical), kinds (id, kind) of canonical entities. A retype assigns the kind to the entity's live canonical, and a
    merge_review to that of the merge's target; none is written if the entity isn't there or has the kind. A merge writes its pair, not
    onto itself.
    """
    subject = F.when(F.col("kind") == "merge_review", F.col("into")).otherwise(F.col("entity"))
    met = proposals.withColumn("_s", subject).join(canonical.select(F.col("id").alias("_s"), F.col("canonical").alias("_c")), "_s", "left").withColumn("target", F.coalesce("_c", "_s"))
    met = met.join(kinds.select(F.col("id").alias("target"), F.col("kind").alias("_now")), "target", "left")
    retype = F.when(F.col("_now").isNull(), "not_found").when(F.col("_now") == F.col("to_kind"), "no_change").otherwise("assign")
    action = F.when(F.col("kind").isin("retype", "merge_review"), retype).when(F.col("kind") == "merge", F.when(F.col("entity") == F.col("into"), "no_change").otherwise("merge")).otherwise("unknown")
    out = met.withColumn("action", action)
    return out.select("id", "action", F.when(F.col("action") == "merge", F.col("entity")).otherwise(F.col("target")).alias("target"), F.when(F.col("action") == "assign", F.col("to_kind")).alias("kind_slug"), F.when(F.col("action") == "merge", F.col("into")).alias("into"))


def retractions(proposals: DataFrame, retracted: DataFrame) -> DataFrame:
    """Retracted proposals (id, kind, entity, into) -> (id, target, writes): the entity, of a merge_review the merge's target; each once."""
    target = F.when(F.col("kind") == "merge_review", F.col("into")).otherwise(F.col("entity"))
    met = proposals.select("id", target.alias("target")).join(retracted.select("target", F.lit(True).alias("_gone")).distinct(), "target", "left")
    return met.select("id", "target", (F.col("_gone").isNull() & (F.row_number().over(Window.partitionBy("target").orderBy("id")) == 1)).alias("writes"))


def nudge(conflicts: Column, waiting: Column, last_total: Column, days_since: Column, min_new: int, cooldown_days: float) -> Column:
    """Whether a session is told of waiting corrections: always of conflicts; else if the queue grew by min_new since it was last told, and
    that is cooldown_days ago or never was."""
    grown = waiting - F.coalesce(last_total, F.lit(0)) >= min_new
    return (conflicts > 0) | (grown & (days_since.isNull() | (days_since >= cooldown_days)))


def same_question(asked: DataFrame, new: DataFrame, canonical: DataFrame) -> DataFrame:
    """New merge reviews (id, from_name, from_kind, into) whose question nobody was asked, of any status: the same name, kind and canonical
    target. Targets resolve through the whole chain of merges."""
    resolve = lambda df: df.join(canonical.select(F.col("id").alias("into"), F.col("canonical").alias("_c")), "into", "left").withColumn("_into", F.coalesce("_c", "into")).withColumn("_name", F.lower("from_name")).drop("_c")
    return resolve(new).join(resolve(asked).select("_name", "from_kind", "_into"), ["_name", "from_kind", "_into"], "left_anti").drop("_name", "_into")
