"""Emergent kinds: the live registry, detectors' decisions and their inverse, all as appends of revisions and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import SLUG, slugify
from sedimenta.operators.graph import resolve
from sedimenta.operators.latest import latest_by

# Fixed values.
PROTECTED, NOT_LIVE, MOST_REASSIGNED = "other", ("deprecate", "rename", "merge"), 50
VARIANTS = {"org": "organization", "organisation": "organization", "people": "person", "human": "person", "individual": "person", "places": "place", "location": "place", "city": "place", "country": "place"}


def live_slugs(registry: DataFrame, revisions: DataFrame) -> DataFrame:
    """Registered slugs whose latest revision (from_slug) doesn't end them."""
    last = latest_by(revisions.where("from_slug IS NOT NULL"), ["from_slug"], ["revised_at", "id"], ["action"])
    gone = last.where(F.col("action").isin(*NOT_LIVE)).select(F.col("from_slug").alias("slug"))
    return registry.select("slug").distinct().join(gone, "slug", "left_anti")


def redirects(revisions: DataFrame) -> DataFrame:
    """(id, into): slugs whose latest revision is a rename or merge; a restore stops the chain."""
    last = latest_by(revisions.where("from_slug IS NOT NULL"), ["from_slug"], ["revised_at", "id"], ["action", "to_slug"])
    return last.where("action IN ('rename', 'merge') AND to_slug IS NOT NULL").select(F.col("from_slug").alias("id"), F.col("to_slug").alias("into"))


def resolve_slugs(slugs: DataFrame, revisions: DataFrame) -> DataFrame:
    return resolve(slugs.select(F.col("slug").alias("id")).distinct(), redirects(revisions)).select(F.col("id").alias("slug"), F.col("canonical").alias("resolved"))


def normalize_kinds(raw: DataFrame, live: DataFrame, resolved: DataFrame) -> DataFrame:
    """raw (kind_raw) with (slug, novel): a live slug, a known variant, a live end of a redirect chain, else other and novel."""
    table = F.create_map(*[F.lit(x) for kv in VARIANTS.items() for x in kv])
    k = F.lower(F.trim("kind_raw"))
    rows = raw.withColumn("_k", k).withColumn("_v", F.try_element_at(table, k)).withColumn("_s", slugify(F.col("kind_raw")))
    a = live.select(F.col("slug").alias("_k"), F.lit(True).alias("_live"))
    b = resolved.join(live.select(F.col("slug").alias("resolved")), "resolved").select(F.col("slug").alias("_s"), F.col("resolved").alias("_r"))
    met = rows.join(a, "_k", "left").join(b, "_s", "left")
    slug = F.when(F.col("_live"), F.col("_k")).otherwise(F.coalesce("_v", "_r"))
    return met.withColumn("slug", F.coalesce(slug, F.lit(PROTECTED))).withColumn("novel", slug.isNull()).drop("_k", "_v", "_s", "_live", "_r")


def apply_decisions(proposals: DataFrame, registry: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confirmed proposals (id, action, subject_slug, target_slug, members) -> (new slugs, revisions, assignments).

    add registers or restores; rename and merge redirect; deprecate ends; split registers its target and redirects to it. `other` is protected.
    """
    own = proposals.where((F.col("subject_slug") != PROTECTED) & F.col("subject_slug").rlike(SLUG))
    wanted = own.where("action = 'add'").select(F.col("subject_slug").alias("slug")).union(own.where("action = 'split'").select("target_slug")).distinct()
    fresh = wanted.join(registry.select("slug"), "slug", "left_anti")
    known = registry.select(F.col("slug").alias("subject_slug"), F.lit(True).alias("_known")).distinct()
    action = F.when((F.col("action") == "add") & F.col("_known"), "restore").when(F.col("action") == "split", "merge").otherwise(F.col("action"))
    to = F.when(F.col("action").isin("rename", "merge", "split"), F.col("target_slug"))
    revisions = own.join(known, "subject_slug", "left").select("id", action.alias("action"), F.col("subject_slug").alias("from_slug"), to.alias("to_slug"), at.alias("revised_at"))
    assigned = own.where("action IN ('add', 'split')").select(F.explode(F.slice("members", 1, MOST_REASSIGNED)).alias("entity_id"), F.when(F.col("action") == "add", F.col("subject_slug")).otherwise(F.col("target_slug")).alias("kind_slug"), at.alias("assigned_at"))
    return fresh, revisions, assigned


def revert_decisions(applied: DataFrame, assignments: DataFrame, base: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Inverse of applied (id, action, subject_slug, members): (revisions, assignments back to each entity's kind before)."""
    undo = F.when(F.col("action") == "add", "deprecate").otherwise("restore")
    revisions = applied.select("id", undo.alias("action"), F.col("subject_slug").alias("from_slug"), F.lit(None).cast("string").alias("to_slug"), at.alias("revised_at"))
    moved = applied.where("action IN ('add', 'split')").select(F.explode("members").alias("entity_id"), F.col("subject_slug").alias("slug"))
    before = assignments.join(moved, "entity_id").where("kind_slug != slug")
    last = latest_by(before, ["entity_id"], ["assigned_at", "kind_slug"], ["kind_slug"])
    back = moved.select("entity_id").distinct().join(last, "entity_id", "left").join(base, "entity_id", "left")
    return revisions, back.select("entity_id", F.coalesce("kind_slug", "kind").alias("kind_slug"), at.alias("assigned_at"))


def in_cooldown(candidates: DataFrame, revisions: DataFrame, since: Column) -> DataFrame:
    """Candidates (slugs array) that touch no slug revised since then."""
    recent = revisions.where(F.col("revised_at") >= since).select(F.explode(F.array_compact(F.array("from_slug", "to_slug"))).alias("slug")).distinct()
    touched = candidates.select("id", F.explode("slugs").alias("slug")).join(recent, "slug", "left_semi").select("id").distinct()
    return candidates.join(touched, "id", "left_anti")


def valid_drafts(drafts: DataFrame, registry: DataFrame) -> DataFrame:
    """Drafted additions (slug, suggested, reassign, sample, confidence) that hold; confidence within 0 and 1."""
    ok = drafts.where(F.col("slug").rlike(SLUG) & (F.col("slug") == F.col("suggested")) & (F.size("reassign") <= MOST_REASSIGNED) & (F.size(F.array_except("reassign", "sample")) == 0))
    return ok.join(registry.select("slug"), "slug", "left_anti").withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
