"""The life cycle of derived records: which events may be sources, which syntheses and articles are superseded or retired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds that are no sources, the newest sources looked at, sources that a synthesis needs, facts of an article.
DERIVED = ("consolidation", "entity_article", "invalidate", "living_synthesis")
MOST_SOURCES, LEAST_SOURCES, FACTS = 400, 3, 6


def current(log: DataFrame, overlay: DataFrame) -> DataFrame:
    """Source events (content_hash, kind, ...) that are not invalidated."""
    return log.where(~F.col("kind").isin(*DERIVED)).join(overlay.select(F.col("target").alias("content_hash")), "content_hash", "left_anti")


def eligible(log: DataFrame, overlay: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """The newest `most` current sources: a window by definition."""
    return current(log, overlay).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)


def source_counts(priors: DataFrame, sources: DataFrame) -> DataFrame:
    """(prior, n): how many of each prior's members (prior, member) are among the sources."""
    hit = sources.select(F.col("content_hash").alias("member"), F.lit(1).alias("_hit"))
    return priors.join(hit, "member", "left").groupBy("prior").agg(F.count("_hit").alias("n"))


def stale(priors: DataFrame, continued: DataFrame, log: DataFrame, overlay: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """(prior, n): live syntheses (prior, member) that no candidate continues and that retire: too few current sources, or all of them in the
    window of discovery, where a candidate would have been found."""
    open_ = priors.join(continued.select("prior"), "prior", "left_anti")
    now = source_counts(open_, current(log, overlay))
    window = source_counts(open_, eligible(log, overlay, most)).withColumnRenamed("n", "_in")
    size = open_.groupBy("prior").agg(F.countDistinct("member").alias("_all"))
    met = now.join(window, "prior").join(size, "prior")
    return met.where((F.col("n") < LEAST_SOURCES) | (F.col("_in") == F.col("_all"))).select("prior", "n")


def superseded(live: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """live (content_hash, key) but the kept one (key, keep_hash): all older live records of a key go, orphans of a crash too."""
    return live.join(kept, key).where("content_hash != keep_hash").select(key, "content_hash")


def new_mentions(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """(entity, latest): entities with a mention after their newest article, or without an article. mentions (entity, at), articles (entity, created_at)."""
    last = mentions.groupBy("entity").agg(F.max("at").alias("latest"))
    written = articles.groupBy("entity").agg(F.max("created_at").alias("_written"))
    return last.join(written, "entity", "left").where(F.col("_written").isNull() | (F.col("latest") > F.col("_written"))).select("entity", "latest")


def cited_facts(facts: Column, hashes: Column, most: int = FACTS) -> Column:
    """Facts (fact, sources: places from 1) of an article with their sources' hashes, each once; a place that isn't there cites nothing, and a
    fact without sources stays."""
    cites = lambda f: F.array_distinct(F.filter(F.transform(F.coalesce(f["sources"], F.array().cast("array<int>")), lambda n: F.when(n >= 1, F.get(hashes, n - 1))), lambda h: h.isNotNull()))
    return F.filter(F.transform(F.slice(facts, 1, most), lambda f: F.struct(F.trim(f["fact"]).alias("fact"), cites(f).alias("citations"))), lambda f: f["fact"] != "")
