"""Reading: the whole retrieval pipeline for a batch of queries, and what surrounds a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.scoring import INVALIDATED
from sedimenta.functions.text import has_temporal_intent, is_unresolved, route_depth
from sedimenta.operators import retrieval as R
from sedimenta.operators.graph import resolve

LIMIT, MOST, MOST_OFFSET = 20, 100, 200


def recall(docs: DataFrame, queries: DataFrame, id_: str, text: str, at: str, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, entity_hits: DataFrame | None = None, factors: DataFrame | None = None, kinds: DataFrame | None = None, limit: int = LIMIT, offset: int = 0, pool: int = 100) -> DataFrame:
    """(query_id, id, rank) for queries (query_id, query).

    Route; BM25 and vectors fused, then fused with entity hits; by time where a query asks for what is current; times temporal factors
    (id, factor, invalidated) by position; syntheses and articles first (kinds: id, synthesis, article); one page. Empty queries read the
    newest rows. Each step is a lazy plan over all queries at once.
    """
    limit, offset = min(limit, MOST), min(offset, MOST_OFFSET)
    routed = queries.select("query_id", "query", route_depth(F.col("query")).alias("depth"), has_temporal_intent(F.coalesce("query", F.lit(""))).alias("now"))
    asked = routed.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    lists = [R.top_k(R.bm25(docs, asked, id_, text).withColumn("score", F.round("score", 9)), pool)]
    if vectors is not None:
        normal = asked.where("depth = 'normal'").select("query_id")
        lists.append(R.knn(vectors, query_vectors.join(normal, "query_id", "left_semi"), pool))
    hits = R.fused_top(R.rrf(lists), pool)
    if entity_hits is not None:
        hits = R.fused_top(R.rrf([hits, entity_hits]), pool)
    when = docs.select(F.col(id_).alias("id"), F.col(at).alias("at"))
    met = hits.join(when, "id").join(routed.select("query_id", "now", "depth"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("now"), F.col("at")).desc_nulls_last(), "rank")
    met = met.withColumn("rank", F.row_number().over(order))
    if factors is not None:
        f = met.join(factors, "id", "left")
        factor = F.when(F.col("invalidated"), INVALIDATED).otherwise(F.coalesce("factor", F.lit(1.0)))
        met = R.temporal_rerank(f, factor).drop("rank").withColumnRenamed("new_rank", "rank")
    if kinds is not None:
        inv = F.coalesce(F.col("invalidated"), F.lit(False)) if factors is not None else F.lit(False)
        k = met.join(kinds, "id", "left")
        met = R.article_first(k, F.coalesce("synthesis", F.lit(False)), F.coalesce("article", F.lit(False)), inv).drop("rank").withColumnRenamed("new_rank", "rank")
    newest = routed.where(F.trim(F.coalesce("query", F.lit(""))) == "").select("query_id")
    page = met.select("query_id", "id", "rank")
    plain = R.recency_rerank(newest.crossJoin(when.orderBy(F.col("at").desc_nulls_last(), "id").limit(offset + limit).withColumn("rank", F.col("id")))).select("query_id", "id", F.col("new_rank").alias("rank"))
    return page.unionByName(plain).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def overlay(hits: DataFrame, mentions: DataFrame, edges: DataFrame, canonical: DataFrame, retracted: DataFrame, most: int = 5) -> DataFrame:
    """hits (query_id, id) with entities and edges: canonical entities by first mention, retracted ones left out, and live edges of the event."""
    m = mentions.join(canonical.select(F.col("id").alias("entity"), "canonical"), "entity", "left").withColumn("canonical", F.coalesce("canonical", "entity"))
    m = m.join(retracted.select(F.col("entity").alias("canonical")), "canonical", "left_anti").groupBy("event", "canonical").agg(F.min("at").alias("at"))
    ents = m.groupBy("event").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "canonical"))), lambda x: x["canonical"]), 1, most).alias("entities"))
    eds = edges.groupBy("source").agg(F.slice(F.array_sort(F.collect_list(F.struct("edge_id", "predicate"))), 1, most).alias("edges"))
    return hits.join(ents, hits["id"] == ents["event"], "left").join(eds, hits["id"] == eds["source"], "left").drop("event", "source")


def coverage(hits: DataFrame, as_of: Column, stale_days: int = 30) -> DataFrame:
    """(query_id, hits, thin, stale, invalidated, unresolved, caveats) of hits (query_id, at_seconds, invalidated, unresolved, low_edges)."""
    g = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("at_seconds").alias("newest"), F.count_if("invalidated").alias("invalidated"), F.count_if("unresolved").alias("unresolved"), F.sum("low_edges").alias("low_edges"))
    age = (as_of - F.col("newest")) / 86400
    notes = F.array_compact(F.array(F.when(F.col("hits") <= 1, "thin evidence"), F.when(age >= stale_days, "stale"), F.when(F.col("unresolved") > 0, "unresolved conflict"), F.when(F.col("invalidated") > 0, "invalidated"), F.when(F.col("low_edges") > 0, "low confidence edges")))
    return g.withColumn("caveats", notes)


def dashboard(events: DataFrame, salience: DataFrame, mode: DataFrame, upcoming: DataFrame, pending: DataFrame, threads: DataFrame) -> DataFrame:
    """One row: mode, most salient ten, open threads, upcoming, pending counts, totals."""
    top = salience.orderBy(F.col("salience").desc(), "id").limit(10).agg(F.array_sort(F.collect_list(F.struct(F.col("salience") * -1, "id"))).alias("salient"))
    soon = upcoming.orderBy("moment", "id").limit(8).agg(F.array_sort(F.collect_list(F.struct("moment", "id"))).alias("upcoming"))
    parts = [mode.agg(F.coalesce(F.max_by("mode", "at"), F.lit("dmn")).alias("mode")), top, soon, pending.agg(F.count(F.lit(1)).alias("pending")), threads.agg(F.slice(F.array_sort(F.collect_set("thread")), 1, 8).alias("threads")), events.agg(F.count(F.lit(1)).alias("events"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def recent_context(events: DataFrame, mentions: DataFrame, merges: DataFrame, window: int) -> DataFrame:
    """(canonical): entities that the last `window` events mention, after merges; later ids come first among events of one time.

    events (id, at), mentions (id, entity), merges (id, into). The window is the feature: hits are measured against this set.
    """
    last = events.orderBy(F.desc("at"), F.desc("id")).limit(max(window, 0)).select("id")
    named = mentions.join(last, "id", "left_semi").select(F.col("entity").alias("id")).where("id IS NOT NULL").distinct()
    return resolve(named, merges).select("canonical").distinct()


def conflicted(sources: DataFrame, flags: DataFrame) -> DataFrame:
    """sources (id) with `conflicted`: whether a verdict among flags (id, verdict) on it is an unresolved conflict. Decisions on it play no part."""
    bad = flags.where(is_unresolved(F.col("verdict"))).select("id").distinct().withColumn("conflicted", F.lit(True))
    return sources.join(bad, "id", "left").withColumn("conflicted", F.coalesce("conflicted", F.lit(False)))
