"""Evaluation of rankings and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, hit1, hit3, mrr, recall_k): ranked (query_id, id, rank from 1), relevant (query_id, id)."""
    met = relevant.join(ranked, ["query_id", "id"], "left")
    first = F.min("rank")
    return met.groupBy("query_id").agg(
        F.when(first <= 1, 1.0).otherwise(0.0).alias("hit1"),
        F.when(first <= 3, 1.0).otherwise(0.0).alias("hit3"),
        F.coalesce(1 / first, F.lit(0.0)).alias("mrr"),
        (F.count(F.when(F.col("rank") <= k, 1)) / F.count(F.lit(1))).alias("recall_k"),
    )


def leaks(ranked: DataFrame, forbidden: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, leak) for queries with forbidden ids: whether one stands among the first k."""
    met = forbidden.join(ranked.where(F.col("rank") <= k), ["query_id", "id"], "left")
    return met.groupBy("query_id").agg((F.count("rank") > 0).alias("leak"))


#: Shape of a memory case: what is known and what each tool answered.
MEMORY_CASE = (
    "id string, family string, evidence array<struct<id: string, current: boolean>>, expected_claims array<string>, forbidden_claims array<string>, claim_support map<string, array<string>>, "
    "answer_known boolean, requires_conflict_disclosure boolean, outputs array<struct<claims: array<struct<id: string, citations: array<string>, mode: string>>, abstained: boolean, conflict_disclosed: boolean>>"
)
MEMORY_METRICS = ("truth_precision", "current_recall", "stale_exclusion", "citation_coverage", "citation_validity", "conflict_honesty", "abstention_accuracy")


def memory_quality(cases: DataFrame) -> DataFrame:
    """(id, family, the seven MEMORY_METRICS, cross_tool_consistency): means over a case's outputs; a share of nothing is 1."""
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(1.0)
    ids = F.transform("evidence", lambda e: e["id"])
    current = F.transform(F.filter("evidence", lambda e: e["current"]), lambda e: e["id"])

    def of(o):
        facts = F.filter(o["claims"], lambda c: c["mode"] == "fact")
        names = F.array_distinct(F.transform(facts, lambda c: c["id"]))
        cited = F.flatten(F.transform(facts, lambda c: c["citations"]))
        n = F.size(facts)
        supported = F.filter(facts, lambda c: F.coalesce(F.arrays_overlap(c["citations"], F.try_element_at(F.col("claim_support"), c["id"])), F.lit(False)))
        stale = (F.size(F.array_intersect(names, "forbidden_claims")) > 0) | (F.size(F.filter(cited, lambda x: ~F.array_contains(current, x))) > 0)
        known = F.when(F.col("answer_known"), ~o["abstained"]).otherwise(o["abstained"] & (n == 0))
        return F.struct(
            share(F.size(supported), n).alias("truth_precision"), share(F.size(F.array_intersect(names, "expected_claims")), F.size(F.array_distinct("expected_claims"))).alias("current_recall"),
            F.when(stale, 0.0).otherwise(1.0).alias("stale_exclusion"), share(F.size(F.filter(facts, lambda c: F.size(c["citations"]) > 0)), n).alias("citation_coverage"),
            share(F.size(F.filter(cited, lambda x: F.array_contains(ids, x))), F.size(cited)).alias("citation_validity"),
            F.when(F.col("requires_conflict_disclosure") & ~o["conflict_disclosed"], 0.0).otherwise(1.0).alias("conflict_honesty"), F.when(known, 1.0).otherwise(0.0).alias("abstention_accuracy"), names.alias("names"),
        )

    scored = cases.withColumn("s", F.transform("outputs", of))
    mean = lambda m: share(F.aggregate("s", F.lit(0.0), lambda a, x: a + x[m]), F.size("s"))
    pair = lambda a, b: F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda y: pair(x["names"], y["names"]))))
    consistency = share(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), F.size("p"))
    return scored.withColumn("p", pairs).select("id", "family", *[mean(m).alias(m) for m in MEMORY_METRICS], consistency.alias("cross_tool_consistency"))


def topk_agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, jaccard, same_top): two rankings (query_id, id, rank) over their first k; both empty agree."""
    x = a.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias("a"), F.min_by("id", "rank").alias("a1"))
    y = b.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias("b"), F.min_by("id", "rank").alias("b1"))
    both = x.join(y, "query_id", "full_outer")
    none = F.array().cast("array<long>")
    p, q = F.coalesce("a", none), F.coalesce("b", none)
    union = F.size(F.array_union(p, q))
    return both.select("query_id", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(p, q)) / union).alias("jaccard"), F.col("a1").eqNullSafe(F.col("b1")).cast("int").alias("same_top"))


def gate(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(metric, value, floor, ok) of a one-row table of metrics."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(f).alias("floor")) for m, f in floors.items()])
    return metrics.select(F.inline(rows)).withColumn("ok", F.col("value") >= F.col("floor"))


def mean_pairwise_jaccard(sets: DataFrame, group: str, member: str, item: str) -> DataFrame:
    """(group, consistency): mean Jaccard over pairs of members' item sets; groups of one member have 1."""
    own = sets.groupBy(group, member).agg(F.collect_set(item).alias("items"))
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{member}") < F.col(f"b.{member}")))
    union = F.size(F.array_union("a.items", "b.items"))
    j = pairs.select(F.col(f"a.{group}").alias(group), F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a.items", "b.items")) / union).alias("j")).groupBy(group).agg(F.avg("j").alias("j"))
    return own.select(group).distinct().join(j, group, "left").select(group, F.coalesce("j", F.lit(1.0)).alias("consistency"))
