"""Maintenance, canonicalisation and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import canonical, embedding, maintenance
from sedimenta.plans.base import LOG_SQL, log, query, read


@query("rebuild_sources", f"""WITH {LOG_SQL}, e AS (SELECT id, CASE kind WHEN 'view' THEN 'remember' WHEN 'click' THEN 'observe' WHEN 'error' THEN 'invalidate' ELSE 'derived' END AS kind, id * 7 % 1000 AS target FROM log),
k AS (SELECT id FROM e WHERE kind IN ('remember', 'observe') AND id NOT IN (SELECT target FROM e WHERE kind = 'invalidate')) SELECT id, kind FROM e WHERE id IN (SELECT id FROM k) OR (kind = 'invalidate' AND target IN (SELECT id FROM k))""")
def rebuild_sources(spark, sf_dir):
    k = F.col("kind")
    kind = F.when(k == "view", "remember").when(k == "click", "observe").when(k == "error", "invalidate").otherwise("derived")
    e = log(spark, sf_dir).select("id", kind.alias("kind"), F.col("id").alias("content_hash"), F.col("at").alias("created_at"), F.array(F.col("id") * 7 % 1000).alias("parent_hashes"))
    return maintenance.sources_to_keep(e).select("id", "kind")


@query("reprocess_failed", """WITH i AS (SELECT l_orderkey AS h, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'ok' END AS s, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_returnflag DESC) AS rn FROM lineitem)
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT h FROM i WHERE rn = 1 AND s <> 'failed')""")
def reprocess_failed(spark, sf_dir):
    from sedimenta.operators.latest import latest_by

    i = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_hash"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("status"), F.col("l_shipdate").alias("produced_at"), "l_linenumber", "l_returnflag")
    last = latest_by(i, ["event_hash"], ["produced_at", "l_linenumber", "l_returnflag"], ["status", "produced_at"]).withColumn("version", F.lit(1))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("content_hash"))
    return maintenance.to_reprocess(o, last).select("o_orderkey")


@query("checkup_report", """WITH alive AS (SELECT * FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1 AND p_partkey % 2 = 0)), c AS (SELECT lower(p_brand) AS n, COUNT(*) AS m, COUNT(DISTINCT p_type) AS k FROM alive GROUP BY 1 HAVING COUNT(*) > 1)
SELECT 'entities' AS metric, COUNT(*) AS value FROM part UNION ALL SELECT 'entities_v2', 0 UNION ALL SELECT 'clusters', COUNT(*) FROM c UNION ALL SELECT 'clusters_cross_kind', COUNT(*) FROM c WHERE k > 1
UNION ALL SELECT 'mentions', COUNT(*) FROM lineitem UNION ALL SELECT 'mentions_exact', COUNT(*) FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'merges', COUNT(*) FROM part WHERE p_size = 1""")
def checkup_report(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("canonical_name"), F.col("p_type").alias("kind"))
    m = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", "exact").otherwise("llm").alias("match_method"))
    merges = p.where("p_size = 1").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").cast("string").alias("from_entity_id"))
    undone = p.where("p_size = 1 AND p_partkey % 2 = 1").select(F.col("p_partkey").cast("string").alias("merge_id"))
    return maintenance.checkup(e, m, merges, undone)


@query("canonical_cascade")
def canonical_cascade(spark, sf_dir):
    """Names of one half of the parts against entities of the other half."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("entity"), F.col("p_brand").alias("kind"), F.col("p_name").alias("name"))
    even = p.where("cast(entity AS long) % 2 = 0")
    names = canonical.gazetteer(even.withColumn("alias", F.explode(F.split("name", " "))))
    m = p.where("cast(entity AS long) % 2 = 1").select(F.col("entity").alias("mention"), F.col("name").alias("surface"), "kind")
    return canonical.canonicalize(m, even, names, even.select("entity").where("false"))


@query("embed_documents")
def embed_documents(spark, sf_dir):
    out = embedding.embed_documents(read(spark, sf_dir, "documents"), "doc_id", "text", size=4000, overlap=200)
    return out.select("id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))
