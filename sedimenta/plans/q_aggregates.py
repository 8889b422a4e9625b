"""Aggregates, censuses and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedimenta.functions.scoring import brier
from sedimenta.functions.text import is_structural_name, slugify, type_mismatch
from sedimenta.functions.timecol import day, epoch, epoch_of
from sedimenta.plans.base import EDGES_SQL, LOG_SQL, edges, log, query, read


@query("stats_by_kind_origin", f"WITH {LOG_SQL} SELECT COALESCE(kind, '*') AS kind, COALESCE(CAST(origin AS VARCHAR), '*') AS origin, COUNT(*) AS n FROM log GROUP BY GROUPING SETS ((kind), (origin), ())")
def stats_by_kind_origin(spark, sf_dir):
    g = log(spark, sf_dir).groupingSets([["kind"], ["origin"], []], "kind", "origin").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce(F.col("origin").cast("string"), F.lit("*")).alias("origin"), "n")


@query("clients_count_distinct", f"WITH {LOG_SQL} SELECT origin AS client, COUNT(DISTINCT k) AS events FROM log GROUP BY origin")
def clients_count_distinct(spark, sf_dir):
    return log(spark, sf_dir).groupBy(F.col("origin").alias("client")).agg(F.countDistinct("k").alias("events"))


@query("vault_size_conditional", f"WITH {LOG_SQL} SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE kind = 'purchase') AS purchases, COUNT(*) FILTER (WHERE kind = 'view' AND value > 50) AS big_views, COUNT(DISTINCT origin) AS origins FROM log")
def vault_size_conditional(spark, sf_dir):
    return log(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "purchase").alias("purchases"), F.count_if((F.col("kind") == "view") & (F.col("value") > 50)).alias("big_views"), F.countDistinct("origin").alias("origins"))


@query("event_scan", f"WITH {LOG_SQL} SELECT id, kind, strftime(at_, '%Y-%m-%d') AS day FROM log WHERE kind = 'purchase' ORDER BY at_ DESC, id DESC LIMIT 100")
def event_scan(spark, sf_dir):
    return log(spark, sf_dir).where("kind = 'purchase'").orderBy(F.col("at").desc(), F.col("id").desc()).limit(100).select("id", "kind", day("at").alias("day"))


@query("calibration_buckets_brier", """WITH r AS (SELECT l.doc_id, l.quality, least(1.0, d.n_chars / 4000.0) AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT least(3, CAST(floor(p * 4) AS INTEGER)) AS bucket, COUNT(*) AS n, round(AVG(quality), 6) AS confirm_rate, round(AVG(p), 6) AS mean_p, round(AVG(pow(p - quality, 2)), 6) AS brier FROM r GROUP BY 1""")
def calibration_buckets_brier(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"))
    r = read(spark, sf_dir, "labels").join(d, "doc_id")
    bucket = F.least(F.lit(3), F.floor(F.col("p") * 4).cast("int"))
    return r.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("confirm_rate"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(brier(F.col("p"), F.col("quality"))), 6).alias("brier"))


@query("calibration_sufficient", """SELECT COUNT(*) AS n, CAST(SUM(quality) AS BIGINT) AS confirms, COUNT(*) >= 20 AND SUM(quality) >= 5 AND COUNT(*) - SUM(quality) >= 5 AS sufficient FROM labels""")
def calibration_sufficient(spark, sf_dir):
    n, c = F.count(F.lit(1)), F.sum("quality")
    return read(spark, sf_dir, "labels").agg(n.alias("n"), c.alias("confirms"), ((n >= 20) & (c >= 5) & (n - c >= 5)).alias("sufficient"))


@query("kind_usage", """WITH e AS (SELECT p_partkey AS id, lower(regexp_replace(p_type, '[ -]+', '_', 'g')) AS kind FROM part WHERE p_partkey % 7 <> 0), r AS (SELECT *, regexp_extract(kind, '^[a-z]+') AS resolved FROM e)
SELECT resolved AS kind, COUNT(*) AS n FROM r GROUP BY 1""")
def kind_usage(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    merged = p.where("p_partkey % 7 = 0").select("p_partkey")
    e = p.join(merged, "p_partkey", "left_anti").groupBy(slugify(F.col("p_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy(F.regexp_extract("kind", "^[a-z]+", 0).alias("kind")).agg(F.sum("n").alias("n"))


@query("near_duplicate_kinds", f"""WITH {LOG_SQL}, o AS (SELECT DISTINCT origin, kind FROM log) SELECT a.kind AS a, b.kind AS b, COUNT(*) AS entities FROM o a JOIN o b ON a.origin = b.origin AND a.kind < b.kind GROUP BY 1, 2 HAVING COUNT(*) >= 5""")
def near_duplicate_kinds(spark, sf_dir):
    """Kinds that share entities; per entity the distinct kinds are few (the registry), so pairs come from its sorted set."""
    o = log(spark, sf_dir).groupBy("origin").agg(F.array_sort(F.collect_set("kind")).alias("s"))
    pairs = o.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("entities")).where("entities >= 5")


@query("promotable_kinds", f"""WITH {LOG_SQL} SELECT k AS raw_kind, COUNT(DISTINCT origin) AS entities, CAST(floor((MAX(floor(epoch(at_))) - MIN(floor(epoch(at_)))) / 86400) AS BIGINT) AS span_days FROM log WHERE k IS NOT NULL AND k % 10 <> 0
GROUP BY k HAVING COUNT(DISTINCT origin) >= 10 AND floor((MAX(floor(epoch(at_))) - MIN(floor(epoch(at_)))) / 86400) >= 14""")
def promotable_kinds(spark, sf_dir):
    rows = log(spark, sf_dir).where("k IS NOT NULL")
    live_slugs = rows.where("k % 10 = 0").select("k").distinct()
    g = rows.join(live_slugs, "k", "left_anti").groupBy(F.col("k").alias("raw_kind")).agg(F.countDistinct("origin").alias("entities"), F.floor((F.max(epoch("at")) - F.min(epoch("at"))) / 86400).alias("span_days"))
    return g.where("entities >= 10 AND span_days >= 14")


@query("overbroad_share", "SELECT COUNT(*) FILTER (WHERE p_brand = 'Brand#11') AS other, COUNT(*) AS total, round(COUNT(*) FILTER (WHERE p_brand = 'Brand#11') / COUNT(*), 6) AS share, COUNT(*) FILTER (WHERE p_brand = 'Brand#11') / COUNT(*) > 0.2 AND COUNT(*) FILTER (WHERE p_brand = 'Brand#11') >= 10 AS overbroad FROM part")
def overbroad_share(spark, sf_dir):
    o, t = F.count_if(F.col("p_brand") == "Brand#11"), F.count(F.lit(1))
    return read(spark, sf_dir, "part").agg(o.alias("other"), t.alias("total"), F.round(o / t, 6).alias("share"), ((o / t > 0.2) & (o >= 10)).alias("overbroad"))


@query("unused_kinds", "SELECT n_nationkey AS kind FROM nation WHERE n_name <> 'OTHER' AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def unused_kinds(spark, sf_dir):
    used = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return read(spark, sf_dir, "nation").where("n_name != 'OTHER'").join(used, "n_nationkey", "left_anti").select(F.col("n_nationkey").alias("kind"))


_NAMES = "nm AS (SELECT p_partkey AS id, lower(p_brand || ' ' || p_size) AS name, p_type AS kind FROM part)"


def _names(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))).alias("name"), F.col("p_type").alias("kind"))


@query("dedup_candidates", f"WITH {_NAMES} SELECT name, COUNT(DISTINCT id) AS members, COUNT(l_orderkey) AS mentions FROM nm LEFT JOIN lineitem ON l_partkey = id GROUP BY name HAVING COUNT(DISTINCT id) > 1")
def dedup_candidates(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    g = _names(spark, sf_dir).join(m, "id", "left").groupBy("name").agg(F.countDistinct("id").alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))
    return g.where("members > 1")


@query("cluster_census", f"""WITH {_NAMES}, g AS (SELECT name, COUNT(*) AS members, COUNT(DISTINCT kind) AS kinds FROM nm WHERE id % 11 <> 0 GROUP BY name HAVING COUNT(*) > 1)
SELECT COUNT(*) AS clusters, CAST(SUM(members) AS BIGINT) AS entities, COUNT(*) FILTER (WHERE kinds = 1) AS same_kind, COUNT(*) FILTER (WHERE kinds > 1) AS cross_kind FROM g""")
def cluster_census(spark, sf_dir):
    n = _names(spark, sf_dir)
    g = n.join(n.where("id % 11 = 0").select("id"), "id", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("kind").alias("kinds")).where("members > 1")
    return g.agg(F.count(F.lit(1)).alias("clusters"), F.sum("members").alias("entities"), F.count_if(F.col("kinds") == 1).alias("same_kind"), F.count_if(F.col("kinds") > 1).alias("cross_kind"))


@query("formation_rate", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, COUNT(*) AS formed FROM orders e WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = e.o_custkey AND o.o_orderdate < e.o_orderdate) GROUP BY 1")
def formation_rate(spark, sf_dir):
    """An older sibling exists just where the row isn't among the oldest: one window, no self-join."""
    oldest = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    o = read(spark, sf_dir, "orders").withColumn("oldest", oldest).where("oldest < o_orderdate")
    return o.groupBy(day("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("formed"))


@query("drain_rate_parse", """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, 'merged=' || CAST(event_id % 5 AS VARCHAR) || ' kept=' || CAST(user_id AS VARCHAR) || ' note=x' AS detail FROM events),
kv AS (SELECT day, UNNEST(regexp_extract_all(detail, '(\\w+)=(\\d+)', 1)) AS key, UNNEST(regexp_extract_all(detail, '(\\w+)=(\\d+)', 2)) AS v FROM d) SELECT day, key, CAST(SUM(CAST(v AS BIGINT)) AS BIGINT) AS total FROM kv GROUP BY day, key""".replace("\\\\", "\\"))
def drain_rate_parse(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    detail = F.concat(F.lit("merged="), (F.col("event_id") % 5).cast("string"), F.lit(" kept="), F.col("user_id").cast("string"), F.lit(" note=x"))
    kv = e.select(day("ts").alias("day"), F.explode(F.arrays_zip(F.regexp_extract_all(detail, F.lit(r"(\w+)=(\d+)"), 1).alias("key"), F.regexp_extract_all(detail, F.lit(r"(\w+)=(\d+)"), 2).alias("v"))).alias("x"))
    return kv.groupBy("day", F.col("x.key").alias("key")).agg(F.sum(F.col("x.v").cast("long")).alias("total"))


@query("cross_kind_merges", "SELECT a.p_partkey AS from_id, b.p_partkey AS into_id, a.p_brand AS from_kind, b.p_brand AS into_kind FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 WHERE a.p_partkey >= 1 AND a.p_brand <> b.p_brand AND b.p_size > 2 AND a.p_size % 10 <> 0")
def cross_kind_merges(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    a = p.where("p_partkey >= 1 AND p_size % 10 != 0").select(F.col("p_partkey").alias("from_id"), F.col("p_brand").alias("from_kind"), F.expr("p_partkey div 2").alias("into_id"))
    b = p.select(F.col("p_partkey").alias("into_id"), F.col("p_brand").alias("into_kind"))
    retracted = p.where("p_size <= 2").select(F.col("p_partkey").alias("into_id"))
    return a.join(b, "into_id").join(retracted, "into_id", "left_anti").where("from_kind != into_kind").select("from_id", "into_id", "from_kind", "into_kind")


@query("structural_names", r"""WITH n AS (SELECT page_id, regexp_extract(url, '://[^/]+(/[^?#]*)?', 1) AS path, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, path <> '' AND (regexp_matches(path, '^[A-Z][A-Z0-9]*-\d+$') OR regexp_matches(path, '^(?:/|\./|\.\./)[^\s]+$|^[\w.-]+(?:/[\w.-]+)+$') OR (regexp_matches(path, '^[\w-]+(?:\.[\w-]+)*\.[A-Za-z0-9]{1,6}$') AND NOT regexp_matches(path, '(?i)\.(team|me|com|ai|io|app|dev|net|org|co|xyz|de|ch|eu)$'))) AS path_structural,
(regexp_matches(host, '^[A-Z][A-Z0-9]*-\d+$') OR regexp_matches(host, '^(?:/|\./|\.\./)[^\s]+$|^[\w.-]+(?:/[\w.-]+)+$') OR (regexp_matches(host, '^[\w-]+(?:\.[\w-]+)*\.[A-Za-z0-9]{1,6}$') AND NOT regexp_matches(host, '(?i)\.(team|me|com|ai|io|app|dev|net|org|co|xyz|de|ch|eu)$'))) AS host_structural FROM n""")
def structural_names(spark, sf_dir):
    n = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]+(/[^?#]*)?", 1).alias("path"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    return n.select("page_id", is_structural_name(F.col("path")).alias("path_structural"), is_structural_name(F.col("host")).alias("host_structural"))


@query("type_mismatch", r"""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)\b[\w-]+\.(team|me|com|ai|io|app|dev|net|org|co|xyz|de|ch|eu)\b') THEN 'product' WHEN regexp_matches(url, '\b(?:19|20)\d{2}\b') THEN 'concept' END AS to_kind FROM pages""")
def type_mismatch_q(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", type_mismatch(F.col("url"), F.lit("person"))["to_kind"].alias("to_kind"))


@query("article_worthy_groups", f"WITH {EDGES_SQL} SELECT object, COUNT(*) AS mentions, strftime(MAX(at_), '%Y-%m-%d') AS last FROM edges GROUP BY object HAVING COUNT(*) >= 3")
def article_worthy_groups(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("object").agg(F.count(F.lit(1)).alias("mentions"), F.date_format(F.max("at"), "yyyy-MM-dd").alias("last")).where("mentions >= 3")


@query("top_raw_kinds", "SELECT lower(trim(p_type)) AS raw_kind, COUNT(DISTINCT p_partkey) AS entities FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_raw_kinds(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_type")).alias("raw_kind")).agg(F.countDistinct("p_partkey").alias("entities")).orderBy(F.col("entities").desc(), "raw_kind").limit(10)


@query("judge_plurality", f"WITH {LOG_SQL}, v AS (SELECT origin, COUNT(*) FILTER (WHERE kind = 'click') AS a, COUNT(*) FILTER (WHERE kind = 'view') AS b FROM log GROUP BY origin) SELECT origin AS pair, CASE WHEN a > b THEN 'A' WHEN b > a THEN 'B' ELSE 'TIE' END AS winner FROM v")
def judge_plurality(spark, sf_dir):
    v = log(spark, sf_dir).groupBy("origin").agg(F.count_if(F.col("kind") == "click").alias("a"), F.count_if(F.col("kind") == "view").alias("b"))
    return v.select(F.col("origin").alias("pair"), F.when(F.col("a") > F.col("b"), "A").when(F.col("b") > F.col("a"), "B").otherwise("TIE").alias("winner"))


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(MAX(value), 6) AS top FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.max("value"), 6).alias("top"))


@query("export_jobs_due", "SELECT o_orderkey AS job, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-07-01' THEN 'stale' WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-06-01' THEN 'expired' ELSE 'keep' END AS state FROM orders")
def export_jobs_due(spark, sf_dir):
    at = epoch("o_orderdate")
    state = F.when((F.col("o_orderstatus") == "P") & (at < epoch_of("1998-07-01 00:00:00")), "stale").when((F.col("o_orderstatus") == "F") & (at < epoch_of("1998-06-01 00:00:00")), "expired").otherwise("keep")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), state.alias("state"))
