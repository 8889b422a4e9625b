"""Incremental and stateful operators as batch queries; streaming forms are in sedimenta.streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions.timecol import epoch, epoch_micros, epoch_of
from sedimenta.operators import incremental as I
from sedimenta.operators.ingest import idempotent_append, monotonic_watermarks, orphans, prune_failed, retry_name, validate_batch
from sedimenta.plans.base import AS_OF, LOG_SQL, log, query, read


@query("timeline_lag", f"WITH {LOG_SQL} SELECT id, CAST(floor(epoch(at_)) - LAG(floor(epoch(at_))) OVER (PARTITION BY origin ORDER BY at_, id) AS BIGINT) AS seconds_since_previous FROM log")
def timeline_lag(spark, sf_dir):
    return I.timeline(log(spark, sf_dir), "origin", epoch("at"), ["at", "id"]).select("id", "seconds_since_previous")


@query("surprise_first_seen", """WITH m AS (SELECT DISTINCT l_orderkey AS event, l_partkey AS entity FROM lineitem), s AS (SELECT event, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY event) = 1 AS fresh FROM m)
SELECT event, COUNT(*) AS n, COUNT(*) FILTER (WHERE fresh) AS fresh, round(COUNT(*) FILTER (WHERE fresh) / COUNT(*), 6) AS surprise FROM s GROUP BY event""")
def surprise_first_seen(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("entity"))
    return I.novelty(m, "event", "entity", ["event"])


@query("surprise_vs_context", """WITH c AS (SELECT DISTINCT l_partkey AS entity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 20)),
m AS (SELECT DISTINCT l_orderkey AS event, l_partkey AS entity FROM lineitem) SELECT event, round(COUNT(*) FILTER (WHERE c.entity IS NULL) / COUNT(*), 6) AS surprise FROM m LEFT JOIN c ON c.entity = m.entity GROUP BY event""")
def surprise_vs_context(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("entity")).distinct()
    recent = read(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(20).select(F.col("o_orderkey").alias("event"))
    c = li.join(recent, "event", "left_semi").select("entity").distinct().withColumn("known", F.lit(1))
    return li.join(c, "entity", "left").groupBy("event").agg(F.round(F.count_if(F.col("known").isNull()) / F.count(F.lit(1)), 6).alias("surprise"))


_TOTAL = f"WITH RECURSIVE {LOG_SQL}, c AS (SELECT origin, id, at_, SUM(value) OVER (PARTITION BY origin ORDER BY at_, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS total, ROW_NUMBER() OVER (PARTITION BY origin ORDER BY at_, id) AS n FROM log)"


def _totals(spark, sf_dir):
    e = log(spark, sf_dir)
    return e.withColumn("total", I.rolling(e, "value", ["at", "id"], 20, ["origin"]))


@query("rolling_window", f"{_TOTAL} SELECT id, round(total, 4) AS total FROM c")
def rolling_window(spark, sf_dir):
    return _totals(spark, sf_dir).select("id", F.round("total", 4).alias("total"))


@query("mode_hysteresis", f"""{_TOTAL}, f AS (SELECT origin, id, n, CASE WHEN total >= 1100 THEN 'cen' ELSE 'dmn' END AS mode FROM c WHERE n = 1
UNION ALL SELECT c.origin, c.id, c.n, CASE WHEN c.total >= 1100 THEN 'cen' WHEN c.total <= 800 THEN 'dmn' ELSE f.mode END FROM f JOIN c ON c.origin = f.origin AND c.n = f.n + 1) SELECT id, mode FROM f""")
def mode_hysteresis(spark, sf_dir):
    return I.fold_modes(_totals(spark, sf_dir), "origin", ["at", "id"], 1100, 800).select("id", "mode")


@query("token_bucket", f"""WITH RECURSIVE {LOG_SQL}, r AS (SELECT id, origin, floor(epoch(at_)) AS t, ROW_NUMBER() OVER (PARTITION BY origin ORDER BY floor(epoch(at_)), id) AS n FROM log),
b AS (SELECT origin, id, n, t, 2.0::DOUBLE AS had FROM r WHERE n = 1 UNION ALL
SELECT r.origin, r.id, r.n, r.t, LEAST(3.0, b.had - CASE WHEN b.had >= 1 THEN 1 ELSE 0 END + (r.t - b.t) * 0.00001)::DOUBLE FROM b JOIN r ON r.origin = b.origin AND r.n = b.n + 1) SELECT id, had >= 1 AS allowed FROM b""".replace("2.0::DOUBLE", "3.0::DOUBLE"))
def token_bucket(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("t", epoch("at"))
    return I.token_bucket(e, "origin", "t", "id", 0.00001, 3.0).select("id", "allowed")


@query("stuck_expectations", f"""WITH {LOG_SQL}, w AS (SELECT origin, MIN(floor(epoch(at_))) AS since FROM log WHERE kind = 'view' GROUP BY origin)
SELECT origin, CAST(epoch(TIMESTAMP '{AS_OF}') - since AS BIGINT) AS age, CASE WHEN epoch(TIMESTAMP '{AS_OF}') - since > 2600000 THEN 'stuck' ELSE 'backlog' END AS state FROM w WHERE origin NOT IN (SELECT origin FROM log WHERE kind = 'purchase' AND value > 100)""")
def stuck_expectations(spark, sf_dir):
    e = log(spark, sf_dir)
    out = I.stuck(e.where("kind = 'view'"), e.where("kind = 'purchase' AND value > 100"), "origin", epoch("at"), epoch_of(AS_OF), 2_600_000)
    return out.withColumn("age", F.col("age").cast("long"))


@query("retry_candidates", f"""WITH {LOG_SQL}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY origin ORDER BY at_ DESC, id DESC) AS rn, COUNT(*) FILTER (WHERE kind = 'error') OVER (PARTITION BY origin) AS attempts FROM log)
SELECT origin, id, attempts FROM r WHERE rn = 1 AND kind = 'error' AND value < 150 AND attempts < 20""")
def retry_candidates(spark, sf_dir):
    from sedimenta.operators.latest import latest_by

    e = log(spark, sf_dir)
    attempts = e.groupBy("origin").agg(F.count_if(F.col("kind") == "error").alias("attempts"))
    last = latest_by(e, ["origin"], ["at", "id"], ["id", "kind", "value"]).where("kind = 'error' AND value < 150")
    return last.join(attempts, "origin").where("attempts < 20").select("origin", "id", "attempts")


@query("daily_tumbling", f"WITH {LOG_SQL} SELECT strftime(at_, '%Y-%m-%d') AS day, COUNT(*) AS n, LEAST(COUNT(*), 50) AS used FROM log WHERE kind <> 'error' GROUP BY 1 HAVING COUNT(*) >= 3")
def daily_tumbling(spark, sf_dir):
    out = I.daily(log(spark, sf_dir).where("kind != 'error'"), "at", ["at", "id"])
    return out.select("day", "n", F.col("used").cast("long"))


@query("idempotent_append", f"""WITH {LOG_SQL}, n AS (SELECT *, kind || '/' || origin AS key, ROW_NUMBER() OVER (PARTITION BY kind, origin ORDER BY at_, id) AS rn FROM log WHERE id % 4 <> 0)
SELECT id, key FROM n WHERE rn = 1 AND key NOT IN (SELECT kind || '/' || origin FROM log WHERE id % 4 = 0)""")
def idempotent_append_q(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("key", F.concat_ws("/", "kind", F.col("origin").cast("string")))
    return idempotent_append(e.where("id % 4 = 0"), e.where("id % 4 != 0"), "key", [F.col("at"), F.col("id")]).select("id", "key")


@query("retention_delete", f"""WITH {LOG_SQL}, r AS (SELECT id, origin AS hash, id % 3 AS version, 'extractor:v' || (id % 2) || CASE WHEN id % 5 = 0 THEN '#retry' || (id % 7) ELSE '' END AS producer, CASE WHEN kind = 'error' THEN 'failed' END AS status, floor(epoch(at_)) AS at_ FROM log)
SELECT id FROM r WHERE NOT (COALESCE(status, '') = 'failed' AND at_ < epoch(TIMESTAMP '2024-01-20') AND EXISTS (SELECT 1 FROM r s WHERE s.status IS NULL AND s.hash = r.hash AND s.version = r.version AND starts_with(s.producer, regexp_replace(r.producer, '#retry.*', ''))))""")
def retention_delete(spark, sf_dir):
    i = F.col("id")
    producer = F.concat(F.lit("extractor:v"), (i % 2).cast("string"), F.when(i % 5 == 0, F.concat(F.lit("#retry"), (i % 7).cast("string"))).otherwise(""))
    rows = log(spark, sf_dir).select("id", F.col("origin").alias("hash"), (i % 3).alias("version"), producer.alias("producer"), F.when(F.col("kind") == "error", "failed").alias("status"), epoch("at").alias("at"))
    return prune_failed(rows, epoch_of("2024-01-20 00:00:00")).select("id")


@query("watermark_upsert", f"""WITH {LOG_SQL} SELECT kind AS worker, MAX(id) AS through_id FROM log GROUP BY kind""")
def watermark_upsert(spark, sf_dir):
    w = log(spark, sf_dir).select(F.col("kind").alias("worker"), F.col("at").alias("through_at"), F.col("id").alias("through_id"))
    return monotonic_watermarks(w.where("through_id % 2 = 0"), w.where("through_id % 2 = 1")).select("worker", "through_id")


@query("retry_names", f"WITH {LOG_SQL} SELECT origin, 'extractor:v0' || CASE WHEN COUNT(*) FILTER (WHERE kind = 'error') > 0 THEN '#retry' || COUNT(*) FILTER (WHERE kind = 'error') ELSE '' END AS producer FROM log GROUP BY origin")
def retry_names(spark, sf_dir):
    g = log(spark, sf_dir).groupBy("origin").agg(F.count_if(F.col("kind") == "error").alias("n"))
    return g.select("origin", retry_name(F.lit("extractor:v0"), F.col("n")).alias("producer"))


@query("import_validation", """WITH s AS (SELECT doc_id, source, strlen(trim(COALESCE(text, ''))) AS bytes, ROW_NUMBER() OVER w AS n, SUM(strlen(trim(COALESCE(text, '')))) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, CASE WHEN bytes = 0 THEN 'empty' WHEN n > 40 THEN 'too_many' WHEN bytes > 10000 THEN 'too_long' WHEN total > 80000 THEN 'over_total' ELSE 'ok' END AS verdict FROM s""")
def import_validation(spark, sf_dir):
    return validate_batch(read(spark, sf_dir, "documents"), "text", "source", "doc_id", 40, 10_000, 80_000).select("doc_id", "verdict")


@query("orphan_blobs", "SELECT p_partkey AS blob FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)")
def orphan_blobs(spark, sf_dir):
    stored = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("blob"), "p_size")
    reach = read(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("blob"))
    return orphans(stored, reach, "blob", F.col("p_size"), 10).select("blob")


@query("frontier", f"WITH {LOG_SQL} SELECT MAX(id) AS through_id FROM log WHERE epoch(at_) < (SELECT MAX(epoch(at_)) FROM log) - 60")
def frontier(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("t", epoch_micros("at"))
    top = e.agg(F.max("t").alias("top"))
    return e.crossJoin(F.broadcast(top)).where("t < top - 60000000").agg(F.max("id").alias("through_id"))


@query("provenance_first_stamp", "SELECT o_custkey AS event, arg_min(o_orderpriority, o_orderkey) AS client, COUNT(*) AS stamps FROM orders GROUP BY 1")
def provenance_first_stamp(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("event")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("client"), F.count(F.lit(1)).alias("stamps"))


@query("active_promotes", f"""WITH {LOG_SQL}, p AS (SELECT *, LEAD(id) OVER (PARTITION BY origin ORDER BY at_, id) AS next FROM log WHERE kind IN ('signup', 'error')) SELECT origin, id FROM p WHERE kind = 'signup' AND next IS NULL""")
def active_promotes(spark, sf_dir):
    from sedimenta.operators.latest import latest_by

    rows = log(spark, sf_dir).where("kind IN ('signup', 'error')")
    return latest_by(rows, ["origin"], ["at", "id"], ["id", "kind"]).where("kind = 'signup'").select("origin", "id")
