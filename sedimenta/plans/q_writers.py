"""Writers, projections, ontology, tuning and whole-recall queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import projections as P
from sedimenta.functions.scoring import SALIENCE
from sedimenta.functions.timecol import epoch, epoch_of
from sedimenta.operators import ontology, recall, tuning, writers
from sedimenta.plans.base import AS_OF, LOG_SQL, SEARCHES, edges, log, query, read
from sedimenta.plans.q_retrieval import _BM25


@query("write_interpretations", f"""WITH {LOG_SQL}, l AS (SELECT origin AS event_hash, k % 3 AS version, 'x:v0' || CASE WHEN id % 8 = 0 THEN '#retry1' ELSE '' END AS produced_by, CASE WHEN kind = 'error' THEN 'failed' ELSE 'ok' END AS status FROM log WHERE id % 2 = 0),
t AS (SELECT event_hash, version, COUNT(*) AS attempts, MAX(CASE WHEN produced_by = 'x:v0' THEN status END) AS first FROM l GROUP BY 1, 2), n AS (SELECT DISTINCT origin AS event_hash, k % 3 AS version FROM log WHERE id % 2 = 1)
SELECT n.event_hash, n.version, CASE WHEN attempts IS NULL THEN 'x:v0' ELSE 'x:v0#retry' || attempts END AS produced_by FROM n LEFT JOIN t USING (event_hash, version) WHERE attempts IS NULL OR first = 'failed'""")
def write_interpretations(spark, sf_dir):
    i = F.col("id")
    rows = log(spark, sf_dir).select("id", F.col("origin").alias("event_hash"), (F.col("k") % 3).alias("version"), F.concat(F.lit("x:v0"), F.when(i % 8 == 0, "#retry1").otherwise("")).alias("produced_by"), F.when(F.col("kind") == "error", "failed").otherwise("ok").alias("status"))
    new = rows.where("id % 2 = 1").select("event_hash", "version", F.lit("x:v0").alias("produced_by"))
    return writers.interpretations(rows.where("id % 2 = 0"), new)


@query("write_mentions", """WITH l AS (SELECT l_partkey AS entity, l_orderkey AS event FROM lineitem WHERE l_linenumber <= 2), n AS (SELECT DISTINCT l_partkey AS entity, l_orderkey AS event FROM lineitem WHERE l_linenumber > 2 AND l_shipmode_ok)
SELECT n.* FROM n ANTI JOIN l ON l.entity = n.entity AND l.event = n.event""".replace(" AND l_shipmode_ok", " AND l_returnflag <> 'N'"))
def write_mentions(spark, sf_dir):
    method = F.when(F.col("l_returnflag") == "N", "guess").otherwise("exact")
    m = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("event_id"), F.lit("x").alias("surface_form"), method.alias("match_method"), "l_linenumber")
    good, _ = writers.mentions(m.where("l_linenumber <= 2"), m.where("l_linenumber > 2"))
    return good.select(F.col("entity_id").alias("entity"), F.col("event_id").alias("event"))


@query("get_or_create_entities", """WITH l AS (SELECT 'entity:' || sha256(lower(p_name) || '|' || p_type) AS id, lower(p_name) AS name, p_type AS kind FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey, p_name, lower(p_name) AS name, p_type AS kind FROM part WHERE p_partkey % 3 = 0)
SELECT p_name AS canonical_name, n.kind, COUNT(*) AS n, BOOL_OR(NOT EXISTS (SELECT 1 FROM l WHERE l.name = n.name AND l.kind = n.kind)) AS is_new FROM n GROUP BY 1, 2""")
def get_or_create_entities(spark, sf_dir):
    from sedimenta.functions.ids import entity_id

    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("canonical_name"), F.col("p_type").alias("kind"))
    seen = p.where("p_partkey % 2 = 0").select("canonical_name", "kind", entity_id(F.col("canonical_name"), F.col("kind")).alias("id"))
    out = writers.entities(seen, p.where("p_partkey % 3 = 0").withColumn("split", F.lit(False)))
    return out.groupBy("canonical_name", "kind").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_new").alias("is_new"))


@query("write_edge_reviews", """SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS edge_id FROM lineitem WHERE l_returnflag = 'R'""")
def write_edge_reviews(spark, sf_dir):
    v = F.when(F.col("predicate").startswith("R"), "reject").when(F.col("predicate").startswith("A"), "confirm").otherwise("maybe")
    return writers.edge_reviews(edges(spark, sf_dir).select("edge_id", v.alias("verdict")))[1].select("edge_id")


@query("rescore_delta", """WITH e AS (SELECT l_suppkey, l_partkey, round(1 - l_discount * 5, 6) AS c, ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_quantity < 25),
n AS (SELECT l_suppkey, l_partkey, MAX(round(1 - l_discount * 5, 6)) AS c FROM lineitem WHERE l_quantity >= 25 GROUP BY 1, 2)
SELECT n.l_suppkey || '/' || n.l_partkey AS edge_id, n.c AS confidence FROM n LEFT JOIN e ON e.l_suppkey = n.l_suppkey AND e.l_partkey = n.l_partkey AND rn = 1 WHERE e.c IS NULL OR abs(n.c - e.c) >= 0.01""")
def rescore_delta(spark, sf_dir):
    from sedimenta.operators.latest import latest_by

    e = edges(spark, sf_dir).withColumn("edge_id", F.concat_ws("/", F.col("subject").cast("string"), F.col("object").cast("string"))).withColumn("confidence", F.round("confidence", 6))
    last = latest_by(e.where("quantity < 25"), ["edge_id"], ["at", "source", "line"], ["confidence"])
    return writers.rescored(last, e.where("quantity >= 25").groupBy("edge_id").agg(F.max("confidence").alias("confidence")))


@query("payload_summary", """SELECT doc_id, left(text, 500) AS text, length(text) > 500 AS truncated FROM documents""")
def payload_summary(spark, sf_dir):
    payload = F.to_json(F.struct(F.lit("text").alias("content_type"), F.col("text").alias("text")))
    d = read(spark, sf_dir, "documents").select("doc_id", P.payload_summary(payload).alias("s"))
    return d.select("doc_id", "s.text", "s.truncated")


@query("preview", r"SELECT conv_id, turn, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 320) AS preview FROM conversations")
def preview(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", P.preview(F.to_json(F.struct("text"))).alias("preview"))


@query("parse_json_loose", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def parse_json_loose(spark, sf_dir):
    m, p = F.col("event_id") % 4, F.col("props")
    raw = F.when(m == 0, p).when(m == 1, F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n```"))).when(m == 2, F.concat(F.lit("so "), p, F.lit(" done"))).otherwise("nothing here")
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(P.parse_json_loose(raw), "$.k").cast("long").alias("k"))


@query("why_durable", """SELECT event_id, 'salience ' || printf('%.2f', value / 1000) || '; class ' || event_type AS why FROM events""")
def why_durable(spark, sf_dir):
    none = F.create_map().cast("map<string,double>")
    return read(spark, sf_dir, "events").select("event_id", P.why_durable(F.col("value") / 1000, none, F.col("event_type"), F.lit(None).cast("double")).alias("why"))


@query("next_monthly", """WITH RECURSIVE o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'), w AS (SELECT id, d FROM o UNION ALL SELECT id, CAST(d + INTERVAL 1 MONTH AS DATE) FROM w WHERE d < DATE '1998-12-31')
SELECT id, strftime(MAX(d), '%Y-%m-%d') AS moment FROM w GROUP BY id""")
def next_monthly(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where(epoch("o_orderdate") >= epoch_of("1998-01-01 00:00:00")).select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    return o.select("id", F.date_format(P.next_monthly(F.col("d"), F.lit("1998-12-31").cast("date")), "yyyy-MM-dd").alias("moment"))


_REV = "rev AS (SELECT 'n' || s_nationkey AS from_slug, 'n' || (s_nationkey // 2) AS to_slug, CASE s_suppkey % 4 WHEN 0 THEN 'rename' WHEN 1 THEN 'restore' WHEN 2 THEN 'merge' ELSE 'deprecate' END AS action, s_suppkey AS id FROM supplier)"


def _revisions(spark, sf_dir):
    m = F.col("s_suppkey") % 4
    action = F.when(m == 0, "rename").when(m == 1, "restore").when(m == 2, "merge").otherwise("deprecate")
    n = F.col("s_nationkey")
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("revised_at"), action.alias("action"), F.concat(F.lit("n"), n.cast("string")).alias("from_slug"), F.concat(F.lit("n"), F.floor(n / 2).cast("string")).alias("to_slug"))


def _registry(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("slug"))


@query("ontology_live", f"""WITH {_REV}, last AS (SELECT from_slug, arg_max(action, id) AS action FROM rev GROUP BY 1) SELECT 'n' || n_nationkey AS slug FROM nation WHERE 'n' || n_nationkey NOT IN (SELECT from_slug FROM last WHERE action IN ('rename', 'merge', 'deprecate'))""")
def ontology_live(spark, sf_dir):
    return ontology.live_slugs(_registry(spark, sf_dir), _revisions(spark, sf_dir))


@query("ontology_resolve", f"""WITH RECURSIVE {_REV}, last AS (SELECT from_slug, arg_max(action, id) AS action, arg_max(to_slug, id) AS to_slug FROM rev GROUP BY 1), w AS (SELECT 'n' || n_nationkey AS slug, 'n' || n_nationkey AS cur, 0 AS d FROM nation
UNION ALL SELECT slug, to_slug, d + 1 FROM w JOIN last ON from_slug = cur AND action IN ('rename', 'merge') WHERE d < 16) SELECT slug, arg_max(cur, d) AS resolved FROM w GROUP BY slug""")
def ontology_resolve(spark, sf_dir):
    return ontology.resolve_slugs(_registry(spark, sf_dir), _revisions(spark, sf_dir))


@query("ontology_apply", """SELECT CASE p_size % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'rename' WHEN 2 THEN 'merge' WHEN 3 THEN 'deprecate' ELSE 'merge' END AS action, COUNT(*) AS n FROM part WHERE regexp_full_match(lower(replace(p_brand, '#', '_')), '[a-z][a-z0-9_]{1,30}') GROUP BY 1""")
def ontology_apply(spark, sf_dir):
    m = F.col("p_size") % 5
    action = F.when(m == 0, "add").when(m == 1, "rename").when(m == 2, "merge").when(m == 3, "deprecate").otherwise("split")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), action.alias("action"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("subject_slug"), F.lit("target").alias("target_slug"), F.array(F.col("p_partkey")).alias("members"))
    _, revisions, _ = ontology.apply_decisions(p, _registry(spark, sf_dir), F.lit(1))
    return revisions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_kinds", f"""WITH {_REV}, last AS (SELECT from_slug, arg_max(action, id) AS action FROM rev GROUP BY 1), live AS (SELECT 'n' || n_nationkey AS slug FROM nation WHERE 'n' || n_nationkey NOT IN (SELECT from_slug FROM last WHERE action IN ('rename', 'merge', 'deprecate'))),
r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' N' || c_nationkey WHEN 1 THEN 'City' ELSE 'Gadget' END AS raw FROM customer)
SELECT c_custkey, CASE WHEN lower(trim(raw)) IN (SELECT slug FROM live) THEN lower(trim(raw)) WHEN raw = 'City' THEN 'place' ELSE 'other' END AS slug FROM r""")
def normalize_kinds(spark, sf_dir):
    live = ontology.live_slugs(_registry(spark, sf_dir), _revisions(spark, sf_dir))
    m = F.col("c_custkey") % 3
    raw = read(spark, sf_dir, "customer").select("c_custkey", F.when(m == 0, F.concat(F.lit(" N"), F.col("c_nationkey").cast("string"))).when(m == 1, "City").otherwise("Gadget").alias("kind_raw"))
    none = live.select("slug", F.col("slug").alias("resolved")).where("false")
    return ontology.normalize_kinds(raw, live, none).select("c_custkey", "slug")


@query("rollback_reason", f"""WITH {LOG_SQL}, g AS (SELECT origin, COUNT(*) FILTER (WHERE kind = 'error' AND value > 190) AS violations, COUNT(*) AS events, COUNT(*) FILTER (WHERE id % 2 = 0 AND kind = 'click') / NULLIF(COUNT(*) FILTER (WHERE id % 2 = 0), 0) AS before, COUNT(*) FILTER (WHERE id % 2 = 1 AND kind = 'click') / NULLIF(COUNT(*) FILTER (WHERE id % 2 = 1), 0) AS after FROM log GROUP BY 1)
SELECT origin, CASE WHEN violations > 0 THEN 'invariant' WHEN events >= 50 AND before > 0 AND (before - after) / before >= 0.1 THEN 'degraded' END AS reason FROM g""")
def rollback_reason(spark, sf_dir):
    even, click = F.col("id") % 2 == 0, F.col("kind") == "click"
    g = log(spark, sf_dir).groupBy("origin").agg(F.count_if((F.col("kind") == "error") & (F.col("value") > 190)).alias("v"), F.count(F.lit(1)).alias("e"), F.try_divide(F.count_if(even & click), F.count_if(even)).alias("b"), F.try_divide(F.count_if(~even & click), F.count_if(~even)).alias("a"))
    return g.select("origin", tuning.rollback_reason(F.col("v"), F.col("e"), F.col("b"), F.col("a")).alias("reason"))


@query("replay_variants", f"""WITH {LOG_SQL} SELECT id, round(value * 0.25, 6) AS current, round(value * 0.3, 6) AS variant FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY at_ DESC, id DESC) AS r FROM log) WHERE r <= 30 AND kind = 'view'""")
def replay_variants(spark, sf_dir):
    out = tuning.replay(log(spark, sf_dir), lambda p: F.round(F.col("value") * p["w"], 6), {"w": 0.25}, {"w": 0.3}, [F.col("at").desc(), F.col("id").desc()], kind="view")
    return out.select("id", "current", "variant")


@query("salience_guard", "SELECT event_id AS id FROM events WHERE value / 150 > 1 OR event_type = 'error'")
def salience_guard(spark, sf_dir):
    full = F.create_map(*[x for k in SALIENCE for x in (F.lit(k), F.lit(0.1))])
    less = F.create_map(F.lit("recency"), F.lit(0.1))
    rows = log(spark, sf_dir).select("id", (F.col("value") / 150).alias("score"), F.when(F.col("kind") == "error", less).otherwise(full).alias("components"))
    return tuning.salience_guard(rows).select("id")


@query("recall_shallow", f"WITH {_BM25} SELECT query_id, id, rank FROM fts WHERE rank <= 20")
def recall_shallow(spark, sf_dir):
    q = spark.createDataFrame(list(SEARCHES), "query_id int, query string")
    out = recall.recall(read(spark, sf_dir, "documents").withColumn("at", F.lit(None).cast("long")), q, "doc_id", "text", "at")
    return out.select("query_id", "id", F.col("rank").cast("long"))


@query("coverage_report", f"""WITH h AS (SELECT source, doc_id, quality, toxic, ts FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN events ON event_id = doc_id)
SELECT source AS query_id, COUNT(*) AS hits, COUNT(*) FILTER (WHERE quality = 0) AS invalidated, COUNT(*) FILTER (WHERE toxic = 1) AS unresolved, (epoch(TIMESTAMP '{AS_OF}') - MAX(floor(epoch(ts)))) / 86400 >= 30 AS stale FROM h GROUP BY source""")
def coverage_report(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").join(read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), epoch("ts").alias("at_seconds")), "doc_id", "left")
    hits = d.select(F.col("source").alias("query_id"), "at_seconds", (F.col("quality") == 0).alias("invalidated"), (F.col("toxic") == 1).alias("unresolved"), F.lit(0).alias("low_edges"))
    out = recall.coverage(hits, epoch_of(AS_OF))
    return out.select("query_id", "hits", "invalidated", "unresolved", F.when(F.col("newest").isNotNull(), F.array_contains("caveats", "stale")).alias("stale"))


@query("embedding_text", """SELECT event_id, CASE WHEN event_type = 'error' THEN '(empty event)' ELSE event_type || chr(10) || 'u' || user_id || ', ' || 'v' END AS text FROM events""")
def embedding_text(spark, sf_dir):
    bad = F.col("event_type") == "error"
    payload = F.when(bad, "{}").otherwise(F.to_json(F.struct(F.col("event_type").alias("action"), F.lit("").alias("result"))))
    names = F.when(bad, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("v")))
    return read(spark, sf_dir, "events").select("event_id", P.embedding_text(payload, F.lit("{}"), names).alias("text"))


@query("key_point_reviews", """WITH x AS (SELECT l_orderkey % 500 AS synthesis, l_linenumber AS digest, l_returnflag AS verdict, l_shipdate AS t, l_partkey AS id FROM lineitem WHERE l_linenumber <= 3), e AS (SELECT synthesis, digest, arg_max(verdict, (t, id, verdict)) AS v FROM x GROUP BY 1, 2),
y AS (SELECT (l_orderkey % 500) // 10 AS cluster_id, l_linenumber AS digest, l_linestatus AS verdict, l_shipdate AS t, l_partkey AS id FROM lineitem WHERE l_linenumber >= 3), c AS (SELECT cluster_id, digest, arg_max(verdict, (t, id, verdict)) AS v FROM y GROUP BY 1, 2),
m AS (SELECT DISTINCT l_orderkey % 500 AS synthesis, (l_orderkey % 500) // 10 AS cluster_id FROM lineitem), w AS (SELECT synthesis, digest, v FROM m JOIN c USING (cluster_id))
SELECT COALESCE(e.synthesis, w.synthesis) AS synthesis, COALESCE(e.digest, w.digest) AS digest, COALESCE(e.v, w.v) AS verdict FROM e FULL JOIN w ON e.synthesis = w.synthesis AND e.digest = w.digest""")
def key_point_reviews(spark, sf_dir):
    from sedimenta.operators.latest import exact_over_cluster

    li = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("synthesis"), F.expr("(l_orderkey % 500) div 10").alias("cluster_id"), F.col("l_linenumber").alias("digest"), "l_returnflag", "l_linestatus", F.col("l_shipdate").alias("t"), F.col("l_partkey").alias("id"))
    exact = li.where("digest <= 3").select("synthesis", "digest", F.col("l_returnflag").alias("verdict"), "t", "id")
    cluster = li.where("digest >= 3").select("cluster_id", "digest", F.col("l_linestatus").alias("verdict"), "t", "id")
    return exact_over_cluster(exact, cluster, li.select("synthesis", "cluster_id").distinct(), ["t", "id", "verdict"])
