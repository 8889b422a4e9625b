"""Overlays over the append-only graph: live views, review pools, trust, corroboration, conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions.ids import pair_key
from sedimenta.functions.scoring import auto_confirm, edge_confidence, trust
from sedimenta.functions.text import enforce_floor, is_unresolved, normalize_verdict, predicate_is_crisp
from sedimenta.functions.timecol import day, epoch, epoch_of
from sedimenta.operators import retrieval as R
from sedimenta.operators.corrections import conflict_resolution, decide, expire, pending_union, propose_once
from sedimenta.operators.latest import latest_by, latest_n, live
from sedimenta.plans.base import EDGES_SQL, edges, log, query, read

_TRIPLE = ["subject", "object"]
_LATEST = "ROW_NUMBER() OVER (PARTITION BY subject, object ORDER BY at_ DESC, source DESC, line DESC)"


@query("latest_score_per_edge", f"WITH {EDGES_SQL} SELECT subject, object, round(confidence, 6) AS confidence, source FROM (SELECT *, {_LATEST} AS rn FROM edges) WHERE rn = 1")
def latest_score_per_edge(spark, sf_dir):
    return latest_by(edges(spark, sf_dir), _TRIPLE, ["at", "source", "line"], ["confidence", "source"]).select(*_TRIPLE, F.round("confidence", 6).alias("confidence"), "source")


@query("latest_review_per_edge", f"""WITH {EDGES_SQL} SELECT subject, object, CASE WHEN predicate LIKE 'R%' THEN 'reject' ELSE 'confirm' END AS verdict
FROM (SELECT *, {_LATEST} AS rn FROM edges WHERE predicate <> 'NO') WHERE rn = 1""")
def latest_review_per_edge(spark, sf_dir):
    reviews = edges(spark, sf_dir).where("predicate != 'NO'").withColumn("verdict", F.when(F.col("predicate").startswith("R"), "reject").otherwise("confirm"))
    return latest_by(reviews, _TRIPLE, ["at", "source", "line"], ["verdict"])


@query("live_edges_anti_join", f"""WITH {EDGES_SQL} SELECT edge_id, subject, predicate, object FROM edges e WHERE NOT EXISTS
(SELECT 1 FROM edges i WHERE i.predicate LIKE 'R%' AND i.subject = e.subject AND i.object = e.object)""")
def live_edges_anti_join(spark, sf_dir):
    e = edges(spark, sf_dir)
    gone = e.where(F.col("predicate").startswith("R")).select(*_TRIPLE).distinct()
    return e.join(gone, _TRIPLE, "left_anti").select("edge_id", "subject", "predicate", "object")


@query("edges_by_source_batch", f"""WITH {EDGES_SQL} SELECT source, COUNT(*) AS n, string_agg(edge_id, ',' ORDER BY at_, edge_id) AS edge_ids
FROM edges WHERE source % 50 = 0 AND edge_id NOT IN (SELECT edge_id FROM edges WHERE predicate LIKE 'R%') GROUP BY source""")
def edges_by_source_batch(spark, sf_dir):
    e = edges(spark, sf_dir)
    wanted = e.where("source % 50 = 0").select("source").distinct()
    dead = e.where(F.col("predicate").startswith("R")).select("edge_id")
    got = live(e.join(wanted, "source", "left_semi"), dead, "edge_id")
    g = got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("at", "edge_id"))).alias("l"))
    return g.select("source", "n", F.array_join(F.transform("l", lambda x: x["edge_id"].cast("string")), ",").alias("edge_ids"))


@query("review_candidate_pool", f"""WITH {EDGES_SQL}, pool AS (SELECT e.edge_id, e.confidence, e.at_ FROM edges e JOIN orders o ON o.o_orderkey = e.source
  WHERE e.predicate NOT LIKE 'R%' AND o.o_orderstatus <> 'F' AND e.confidence < 0.6)
SELECT edge_id, round(confidence, 6) AS confidence, strftime(at_, '%Y-%m-%d') AS day FROM pool WHERE (confidence, at_, edge_id) > (0.5, TIMESTAMP '1995-01-01', 0)""")
def review_candidate_pool(spark, sf_dir):
    e = edges(spark, sf_dir).where(~F.col("predicate").startswith("R") & (F.col("confidence") < 0.6))
    served = read(spark, sf_dir, "orders").where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("source"))
    pool = e.join(served, "source", "left_semi")
    c, at, i = F.col("confidence"), F.col("at"), F.col("edge_id")
    start = F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'")
    after = (c > 0.5) | (c == 0.5) & ((at.cast("timestamp_ntz") > start) | (at.cast("timestamp_ntz") == start) & (i > 0))
    return pool.where(after).select("edge_id", F.round("confidence", 6).alias("confidence"), day("at").alias("day"))


@query("unserved_expiry", f"""WITH {EDGES_SQL} SELECT edge_id FROM edges e WHERE confidence < 0.65 AND predicate NOT LIKE 'R%'
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = e.source AND o.o_orderpriority LIKE '1%') AND GREATEST(at_, TIMESTAMP '1993-01-01') < TIMESTAMP '1998-01-01'""")
def unserved_expiry(spark, sf_dir):
    e = edges(spark, sf_dir).where((F.col("confidence") < 0.65) & ~F.col("predicate").startswith("R"))
    served = read(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("source"))
    seconds = F.greatest(epoch("at"), epoch_of("1993-01-01 00:00:00"))
    return live(e, served, "source").where(seconds < epoch_of("1998-01-01 00:00:00")).select("edge_id")


@query("noise_sweep", f"""WITH {EDGES_SQL}, r AS (SELECT edge_id, CASE WHEN o.o_orderstatus = 'P' THEN 'observed' WHEN p.p_size < 5 AND e.confidence >= 0.6 THEN 'transient' WHEN e.predicate = 'NO' AND e.quantity < 3 THEN 'not_durable' END AS reason
  FROM edges e LEFT JOIN orders o ON o.o_orderkey = e.source LEFT JOIN part p ON p.p_partkey = e.object WHERE e.predicate NOT LIKE 'R%') SELECT edge_id, reason FROM r WHERE reason IS NOT NULL""")
def noise_sweep(spark, sf_dir):
    e = edges(spark, sf_dir).where(~F.col("predicate").startswith("R"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), "o_orderstatus")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("object"), "p_size")
    reason = F.when(F.col("o_orderstatus") == "P", "observed").when((F.col("p_size") < 5) & (F.col("confidence") >= 0.6), "transient").when((F.col("predicate") == "NO") & (F.col("quantity") < 3), "not_durable")
    return e.join(o, "source", "left").join(p, "object", "left").select("edge_id", reason.alias("reason")).where("reason IS NOT NULL")


@query("edges_to_score", f"""WITH {EDGES_SQL}, s AS (SELECT edge_id, at_, edge_id IN (SELECT edge_id FROM edges WHERE predicate = 'AF') AS scored FROM edges)
SELECT edge_id, CASE WHEN scored THEN 1 ELSE 0 END AS tier, ROW_NUMBER() OVER (PARTITION BY scored ORDER BY CASE WHEN scored THEN -epoch(at_) ELSE epoch(at_) END, edge_id) AS place FROM s""")
def edges_to_score(spark, sf_dir):
    from pyspark.sql import Window

    e = edges(spark, sf_dir)
    scored = e.where("predicate = 'AF'").select("edge_id")
    first = live(e, scored, "edge_id").select("edge_id", F.lit(0).alias("tier"), epoch("at").alias("o"))
    then = e.join(scored, "edge_id", "left_semi").select("edge_id", F.lit(1).alias("tier"), (-epoch("at")).alias("o"))
    return first.unionByName(then).select("edge_id", "tier", F.row_number().over(Window.partitionBy("tier").orderBy("o", "edge_id")).cast("long").alias("place"))


_SIGNALS = f"""{EDGES_SQL}, n AS (SELECT subject, predicate, object, COUNT(DISTINCT source) AS sources FROM edges GROUP BY ALL),
sig AS (SELECT e.*, n.sources - 1 AS corroborating, 0.5 + p.p_size / 100.0 AS subject_conf, CASE WHEN e.line % 2 = 0 THEN 0.9 END AS object_conf, e.predicate = 'RF' AS conflicted
  FROM edges e JOIN n USING (subject, predicate, object) LEFT JOIN part p ON p.p_partkey = e.object),
conf AS (SELECT *, ln(0.7 / 0.3) + 1.5 * (confidence - 0.7) + 0.4 + COALESCE(2.0 * (LEAST(subject_conf, object_conf) - 1), 0) + 0.8 * log2(1 + corroborating) - CASE WHEN conflicted THEN 1 ELSE 0 END AS z FROM sig),
scored AS (SELECT *, GREATEST(0.05, LEAST(0.99, 1 / (1 + exp(-z)))) AS p FROM conf)"""


def _scored(spark, sf_dir):
    e = edges(spark, sf_dir)
    n = e.groupBy("subject", "predicate", "object").agg(F.countDistinct("source").alias("sources"))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("object"), (0.5 + F.col("p_size") / 100.0).alias("subject_conf"))
    met = e.join(n, ["subject", "predicate", "object"]).join(p, "object", "left").withColumn("object_conf", F.when(F.col("line") % 2 == 0, 0.9))
    p_ = edge_confidence(F.col("confidence"), F.col("subject_conf"), F.col("object_conf"), predicate_is_crisp(F.col("predicate")), F.col("sources") - 1, F.col("predicate") == "RF")
    return met.withColumn("p", p_)


@query("edge_confidence_logodds", f"WITH {_SIGNALS} SELECT edge_id, round(p, 6) AS p FROM scored")
def edge_confidence_logodds(spark, sf_dir):
    return _scored(spark, sf_dir).select("edge_id", F.round("p", 6).alias("p"))


@query("trust_state", f"""WITH {_SIGNALS}, v AS (SELECT subject, object, CASE WHEN predicate = 'AF' THEN 'confirm' ELSE 'reject' END AS verdict FROM (SELECT *, {_LATEST} AS rn FROM edges WHERE predicate IN ('AF', 'NF')) WHERE rn = 1)
SELECT edge_id, CASE WHEN predicate = 'RF' THEN 'rejected' WHEN verdict = 'confirm' THEN 'confirmed' WHEN round(p, 9) >= 0.75 THEN 'auto_confirmed' ELSE 'proposed' END AS trust FROM scored LEFT JOIN v USING (subject, object)""")
def trust_state(spark, sf_dir):
    s = _scored(spark, sf_dir)
    reviews = edges(spark, sf_dir).where(F.col("predicate").isin("AF", "NF")).withColumn("verdict", F.when(F.col("predicate") == "AF", "confirm").otherwise("reject"))
    v = latest_by(reviews, _TRIPLE, ["at", "source", "line"], ["verdict"])
    auto = auto_confirm(F.round("p", 9), predicate_is_crisp(F.col("predicate")), F.lit(1), F.lit(True))
    return s.join(v, _TRIPLE, "left").select("edge_id", trust(F.col("predicate") == "RF", F.col("verdict"), auto).alias("trust"))


@query("corroboration_count", f"""WITH {EDGES_SQL}, k AS (SELECT *, object // 2 AS canonical FROM edges), t AS (SELECT subject, lower(predicate) AS p, canonical, COUNT(DISTINCT source) AS n FROM k WHERE predicate NOT LIKE 'R%' GROUP BY ALL)
SELECT edge_id, n - 1 AS others FROM k JOIN t ON t.subject = k.subject AND t.p = lower(k.predicate) AND t.canonical = k.canonical WHERE k.predicate NOT LIKE 'R%'""")
def corroboration_count(spark, sf_dir):
    """Distinct other sources of the same canonical triple: all sources less the edge's own, so no self-join is needed."""
    k = edges(spark, sf_dir).where(~F.col("predicate").startswith("R")).select("edge_id", "subject", F.lower("predicate").alias("p"), F.expr("object div 2").alias("canonical"), "source")
    n = k.groupBy("subject", "p", "canonical").agg(F.countDistinct("source").alias("n"))
    return k.join(n, ["subject", "p", "canonical"]).select("edge_id", (F.col("n") - 1).alias("others"))


_PAIRS = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings),
n AS (SELECT a.id AS a, b.id AS b, list_distance(a.vector, b.vector) AS d FROM v a CROSS JOIN v b WHERE a.id <> b.id AND a.id % 50 = 0),
links AS (SELECT a, b, d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY d, b) AS r FROM n) WHERE r <= 3),
judged AS (SELECT a, b, d, CASE WHEN d < 0.9 THEN 'contradicts' WHEN d < 1.1 THEN 'temporal_evolution' WHEN d < 1.25 THEN 'reverts' ELSE 'no_relation' END AS raw, 1.6 - d AS c FROM links)"""


def _judged(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    links = R.knn(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 3, exclude_self=True).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("distance").alias("d"))
    raw = F.when(F.col("d") < 0.9, "contradicts").when(F.col("d") < 1.1, "temporal_evolution").when(F.col("d") < 1.25, "reverts").otherwise("no_relation")
    return links.withColumn("raw", raw).withColumn("c", 1.6 - F.col("d"))


_NORM = "CASE raw WHEN 'contradicts' THEN CASE WHEN c < 0.7 THEN 'unsure' ELSE 'conflicts' END WHEN 'temporal_evolution' THEN 'evolves' WHEN 'reverts' THEN 'reverts' ELSE 'unrelated' END"


@query("conflict_pairs", f"""WITH {_PAIRS}, w AS (SELECT a, b, {_NORM} AS verdict FROM judged), both_ AS (SELECT a AS anchor, b AS other, verdict FROM w UNION ALL SELECT b, a, verdict FROM w)
SELECT DISTINCT anchor, other, LEAST(CAST(anchor AS VARCHAR), CAST(other AS VARCHAR)) || ':' || GREATEST(CAST(anchor AS VARCHAR), CAST(other AS VARCHAR)) AS pair, verdict,
verdict IN ('reverts', 'conflicts') AND quality IS NULL AS unresolved FROM both_ LEFT JOIN labels ON doc_id = LEAST(anchor, other)""")
def conflict_pairs(spark, sf_dir):
    w = _judged(spark, sf_dir).withColumn("verdict", enforce_floor(normalize_verdict(F.col("raw")), F.col("c")))
    both = w.select(F.col("a").alias("anchor"), F.col("b").alias("other"), "verdict").union(w.select("b", "a", "verdict"))
    settled = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("low"), F.lit(True).alias("settled"))
    met = both.withColumn("low", F.least("anchor", "other")).join(settled, "low", "left")
    unresolved = is_unresolved(F.col("verdict")) & F.col("settled").isNull()
    return met.select("anchor", "other", pair_key(F.col("anchor").cast("string"), F.col("other").cast("string")).alias("pair"), "verdict", unresolved.alias("unresolved")).distinct()


@query("verdict_taxonomy", f"WITH {_PAIRS} SELECT {_NORM} AS verdict, COUNT(*) AS n FROM judged GROUP BY 1")
def verdict_taxonomy(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy(enforce_floor(normalize_verdict(F.col("raw")), F.col("c")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("decide_conflicts", """WITH p AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'proposed' WHEN 'P' THEN 'expired' ELSE 'applied' END AS status FROM orders),
d AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'confirm' WHEN 'R' THEN 'retract' ELSE 'reject' END AS verdict, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, CASE l_returnflag WHEN 'A' THEN 'confirm' WHEN 'R' THEN 'retract' ELSE 'reject' END) AS rn FROM lineitem WHERE l_linenumber <= 3)
SELECT p.id, CASE WHEN verdict IS NULL THEN 'none' WHEN status = 'applied' THEN 'already_decided' ELSE 'decided' END AS outcome,
CASE WHEN verdict IS NULL OR status = 'applied' THEN status WHEN verdict = 'confirm' THEN 'applied' WHEN verdict = 'retract' THEN 'retracted' ELSE 'rejected' END AS new_status,
CASE WHEN verdict IS NOT NULL AND status <> 'applied' THEN CASE verdict WHEN 'confirm' THEN 'superseded_older' WHEN 'retract' THEN 'superseded_newer' ELSE 'no_conflict' END END AS resolution
FROM p LEFT JOIN d ON d.id = p.id AND d.rn = 1""")
def decide_conflicts(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "P", "expired").otherwise("applied")
    p = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))
    verdict = F.when(F.col("l_returnflag") == "A", "confirm").when(F.col("l_returnflag") == "R", "retract").otherwise("reject")
    d = read(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("id"), verdict.alias("verdict"), F.col("l_shipdate").alias("decided_at"))
    out = decide(p, d)
    return out.select("id", "outcome", "new_status", F.when(F.col("outcome") == "decided", conflict_resolution(F.col("verdict"))).alias("resolution"))


@query("expire_reviews", f"""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND (epoch(TIMESTAMP '1998-08-01') - epoch(o_orderdate)) / 86400.0 > 30 THEN 'expired' WHEN o_orderstatus = 'O' THEN 'proposed' ELSE 'decided' END AS status FROM orders""")
def expire_reviews(spark, sf_dir):
    p = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "proposed").otherwise("decided").alias("status"), ((epoch_of("1998-08-01 00:00:00") - epoch("o_orderdate")) / 86400.0).alias("age"))
    return expire(p, F.col("age"), 30.0).select("id", "status")


@query("propose_once", """SELECT DISTINCT l_partkey AS entity FROM lineitem WHERE l_returnflag = 'N' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def propose_once_q(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    rows = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("entity"))
    return propose_once(rows("R"), rows("N"), ["entity"])


@query("pending_union", """WITH q AS (
(SELECT o_orderkey AS id, o_totalprice AS confidence, 0 AS queue, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) UNION ALL
(SELECT p_partkey, p_retailprice, 1, ROW_NUMBER() OVER (ORDER BY p_retailprice DESC, p_partkey) FROM part) UNION ALL
(SELECT s_suppkey, s_acctbal, 2, ROW_NUMBER() OVER (ORDER BY s_acctbal DESC, s_suppkey) FROM supplier))
SELECT id, queue, round(confidence, 4) AS confidence FROM (SELECT * FROM q WHERE r <= 60 ORDER BY queue, r OFFSET 40 LIMIT 20)""")
def pending_union_q(spark, sf_dir):
    def q(name, id_, value):
        return read(spark, sf_dir, name).select(F.col(id_).alias("id"), F.col(value).alias("confidence"), F.lit(0).alias("detected_at"))

    out = pending_union([q("orders", "o_orderkey", "o_totalprice"), q("part", "p_partkey", "p_retailprice"), q("supplier", "s_suppkey", "s_acctbal")], 20, 40)
    return out.select("id", "queue", F.round("confidence", 4).alias("confidence"))


@query("prior_kind", """WITH a AS (SELECT o_custkey AS entity, o_orderpriority AS slug, o_orderdate AS at_, o_orderkey AS id FROM orders)
SELECT c_custkey AS entity, COALESCE(slug, c_mktsegment) AS kind FROM customer LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY at_ DESC, id DESC) AS rn FROM a WHERE slug <> '5-LOW') WHERE rn = 1) l ON l.entity = c_custkey""")
def prior_kind(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("slug"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    last = latest_by(a.where("slug != '5-LOW'"), ["entity"], ["at", "id"], ["slug"])
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    return base.join(last, "entity", "left").select("entity", F.coalesce("slug", "c_mktsegment").alias("kind"))


@query("newest_sources", f"""WITH {EDGES_SQL} SELECT object, string_agg(source, ',' ORDER BY at_ DESC, source DESC, line DESC) AS sources FROM
(SELECT *, ROW_NUMBER() OVER (PARTITION BY object ORDER BY at_ DESC, source DESC, line DESC) AS rn FROM edges) WHERE rn <= 2 GROUP BY object""")
def newest_sources(spark, sf_dir):
    rows = latest_n(edges(spark, sf_dir), ["object"], [F.col("at").desc(), F.col("source").desc(), F.col("line").desc()], 2)
    g = rows.groupBy("object").agg(F.sort_array(F.collect_list(F.struct("at", "source", "line")), asc=False).alias("l"))
    return g.select("object", F.array_join(F.transform("l", lambda x: x["source"].cast("string")), ",").alias("sources"))


@query("top_salient", """SELECT event_id AS id, round(value, 4) AS salience FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 30) ORDER BY value DESC, event_id LIMIT 10""")
def top_salient(spark, sf_dir):
    newest = log(spark, sf_dir).orderBy(F.col("at").desc(), F.col("id").desc()).limit(30)
    return newest.orderBy(F.col("value").desc(), "id").limit(10).select("id", F.round("value", 4).alias("salience"))


