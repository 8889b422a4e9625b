"""Applied decisions, life cycles, session start: queries over the test tables as queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions.timecol import epoch, epoch_of
from sedimenta.operators import applied as A
from sedimenta.operators import corrections as C
from sedimenta.operators import syntheses as S
from sedimenta.operators.graph import resolve
from sedimenta.plans.base import AS_OF, LOG_SQL, log, query, read

#: orders as a queue of proposals, events as the log, every fifth event of a kind invalidated.
_KIND = "CASE WHEN kind = 'error' THEN 'invalidate' WHEN kind = 'signup' AND id % 2 = 0 THEN 'living_synthesis' ELSE kind END"
_STORE = f"""{LOG_SQL}, store AS (SELECT id, at_ AS created_at, 'h' || id AS content_hash, {_KIND} AS kind FROM log), overlay AS (SELECT 'h' || id AS target FROM log WHERE id % 5 = 0)"""


def _store(spark, sf_dir):
    rows = log(spark, sf_dir).select("id", F.col("at").alias("created_at"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("content_hash"), F.expr(_KIND).alias("kind"))
    return rows, rows.where("id % 5 = 0").select(F.col("content_hash").alias("target"))


_ASKS = """asks AS (SELECT o_orderkey AS request, 'h' || (o_custkey * 8) AS target, CASE WHEN o_orderkey % 3 > 0 THEN 'text ' || (o_orderkey % 2) END AS text, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS reason FROM orders),
known AS (SELECT DISTINCT target, text FROM asks WHERE request % 11 = 0 AND text IS NOT NULL)"""


@query("correct_events", f"""WITH {_STORE}, {_ASKS}, m AS (SELECT a.*, s.kind, o.target IS NOT NULL AS gone, k.target IS NOT NULL AS was, ROW_NUMBER() OVER (PARTITION BY a.target ORDER BY request) AS nth, ROW_NUMBER() OVER (PARTITION BY a.target, a.text ORDER BY request) AS nth_text
  FROM asks a LEFT JOIN store s ON s.content_hash = a.target LEFT JOIN overlay o ON o.target = a.target LEFT JOIN known k ON k.target = a.target AND k.text = a.text),
r AS (SELECT *, kind IS NOT NULL AND kind <> 'invalidate' AS ok FROM m), w AS (SELECT *, ok AND text IS NOT NULL AND NOT was AND nth_text = 1 AS wc, ok AND NOT gone AND nth = 1 AS wi FROM r)
SELECT request, target, CASE WHEN kind IS NULL THEN 'not_found' WHEN NOT ok THEN 'is_invalidation' ELSE 'ok' END AS outcome, wc AS writes_correction, wi AS writes_invalidation, CASE WHEN wi THEN COALESCE(text, reason, 'operator') END AS invalidation_reason,
  CASE WHEN ok THEN CASE WHEN wi THEN 'invalidated' ELSE 'already_invalidated' END || CASE WHEN wc THEN '; correction_recorded' WHEN text IS NOT NULL THEN '; correction_deduplicated' ELSE '' END END AS result FROM w""")
def correct_events(spark, sf_dir):
    store, overlay = _store(spark, sf_dir)
    o = read(spark, sf_dir, "orders")
    asks = o.select(F.col("o_orderkey").alias("request"), F.concat(F.lit("h"), (F.col("o_custkey") * 8).cast("string")).alias("target"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("text "), (F.col("o_orderkey") % 2).cast("string"))).alias("text"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("reason"))
    known = asks.where("request % 11 = 0 AND text IS NOT NULL").select("target", "text")
    return A.correct_events(store, overlay, known, asks, "operator")


_CONFLICTS = """q AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'applied' ELSE 'proposed' END AS status, 'h' || o_custkey AS a_hash, o_orderkey % 7 AS a_at, 'h' || (o_custkey + 1 + o_orderkey % 3) AS b_hash, o_orderkey % 5 AS b_at FROM orders),
d AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN 'reject' WHEN 'A' THEN 'confirm' ELSE 'retract' END AS verdict, l_shipdate AS decided_at FROM lineitem WHERE l_linenumber <= 2)"""


@query("apply_resolutions", f"""WITH {_CONFLICTS}, f AS (SELECT id, verdict, decided_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY decided_at, verdict) AS rn FROM d) WHERE rn = 1),
m AS (SELECT q.id, decided_at, a_hash, b_hash, CASE verdict WHEN 'confirm' THEN 'superseded_older' WHEN 'retract' THEN 'superseded_newer' ELSE 'no_conflict' END AS resolution, a_at < b_at OR a_at = b_at AND a_hash < b_hash AS a_older FROM q JOIN f USING (id) WHERE status = 'proposed'),
l AS (SELECT *, CASE WHEN resolution = 'superseded_older' THEN CASE WHEN a_older THEN a_hash ELSE b_hash END WHEN resolution = 'superseded_newer' THEN CASE WHEN a_older THEN b_hash ELSE a_hash END END AS loser FROM m)
SELECT id, resolution, loser, loser IS NOT NULL AND CAST(loser[2:] AS BIGINT) % 5 <> 0 AND ROW_NUMBER() OVER (PARTITION BY loser ORDER BY decided_at, id) = 1 AS writes_invalidation, 'conflict:' || least(a_hash, b_hash) || ':' || greatest(a_hash, b_hash) AS produced_by FROM l""")
def apply_resolutions(spark, sf_dir):
    k = F.col("o_orderkey")
    h = lambda c: F.concat(F.lit("h"), c.cast("string"))
    q = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(F.col("o_orderstatus") == "F", "applied").otherwise("proposed").alias("status"), h(F.col("o_custkey")).alias("a_hash"), (k % 7).alias("a_at"), h(F.col("o_custkey") + 1 + k % 3).alias("b_hash"), (k % 5).alias("b_at"))
    verdict = F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_returnflag") == "A", "confirm").otherwise("retract")
    d = read(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("id"), verdict.alias("verdict"), F.col("l_shipdate").alias("decided_at"))
    gone = read(spark, sf_dir, "orders").select(F.explode(F.array(*[h(F.col("o_custkey") + n) for n in range(4)])).alias("target")).distinct().where("cast(substr(target, 2) AS long) % 5 = 0")
    return A.apply_resolutions(q, d, gone, "conflict")


_MERGED = "chain AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN p_partkey + 1 WHEN p_partkey % 4 = 2 THEN p_partkey + 1 ELSE p_partkey END AS one FROM part), canon AS (SELECT id, CASE WHEN one % 4 = 2 THEN one + 1 ELSE one END AS canonical FROM chain)"
_PROPOSED = """p AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'merge' WHEN '2-HIGH' THEN 'merge_review' ELSE 'retype' END AS kind, o_custkey AS entity, 'k' || (o_orderkey % 3) AS to_kind, o_custkey + o_orderkey % 2 AS into_ FROM orders WHERE o_orderstatus = 'O')"""


def _canonical(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return resolve(p, p.where("id % 4 IN (1, 2)").select("id", (F.col("id") + 1).alias("into"))).select("id", "canonical")


def _proposed(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), F.col("o_orderkey")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "merge").when(F.col("o_orderpriority") == "2-HIGH", "merge_review").otherwise("retype")
    return o.select(k.alias("id"), kind.alias("kind"), F.col("o_custkey").alias("entity"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("to_kind"), (F.col("o_custkey") + k % 2).alias("into"))


@query("apply_corrections", f"""WITH {_MERGED}, {_PROPOSED}, m AS (SELECT p.*, COALESCE(c.canonical, CASE WHEN kind = 'merge_review' THEN into_ ELSE entity END) AS target FROM p LEFT JOIN canon c ON c.id = CASE WHEN kind = 'merge_review' THEN into_ ELSE entity END),
n AS (SELECT m.*, CASE WHEN p_partkey IS NULL THEN NULL ELSE 'k' || (p_size % 3) END AS now FROM m LEFT JOIN part ON p_partkey = target AND p_partkey % 10 <> 3),
a AS (SELECT *, CASE WHEN kind <> 'merge' THEN CASE WHEN now IS NULL THEN 'not_found' WHEN now = to_kind THEN 'no_change' ELSE 'assign' END WHEN entity = into_ THEN 'no_change' ELSE 'merge' END AS action FROM n)
SELECT id, action, CASE WHEN action = 'merge' THEN entity ELSE target END AS target, CASE WHEN action = 'assign' THEN to_kind END AS kind_slug, CASE WHEN action = 'merge' THEN into_ END AS into_id FROM a""")
def apply_corrections(spark, sf_dir):
    kinds = read(spark, sf_dir, "part").where("p_partkey % 10 != 3").select(F.col("p_partkey").alias("id"), F.concat(F.lit("k"), (F.col("p_size") % 3).cast("string")).alias("kind"))
    return A.apply_corrections(_proposed(spark, sf_dir), _canonical(spark, sf_dir), kinds).withColumnRenamed("into", "into_id")


@query("retract_targets", f"""WITH {_PROPOSED}, t AS (SELECT id, CASE WHEN kind = 'merge_review' THEN into_ ELSE entity END AS target FROM p)
SELECT id, target, target % 6 <> 0 AND ROW_NUMBER() OVER (PARTITION BY target ORDER BY id) = 1 AS writes FROM t""")
def retract_targets(spark, sf_dir):
    p = _proposed(spark, sf_dir)
    return A.retractions(p, p.select(F.explode(F.array("entity", "into")).alias("target")).where("target % 6 = 0"))


@query("ask_once", f"""WITH {_MERGED}, n AS (SELECT p_partkey AS id, p_name AS from_name, p_brand AS from_kind, p_partkey + 1 AS into_ FROM part), a AS (SELECT lower(from_name) AS name, from_kind, into_ + 1 AS into_ FROM n WHERE id % 3 = 0),
rn AS (SELECT n.*, COALESCE(canonical, into_) AS c FROM n LEFT JOIN canon ON canon.id = into_), ra AS (SELECT a.*, COALESCE(canonical, into_) AS c FROM a LEFT JOIN canon ON canon.id = into_)
SELECT rn.id, from_name FROM rn WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.name = lower(rn.from_name) AND ra.from_kind = rn.from_kind AND ra.c = rn.c)""")
def ask_once(spark, sf_dir):
    new = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("from_name"), F.col("p_brand").alias("from_kind"), (F.col("p_partkey") + 1).alias("into"))
    asked = new.where("id % 3 = 0").select(F.upper("from_name").alias("from_name"), "from_kind", (F.col("into") + 1).alias("into"))
    return A.same_question(asked, new, _canonical(spark, sf_dir)).select("id", "from_name")


_CURRENT = "cur AS (SELECT * FROM store WHERE kind NOT IN ('consolidation', 'entity_article', 'invalidate', 'living_synthesis') AND content_hash NOT IN (SELECT target FROM overlay))"


@query("eligible_sources", f"WITH {_STORE}, {_CURRENT} SELECT content_hash, kind FROM cur ORDER BY created_at DESC, id DESC LIMIT 400")
def eligible_sources(spark, sf_dir):
    return S.eligible(*_store(spark, sf_dir)).select("content_hash", "kind")


_PRIOR = "pri AS (SELECT DISTINCT l_orderkey AS prior, 'h' || l_partkey AS member FROM lineitem)"


def _prior(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prior"), F.concat(F.lit("h"), F.col("l_partkey").cast("string")).alias("member")).distinct()


@query("synthesis_source_counts", f"WITH {_STORE}, {_CURRENT}, {_PRIOR} SELECT prior, COUNT(content_hash) AS n FROM pri LEFT JOIN cur ON content_hash = member GROUP BY prior")
def synthesis_source_counts(spark, sf_dir):
    return S.source_counts(_prior(spark, sf_dir), S.current(*_store(spark, sf_dir)))


@query("stale_syntheses", f"""WITH {_STORE}, {_CURRENT}, {_PRIOR}, e AS (SELECT content_hash FROM cur ORDER BY created_at DESC, id DESC LIMIT 400), o AS (SELECT * FROM pri WHERE prior % 3 <> 0),
s AS (SELECT prior, COUNT(c.content_hash) AS n, COUNT(e.content_hash) AS inside, COUNT(*) AS n_all FROM o LEFT JOIN cur c ON c.content_hash = member LEFT JOIN e ON e.content_hash = member GROUP BY prior)
SELECT prior, n FROM s WHERE n < 3 OR inside = n_all""")
def stale_syntheses(spark, sf_dir):
    priors = _prior(spark, sf_dir)
    return S.stale(priors, priors.where("prior % 3 = 0").select("prior").distinct(), *_store(spark, sf_dir))


@query("superseded_articles", f"""WITH {_STORE}, live AS (SELECT id % 50 AS entity_key, content_hash, created_at, id FROM store WHERE kind <> 'invalidate' AND content_hash NOT IN (SELECT target FROM overlay)),
k AS (SELECT entity_key, arg_max(content_hash, id) AS keep_hash FROM live GROUP BY 1) SELECT live.entity_key, content_hash FROM live JOIN k USING (entity_key) WHERE content_hash <> keep_hash""")
def superseded_articles(spark, sf_dir):
    store, overlay = _store(spark, sf_dir)
    live = store.where("kind != 'invalidate'").join(overlay.select(F.col("target").alias("content_hash")), "content_hash", "left_anti").withColumn("entity_key", F.col("id") % 50)
    kept = live.groupBy("entity_key").agg(F.max_by("content_hash", "id").alias("keep_hash"))
    return S.superseded(live.select("entity_key", "content_hash"), kept, "entity_key")


@query("articles_due", """WITH m AS (SELECT l_partkey AS entity, MAX(l_shipdate) AS latest FROM lineitem GROUP BY 1), a AS (SELECT o_custkey AS entity, MAX(o_orderdate) AS written FROM orders GROUP BY 1)
SELECT m.entity, latest FROM m LEFT JOIN a USING (entity) WHERE written IS NULL OR latest > written""")
def articles_due(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_shipdate").alias("at"))
    return S.new_mentions(m, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("created_at")))


@query("cited_facts", """WITH l AS (SELECT l_orderkey AS id, list('f' || (l_partkey % 5) ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) % 6, 'h' || l_suppkey) AS facts, list('h' || l_suppkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) % 6, 'h' || l_suppkey) AS hashes, list(CAST(l_quantity AS INTEGER) % 6 - 1 ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) % 6, 'h' || l_suppkey) AS src FROM lineitem GROUP BY 1),
f AS (SELECT id, hashes, UNNEST(facts[1:6]) AS fact, UNNEST(src[1:6]) AS s, UNNEST(range(1, least(len(facts), 6) + 1)) AS nth FROM l)
SELECT id, nth, fact, CASE WHEN s >= 1 AND s <= len(hashes) THEN hashes[s] END AS citation FROM f""")
def cited_facts(spark, sf_dir):
    of = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string")).alias("fact"), F.array(F.col("l_quantity").cast("int") % 6 - 1).alias("sources"), F.concat(F.lit("h"), F.col("l_suppkey").cast("string")).alias("h"))
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(of)).alias("x"))
    out = rows.select("id", F.posexplode(S.cited_facts(F.col("x"), F.col("x.h"))).alias("nth", "f"))
    return out.select("id", (F.col("nth") + 1).cast("long").alias("nth"), "f.fact", F.get("f.citations", F.lit(0)).alias("citation"))


@query("session_nudge", f"""WITH c AS (SELECT o_custkey AS session, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS conflicts, COUNT(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS waiting,
  MAX(CASE WHEN o_orderstatus = 'F' THEN epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate) END) / 86400.0 AS days, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS told FROM orders GROUP BY 1)
SELECT session, conflicts > 0 OR waiting - told >= 5 AND (days IS NULL OR days >= 400) AS show FROM c""")
def session_nudge(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    days = (epoch_of(AS_OF) - epoch("o_orderdate")) / F.lit(86400.0)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    c = o.groupBy(F.col("o_custkey").alias("session")).agg(F.count_if(urgent & (F.col("o_orderstatus") == "O")).alias("conflicts"), F.count_if(~urgent).alias("waiting"), F.max(F.when(F.col("o_orderstatus") == "F", days)).alias("days"), F.count_if(F.col("o_orderstatus") == "P").alias("told"))
    return c.select("session", A.nudge(F.col("conflicts"), F.col("waiting"), F.col("told"), F.col("days"), 5, 400).alias("show"))


_QUEUE = "q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'proposed' WHEN 'P' THEN 'expired' ELSE 'applied' END AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'conflict' WHEN '2-HIGH' THEN 'retype' WHEN '3-MEDIUM' THEN 'merge' WHEN '4-NOT SPECIFIED' THEN 'ontology_add' ELSE 'edge_review' END AS kind, round(o_totalprice % 1000 / 1000, 3) AS confidence, o_orderdate AS detected_at FROM orders)"


def _queue(spark, sf_dir):
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "conflict").when(p == "2-HIGH", "retype").when(p == "3-MEDIUM", "merge").when(p == "4-NOT SPECIFIED", "ontology_add").otherwise("edge_review")
    status = F.when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "P", "expired").otherwise("applied")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), kind.alias("kind"), F.round(F.col("o_totalprice") % 1000 / 1000, 3).alias("confidence"), F.col("o_orderdate").alias("detected_at"))


@query("session_pending", f"""WITH {_QUEUE}, r AS (SELECT id, kind, confidence, CASE kind WHEN 'conflict' THEN 0 WHEN 'ontology_add' THEN 2 WHEN 'edge_review' THEN 3 ELSE 1 END AS queue, detected_at FROM q WHERE status = 'proposed')
SELECT queue, kind, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY queue ORDER BY confidence DESC, detected_at, id) AS rn FROM r) WHERE rn <= 5""")
def session_pending(spark, sf_dir):
    """The five surest of each queue in the order that a session sees: conflicts, entity corrections, ontology, edge reviews."""
    q = _queue(spark, sf_dir).where("status = 'proposed'")
    parts = [q.where(w) for w in ("kind = 'conflict'", "kind IN ('retype', 'merge')", "kind = 'ontology_add'", "kind = 'edge_review'")]
    top = [p.orderBy(F.col("confidence").desc(), "detected_at", "id").limit(5) for p in parts]
    return C.pending_union(top, 20).select(F.col("queue").cast("long").alias("queue"), "kind", "id")


@query("pending_counts", f"WITH {_QUEUE} SELECT kind, COUNT(*) AS n FROM q WHERE status = 'proposed' GROUP BY kind")
def pending_counts(spark, sf_dir):
    return _queue(spark, sf_dir).where("status = 'proposed'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("decide_proposals", f"""WITH {_QUEUE}, d AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN 'reject' WHEN 'A' THEN 'confirm' ELSE 'shrug' END AS verdict, l_shipdate AS decided_at FROM lineitem WHERE l_linenumber = 1),
f AS (SELECT id, verdict FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY decided_at, verdict) AS rn FROM d) WHERE rn = 1)
SELECT q.id, CASE WHEN verdict IS NULL THEN 'none' WHEN status = 'applied' THEN 'already_decided' WHEN verdict = 'shrug' THEN 'invalid_verdict' ELSE 'decided' END AS outcome,
  CASE WHEN status <> 'applied' AND verdict = 'confirm' THEN 'applied' WHEN status <> 'applied' AND verdict = 'reject' THEN 'rejected' ELSE status END AS new_status FROM q LEFT JOIN f USING (id)""")
def decide_proposals(spark, sf_dir):
    v = F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_returnflag") == "A", "confirm").otherwise("shrug")
    d = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), v.alias("verdict"), F.col("l_shipdate").alias("decided_at"))
    return C.decide(_queue(spark, sf_dir), d).select("id", "outcome", "new_status")


@query("expire_proposals", f"WITH {_QUEUE} SELECT id, CASE WHEN status = 'proposed' AND epoch(TIMESTAMP '{AS_OF}') - epoch(detected_at) > 86400 * 900 THEN 'expired' ELSE status END AS status FROM q")
def expire_proposals(spark, sf_dir):
    return C.expire(_queue(spark, sf_dir), epoch_of(AS_OF) - epoch("detected_at"), 86400 * 900).select("id", "status")


@query("propose_once", f"WITH {_QUEUE} SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 30 AND l_orderkey NOT IN (SELECT id FROM q WHERE status = 'proposed')")
def propose_once(spark, sf_dir):
    new = read(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("id"))
    return C.propose_once(_queue(spark, sf_dir).where("status = 'proposed'"), new, ["id"])


@query("versioned_reviews", """WITH e AS (SELECT l_orderkey AS point, l_returnflag AS verdict, l_linenumber, l_partkey FROM lineitem), old AS (SELECT point, arg_max(verdict, l_linenumber * 1000000 + l_partkey) AS v, COUNT(*) AS version FROM e WHERE l_linenumber <= 3 GROUP BY 1),
n AS (SELECT point, arg_max(verdict, l_linenumber * 1000000 + l_partkey) AS verdict FROM e WHERE l_linenumber > 3 GROUP BY 1) SELECT n.point, n.verdict, COALESCE(version, 0) + 1 AS version FROM n LEFT JOIN old USING (point) WHERE n.verdict IS DISTINCT FROM old.v""")
def versioned_reviews(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point"), F.col("l_returnflag").alias("verdict"), "l_linenumber", F.expr("l_linenumber * 1000000L + l_partkey").alias("at"), "_metadata.file_path", "_metadata.row_index")
    known = F.col("verdict").isNotNull() & F.col("at").isNotNull()
    last = F.min_by("verdict", F.when(known, F.struct(-F.col("at"), "file_path", "row_index"))).alias("verdict")  # of equals the first in the files
    old = e.where("l_linenumber <= 3").groupBy("point").agg(last, F.count(F.lit(1)).alias("version"))
    return C.versioned_reviews(old, e.where("l_linenumber > 3").groupBy("point").agg(last), "point").select("point", "verdict", "version")
