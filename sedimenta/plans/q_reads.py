"""Keyed reads, latest rows, tuner state, registry metrics and the texts that readers see."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import projections as P
from sedimenta.functions import text as T
from sedimenta.functions.timecol import epoch, epoch_of
from sedimenta.operators import corrections, maintenance, ontology, recall, tuning, writers
from sedimenta.operators.latest import latest_by, live
from sedimenta.plans.base import AS_OF, LOG_SQL, log, query, read


@query("read_events_by_id", "SELECT o_orderkey AS id, event_id IS NOT NULL AS found, event_type AS kind FROM orders LEFT JOIN events ON event_id = o_orderkey")
def read_events_by_id(spark, sf_dir):
    """A batch of point reads is one keyed join."""
    found = log(spark, sf_dir).select("id", F.lit(True).alias("found"), "kind")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(found, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"), "kind")


@query("read_events_by_hash", f"""WITH {LOG_SQL}, h AS (SELECT sha256(kind || '|' || origin || '|' || payload) AS hash, MIN(id) AS id FROM log GROUP BY 1), w AS (SELECT DISTINCT sha256(kind || '|' || origin || '|' || payload) AS hash FROM log WHERE id % 3 = 0 UNION SELECT sha256('none' || n_nationkey) FROM nation)
SELECT w.hash, h.id FROM w LEFT JOIN h USING (hash)""")
def read_events_by_hash(spark, sf_dir):
    rows = log(spark, sf_dir).select("id", F.sha2(F.concat_ws("|", "kind", F.col("origin").cast("string"), "payload"), 256).alias("hash"))
    none = read(spark, sf_dir, "nation").select(F.sha2(F.concat(F.lit("none"), F.col("n_nationkey").cast("string")), 256).alias("hash"))
    return rows.where("id % 3 = 0").select("hash").union(none).distinct().join(rows.groupBy("hash").agg(F.min("id").alias("id")), "hash", "left")


_LATEST = "SELECT {k}, {c} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {k} ORDER BY {o}) AS rn FROM log) WHERE rn = 1"


@query("latest_interpretation", f"WITH {LOG_SQL} " + _LATEST.format(k="origin", c="kind, value", o="at_ DESC, id DESC"))
def latest_interpretation(spark, sf_dir):
    return latest_by(log(spark, sf_dir), ["origin"], ["at", "id"], ["kind", "value"])


@query("latest_invalidation", f"WITH {LOG_SQL} SELECT k AS target, arg_max(id, id) AS by_event FROM log WHERE kind = 'error' GROUP BY k")
def latest_invalidation(spark, sf_dir):
    return latest_by(log(spark, sf_dir).where("kind = 'error'").select(F.col("k").alias("target"), F.col("id").alias("by_event")), ["target"], ["by_event"])


@query("current_mode", f"WITH {LOG_SQL} SELECT kind AS mode, id FROM log WHERE kind IN ('click', 'view') ORDER BY at_ DESC, id DESC LIMIT 1")
def current_mode(spark, sf_dir):
    rows = log(spark, sf_dir).where("kind IN ('click', 'view')").agg(F.max_by(F.struct(F.col("kind").alias("mode"), "id"), F.struct("at", "id")).alias("x"))
    return rows.select("x.mode", "x.id")


@query("live_rows", f"WITH {LOG_SQL} SELECT id FROM log WHERE kind <> 'error' AND id NOT IN (SELECT k FROM log WHERE kind = 'error' AND k IS NOT NULL)")
def live_rows(spark, sf_dir):
    rows = log(spark, sf_dir)
    return live(rows.where("kind != 'error'").select("id"), rows.where("kind = 'error'").select(F.col("k").alias("id")), "id")


@query("unscored_batch", f"WITH {LOG_SQL} SELECT id FROM log WHERE id > 100 AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') ORDER BY id LIMIT 500")
def unscored_batch(spark, sf_dir):
    """The next batch of a worker: the limit is its size."""
    events = log(spark, sf_dir).select("id", F.col("id").alias("content_hash"))
    done = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_hash"), F.when(F.col("o_orderstatus") == "O", "p").otherwise("q").alias("produced_by"))
    return maintenance.unscored(events, done, "p", 100, 500).select("id")


@query("pruned_telemetry", f"WITH {LOG_SQL} SELECT id FROM log WHERE at_ >= TIMESTAMP '2024-01-15 00:00:00'")
def pruned_telemetry(spark, sf_dir):
    return maintenance.prune_older(log(spark, sf_dir), F.col("at"), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("id")


_LEDGER = f"{LOG_SQL}, ledger AS (SELECT id, epoch(date_trunc('second', at_)) AS recorded_at, 'w' || (origin % 3) AS worker, 't' || (id % 7) AS tunable, CASE kind WHEN 'click' THEN 'promote' WHEN 'error' THEN 'rollback' ELSE 'observation' END AS kind, value AS new_value FROM log)"


def _ledger(spark, sf_dir):
    kind = F.when(F.col("kind") == "click", "promote").when(F.col("kind") == "error", "rollback").otherwise("observation")
    return log(spark, sf_dir).select("id", epoch("at").alias("recorded_at"), F.concat(F.lit("w"), (F.col("origin") % 3).cast("string")).alias("worker"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("tunable"), kind.alias("kind"), F.col("value").alias("new_value"))


@query("tuner_current_values", f"WITH {_LEDGER} SELECT worker, tunable, new_value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY worker, tunable ORDER BY recorded_at DESC, id DESC) AS rn FROM ledger WHERE kind <> 'observation') WHERE rn = 1")
def tuner_current_values(spark, sf_dir):
    return tuning.current_values(_ledger(spark, sf_dir))


@query("tuner_history", f"WITH {_LEDGER} SELECT worker, tunable, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY worker, tunable ORDER BY recorded_at DESC, id DESC) AS rn FROM ledger) WHERE rn <= 3")
def tuner_history(spark, sf_dir):
    from sedimenta.operators.latest import latest_n

    return latest_n(_ledger(spark, sf_dir), ["worker", "tunable"], [F.col("recorded_at").desc(), F.col("id").desc()], 3).select("worker", "tunable", "id")


@query("active_promotes", f"""WITH {_LEDGER}, n AS (SELECT *, LEAD(id) OVER (PARTITION BY worker, tunable ORDER BY recorded_at, id) AS nxt FROM ledger WHERE kind <> 'observation')
SELECT worker, tunable, id FROM n WHERE kind = 'promote' AND nxt IS NULL AND recorded_at > epoch(TIMESTAMP '{AS_OF}') - 40 * 86400""")
def active_promotes(spark, sf_dir):
    return tuning.active_promotes(_ledger(spark, sf_dir), epoch_of(AS_OF), 40).select("worker", "tunable", "id")


@query("tuner_halted", f"WITH {_LEDGER} SELECT worker, COUNT(*) FILTER (WHERE kind = 'rollback' AND recorded_at >= epoch(TIMESTAMP '{AS_OF}') - 20 * 86400) > 3 AS halted FROM ledger GROUP BY worker")
def tuner_halted(spark, sf_dir):
    return _ledger(spark, sf_dir).groupBy("worker").agg(tuning.halted(_ledger(spark, sf_dir), epoch_of(AS_OF), 3, 20).alias("halted"))


@query("last_rollback", f"WITH {_LEDGER} SELECT worker, tunable, MAX(recorded_at) AS at FROM ledger WHERE kind = 'rollback' GROUP BY 1, 2")
def last_rollback(spark, sf_dir):
    return _ledger(spark, sf_dir).where("kind = 'rollback'").groupBy("worker", "tunable").agg(F.max("recorded_at").alias("at"))


@query("next_disambiguator", "SELECT lower(trim(p_name)) AS name, COUNT(*) FILTER (WHERE p_size > 20) AS next FROM part GROUP BY 1")
def next_disambiguator(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("name")).agg(F.count_if(F.col("p_size") > 20).alias("next"))


@query("wildcard_metric", "SELECT COUNT(*) AS exact_mentions, COUNT(*) FILTER (WHERE p_size % 5 = 0) AS other_kind_exact_mentions FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N'")
def wildcard_metric(spark, sf_dir):
    kinds = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.when(F.col("p_size") % 5 == 0, "other").otherwise("person").alias("kind"))
    m = read(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_partkey").alias("entity")).join(kinds, "entity")
    return m.agg(F.count(F.lit(1)).alias("exact_mentions"), F.count_if(F.col("kind") == "other").alias("other_kind_exact_mentions"))


@query("sample_entities_by_kind", "SELECT p_brand AS kind, p_partkey AS id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 8")
def sample_entities_by_kind(spark, sf_dir):
    """The eight best attested of each kind, as drafts are shown them."""
    from sedimenta.operators.latest import latest_n

    return latest_n(read(spark, sf_dir, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 8).select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("id"))


@query("failed_aggregates", f"WITH {LOG_SQL} SELECT kind, COUNT(*) AS failed, COUNT(DISTINCT origin) AS origins, MAX(id) AS last_id FROM log WHERE k % 10 = 3 GROUP BY kind")
def failed_aggregates(spark, sf_dir):
    return log(spark, sf_dir).where("k % 10 = 3").groupBy("kind").agg(F.count(F.lit(1)).alias("failed"), F.countDistinct("origin").alias("origins"), F.max("id").alias("last_id"))


@query("ontology_revert", """WITH a AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'add' WHEN n_nationkey % 3 = 1 THEN 'deprecate' ELSE 'split' END AS action, lower(n_name) AS slug FROM nation)
SELECT id, CASE WHEN action = 'add' THEN 'deprecate' ELSE 'restore' END AS action, slug AS from_slug FROM a""")
def ontology_revert(spark, sf_dir):
    k = F.col("n_nationkey")
    a = read(spark, sf_dir, "nation").select(k.alias("id"), F.when(k % 3 == 0, "add").when(k % 3 == 1, "deprecate").otherwise("split").alias("action"), F.lower("n_name").alias("subject_slug"), F.array(k.cast("string")).alias("members"))
    none = spark.createDataFrame([], "entity_id string, kind_slug string, assigned_at long")
    base = a.select(F.col("id").cast("string").alias("entity_id"), F.lit("other").alias("kind"))
    return ontology.revert_decisions(a, none, base, F.lit(1).cast("long"))[0].select("id", "action", "from_slug")


_JSON = "'{\"best_guess_kind\": \"' || CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END || '\", ' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '\"summary\": \"' || p_name || '\", ' END || '\"n\": ' || p_size || '}'"


def _extractions(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_JSON).alias("extraction"))


@query("validate_extractions", """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'not an object' WHEN p_size % 3 = 0 THEN 'summary is missing' END AS problem FROM part""")
def validate_extractions(spark, sf_dir):
    e = _extractions(spark, sf_dir)
    raw = F.when(F.col("id") % 7 == 0, F.lit("{broken")).otherwise(F.col("extraction"))
    return e.select("id", P.validate_extraction(raw).alias("problem"))


@query("surface_keys", "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS kind, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS summary FROM part")
def surface_keys(spark, sf_dir):
    m = P.interpretation_summary(F.col("extraction"))
    return _extractions(spark, sf_dir).select("id", F.try_element_at(m, F.lit("best_guess_kind")).alias("kind"), F.try_element_at(m, F.lit("summary")).alias("summary"))


@query("shaped_hits", "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS kind, CASE WHEN p_size % 3 = 0 THEN NULL ELSE left(p_name, 280) END AS summary FROM part")
def shaped_hits(spark, sf_dir):
    none = F.array().cast("array<string>")
    j = P.shape(F.col("extraction"), none, none, F.lit(None).cast("double"), F.lit(None).cast("string"))
    return _extractions(spark, sf_dir).select("id", F.get_json_object(j, "$.best_guess_kind").alias("kind"), F.get_json_object(j, "$.summary").alias("summary"))


@query("sanitized_actors", r"SELECT c_custkey AS id, left(trim(c_name || ' ' || c_mktsegment), 120) AS actor FROM customer")
def sanitized_actors(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), P.sanitize_actor(F.concat(F.lit("\t"), F.col("c_name"), F.lit("\n"), F.col("c_mktsegment"), F.lit("\x07 "))).alias("actor"))


@query("wrapped_texts", "SELECT item_id AS id, md5('<untrusted>' || chr(10) || replace(text || '</untrusted>x', '</untrusted>', '&lt;/untrusted&gt;') || chr(10) || '</untrusted>') AS md5 FROM benchmark")
def wrapped_texts(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.md5(P.wrap_untrusted(F.concat("text", F.lit("</untrusted>x"))).cast("binary")).alias("md5"))


@query("capped_fields", "SELECT doc_id AS id, md5(left(text, 100)) AS short, CASE WHEN length(text) > 100 THEN md5(text) END AS whole FROM documents")
def capped_fields(spark, sf_dir):
    c = P.capped(F.col("text"), 100)
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(c["short"].cast("binary")).alias("short"), F.md5(c["full"].cast("binary")).alias("whole"))


@query("flattened_parts", """SELECT conv_id AS id, md5(string_agg(CASE WHEN turn % 2 = 0 THEN role || ': ' || text ELSE text END, chr(10) ORDER BY turn) FILTER (WHERE text <> '')) AS md5 FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id""")
def flattened_parts(spark, sf_dir):
    part = F.struct("turn", F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("").alias("label"), "text")
    g = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct().groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return g.select(F.col("conv_id").alias("id"), F.md5(F.nullif(P.flatten_parts(F.col("parts")), F.lit("")).cast("binary")).alias("md5"))


@query("enriched_texts", "SELECT item_id AS id, md5(CASE WHEN trim(text) = '' THEN '' ELSE trim(text) || chr(10) END || 'summary ' || item_id || chr(10) || 'fact') AS md5 FROM benchmark WHERE text IS NOT NULL")
def enriched_texts(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    text = P.enriched_text(F.col("text"), F.lit(" "), F.concat(F.lit("summary "), F.col("item_id").cast("string")), F.array(F.lit("fact"), F.lit("  ")))
    return b.select(F.col("item_id").alias("id"), F.md5(text.cast("binary")).alias("md5"))


@query("rrule_frequency", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'MONTHLY' ELSE 'YEARLY' END AS freq FROM orders")
def rrule_frequency(spark, sf_dir):
    k = F.col("o_orderkey")
    rule = F.when(k % 3 == 0, "INTERVAL=2").when(k % 3 == 1, "interval=2;freq=monthly").otherwise("FREQ=YEARLY;COUNT=3")
    return read(spark, sf_dir, "orders").select(k.alias("id"), P.rrule_freq(rule).alias("freq"))


@query("recent_feedback_rate", f"""WITH {LOG_SQL} SELECT kind, COUNT(*) FILTER (WHERE value > 100) * 1.0 / COUNT(*) AS rate FROM log WHERE at_ >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY kind""")
def recent_feedback_rate(spark, sf_dir):
    rows = log(spark, sf_dir).where(epoch("at") >= epoch_of("2024-01-10 00:00:00"))
    return rows.groupBy("kind").agg((F.count_if(F.col("value") > 100) / F.count(F.lit(1))).alias("rate"))


_LIVE = "SELECT DISTINCT origin AS id, origin // 2 AS into_ FROM log WHERE origin >= 1 AND origin % 5 <> 0"


@query("recent_canonical_context", f"""WITH RECURSIVE {LOG_SQL}, last AS (SELECT id, origin FROM log WHERE kind IN ('click', 'view') ORDER BY at_ DESC, id DESC LIMIT 50), live AS ({_LIVE}),
walk AS (SELECT DISTINCT origin AS id, origin AS cur, 0 AS depth FROM last UNION ALL SELECT w.id, l.into_, w.depth + 1 FROM walk w JOIN live l ON l.id = w.cur WHERE w.depth < 16)
SELECT DISTINCT canonical FROM (SELECT id, arg_max(cur, depth) AS canonical FROM walk GROUP BY id)""")
def recent_canonical_context(spark, sf_dir):
    """The window of 50 events is the feature."""
    rows = log(spark, sf_dir)
    merges = rows.where("origin >= 1 AND origin % 5 != 0").select(F.col("origin").alias("id"), F.expr("origin div 2").alias("into")).distinct()
    return recall.recent_context(rows.where("kind IN ('click', 'view')").select("id", "at"), rows.select("id", F.col("origin").alias("entity")), merges, 50)


@query("conflicted_sources", """SELECT o_orderkey AS id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40 AND l_returnflag IN ('A', 'R')) AS conflicted FROM orders""")
def conflicted_sources(spark, sf_dir):
    verdict = F.when(F.col("l_returnflag") == "A", " Conflicts").when(F.col("l_returnflag") == "R", "reverts").otherwise("unsure")
    flags = read(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id"), verdict.alias("verdict"))
    return recall.conflicted(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), flags)


@query("newer_side", "SELECT a.o_orderkey AS a, b.o_orderkey AS b, CASE WHEN a.o_orderdate > b.o_orderdate THEN a.o_orderkey ELSE b.o_orderkey END AS newer FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def newer_side(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    one = o.select(F.col("o_orderkey").alias("a"), F.col("o_orderdate").alias("a_at"))
    two = o.select(F.col("o_orderkey").alias("b"), F.col("o_orderdate").alias("b_at"))
    return one.join(two, F.col("b") == F.col("a") + 1).select("a", "b", T.newer(F.col("a"), F.col("a_at"), F.col("b"), F.col("b_at")).alias("newer"))


_KIND = "CASE WHEN p_size % 4 = 0 THEN 'other' WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END"


@query("kind_agreement", f"WITH p AS (SELECT p_partkey AS id, {_KIND} AS kind FROM part) SELECT a.id AS a, b.id AS b, COALESCE(a.kind = b.kind OR a.kind = 'other' OR b.kind = 'other', FALSE) AS agree FROM p a JOIN p b ON b.id = a.id + 1")
def kind_agreement(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.expr(_KIND).alias("kind_a"))
    q = p.select(F.col("a").alias("b"), F.col("kind_a").alias("kind_b"))
    return p.join(q, F.col("b") == F.col("a") + 1).select("a", "b", T.kinds_agree(F.col("kind_a"), F.col("kind_b")).alias("agree"))


@query("temporal_rows", f"WITH {LOG_SQL}, t AS (SELECT id // 2 AS event_hash, 'w' || (k % 3) AS computed_by, id, kind FROM log), o AS (SELECT event_hash, computed_by FROM t WHERE id % 3 = 0) SELECT event_hash, computed_by, MIN(kind) AS temporal_class FROM t WHERE id % 3 = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.event_hash = t.event_hash AND o.computed_by = t.computed_by) GROUP BY 1, 2")
def temporal_rows(spark, sf_dir):
    rows = log(spark, sf_dir).select("id", F.expr("id div 2").alias("event_hash"), F.concat(F.lit("w"), (F.col("k") % 3).cast("string")).alias("computed_by"), F.col("kind").alias("temporal_class"))
    pick = lambda m: rows.where(f"id % 3 = {m}").drop("id")
    return writers.temporal_rows(pick(0), pick(1).where("computed_by IS NOT NULL"))


@query("asked_before", """WITH RECURSIVE live AS (SELECT p_partkey AS id, p_partkey // 2 AS into_ FROM part WHERE p_size <> 13),
walk AS (SELECT p_partkey AS id, p_partkey AS cur, 0 AS depth FROM part UNION ALL SELECT w.id, l.into_, w.depth + 1 FROM walk w JOIN live l ON l.id = w.cur WHERE w.depth < 16),
q AS (SELECT p_partkey AS id, lower(p_brand) AS name, p_size AS kind, (SELECT arg_max(cur, depth) FROM walk WHERE walk.id = p_partkey) AS ending FROM part)
SELECT id, EXISTS (SELECT 1 FROM q o WHERE o.id % 2 = 0 AND o.name = q.name AND o.kind = q.kind AND o.ending = q.ending) AS asked FROM q WHERE id % 2 = 1""")
def asked_before(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    merges = p.where("p_size != 13").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("into"))
    asked = p.select(F.col("p_partkey").alias("into"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("from_name"), F.col("p_size").alias("from_kind"))
    return corrections.asked_before(asked.where("into % 2 = 0"), asked.where("into % 2 = 1"), merges).select(F.col("into").alias("id"), "asked")


@query("binary_payloads", "SELECT page_id AS id, 'sha256:' || sha256(COALESCE(html, '')) AS blob_hash, octet_length(encode(COALESCE(html, ''))) AS size_bytes, 'text/html' AS mime, url AS filename_hint FROM pages")
def binary_payloads(spark, sf_dir):
    content = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    made = P.binary_payload(content, F.lit("text/html"), F.col("url"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), made.alias("p")).select("id", "p.blob_hash", "p.size_bytes", "p.mime", "p.filename_hint")
