"""Scoring models, scalar functions, projections, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import ids, text
from sedimenta.functions.scoring import salience
from sedimenta.functions.timecol import age_days, day, epoch, epoch_of
from sedimenta.operators.ingest import build_text_payload
from sedimenta.plans.base import AS_OF, LOG_SQL, edges, log, query, read


@query("salience_score", f"""WITH {LOG_SQL}, e AS (SELECT l_orderkey AS id, COUNT(DISTINCT l_partkey) AS entities, SUM(CAST(l_quantity AS INTEGER)) % 13 AS links FROM lineitem GROUP BY 1)
SELECT log.id, round(GREATEST(0, LEAST(1, 0.25 * LEAST(1, COALESCE(entities, 0) / 5) + 0.2 * LEAST(1, COALESCE(links, 0) / 10) + CASE WHEN kind = 'error' THEN 0.1 ELSE 0 END + CASE WHEN kind = 'signup' THEN 0.15 ELSE 0 END
+ CASE WHEN k > 90 THEN 0.1 ELSE 0 END + 0.2 * GREATEST(0, LEAST(1, 1 - (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(at_))) / 86400.0 / 30)))), 6) AS salience FROM log LEFT JOIN e USING (id)""")
def salience_score(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.countDistinct("l_partkey").alias("entities"), (F.sum(F.col("l_quantity").cast("int")) % 13).alias("links"))
    rows = log(spark, sf_dir).join(e, "id", "left")
    hint = F.when(F.col("kind") == "signup", "decision").otherwise("note")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    s = salience(zero("entities"), zero("links"), F.col("kind") == "error", hint, F.coalesce(F.col("k") > 90, F.lit(False)), age_days("at", AS_OF))
    return rows.select("id", F.round(s, 6).alias("salience"))


_WORDS3 = r"list_aggregate(list_slice(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), 1, 3), 'string_agg', ' ')"


@query("predicate_gates", rf"""WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'is similar to' WHEN 1 THEN 'runs' WHEN 2 THEN 'was mentioned' WHEN 3 THEN 'about' WHEN 4 THEN 'is design partner for the new' ELSE COALESCE({_WORDS3}, '') END AS predicate FROM documents),
n AS (SELECT *, regexp_replace(trim(regexp_replace(lower(predicate), '\s+', ' ', 'g')), '^(?:(?:{"|".join(text.AUXILIARIES)}) )+', '') AS norm FROM p)
SELECT doc_id, len(list_filter(string_split_regex(trim(predicate), '\s+'), lambda x: x <> '')) BETWEEN 1 AND 4 AS crisp, NOT regexp_matches(norm, '^(?:{"|".join(text.NON_DURABLE)})(?: |$)') AS durable FROM n""")
def predicate_gates(spark, sf_dir):
    words = F.array_join(F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""), 1, 3), " ")
    m = F.col("doc_id") % 6
    p = F.when(m == 0, "is similar to").when(m == 1, "runs").when(m == 2, "was mentioned").when(m == 3, "about").when(m == 4, "is design partner for the new").otherwise(words)
    d = read(spark, sf_dir, "documents").select("doc_id", p.alias("p"))
    return d.select("doc_id", text.predicate_is_crisp(F.col("p")).alias("crisp"), text.predicate_is_durable(F.col("p")).alias("durable"))


@query("searchable_text", "SELECT doc_id, sha256(concat_ws(chr(10), nullif(text, ''), nullif(lang, ''), nullif(source, ''))) AS digest FROM documents")
def searchable_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text.searchable(F.col("text"), F.col("lang"), F.col("source")), 256).alias("digest"))


@query("content_hash", """SELECT event_id, 'sha256:' || sha256('{"kind":"' || event_type || '","origin":"' || user_id || '","parent_hashes":null,"payload":"' || replace(props, '"', '\\"') || '"}') AS hash FROM events""".replace("'\\\\\"'", "'\\\"'"))
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", ids.content_hash(F.col("event_type"), F.col("user_id").cast("string"), F.col("props")).alias("hash"))


@query("entity_ids", "SELECT p_partkey, 'entity:' || sha256(lower(trim(p_name)) || '|' || p_type) AS v1, 'entity:v2:' || sha256(lower(trim(p_name)) || '|' || (ROW_NUMBER() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) - 1)) AS v2 FROM part")
def entity_ids(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.lower(F.trim("p_name"))).orderBy("p_partkey")) - 1
    return read(spark, sf_dir, "part").withColumn("n", n).select("p_partkey", ids.entity_id(F.col("p_name"), F.col("p_type")).alias("v1"), ids.entity_id_v2(F.col("p_name"), F.col("n")).alias("v2"))


@query("slugify", r"""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type || ' #' || p_brand)), '[\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(slug, '[a-z][a-z0-9_]{1,30}') THEN slug END AS slug FROM s""")
def slugify_q(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.slugify(F.concat_ws(" #", "p_type", "p_brand")).alias("slug"))


@query("client_slugs", r"""WITH s AS (SELECT page_id, regexp_replace(left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 64), '[-._]+$', '') AS s FROM pages) SELECT page_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM s""")
def client_slugs(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.client_slug(F.col("url")).alias("slug"))


@query("modality_for_mime", """WITH m AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'Image/PNG; q=1' WHEN 'click' THEN 'application/pdf' WHEN 'signup' THEN 'audio/mpeg' ELSE 'text/html; charset=utf-8' END AS mime FROM events)
SELECT event_id, CASE WHEN trim(split_part(lower(mime), ';', 1)) = 'application/pdf' THEN 'pdf' WHEN lower(mime) LIKE 'image/%' THEN 'image' WHEN lower(mime) LIKE 'audio/%' THEN 'audio' ELSE 'other' END AS modality FROM m""")
def modality_for_mime(spark, sf_dir):
    k = F.col("event_type")
    mime = F.when(k == "view", "Image/PNG; q=1").when(k == "click", "application/pdf").when(k == "signup", "audio/mpeg").otherwise("text/html; charset=utf-8")
    return read(spark, sf_dir, "events").select("event_id", text.modality(mime).alias("modality"))


@query("truncate_marked", "SELECT doc_id, length(t) AS n, sha256(t) AS digest FROM (SELECT doc_id, CASE WHEN length(text) > 3000 THEN left(text, 2400) || chr(10) || chr(10) || '[TRUNCATED: ' || format('{:,}', length(text) - 2800) || ' chars elided from middle]' || chr(10) || chr(10) || right(text, 400) ELSE text END AS t FROM documents)")
def truncate_marked(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", text.truncate_marked(F.col("text"), 3000, 2400, 400).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("digest"))


@query("point_digest", r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def point_digest(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.point_digest(F.col("text")).alias("digest"))


@query("evidence_in_text", r"""WITH n AS (SELECT d.doc_id, b.item_id, trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')) AS e, trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')) AS t FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)
SELECT doc_id, length(e) >= 10 AND contains(t, e) AS found FROM n""")
def evidence_in_text(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("evidence"))
    d = read(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % 40)
    return d.join(b, "item_id").select("doc_id", text.evidence_in_text(F.col("evidence"), F.col("text")).alias("found"))


@query("payload_inline_or_spill", """SELECT doc_id, strlen(text) > 2000 AS spilled, CASE WHEN strlen(text) > 2000 THEN 'sha256:' || sha256(text) END AS blob FROM documents""")
def payload_inline_or_spill(spark, sf_dir):
    p = read(spark, sf_dir, "documents").select("doc_id", build_text_payload(F.col("text"), 2000).alias("p"))
    return p.select("doc_id", (F.get_json_object("p", "$.content_type") == "text-large").alias("spilled"), F.get_json_object("p", "$.blob_hash").alias("blob"))


@query("upcoming_recurring", f"""WITH o AS (SELECT o_orderkey AS id, floor(epoch(o_orderdate)) AS anchor, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 7 ELSE 14 END * 86400 AS step FROM orders),
n AS (SELECT id, anchor + step * (floor((epoch(TIMESTAMP '{AS_OF}') - anchor) / step) + 1) AS moment FROM o) SELECT id, CAST(moment AS BIGINT) AS moment FROM n WHERE moment <= epoch(TIMESTAMP '{AS_OF}') + 3 * 86400""")
def upcoming_recurring(spark, sf_dir):
    s = F.col("o_orderstatus")
    step = F.when(s == "O", 1).when(s == "F", 7).otherwise(14) * 86400
    now = epoch_of(AS_OF)
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), epoch("o_orderdate").alias("anchor"), step.alias("step"))
    return o.select("id", (F.col("anchor") + F.col("step") * (F.floor((now - F.col("anchor")) / F.col("step")) + 1)).cast("long").alias("moment")).where(F.col("moment") <= now + 3 * 86400)


@query("coverage", f"""WITH d AS (SELECT source, COUNT(*) AS hits, COUNT(*) FILTER (WHERE quality = 0) AS invalidated, COUNT(*) FILTER (WHERE toxic = 1) AS unresolved FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, hits, invalidated, unresolved, array_to_string(list_sort(list_filter([CASE WHEN hits <= 1 THEN 'thin' END, CASE WHEN invalidated > 0 THEN 'invalidated' END, CASE WHEN unresolved > 0 THEN 'unresolved' END], lambda x: x IS NOT NULL)), ',') AS caveats FROM d""")
def coverage(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("quality") == 0).alias("invalidated"), F.count_if(F.col("toxic") == 1).alias("unresolved"))
    notes = F.array_compact(F.array(F.when(F.col("hits") <= 1, "thin"), F.when(F.col("invalidated") > 0, "invalidated"), F.when(F.col("unresolved") > 0, "unresolved")))
    return g.withColumn("caveats", F.array_join(F.array_sort(notes), ","))


@query("edge_age", "SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS edge_id, CAST(floor(GREATEST(0, epoch(TIMESTAMP '1998-08-01') - epoch(l_shipdate)) / 86400) AS BIGINT) AS days FROM lineitem")
def edge_age(spark, sf_dir):
    return edges(spark, sf_dir).select("edge_id", F.floor(F.greatest(F.lit(0), epoch_of("1998-08-01 00:00:00") - epoch("at")) / 86400).alias("days"))


@query("extraction_caps", "SELECT doc_id, left(text, 400) AS summary, least(10, len(string_split(text, chr(10)))) AS facts FROM documents")
def extraction_caps(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.left("text", F.lit(400)).alias("summary"), F.size(F.slice(F.split("text", "\n"), 1, 10)).cast("long").alias("facts"))


@query("log_by_day", f"WITH {LOG_SQL} SELECT strftime(at_, '%Y-%m-%d') AS day, kind, COUNT(*) AS n FROM log GROUP BY 1, 2")
def log_by_day(spark, sf_dir):
    return log(spark, sf_dir).groupBy(day("at").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))
