"""Retrieval: full text, vectors, fusion, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.scoring import temporal_factor, temporal_relevance
from sedimenta.functions.text import estimate_tokens, fold_accents, has_temporal_intent, route_depth
from sedimenta.functions.timecol import age_days
from sedimenta.operators import retrieval as R
from sedimenta.plans.base import AS_OF, PHRASES, SEARCHES, query, read, values

_TOK = r"regexp_extract_all(lower(COALESCE({0}, '')), '[\p{{L}}\p{{N}}]+')"
_BM25 = rf"""
searches AS (SELECT * FROM {values(SEARCHES, "query_id, query")}),
parts AS (SELECT query_id, UNNEST(string_split_regex(trim(regexp_replace(query, '[-+*"():^]', ' ', 'g')), '\s+')) AS part FROM searches),
wanted AS (SELECT query_id, token, COUNT(*) AS times FROM (SELECT query_id, UNNEST({_TOK.format("part")}) AS token FROM parts) GROUP BY ALL),
toks AS (SELECT doc_id AS id, {_TOK.format("text")} AS tokens FROM documents),
corpus AS (SELECT COUNT(*) AS n, AVG(len(tokens)) AS avgdl FROM toks),
tf AS (SELECT id, dl, token, COUNT(*) AS tf FROM (SELECT id, len(tokens) AS dl, UNNEST(tokens) AS token FROM toks) WHERE token IN (SELECT token FROM wanted) GROUP BY ALL),
df AS (SELECT token, COUNT(*) AS df FROM tf GROUP BY token),
bm25 AS (SELECT query_id, id, SUM(GREATEST(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN df USING (token) JOIN wanted USING (token) CROSS JOIN corpus GROUP BY query_id, id),
fts AS (SELECT query_id, id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm25)
"""


def _fts(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    q = spark.createDataFrame(list(SEARCHES), "query_id int, query string")
    scored = R.bm25(read(spark, sf_dir, "documents"), q, "doc_id", "text")
    return R.top_k(scored.withColumn("score", F.round("score", 9)), k)


@query("fts_bm25_topk", f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM fts WHERE rank <= 10")
def fts_bm25_topk(spark, sf_dir):
    return _fts(spark, sf_dir, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("fts_phrase", rf"""
WITH phrases AS (SELECT * FROM {values(PHRASES, "phrase_id, phrase")}), pt AS (SELECT phrase_id, {_TOK.format("phrase")} AS p FROM phrases),
post AS (SELECT doc_id AS id, UNNEST(t) AS token, UNNEST(range(len(t))) AS pos FROM (SELECT doc_id, {_TOK.format("text")} AS t FROM documents))
SELECT phrase_id, a.id, COUNT(*) AS n FROM pt JOIN post a ON a.token = p[1] JOIN post b ON b.id = a.id AND b.pos = a.pos + 1 AND b.token = p[2] GROUP BY phrase_id, a.id
""")
def fts_phrase(spark, sf_dir):
    p = spark.createDataFrame(list(PHRASES), "phrase_id int, phrase string")
    return R.phrase_hits(read(spark, sf_dir, "documents"), p, "doc_id", "text")


def _vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


_KNN = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
q AS (SELECT id AS query_id, vector AS qv FROM v WHERE id % 50 = 0),
knn AS (SELECT query_id, id, {0}(qv, vector) AS distance FROM q CROSS JOIN v),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM knn)
"""


@query("vec_knn_l2", f"WITH {_KNN.format('list_distance')} SELECT query_id, id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 10")
def vec_knn_l2(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.knn(v, q, 10).select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long"))


@query("vec_knn_cosine", f"WITH {_KNN.format('list_cosine_distance')} SELECT query_id, id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 10")
def vec_knn_cosine(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.knn(v, q, 10, "cosine").select("query_id", "id", F.abs(F.round("distance", 6)).alias("distance"), F.col("rank").cast("long"))


@query("binder_links_top3", f"""WITH {_KNN.format('list_distance')}, near AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM knn WHERE id <> query_id)
SELECT query_id AS event_id, string_agg(id, ',' ORDER BY r) AS links, COUNT(*) AS n FROM near WHERE r <= 3 GROUP BY query_id""")
def binder_links_top3(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    links = R.knn(v, q, 3, exclude_self=True).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("l"))
    return links.select(F.col("query_id").alias("event_id"), F.array_join(F.transform("l", lambda x: x["id"].cast("string")), ",").alias("links"), F.size("l").cast("long").alias("n"))


#: Each search stands beside the vector of the same number times 50.
_HYBRID = f"""{_BM25}, {_KNN.format('list_distance')},
lists AS (SELECT query_id, id, rank, 0 AS list FROM fts WHERE rank <= 50 UNION ALL SELECT CAST(query_id // 50 AS INTEGER) AS query_id, id, rank, 1 AS list FROM ranked WHERE rank <= 50 AND query_id BETWEEN 50 AND 400),
fused AS (SELECT query_id, id, SUM(1.0 / (60 + rank)) AS score, MIN({{'list': list, 'rank': rank}}) AS f FROM lists GROUP BY query_id, id),
hybrid AS (SELECT query_id, id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f, id) AS rank FROM fused)
"""


def _hybrid(spark, sf_dir, k: int) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    vec = R.knn(v, q.where("query_id BETWEEN 50 AND 400"), 50).select((F.col("query_id") / 50).cast("int").alias("query_id"), "id", "rank")
    return R.fused_top(R.rrf([_fts(spark, sf_dir, 50), vec]), k)


@query("rrf_hybrid", f"WITH {_HYBRID} SELECT query_id, id, round(score, 9) AS score, rank FROM hybrid WHERE rank <= 20")
def rrf_hybrid(spark, sf_dir):
    return _hybrid(spark, sf_dir, 20).select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long"))


@query("rrf_nested_entity", f"""WITH {_HYBRID}, entity AS (SELECT query_id, doc_id AS id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank
  FROM searches JOIN documents ON lower(source) = 'src' || query_id),
outer_ AS (SELECT query_id, id, rank, 0 AS list FROM hybrid WHERE rank <= 50 UNION ALL SELECT query_id, id, rank, 1 AS list FROM entity WHERE rank <= 50),
f2 AS (SELECT query_id, id, SUM(1.0 / (60 + rank)) AS score, MIN({{'list': list, 'rank': rank}}) AS f FROM outer_ GROUP BY query_id, id)
SELECT query_id, id, round(score, 9) AS score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f, id) AS rank FROM f2) WHERE rank <= 20""")
def rrf_nested_entity(spark, sf_dir):
    names = spark.createDataFrame([(q, f"src{q}") for q, _ in SEARCHES], "query_id int, name string")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("source").alias("name"))
    entity = R.top_k(names.join(docs, "name").select("query_id", "id", F.col("id").alias("score")), 50)
    return R.fused_top(R.rrf([_hybrid(spark, sf_dir, 50), entity]), 20).select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long"))


@query("recency_rerank", f"""WITH {_BM25} SELECT query_id, id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ts DESC NULLS LAST, rank) AS new_rank
FROM fts LEFT JOIN events ON event_id = id WHERE rank <= 20""")
def recency_rerank(spark, sf_dir):
    at = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return R.recency_rerank(_fts(spark, sf_dir, 20).join(at, "id", "left")).select("query_id", "id", F.col("new_rank").cast("long"))


def _class():
    kinds = {"error": "superseded", "click": "transient", "view": "decaying", "signup": "commitment", "purchase": "one_off"}
    return F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])


_RELEVANCE = f"""CASE event_type WHEN 'error' THEN 0.15 WHEN 'signup' THEN CASE WHEN value < 50 THEN 0.3 ELSE 1.0 END
  WHEN 'click' THEN GREATEST(0.15, pow(0.5, age / 2.0)) WHEN 'view' THEN GREATEST(0.15, pow(0.5, age / 60.0)) WHEN 'purchase' THEN GREATEST(0.15, pow(0.5, (age - 3) / 14.0)) END"""
_AGE = f"(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 86400.0"


@query("temporal_rerank", f"""WITH {_BM25}, t AS (SELECT event_id AS id, {_AGE} AS age, event_type, value FROM events),
m AS (SELECT query_id, f.id, rank, COUNT(*) OVER (PARTITION BY query_id) AS n, CASE WHEN t.id IS NULL THEN 1.0 ELSE ({_RELEVANCE}) * 0.9 + 0.1 END AS factor FROM fts f LEFT JOIN t ON t.id = f.id WHERE rank <= 20)
SELECT query_id, id, round((n - rank + 1) * factor, 6) AS t_score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round((n - rank + 1) * factor, 9) DESC, rank) AS new_rank FROM m""")
def temporal_rerank(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), _class().alias("class"), "value", age_days("ts", AS_OF).alias("age"))
    closure = F.when(F.col("value") < 50, "fulfilled")
    factor = temporal_relevance(temporal_factor(F.col("class"), closure, F.col("age"), F.lit(None).cast("double"), F.col("age") - 3), F.lit(0.9))
    hits = _fts(spark, sf_dir, 20).join(ev, "id", "left")
    out = R.temporal_rerank(hits, F.when(F.col("class").isNull(), 1.0).otherwise(factor))
    return out.select("query_id", "id", F.round("t_score", 6).alias("t_score"), F.col("new_rank").cast("long"))


@query("article_first", f"""WITH {_BM25}, h AS (SELECT query_id, f.id, rank, source = 'src1' AS syn, source = 'src2' AS art, COALESCE(quality = 0, FALSE) AS inv
  FROM fts f JOIN documents d ON d.doc_id = f.id LEFT JOIN labels l ON l.doc_id = f.id WHERE rank <= 50)
SELECT query_id, id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY CASE WHEN syn THEN 0 WHEN art AND NOT inv THEN 1 ELSE 2 END, rank) AS new_rank FROM h WHERE NOT (syn AND inv)""")
def article_first(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    bad = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("inv"))
    hits = _fts(spark, sf_dir, 50).join(docs, "id").join(bad, "id", "left").withColumn("inv", F.coalesce("inv", F.lit(False)))
    return R.article_first(hits, F.col("source") == "src1", F.col("source") == "src2", F.col("inv")).select("query_id", "id", F.col("new_rank").cast("long"))


@query("query_router", r"""SELECT conv_id, turn, CASE WHEN q = '' OR q LIKE 'sha256:%' OR q LIKE 'http://%' OR q LIKE 'https://%' OR q LIKE 'file://%' OR regexp_matches(q, '(?i)^[0-9A-HJKMNP-TV-Z]{26}$')
  OR len(list_filter(string_split_regex(regexp_replace(q, '[-+*"():^]', ' ', 'g'), '\s+'), lambda x: x <> '')) <= 1 THEN 'shallow' ELSE 'normal' END AS depth,
  regexp_matches(text, '(?i)\b(current|currently|latest|now|today|recent|recently|nowadays|present|these days|right now|as of)\b') AS temporal
FROM (SELECT *, trim(COALESCE(text, '')) AS q FROM conversations)""")
def query_router(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", route_depth(F.col("text")).alias("depth"), has_temporal_intent(F.col("text")).alias("temporal"))


@query("entity_match_union", """WITH names AS (SELECT p_partkey AS entity, lower(p_name) AS name FROM part), wanted AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_partkey % 50 = 0),
hit AS (SELECT n.entity FROM names n JOIN wanted USING (name) UNION SELECT p_partkey FROM part WHERE lower(p_brand) IN (SELECT name FROM wanted))
SELECT l_orderkey AS event_id, COUNT(DISTINCT l_partkey) AS entities FROM lineitem WHERE l_partkey IN (SELECT entity FROM hit) GROUP BY l_orderkey""")
def entity_match_union(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    wanted = part.where("p_partkey % 50 = 0").select(F.lower("p_name").alias("name")).distinct()
    by_name = part.select(F.col("p_partkey").alias("entity"), F.lower("p_name").alias("name")).join(wanted, "name", "left_semi").select("entity")
    by_form = part.select(F.col("p_partkey").alias("entity"), F.lower("p_brand").alias("name")).join(wanted, "name", "left_semi").select("entity")
    mentions = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity"))
    return mentions.join(by_name.union(by_form).distinct(), "entity", "left_semi").groupBy("event_id").agg(F.countDistinct("entity").alias("entities"))


@query("chunk_text")
def chunk_text(spark, sf_dir):
    return R.chunk_documents(read(spark, sf_dir, "documents"), "doc_id", "text", 2000, 200).select("id", "chunk", "start", "length", F.sha2(F.col("text"), 256).alias("sha"))


@query("mean_pool", """WITH e AS (SELECT label, UNNEST(CAST(embedding AS DOUBLE[])) AS x, UNNEST(range(len(embedding))) AS k FROM embeddings), m AS (SELECT label, k, AVG(x) AS x FROM e GROUP BY label, k),
n AS (SELECT label, sqrt(SUM(x * x)) AS norm FROM m GROUP BY label) SELECT m.label, CAST(k AS INTEGER) AS k, round(x / norm, 6) + 0.0 AS x FROM m JOIN n USING (label)""")
def mean_pool(spark, sf_dir):
    pooled = R.mean_pool(read(spark, sf_dir, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("k", "x")).select("label", "k", (F.round("x", 6) + 0.0).alias("x"))


@query("estimate_tokens", "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS est FROM documents")
def estimate_tokens_q(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("est"))


@query("folded_tokens", r"""SELECT token, COUNT(*) AS n FROM (SELECT UNNEST(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS token FROM documents) GROUP BY token""")
def folded_tokens(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower(fold_accents(F.coalesce("text", F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
