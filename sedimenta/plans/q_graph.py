"""Recursive resolution, components, clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sedimenta.functions.scoring import jaccard
from sedimenta.operators import graph as G
from sedimenta.operators import retrieval as R
from sedimenta.operators.latest import latest_by, latest_n
from sedimenta.plans.base import edges, query, read


@query("resolve_canonical", """WITH RECURSIVE live AS (SELECT p_partkey AS id, p_partkey // 2 AS into_ FROM part WHERE p_partkey >= 1 AND p_size <> 13),
walk AS (SELECT p_partkey AS id, p_partkey AS cur, 0 AS depth FROM part UNION ALL SELECT w.id, l.into_, w.depth + 1 FROM walk w JOIN live l ON l.id = w.cur WHERE w.depth < 16)
SELECT id, arg_max(cur, depth) AS canonical, MAX(depth) AS depth FROM walk GROUP BY id""")
def resolve_canonical(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    live = p.where("p_partkey >= 1 AND p_size != 13").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("into"))
    return G.resolve(p.select(F.col("p_partkey").alias("id")), live)


@query("kind_chain_resolve", """WITH RECURSIVE k AS (SELECT DISTINCT p_size AS slug FROM part), rev AS (SELECT slug, slug // 3 AS into_ FROM k WHERE slug % 3 = 0 AND slug > 0),
walk AS (SELECT slug AS id, slug AS cur, 0 AS depth FROM k UNION ALL SELECT w.id, r.into_, w.depth + 1 FROM walk w JOIN rev r ON r.slug = w.cur WHERE w.depth < 16)
SELECT id AS slug, arg_max(cur, depth) AS resolved FROM walk GROUP BY id""")
def kind_chain_resolve(spark, sf_dir):
    k = read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("id")).distinct()
    rev = k.where("id % 3 = 0 AND id > 0").select("id", F.expr("id div 3").alias("into"))
    return G.resolve(k, rev).select(F.col("id").cast("int").alias("slug"), F.col("canonical").cast("int").alias("resolved"))


@query("current_kind_view", """WITH a AS (SELECT o_custkey AS entity, o_orderpriority AS kind, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey AS entity, COALESCE(a.kind, c_mktsegment) AS kind FROM customer LEFT JOIN a ON a.entity = c_custkey AND rn = 1""")
def current_kind_view(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("assigned"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    last = latest_by(a, ["entity"], ["at", "id"], ["assigned"])
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment").join(last, "entity", "left").select("entity", F.coalesce("assigned", "c_mktsegment").alias("kind"))


@query("live_kinds", """SELECT n_nationkey AS slug FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM (SELECT s_nationkey, s_suppkey % 3 AS act, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) AS rn FROM supplier) WHERE rn = 1 AND act = 0)""")
def live_kinds(spark, sf_dir):
    rev = latest_by(read(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal", "s_suppkey", (F.col("s_suppkey") % 3).alias("act")), ["s_nationkey"], ["s_acctbal", "s_suppkey"], ["act"])
    gone = rev.where("act = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return read(spark, sf_dir, "nation").join(gone, "n_nationkey", "left_anti").select(F.col("n_nationkey").alias("slug"))


@query("entity_clusters_hub", """WITH t AS (SELECT COUNT(DISTINCT l_orderkey) AS total FROM lineitem), g AS (SELECT l_partkey AS entity, COUNT(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT entity, n FROM g, t WHERE n >= 3 AND NOT (n >= 12 AND n / total > 0.001)""")
def entity_clusters_hub(spark, sf_dir):
    return G.hub_groups(read(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", hub_share=0.001).select(F.col("l_partkey").alias("entity"), "n")


_SEM = """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
n AS (SELECT a.id AS a, b.id AS b, list_distance(a.vector, b.vector) AS d FROM v a CROSS JOIN v b WHERE a.id <> b.id),
links AS (SELECT a, b, d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY d, b) AS r FROM n) WHERE r <= 3),
e AS (SELECT DISTINCT x.a, x.b FROM links x LEFT JOIN links y ON y.a = x.b AND y.b = x.a WHERE x.d <= 0.8 OR (y.d IS NOT NULL AND GREATEST(x.d, y.d) <= 1.1)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""


def _links(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return R.knn(v, v.select(F.col("id").alias("query_id"), "vector"), 3, exclude_self=True).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "distance")


@query("reciprocal_links", _SEM + " SELECT a, b FROM e")
def reciprocal_links(spark, sf_dir):
    return G.reciprocal_edges(_links(spark, sf_dir), 0.8, 1.1)


@query("semantic_components", _SEM + ", c AS (SELECT DISTINCT a AS id, a AS root FROM s UNION SELECT s.b, c.root FROM c JOIN s ON s.a = c.id) SELECT id, MIN(root) AS component FROM c GROUP BY id")
def semantic_components(spark, sf_dir):
    return G.connected_components(G.reciprocal_edges(_links(spark, sf_dir), 0.8, 1.1))


_ROW = "conv_id * 1000 + turn"


@query("lineage_components", f"SELECT {_ROW} AS id, MIN({_ROW}) OVER (PARTITION BY conv_id) AS component FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING COUNT(DISTINCT turn) > 1)")
def lineage_components(spark, sf_dir):
    from pyspark.sql import Window

    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("child"))
    parent = F.lag("child").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.withColumn("parent", parent).where("parent IS NOT NULL").select("child", "parent")
    return G.connected_components(G.lineage_edges(rows))


_GROUPS = "g AS (SELECT l_suppkey AS candidate, list_sort(list(DISTINCT l_partkey % 200)) AS members FROM lineitem WHERE l_quantity >= 45 GROUP BY 1)"


def _groups(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where("l_quantity >= 45")
    return li.groupBy(F.col("l_suppkey").alias("candidate")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 200)).alias("members"))


@query("greedy_merge")
def greedy_merge(spark, sf_dir):
    """Order-dependent by definition; candidates are at most as many as the discovery window allows, so one group takes them."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("candidate")
        groups = G.merge_overlapping([(c, set(m.tolist())) for c, m in zip(rows["candidate"], rows["members"], strict=True)])
        return pd.DataFrame({"cluster": range(len(groups)), "size": [len(g) for g in groups]})

    return _groups(spark, sf_dir).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(merge, "cluster long, size long")


_PRIORS = f"""WITH {_GROUPS}, p AS (SELECT candidate AS cluster, list_filter(members, lambda x: x % 3 <> 0) AS pm, candidate % 5 AS e FROM g WHERE candidate % 2 = 0),
m AS (SELECT candidate, cluster, round(0.85 * CASE WHEN len(list_distinct(list_concat(members, pm))) = 0 THEN 0 ELSE len(list_intersect(members, pm)) / len(list_distinct(list_concat(members, pm))) END + 0.15 * CASE WHEN candidate % 5 = e THEN 1.0 ELSE 0.0 END, 6) AS likeness
  FROM g CROSS JOIN p WHERE len(list_intersect(members, pm)) > 0)"""


def _priors(spark, sf_dir):
    g = _groups(spark, sf_dir).withColumn("entities", F.array(F.col("candidate") % 5))
    p = g.where("candidate % 2 = 0").select(F.col("candidate").alias("cluster"), F.filter("members", lambda x: x % 3 != 0).alias("members"), "entities")
    return g, p


@query("prior_match", _PRIORS + " SELECT candidate, cluster, likeness FROM m WHERE likeness >= 0.25")
def prior_match(spark, sf_dir):
    return G.claim_lineage(*_priors(spark, sf_dir))


@query("lineage_claims")
def lineage_claims(spark, sf_dir):
    return G.greedy_lineage(*_priors(spark, sf_dir))


@query("candidate_scores", f"WITH {_GROUPS} SELECT candidate, round(2 + 0.5 + least(len(members), 40) / 40.0, 6) AS score, len(members) AS size FROM g WHERE len(members) >= 3")
def candidate_scores(spark, sf_dir):
    n = F.size("members")
    return _groups(spark, sf_dir).where(n >= 3).select("candidate", F.round(2 + 0.5 + F.least(n, F.lit(40)) / 40.0, 6).alias("score"), n.cast("long").alias("size"))


@query("group_overlap", f"WITH {_GROUPS} SELECT a.candidate AS a, b.candidate AS b, round(len(list_intersect(a.members, b.members)) / len(list_distinct(list_concat(a.members, b.members))), 6) AS jaccard FROM g a JOIN g b ON b.candidate = a.candidate + 1")
def group_overlap(spark, sf_dir):
    a = _groups(spark, sf_dir)
    b = a.select((F.col("candidate") - 1).alias("candidate"), F.col("members").alias("other"))
    return a.join(b, "candidate").select(F.col("candidate").alias("a"), (F.col("candidate") + 1).alias("b"), F.round(jaccard(F.col("members"), F.col("other")), 6).alias("jaccard"))


@query("alias_gazetteer", """WITH a AS (SELECT p_partkey AS id, p_type AS kind, lower(trim(x)) AS alias, lower(p_name) AS name FROM (SELECT *, UNNEST(string_split(p_name, ' ')) AS x FROM part))
SELECT kind, alias, MIN(id) AS entity FROM a WHERE length(alias) >= 3 AND alias <> name GROUP BY kind, alias HAVING COUNT(DISTINCT id) = 1""")
def alias_gazetteer(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.explode(F.split("p_name", " ")).alias("x"), F.lower("p_name").alias("name")).withColumn("alias", F.lower(F.trim("x")))
    g = a.where("length(alias) >= 3 AND alias != name").groupBy("kind", "alias").agg(F.min("id").alias("entity"), F.max("id").alias("last"))
    return g.where("entity = last").select("kind", "alias", "entity")


@query("candidate_pool")
def candidate_pool(spark, sf_dir):
    """For each 50th name, the eight most like names of its kind, by sequence matching.

    Equal names are matched once; a pair stays unmatched only if its letters show that nine rows are more like.
    """
    import difflib
    import heapq
    from collections.abc import Iterator

    import pyarrow as pa
    import pyarrow.compute as pc

    k = 8
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_type").alias("kind"), F.lower("p_name").alias("name")).where("kind IS NOT NULL AND name IS NOT NULL")
    q = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), "kind", F.col("name").alias("query"))
    forms = latest_n(p, ["kind", "name"], [F.col("id")], k + 1).groupBy("kind", "name").agg(F.collect_list("id").alias("ids"))
    met = forms.join(F.broadcast(q.select("kind", "query").distinct()), "kind").select("kind", "query", "name", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        match = difflib.SequenceMatcher(None, "", "")
        for b in batches:
            kept, score = [], []
            for n, (kind, x, y, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), pc.list_value_length(b.column(3)).to_pylist(), strict=True)):
                top = best.setdefault((kind, x), [-1.0] * (k + 1))
                match.set_seq1(x)
                if match.b is not y and match.b != y:
                    match.set_seq2(y)
                if match.real_quick_ratio() < top[0] or match.quick_ratio() < top[0]:
                    continue
                s = match.ratio()
                for _ in range(ids):
                    heapq.heappushpop(top, s)
                kept.append(n)
                score.append(s)
            own = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3), pa.array(score, pa.float64())], names=["kind", "query", "ids", "score"])

    scored = met.mapInArrow(run, "kind string, query string, ids array<long>, score double").select("kind", "query", F.explode("ids").alias("id"), "score")
    top = latest_n(scored, ["kind", "query"], [F.col("score").desc(), F.col("id")], k + 1)
    found = q.join(top, ["kind", "query"]).where("query_id != id").select("query_id", "id", "score")
    return R.top_k(found, k).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("cascade_invalidation", """SELECT DISTINCT (e.l_orderkey * 10 + e.l_linenumber) * 1000000 + e.l_partkey AS edge_id FROM lineitem e JOIN orders o ON o.o_orderkey = e.l_orderkey WHERE o.o_orderstatus = 'P' AND e.l_returnflag <> 'R'""")
def cascade_invalidation(spark, sf_dir):
    parents = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source"))
    return edges(spark, sf_dir).where(~F.col("predicate").startswith("R")).join(parents, "source", "left_semi").select("edge_id").distinct()


@query("merge_into_densest", """WITH m AS (SELECT lower(p_brand) AS name, p_partkey AS id, COUNT(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
d AS (SELECT name, id, FIRST_VALUE(id) OVER (PARTITION BY name ORDER BY n DESC, id) AS into_id FROM m) SELECT id AS from_id, into_id FROM d WHERE id <> into_id""")
def merge_into_densest(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    m = read(spark, sf_dir, "part").select(F.lower("p_brand").alias("name"), F.col("p_partkey").alias("id")).join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = m.groupBy("name").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("into_id"))
    return m.join(best, "name").where("id != into_id").select(F.col("id").alias("from_id"), "into_id")
