"""Full-text and vector retrieval, fusion and reranking, for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import tokens

K1, B, RRF_K = 1.2, 0.75, 60
QUERY_BLOCK = 4096


def postings(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, pos, token)."""
    return docs.select(F.col(id_).alias("id"), F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def safe_query(query: Column) -> Column:
    """The query's parts: operators to blanks, then split at white space; parts that repeat stay."""
    return F.filter(F.split(F.trim(F.regexp_replace(query, r'[-+*"():^]', " ")), r"\s+"), lambda x: x != "")


def bm25(docs: DataFrame, queries: DataFrame, id_: str, text: str) -> DataFrame:
    """(query_id, id, score) of all matches; queries (query_id, query). Each part of a query counts as often as it stands there.

    Postings are summed by (token, id) after a join with the few query tokens; lengths come from the same projection.
    """
    each = docs.select(F.col(id_).alias("id"), tokens(F.col(text)).alias("tokens"))
    wanted = queries.select("query_id", F.explode(safe_query(F.col("query"))).alias("part")).select("query_id", F.explode(tokens(F.col("part"))).alias("token"))
    wanted = wanted.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    corpus = each.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    hits = each.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    tf = hits.groupBy("token", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weights = wanted.join(df, "token").crossJoin(corpus).withColumn("w", idf * F.col("times")).select("query_id", "token", "w", "avgdl")
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(weights, "token").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def phrase_hits(docs: DataFrame, phrases: DataFrame, id_: str, text: str) -> DataFrame:
    """(phrase_id, id, n): how often each phrase's tokens stand side by side in each document."""
    parts = phrases.select("phrase_id", F.posexplode(tokens(F.col("phrase"))).alias("k", "token"))
    sizes = parts.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("size"))
    met = postings(docs, id_, text).join(parts, "token").select("phrase_id", "id", (F.col("pos") - F.col("k")).alias("start"), "k")
    runs = met.groupBy("phrase_id", "id", "start").agg(F.count(F.lit(1)).alias("size")).join(sizes, ["phrase_id", "size"])
    return runs.groupBy("phrase_id", "id").agg(F.count(F.lit(1)).alias("n"))


def top_k(scored: DataFrame, k: int, group: str = "query_id", score: str = "score", tie: str = "id", descending: bool = True) -> DataFrame:
    """scored with rank (from 1); Spark cuts each partition to k rows a group before the shuffle."""
    first = F.col(score).desc() if descending else F.col(score).asc()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(first, F.col(tie)))).where(F.col("rank") <= k)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): exact nearest neighbours. vectors (id, vector), queries (query_id, vector).

    Queries go out in blocks of at most QUERY_BLOCK; each task keeps its k best a query by matrix products, and the bests meet by query.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    keep = k + 1 if exclude_self else k
    out = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = own.select("query_id", F.col("vector").cast("array<double>")).collect()
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best_d, best_i = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                own, v = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.float64)
                if metric == "l2":
                    d = np.sqrt(np.maximum(((q[:, None, :] - v[None, :, :]) ** 2).sum(axis=2), 0)) if q.shape[0] * v.size < 5e7 else np.stack([np.sqrt(((v - x) ** 2).sum(axis=1)) for x in q])
                else:
                    d = 1 - (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :])
                all_d, all_i = np.concatenate([best_d, d], axis=1), np.concatenate([best_i, np.broadcast_to(own, d.shape)], axis=1)
                order = np.lexsort((all_i, all_d), axis=1)[:, :keep]
                best_d, best_i = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
            m = best_d.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], names=["query_id", "id", "distance"])

        found = vectors.select("id", "vector").mapInArrow(run, "query_id long, id long, distance double")
        out = found if out is None else out.unionByName(found)
    if exclude_self:
        out = out.where("query_id != id")
    return top_k(out, k, score="distance", descending=False)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, list, rank) of ranked lists (query_id, id, rank from 1); ties by first list, then rank there.

    A query that has one list only keeps that list's order, since 1 / (k + rank) falls with rank.
    """
    all_ = None
    for n, one in enumerate(lists):
        part = one.select("query_id", "id", "rank", F.lit(n).alias("list"))
        all_ = part if all_ is None else all_.unionByName(part)
    first = F.min(F.struct("list", "rank"))
    return all_.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), first.alias("_f")).select("query_id", "id", "score", "_f.list", "_f.rank")


def fused_top(fused: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "list", "rank", "id")
    return fused.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("query_id", "id", "score", F.col("rn").alias("rank"))


def recency_rerank(hits: DataFrame, at: str = "at") -> DataFrame:
    """Ranks by time, newest first, unknown times last; equal times keep their order."""
    w = Window.partitionBy("query_id").orderBy(F.col(at).desc_nulls_last(), "rank")
    return hits.withColumn("new_rank", F.row_number().over(w))


def temporal_rerank(hits: DataFrame, factor: Column) -> DataFrame:
    """(n - position) times the row's factor, largest first; equal ones keep their order."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    scored = hits.withColumn("t_score", (n - F.col("rank") + 1) * factor)
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("t_score", 9).desc(), "rank")))


def article_first(hits: DataFrame, synthesis: Column, article: Column, invalidated: Column) -> DataFrame:
    """Live syntheses, then live articles, then the rest; invalidated syntheses go."""
    kept = hits.where(~(synthesis & invalidated))
    tier = F.when(synthesis, 0).when(article & ~invalidated, 1).otherwise(2)
    return kept.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(tier, "rank")))


def find_boundary(text: str, start: int, end: int) -> int:
    """Where to cut within text[start:end]: after its last blank line, else sentence end (marks in order), else blank; else at the end."""
    for mark in ("\n\n", ". ", "! ", "? ", ".\n", "!\n", "?\n", " "):
        at = text.rfind(mark, start, end)
        if at >= 0:
            return at + len(mark)
    return end


def chunks(text: str, size: int = 24_370, overlap: int = 2_000) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text: starts are size - overlap apart, ends lie at a boundary in a piece's last quarter.

    A piece that is cut short by more than the overlap leaves the rest up to the next start out, which is the model's rule.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than a piece")
    if len(text) <= size:
        return [(0, len(text))]
    out = []
    for start in range(0, len(text), size - overlap):
        end = min(start + size, len(text))
        if end < len(text):
            end = max(find_boundary(text, start + size * 3 // 4, end), start + 1)
        out.append((start, end))
        if end == len(text):
            break
    return out


def chunk_documents(docs: DataFrame, id_: str, text: str, size: int = 24_370, overlap: int = 2_000) -> DataFrame:
    """(id, chunk, start, length, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, a, b - a, t[a:b]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, (a, b) in enumerate(chunks(t or "", size, overlap))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "chunk", "start", "length", "text"])

    return docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string")).mapInArrow(run, "id long, chunk int, start long, length long, text string")


def mean_pool(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pooled): the mean of a key's vectors at unit length; a zero mean stays zero."""
    means = vectors.select(key, F.posexplode(vector).alias("k", "x")).groupBy(key, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pooled = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    norm_ = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return pooled.select(key, F.when(norm_ > 0, F.transform("v", lambda x: x / norm_)).otherwise(F.col("v")).alias("pooled"))
