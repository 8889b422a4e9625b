"""Canonical exact digests of documents, by SQL functions only.

A text is folded (ICU case folding and NFKC through java_method, white space runs to one space, ends trimmed) and hashed by four seeded
64-bit xxhashes, 256 bits in all. Texts with equal hashes form a bucket, and inside buckets the folded bytes are compared: only least and
greatest text of a bucket (aggregated before the shuffle, however large the bucket) need to be equal. Where they aren't, the texts of that
bucket are numbered and the number becomes part of the fingerprint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import clean_name, scratch_dir, table, written

#: Hashes of copies that are compared by broadcast; more go by a shuffled join.
BROADCAST_HASHES = 500_000
#: Characters of a range of ids, and ranges at most; the bounds are a constant array of the plan. Beyond 1.6 TB ranges grow, to 0.5 GB at 100 TB.
RANGE_CHARS, MOST_RANGES, _LEAST = 8 << 20, 200_000, -(1 << 63)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding may leave what composes), white space runs as one space, trimmed. Null is empty."""
    text = F.coalesce(text, F.lit(""))
    normal = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal(text), F.lit(True))
    return F.trim(F.regexp_replace(normal(folded), r"[\p{Z}\s]+", " "))


def wide_hash(text: Column) -> Column:
    """256 bits as hex: xxhash64 with four seeds."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), text))), 16, "0") for seed in (11, 23, 47, 91)])


def likeness(a: Column, b: Column) -> Column:
    """Of exact digests: 1 if equal, else 0."""
    return F.when(a == b, 1.0).otherwise(0.0)


def collided(texts: DataFrame) -> DataFrame:
    """texts (hash, folded) -> (hash, folded, number) of the buckets that hold different texts; number 0 is the least text's.

    Least and greatest text are taken before the shuffle, so a bucket with a third of all rows sends one row a task.
    """
    bad = written(texts.groupBy("hash").agg(F.min("folded").alias("least"), F.max("folded").alias("most")).where("least != most").select("hash"), "fingerprint-buckets")
    if not bad.head(1):  # the rule: then no text is dealt by its hash
        return bad.select("hash", F.lit("").alias("folded"), F.lit(0).alias("number"))
    each = texts.join(bad, "hash", "left_semi").groupBy("hash", "folded").agg(F.lit(1).alias("one"))
    return each.select("hash", "folded", (F.row_number().over(Window.partitionBy("hash").orderBy("folded")) - 1).alias("number"))


def named(hash_: Column, number: Column) -> Column:
    return F.when(F.coalesce(number, F.lit(0)) == 0, hash_).otherwise(F.concat(hash_, F.lit("-"), number.cast("string")))


def multiple(hashes: DataFrame, texts: DataFrame) -> DataFrame:
    """texts whose hash occurs twice or more in `hashes`: by broadcast if these are few (counted), else by a shuffled join."""
    several = written(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "fingerprint-copies")
    return texts.join(F.broadcast(several) if several.count() <= BROADCAST_HASHES else several, "hash", "left_semi")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row; null and empty texts share one fingerprint, rows that repeat too."""
    texts = docs.select("doc_id", canonical(F.col("text")).alias("folded")).withColumn("hash", wide_hash(F.col("folded")))
    light = written(texts.select("doc_id", "hash"), "fingerprints")
    odd = written(collided(multiple(light, texts.select("hash", "folded"))), "fingerprint-collisions")
    if not odd.head(1):
        return light.select("doc_id", F.col("hash").alias("fingerprint"))
    return texts.join(odd, ["hash", "folded"], "left").select("doc_id", named(F.col("hash"), F.col("number")).alias("fingerprint"))


def _tie(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs (doc_id, text, carried...) with next_<column> of the row that follows in descending doc_id (nulls last); the first follows the last.

    Rows go to ranges of doc_id, once; the first row of each range is also sent to the range before it. Rows with the same id stand in
    the order of their text's hash. Bounds come from a sketch of the ids, as many as the input's size asks for; rows of one id stay in one
    range, so an id that repeats without end is one sorted run, which spills.
    """
    n = _ranges(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    shares = F.split(F.lit(",".join(repr(k / n) for k in range(1, n))), ",").cast("array<double>")
    bounds = sorted(set(ids.agg(F.percentile_approx("id", shares, max(10_000, 5 * n))).first()[0] or [])) if n > 1 else []
    # range 0 holds the largest ids; nulls stand in the last
    place = lambda c: F.coalesce(F.lit(len(bounds)) - _at_most(c, bounds), F.lit(len(bounds)))
    tops = ids.select(place(F.col("id")).alias("range"), "id").groupBy("range").agg(F.max("id").alias("top")).orderBy("range").collect()
    if not tops:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    top, before = [_LEAST] * (len(bounds) + 1), [-1] * (len(bounds) + 1)
    for k, r in enumerate(tops):
        top[r["range"]] = _LEAST if r["top"] is None else r["top"]
        before[r["range"]] = tops[k - 1]["range"]  # before the first: the last
    at, go = clean_name(docs, "range_of"), clean_name(docs, "range_go")
    own = F.struct(F.col(at).alias("range"), F.lit(0).alias("extra"))
    first = (F.get(_longs(top), F.col(at)) == F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))) & (F.get(_longs(before), F.col(at)) >= 0)
    also = F.struct(F.get(_longs(before), F.col(at)).cast("int").alias("range"), F.lit(1).alias("extra"))
    rows = docs.withColumn(at, place(F.col("doc_id").cast("long")).cast("int"))
    rows = rows.withColumn(go, F.explode(F.when(first, F.array(own, also)).otherwise(F.array(own)))).withColumn(at, F.col(f"{go}.range"))
    rows = rows.repartition(2 * (len(bounds) + 1), F.col(at))  # as many tasks as ranges ask for, whatever the session's number
    order = Window.partitionBy(F.col(at)).orderBy(F.col(f"{go}.extra"), F.col("doc_id").desc_nulls_last(), _tie(F.col("text")), F.col("text"))
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return rows.where(F.col(f"{go}.extra") == 0).drop(at, go)


def _longs(values: list[int]) -> Column:
    """A constant array, folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _at_most(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above value: first among every g-th, then within that stretch, so 2 sqrt(n) steps."""
    if not bounds:
        return F.when(value.isNotNull(), F.lit(0))
    g = max(1, math.isqrt(len(bounds)))
    below = lambda array: F.array_size(F.filter(array, lambda b: b <= value))
    k = below(_longs(bounds[::g]))
    stretch = F.slice(_longs(bounds), (k - 1) * g + 1, F.lit(g))
    return F.when(value.isNull(), None).when(k == 0, 0).otherwise((k - 1) * g + below(stretch))


def _ranges(docs: DataFrame) -> int:
    """As many ranges as the texts have RANGE_CHARS, 12 at least."""
    chars = int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    return int(min(MOST_RANGES, max(12, chars // RANGE_CHARS)))


def edited_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text and edited: the last half of the code points replaced by as many of the next document's first."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    return with_next(docs, ["text"]).withColumn("edited", edited)


def _some(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose doc_id is among ids: by broadcast if these are few (counted), else by a shuffled join."""
    few = written(ids.select(F.col("doc_id").alias("some_id")).distinct(), "fingerprint-ids")
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_HASHES else few, F.col("doc_id").eqNullSafe(F.col("some_id")), "left_semi")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and edited texts. Texts are folded and hashed once; bytes are compared, on texts folded again, only where a
    hash occurs twice. The two cases of a hash that different texts share (never seen) join the number of the text to its hash."""
    scratch_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = edited_texts(docs)
    folded = {"a": canonical(F.col("text")), "b": canonical(F.col("edited")), "c": canonical(F.col("next_text"))}
    light = written(
        near.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[wide_hash(c).alias(f"{k}_hash") for k, c in folded.items()]),
        "edited",
    )
    both = light.select(F.explode(F.array("a_hash", "b_hash")).alias("hash"))
    several = written(both.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "fingerprint-copies")
    hashes = F.broadcast(several) if several.count() <= BROADCAST_HASHES else several
    copies = _some(docs, light.join(hashes, light["a_hash"] == several["hash"], "left_semi").select("doc_id"))
    texts = copies.select(folded["a"].alias("folded")).withColumn("hash", wide_hash(F.col("folded"))).select("hash", "folded")
    held = written(light.join(hashes, light["b_hash"] == several["hash"], "left_semi").where("a_hash != b_hash").select("doc_id"), "fingerprint-edited")
    if held.head(1):
        again = _some(near, held).select(folded["b"].alias("folded")).withColumn("hash", wide_hash(F.col("folded")))
        texts = texts.unionByName(again.select("hash", "folded"))
    odd = written(collided(texts), "fingerprint-collisions")
    if odd.head(1):  # as good as never: 256 bits met for different texts
        light = near.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", *[c.alias(k) for k, c in folded.items()])
        light = light.select("*", *[wide_hash(F.col(c)).alias(f"{c}_hash") for c in "abc"])
        for c in "abc":
            own = odd.select(F.col("hash").alias(f"{c}_hash"), F.col("folded").alias(c), F.col("number").alias(f"{c}_number"))
            light = light.join(own, [f"{c}_hash", c], "left").withColumn(f"{c}_hash", named(F.col(f"{c}_hash"), F.col(f"{c}_number")))
        light = light.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return light.select("doc_id", "n_chars", "edited_sha256", F.col("a_hash").alias("fingerprint"), F.col("b_hash").alias("edited_fingerprint"), likeness(F.col("a_hash"), F.col("b_hash")).alias("near_edited"), likeness(F.col("a_hash"), F.col("c_hash")).alias("near_next"))
