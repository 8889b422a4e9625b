from collections import Counter

from pyspark.sql import functions as F

from sedimenta.functions.timecol import epoch
from sedimenta.operators import incremental as I
from sedimenta.plans.base import log
from sedimenta.streaming import log as S


def drain(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def source(spark, sf, folder):
    """The events in three files by time, read one a micro-batch."""
    e = log(spark, sf).withColumn("at", F.col("at").cast("timestamp"))
    for n in range(3):
        e.where(F.pmod(F.floor(F.dayofmonth("at") / 10.5), F.lit(3)) == n).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_daily_counts_equal_the_batch(spark, sf, tmp_path):
    drain(S.daily_counts(source(spark, sf, str(tmp_path)), "at", ["kind"]), "complete", "daily")
    got = Counter({(r["day"], r["kind"]): r["n"] for r in spark.table("daily").collect()})
    want = Counter((r["d"], r["kind"]) for r in log(spark, sf).select(F.date_format("at", "yyyy-MM-dd").alias("d"), "kind").collect())
    assert got == want


def test_modes_equal_the_batch(spark, sf, tmp_path):
    drain(S.sliding_modes(source(spark, sf, str(tmp_path)), "origin", "at", "id", "value", high=1100, low=800), "append", "modes")
    e = log(spark, sf).withColumn("total", I.rolling(None, "value", ["at", "id"], 20, ["origin"]))
    want = {r["id"]: r["mode"] for r in I.fold_modes(e, "origin", ["at", "id"], 1100, 800).collect()}
    assert {r["id"]: r["mode"] for r in spark.table("modes").collect()} == want


def test_buckets_equal_the_batch(spark, sf, tmp_path):
    stream = source(spark, sf, str(tmp_path)).withColumn("t", epoch("at").cast("double"))
    drain(S.token_buckets(stream, "origin", "t", "id", 1e-5, 3.0), "append", "buckets")
    e = log(spark, sf).withColumn("t", epoch("at"))
    want = {r["id"]: r["allowed"] for r in I.token_bucket(e, "origin", "t", "id", 1e-5, 3.0).collect()}
    assert {r["id"]: r["allowed"] for r in spark.table("buckets").collect()} == want


def test_appends_are_idempotent(spark, sf, tmp_path):
    path = str(tmp_path / "log")
    for run in range(2):
        stream = source(spark, sf, str(tmp_path / f"s{run}"))
        stream.writeStream.foreachBatch(S.append_to(path, "id")).option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(path)
    assert got.count() == got.select("id").distinct().count() == log(spark, sf).count()


def test_duplicates_within_the_watermark(spark, sf, tmp_path):
    stream = source(spark, sf, str(tmp_path))
    drain(S.unique_within_watermark(stream.unionByName(stream), "id", "at", "40 days"), "append", "once")
    assert spark.table("once").count() == log(spark, sf).count()
