"""The content-addressed blob store: objects/<2 hex>/<62 hex>."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRACE_SECONDS = 24 * 3600


def blob_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def relative_path(hash_: Column) -> Column:
    h = F.substring(hash_, 8, 64)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 62))


def stored(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(hash, path, length, modified[, content]) of all well-formed objects; the content is read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "/([0-9a-f]{2})/([0-9a-f]{62})$", 1)
    rest = F.regexp_extract("path", "/([0-9a-f]{2})/([0-9a-f]{62})$", 2)
    rows = files.withColumn("hash", F.concat(F.lit("sha256:"), name, rest)).where(name != "")
    return rows.select("hash", "path", "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def write_objects(blobs: DataFrame, folder: str) -> DataFrame:
    """Writes the binary column `content` of blobs below a folder that all executors mount; returns (hash, length, written).

    A file appears under its name only when it is whole (temporary name, then rename), so that a task that runs twice does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            hashes, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for h, c in zip(hashes, contents, strict=True):
                path = os.path.join(folder, h[7:9], h[9:])
                fresh = not os.path.exists(path)
                if fresh:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
                    with open(tmp, "wb") as f:
                        f.write(c)
                    os.replace(tmp, path)
                done.append(fresh)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in contents], pa.int64()), pa.array(done)], names=["hash", "length", "written"])

    rows = blobs.where("content IS NOT NULL").select(blob_hash(F.col("content")).alias("hash"), "content").dropDuplicates(["hash"])
    return rows.mapInArrow(run, "hash string, length long, written boolean")


def reachable(payloads: DataFrame, column: str) -> DataFrame:
    """(hash) of all blobs that JSON payloads name under blob_hash, at any depth."""
    found = F.regexp_extract_all(F.col(column), F.lit(r'"blob_hash"\s*:\s*"(sha256:[0-9a-f]{64})"'), 1)
    return payloads.where(F.col(column).contains("blob_hash")).select(F.explode(found).alias("hash")).distinct()


def orphaned(all_: DataFrame, used: DataFrame, now: Column, grace: int = GRACE_SECONDS) -> DataFrame:
    """Stored blobs that nothing names and that are older than the grace time."""
    age = F.unix_timestamp(now) - F.unix_timestamp("modified")
    return all_.where(age > grace).join(used, "hash", "left_anti")


def rehydrate(events: DataFrame, blobs: DataFrame) -> DataFrame:
    """events (payload JSON) with `text`: inline, or from the blob; null with `unavailable` true where the blob is missing."""
    h = F.get_json_object("payload", "$.blob_hash")
    met = events.withColumn("_h", h).join(blobs.select(F.col("hash").alias("_h"), F.decode("content", "UTF-8").alias("_t")), "_h", "left")
    text = F.coalesce(F.get_json_object("payload", "$.text"), F.col("_t"))
    return met.withColumn("text", text).withColumn("unavailable", F.col("_h").isNotNull() & F.col("text").isNull()).drop("_h", "_t")
