"""Writing to the log: validation, idempotent appends, retention, export and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions.ids import canonical_json
from sedimenta.operators.latest import append_new

MAX_ITEMS, MAX_ITEM_BYTES, MAX_TOTAL_BYTES = 500, 100_000, 8_000_000


def idempotent_append(log: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """What to append: rows of new with a key that is new, the first of each."""
    return append_new(log, new, [key], order)


def validate_batch(items: DataFrame, text: str, batch: str, position: str, max_items: int = MAX_ITEMS, max_item: int = MAX_ITEM_BYTES, max_total: int = MAX_TOTAL_BYTES) -> DataFrame:
    """items with `verdict`: empty, too_many, too_long, over_total or ok; sums run within a batch in position order."""
    size = F.octet_length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    w = Window.partitionBy(batch).orderBy(position)
    sized = items.withColumn("bytes", size.cast("long")).withColumn("n", F.row_number().over(w)).withColumn("total", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    verdict = F.when(F.col("bytes") == 0, "empty").when(F.col("n") > max_items, "too_many").when(F.col("bytes") > max_item, "too_long").when(F.col("total") > max_total, "over_total").otherwise("ok")
    return sized.withColumn("verdict", verdict).drop("n", "total")


def monotonic_watermarks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(worker, through_at, through_id): the greatest id of each worker wins, however writes come."""
    return old.unionByName(new).groupBy("worker").agg(F.max_by(F.struct("through_at", "through_id"), "through_id").alias("w")).select("worker", "w.*")


def retry_name(base: Column, attempts: Column) -> Column:
    return F.when(attempts > 0, F.concat(base, F.lit("#retry"), attempts.cast("string"))).otherwise(base)


def prune_failed(rows: DataFrame, cutoff: Column) -> DataFrame:
    """rows (id, hash, version, producer, status, at) without failed ones older than cutoff that have a success under the same producer prefix."""
    failed = rows.where((F.col("status") == "failed") & (F.col("at") < cutoff)).withColumn("base", F.regexp_replace("producer", "#retry.*", ""))
    done = rows.where(~F.col("status").eqNullSafe("failed")).select("hash", "version", F.col("producer").alias("p"))
    gone = failed.join(done, ["hash", "version"]).where(F.col("p").startswith(F.col("base"))).select("id").distinct()
    return rows.join(gone, "id", "left_anti")


def export_lines(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(part, seq, line): each row as JSON with its table's `kind`; an own column of that name becomes <table>_kind. The manifest comes last.

    Lines keep each table's order; write them sorted by (part, seq).
    """
    out = None
    for n, (name, (df, order)) in enumerate(tables.items()):
        cols = {(f"{name}_kind" if c == "kind" else c): F.col(c) for c in df.columns}
        line = F.to_json(F.struct(F.lit(name).alias("kind"), *[v.alias(k) for k, v in cols.items()]), {"ignoreNullFields": "false"})
        part = df.select(F.lit(n).alias("part"), F.struct(*[F.col(o).cast("string") for o in order]).cast("string").alias("seq"), line.alias("line"))
        out = part if out is None else out.unionByName(part)
    spark = out.sparkSession
    manifest = spark.range(1).select(F.lit(len(tables)).alias("part"), F.lit("").alias("seq"), F.lit('{"kind":"manifest","format_version":1}').alias("line"))
    return out.unionByName(manifest)


def write_export(tables: dict[str, tuple[DataFrame, list[str]]], path: str, compression: str = "gzip") -> None:
    """JSON lines in order, in as many files as there are tables' ranges; range partitions keep the order across files."""
    lines = export_lines(tables)
    lines.repartitionByRange("part", "seq").sortWithinPartitions("part", "seq").select("line").write.option("compression", compression).text(path)


def import_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, counts) of a JSON-lines export: lines (kind, line) of valid objects; counts by kind, invalid lines as `invalid`.

    Raises if the closing manifest is missing, for then the file was cut off.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    kind = F.get_json_object("value", "$.kind")
    rows = raw.select(F.coalesce(kind, F.lit("invalid")).alias("kind"), F.col("value").alias("line"))
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    if not counts.where("kind = 'manifest'").head(1):
        raise ValueError("the export has no manifest: it is cut off")
    return rows.where("kind NOT IN ('invalid', 'manifest')"), counts


def replace_by_id(old: DataFrame, new: DataFrame, id_: str) -> DataFrame:
    """Rows of new take the place of rows with their id."""
    return old.join(new.select(id_), id_, "left_anti").unionByName(new)


def build_text_payload(text: Column, inline_bytes: int) -> Column:
    """Inline up to inline_bytes of UTF-8, else a reference by hash."""
    long_ = F.octet_length(text) > inline_bytes
    return F.when(~long_, canonical_json(content_type=F.lit("text"), text=text)).otherwise(canonical_json(content_type=F.lit("text-large"), blob_hash=F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256)), size_bytes=F.octet_length(text)))


def orphans(stored: DataFrame, reachable: DataFrame, key: str, age: Column, grace: float) -> DataFrame:
    """Stored rows that nothing reaches and that are older than the grace time."""
    return stored.where(age > grace).join(reachable.select(key).distinct(), key, "left_anti")
