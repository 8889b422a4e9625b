"""Latest-wins views over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str] | None = None) -> DataFrame:
    """One row a key: the greatest by `order`. An aggregate with partial maxima, so a hot key sends one row a task."""
    rest = columns or [c for c in df.columns if c not in keys]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)])
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def latest_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in `order`; Spark prunes by rank before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def live(rows: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """Rows that no overlay row names."""
    return rows.join(overlay.select(key), key, "left_anti")


def append_new(log: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The rows of `new` to append: the first of each key, none that the log has."""
    first = latest_n(new, keys, order, 1) if order else new.dropDuplicates(keys)
    return first.join(log.select(*keys), keys, "left_anti")


def exact_over_cluster(exact: DataFrame, cluster: DataFrame, members: DataFrame, order: list[str | Column]) -> DataFrame:
    """(synthesis, digest, verdict): the latest review of a point for its synthesis, else the latest for its cluster.

    exact (synthesis, digest, verdict, ...), cluster (cluster_id, digest, verdict, ...), members (synthesis, cluster_id).
    """
    own = latest_by(exact, ["synthesis", "digest"], order, ["verdict"])
    wide = members.join(latest_by(cluster, ["cluster_id", "digest"], order, ["verdict"]), "cluster_id").select("synthesis", "digest", F.col("verdict").alias("_wide"))
    return own.join(wide, ["synthesis", "digest"], "full_outer").select("synthesis", "digest", F.coalesce("verdict", "_wide").alias("verdict"))
