"""The registry of queries, and adapters that read the test tables as the engine's model tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Fixed moment that stands for now, and a search workload; parameters of the queries.
AS_OF = "2024-02-01 00:00:00"
SEARCHES = ((1, "the ting of and"), (2, "und der die ung"), (3, "que los cion para"), (4, "les des eau tion"), (5, "license copyright software"), (6, "email phone contact address"), (7, "the quick answer is not the question"), (8, "shed tion-ed anan.the"))
PHRASES = ((1, "of the"), (2, "in the"), (3, "de la"), (4, "and.the"))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows, names: str) -> str:
    """A VALUES list for the oracle."""
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS t({names})"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as edges (edge_id, subject, predicate, object, source, confidence, at, n)."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("edge_id"), F.col("l_suppkey").alias("subject"), F.concat("l_returnflag", "l_linestatus").alias("predicate"), F.col("l_partkey").alias("object"),
        F.col("l_orderkey").alias("source"), (1 - F.col("l_discount") * 5).alias("confidence"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"),
    )


EDGES_SQL = """edges AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS edge_id, l_suppkey AS subject, l_returnflag || l_linestatus AS predicate, l_partkey AS object, l_orderkey AS source,
  1 - l_discount * 5 AS confidence, l_shipdate AS at_, l_linenumber AS line, l_quantity AS quantity FROM lineitem)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the log (id, at, origin, kind, payload, value, k)."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("origin"), F.col("event_type").alias("kind"), F.col("props").alias("payload"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


LOG_SQL = "log AS (SELECT event_id AS id, ts AS at_, user_id AS origin, event_type AS kind, props AS payload, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
