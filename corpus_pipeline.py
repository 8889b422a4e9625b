"""A corpus pipeline over documents: each stage takes the documents its predecessor kept and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.common import written
from sedimenta.llm.language_id import keep_known
from sedimenta.llm.line_dedup import dedup_lines
from sedimenta.llm.mixing import mixed_documents
from sedimenta.llm.near_dedup import drop_near_duplicates
from sedimenta.llm.packing import pack_documents


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters or of no clear language go."""
    return keep_known(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; n_chars follows the text."""
    out = dedup_lines(docs).select(*docs.columns)
    return out.selectExpr(*[f"cast(length(text) as {docs.schema['n_chars'].dataType.simpleString()}) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, whole or in part, once or twice."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return pack_documents(docs)


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("mixing", mix_sources), ("packing", pack)]

#: Neither the random field nor the packing can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
