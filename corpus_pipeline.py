"""The training-data pipeline: quality rules, exact duplicates, near duplicates, the mix of sources, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuesmith.llm import exact, jaccard, mixing, packing, queries, repetition
from cuesmith.llm.common import save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep. Null, empty and short texts go; repeated rows are judged alike; no rows give none."""
    return repetition.keep_unrepetitive(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null and empty texts are equal. Repeated rows leave one; no rows give none."""
    return exact.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, that of the smallest doc_id, nulls last; texts without words stay. No rows give none."""
    return jaccard.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, the last one cut. Null sources are one source; texts without words go; no rows give none."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows. Null and empty texts are the end id alone; repeated rows are packed each; no rows give none."""
    return packing.pack(docs, queries.vocabulary(), end_id=2)


#: In this order; each stage's result is written and read again as the next one's docs.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact duplicates", exact_duplicates),
    ("near duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express packing (nor its tokenizer); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
