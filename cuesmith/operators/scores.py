"""Tables of model scores: top k, re-ranking, best path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(scores: DataFrame, k: int, key: list[str]) -> DataFrame:
    """The k largest scores of each group (score descending, id ascending) as rank from 1; not-a-number scores are an error."""
    if k < 1:
        raise ValueError("k is below 1")
    sound = F.when(F.isnan("score") | (F.abs("score") == float("inf")), F.raise_error(F.lit("score isn't finite"))).otherwise(F.col("score"))
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "id")
    return scores.withColumn("score", sound).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, finished: DataFrame, width: int, end_token: int, limit: int) -> DataFrame:
    """One step of re-ranking: candidates (utt, step, token, acoustic, prev, path) get the mean score of their path and are merged with
    the finished paths kept so far; the best `width` of each utterance stay, open or terminal."""
    score = (F.col("prev") * (F.col("step") - 1) + F.col("acoustic")) / F.col("step")
    new = candidates.withColumn("normalized", score).withColumn("terminal", (F.col("token") == end_token) | (F.col("step") >= limit))
    columns = ["utt", "step", "token", "normalized", "path", "terminal"]
    every = new.select(*columns).unionByName(finished.select(*columns))
    order = Window.partitionBy("utt").orderBy(F.col("normalized").desc(), "path")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width)


def best_path(candidates: DataFrame, final: bool) -> DataFrame:
    """The best path of each utterance: a finished one first when final, otherwise the best open one with a path."""
    first = F.col("terminal") if final else ~F.col("terminal") & (F.size("path") > 0)
    best = F.max_by(F.struct("path", "normalized", "terminal"), F.struct(first.cast("int").alias("c"), F.col("normalized").alias("s")))
    return candidates.groupBy("utt").agg(best.alias("_b")).select("utt", "_b.*")
