"""Sinks: transcripts as JSON, training sets, SRT files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_transcripts(df: DataFrame, path: str) -> None:
    """JSON lines in which absent values are null."""
    df.write.option("ignoreNullFields", "false").json(path)


def dataset_rows(df: DataFrame, sample_rate: int = 16_000) -> DataFrame:
    """Training-set records of successful segments (session_id, seg_idx, text, ..., event_time): ids come from the segment and times from
    the event, so a replay gives the same records."""
    return df.where("success").select(
        F.sha2(F.concat_ws(":", F.col("session_id").cast("string"), F.col("seg_idx").cast("string")), 256).alias("id"),
        "text",
        "raw_text",
        "duration",
        F.lit(sample_rate).alias("sample_rate"),
        "inference_latency",
        "confidence",
        F.col("event_time").alias("timestamp"),
        F.to_date("event_time").alias("day"),
    )


def append_dataset(df: DataFrame, path: str, mode: str = "append") -> None:
    dataset_rows(df).write.mode(mode).partitionBy("day").json(path)


def write_srt(texts: DataFrame, path: str) -> None:
    """SRT texts (a key column and srt), one folder per key."""
    key = next(c for c in texts.columns if c != "srt")
    texts.select(key, "srt").write.partitionBy(key).text(path)
