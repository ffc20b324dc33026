"""File reports: missing files, checksum results, readiness, preferred files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_files(required: DataFrame, listing: DataFrame) -> DataFrame:
    return required.join(listing.select("path"), "path", "left_anti")


def verify_manifest(manifest: DataFrame, checksums: DataFrame) -> DataFrame:
    """Adds status to the manifest's files: no entry, mismatch or ok."""
    known = checksums.select("path", F.col("sha256").alias("_want"))
    status = F.when(F.col("_want").isNull(), "no entry").when(F.col("_want") != F.col("sha256"), "mismatch").otherwise("ok")
    return manifest.join(known, "path", "left").withColumn("status", status).drop("_want")


def readiness(required: DataFrame, listing: DataFrame) -> DataFrame:
    """Each kind's state and its missing files, from required (kind, path)."""
    there = listing.select("path", F.lit(True).alias("_there")).distinct()
    gap = F.col("_there").isNull()
    rows = required.join(there, "path", "left").groupBy("kind").agg(F.max(gap.cast("int")).alias("_gap"), F.sort_array(F.collect_list(F.when(gap, F.col("path")))).alias("missing"))
    return rows.select("kind", F.when(F.col("_gap") == 0, "ready").otherwise("missing").alias("state"), "missing")


def pick_file(listing: DataFrame, preferred: list[str], suffix: str = ".onnx", depth: int = 2) -> DataFrame:
    """The file to load: preferred names in their order, else the first with the suffix by path, down to a depth."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.coalesce(*[F.when(name == p, F.lit(i)) for i, p in enumerate(preferred)], F.when(F.endswith("path", F.lit(suffix)), F.lit(len(preferred))))
    rows = listing.where(F.size(F.split("path", "/")) <= depth).withColumn("_rank", rank).where("_rank is not null")
    return rows.agg(F.min_by("path", F.struct("_rank", "path")).alias("path"))
