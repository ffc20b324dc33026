"""Exact duplicates by distributed MSD radix partitioning: groups split by successive bytes until they are singletons or their texts end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.common import row_ids, save

#: Bytes that the first level looks at, and how many times more each further level takes.
FIRST_BYTES, WIDER = 128, 8
#: Rows from which a group is hot, the most groups (the largest) that are sent to all tasks, and the most bytes that these may have together.
HOT_ROWS, HOT_GROUPS, HOT_BYTES = 1024, 1024, 64 << 20


def _split(rows: DataFrame, width: int) -> DataFrame:
    """One level: the rows' groups split by their next `width` bytes.

    A group is named by the smallest row number in it, so names are exact. Counting combines on the map side. Rows of the largest groups
    get their group's row by broadcast, at most HOT_GROUPS rows of `width` bytes and never more than HOT_BYTES, and then join by numbers of
    their own, so that they spread; all others join by group and bytes, a join whose large side Spark may split.
    """
    rows = rows.withColumn("chunk", F.expr(f"substring(rest, 1, {width})"))
    best = F.max(F.struct("doc_id", "rid"))
    groups = save(rows.groupBy("grp", "chunk").agg(F.min("rid").alias("next"), F.count("*").alias("n"), best.alias("best")))
    if HOT_GROUPS * width <= HOT_BYTES:
        hot = groups.where(f"n >= {HOT_ROWS}").orderBy(F.col("n").desc(), "next").limit(HOT_GROUPS)
        hot = hot.select("grp", "chunk", F.struct("next", "n", "best").alias("hot"))
        rows = rows.join(F.broadcast(hot), ["grp", "chunk"], "left")
        own = F.col("hot").isNotNull()
        groups = groups.select(F.col("grp").alias("key"), F.col("chunk").alias("bytes"), F.struct("next", "n", "best").alias("cold"))
        rows = rows.withColumn("key", F.when(own, -1 - F.col("rid")).otherwise(F.col("grp"))).withColumn("bytes", F.when(~own, F.col("chunk")))
        rows = rows.join(groups, ["key", "bytes"], "left").withColumn("found", F.coalesce("hot", "cold")).select("rid", "doc_id", "sha", "chunk", "rest", "found.*")
    else:
        rows = rows.join(groups, ["grp", "chunk"])
    done = (F.col("n") == 1) | (F.octet_length("chunk") < width)
    return rows.withColumn("rest", F.when(~done, F.expr(f"substring(rest, {width + 1})"))).select("rid", "doc_id", "sha", F.col("next").alias("grp"), "n", "best", "rest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rid: str | None = None) -> DataFrame:
    """One row per row of docs: rid, doc_id, keep_id (the largest doc_id of its equal texts), group_size, kept, text_sha256.

    A wide radix: no digest takes part in finding equal texts: level after level, groups split by their texts' next bytes (128, then 1024, 8192, ...),
    and only rows whose group is neither single nor ended go on, with what is left of their texts. Ended: the text has no byte beyond the
    level, so all rows of the group are equal. The number of levels grows with the logarithm of the longest repeated beginning.
    Null text counts as empty; all empty texts are equal. Of rows that repeat the largest doc_id too, the one that comes last stays;
    null doc_ids come before all others. Very long texts take more levels, never more memory than their own bytes; columns other than
    id and text aren't read. docs must be a plain scan, or have its own row number in column `rid`.
    """
    rows = docs if rid else row_ids(docs, "rid")
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = rows.select(F.col(rid or "rid").alias("rid"), F.col(id_col).alias("doc_id"), F.unhex(F.sha2(data, 256)).alias("sha"), F.lit(0).cast("long").alias("grp"), data.alias("rest"))
    levels, width = [], FIRST_BYTES
    while True:
        level = save(_split(rows, width))
        levels.append(level)
        rows = level.where("rest is not null").select("rid", "doc_id", "sha", "grp", "rest")
        if rows.isEmpty():
            break
        width *= WIDER
    ended = reduce(DataFrame.unionByName, [level.where("rest is null").drop("rest", "grp") for level in levels])
    return ended.select(
        "rid",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text equals another's that stays; docs' own columns and whole rows."""
    name = "rid"
    while name in docs.columns:
        name += "_"
    numbered = row_ids(docs, name)
    gone = save(exact_groups(numbered, id_col, text, rid=name).where("not kept").select(F.col("rid").alias(name)))
    return numbered.join(gone, name, "left_anti").drop(name)
