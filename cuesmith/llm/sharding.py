"""Sharding by a Feistel permutation of global row numbers with cycle walking: a reproducible shuffle whose places can be computed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.common import save

ROUNDS = 6
#: The round function works on numbers below 2**31, so that no product leaves 63 bits.
SMALL, FIRST, SECOND = (1 << 31) - 1, 1_640_531_527, 1_103_515_245


def round_keys(seed: int) -> list[int]:
    return [(seed * 1_000_003 + i * 7_368_787 + 12_345) & SMALL for i in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of each half of the smallest square domain with n numbers; at least one."""
    return max(1, (max(n - 1, 0).bit_length() + 1) // 2)


def _round(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (x * FIRST + key) & SMALL
    x = ((x ^ (x >> 15)) * SECOND) & SMALL
    return (x ^ (x >> 13)) & mask


def _pass(x: np.ndarray, keys: list[int], bits: int, back: bool) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in reversed(keys) if back else keys:
        left, right = (right ^ _round(left, key, mask), left) if back else (right, left ^ _round(right, key, mask))
    return (left << bits) | right


def permute(x: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The place of each of the numbers x in a permutation of 0 .. n - 1, n at most 2**62 (back: the number at each place).

    A number that the Feistel network sends past n walks on along its cycle until it is below n again; both directions walk the same cycle.
    """
    keys, bits = round_keys(seed), half_bits(n)
    x = _pass(np.asarray(x, np.int64), keys, bits, back)
    while (out := x >= n).any():
        x[out] = _pass(x[out], keys, bits, back)
    return x


def locate(row_number: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of rows, from their numbers alone."""
    place = permute(row_number, n, seed)
    return place % shards, place // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The number of the row that lies in a slot of a shard."""
    return permute(np.asarray(slot) * shards + shard, n, seed, back=True)


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with `row_number` 0, 1, ... in the given order, and how many rows it has.

    A range-partitioned sort, written once; then each partition's numbers start at the sum of the partitions before it. Only those
    sums, one per partition, pass through the driver.
    """
    place = F.monotonically_increasing_id()
    numbered = save(df.orderBy(*order).withColumn("_at", place))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for row in sizes:
        before.append((row.part, total))
        total += row.n
    starts = df.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    joined = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn("row_number", F.col("_before") + within).drop("_part", "_before", "_at"), total


def shard(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its size, row_number, shard and slot; shards' row counts differ by one at most (law `rows`).

    Row numbers go by id, then checksum, then size, so the result doesn't depend on how the input is split into files; rows that are
    equal in all of these are interchangeable. Null ids come first. Null text: size 8 and the checksum of no bytes. Only the id,
    size and checksum are sorted, never the text; other columns aren't read. Equal texts aren't kept together, as the law forbids it.
    An empty table gives no rows.
    """
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + F.lit(8)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows, n = number_rows(slim, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(permute(x.to_numpy(), n, seed))

    placed = rows.withColumn("place", place("row_number"))
    return placed.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {shards}")}).drop("place")
