"""Readers: transcripts, frames, audio files, lexicons, rule lists, vocabularies, manifests, checksums."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesmith.functions import text as X
from cuesmith.sources import schemas


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRANSCRIPTS).json(path)


def read_frames(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of frames from Parquet files."""
    return spark.readStream.schema(schemas.FRAMES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_blocks(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of raw audio blocks (schemas.BLOCKS) from Parquet files; a topic gives the same columns."""
    return spark.readStream.schema(schemas.BLOCKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


BLOCK_FORMATS = {"f32": "<f4", "i16": "<i2", "u16": "<u2"}


def mono_samples(data: bytes, kind: str, channels: int) -> np.ndarray:
    """A block's samples as one channel of 16-bit integers: floats are averaged, clamped to 1 and cut to integers, NaN is silence;
    unsigned ones are shifted; integers are averaged towards zero. A last group with fewer channels is averaged over those it has."""
    x = np.frombuffer(data[: len(data) - len(data) % np.dtype(BLOCK_FORMATS[kind]).itemsize], BLOCK_FORMATS[kind])
    x = x if kind == "f32" else x.astype(np.int64) - (32_768 if kind == "u16" else 0)
    size = max(channels, 1)
    groups = -(-len(x) // size)
    filled = np.zeros(groups * size, x.dtype)
    filled[: len(x)] = x
    count = np.full(groups, size)
    if len(x) % size:
        count[-1] = len(x) % size
    total = np.zeros(groups, x.dtype)
    for c in range(size):
        total = total + filled[c::size]
    if kind == "f32":
        mean = np.clip(total / count.astype(np.float32), np.float32(-1), np.float32(1)) * np.float32(32_767)
        return np.nan_to_num(np.trunc(mean), nan=0.0).astype(np.int16)
    return (np.sign(total) * (np.abs(total) // count)).astype(np.int16)


def frames_of_blocks(blocks: DataFrame) -> DataFrame:
    """Raw blocks (schemas.BLOCKS), a table or a stream, as frames (stream_id, pos, ts, rate, samples); the rate stays that of the block.

    A null or empty block has no samples; a format other than f32, i16 and u16 raises an error, as does one without a format.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, channels, data = (batch.column(c).to_pylist() for c in ("format", "channels", "data"))
            if unknown := {k for k in kinds if k not in BLOCK_FORMATS}:
                raise ValueError(f"no sample format {sorted(map(str, unknown))}")
            found = [mono_samples(d or b"", k, c or 1) for k, c, d in zip(kinds, channels, data, strict=True)]
            samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int16)]), pa.int16()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("stream_id", "pos", "ts", "rate")), samples], names=["stream_id", "pos", "ts", "rate", "samples"])

    return blocks.select("stream_id", "pos", "ts", "format", "channels", "rate", "data").mapInArrow(decode, "stream_id string, pos long, ts timestamp, rate int, samples array<smallint>")


WAV = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("rate", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("samples", T.ArrayType(T.ShortType())),
        T.StructField("error", T.StringType()),
    ]
)


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _decode(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """Channels, rate, bits and 16-bit samples of a WAV file: integers of up to 16 bits as they are, wider ones by their upper 16 bits,
    floats clamped to -1 .. 1 and scaled, rounding towards zero."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    parts = dict(_chunks(data))
    head, body = parts[b"fmt "], parts[b"data"]
    kind, channels = (int.from_bytes(head[i : i + 2], "little") for i in (0, 2))
    rate, bits = int.from_bytes(head[4:8], "little"), int.from_bytes(head[14:16], "little")
    if kind == 0xFFFE:
        kind = int.from_bytes(head[24:26], "little")
    if kind == 3 and bits == 32:
        return channels, rate, bits, (np.clip(np.frombuffer(body, "<f4"), -1, 1) * 32767).astype(np.int16)
    if kind != 1 or bits not in (8, 16, 24, 32):
        raise ValueError(f"format {kind} with {bits} bits")
    if bits == 8:
        return channels, rate, bits, (np.frombuffer(body, np.uint8).astype(np.int16) - 128).astype(np.int16)
    width = bits // 8
    whole = np.frombuffer(body[: len(body) // width * width], np.uint8).reshape(-1, width)
    return channels, rate, bits, whole[:, -2:].copy().view("<i2").ravel()


def ingest_wav(spark: SparkSession, glob: str) -> DataFrame:
    """WAV files as rows (path, channels, rate, bits, n_samples, samples); a file that can't be read has its error instead."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    channels, rate, bits, samples = _decode(content.as_py())
                    rows.append((path, channels, rate, bits, len(samples), samples, None))
                except (ValueError, KeyError, IndexError) as e:
                    rows.append((path, None, None, None, None, None, str(e) or type(e).__name__))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int16()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], WAV.names)

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(decode, WAV)


def wav_bytes(samples: list[int], rate: int = 16_000, channels: int = 1) -> bytes:
    """A 16-bit WAV file, for tests and small exports."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.array(samples, "<i2").tobytes())
    return out.getvalue()


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of whole text files: path, no (from 0), line."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("no", "line"))


def read_lexicon(spark: SparkSession, paths: str | list[str], limit: int = 20_000) -> DataFrame:
    """Words of lexicon files: after the line `...`, blanks and comments skipped, first tab field, valid ones, the first spelling wins."""
    own = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    body = F.coalesce(F.max(F.trim("line") == "...").over(own), F.lit(False))
    rows = _lines(spark, paths).withColumn("_body", body).where("_body")
    rows = rows.withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, '#')").withColumn("word", F.trim(F.element_at(F.split("line", "\t"), 1)))
    rows = rows.where(X.valid_hotword(F.col("word")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("word")).orderBy("path", "no"))).where("_n = 1")
    return rows.orderBy("path", "no").limit(limit).select("word", F.struct("path", "no").alias("ord"))


def lexicon_imports(spark: SparkSession, paths: str | list[str], suffix: str = ".dict.yaml") -> DataFrame:
    """Imports (src, dst, pos) in the heads of lexicon files: the list below `import_tables:`, until its first other line that isn't blank."""
    own = Window.partitionBy("path").orderBy("no")
    rows = _lines(spark, paths).withColumn("line", F.trim(F.element_at(F.split("line", "#"), 1))).where("line <> ''")
    ended = F.max(F.col("line") == "...").over(own.rowsBetween(Window.unboundedPreceding, 0))
    item = F.startswith("line", F.lit("- "))
    rows = rows.where(F.lit(True)).withColumn("_ended", ended).where("not _ended").withColumn("_item", item)
    rows = rows.withColumn("_list", F.last(F.when(~F.col("_item"), F.col("line")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.where("_item and _list = 'import_tables:'").withColumn("dst", F.trim(F.substring("line", 3, 1 << 20)))
    named = F.when(F.col("dst").rlike(r"\.[A-Za-z]+$"), F.col("dst")).otherwise(F.concat("dst", F.lit(suffix)))
    return found.select(F.col("path").alias("src"), named.alias("dst"), (F.row_number().over(own) - 1).alias("pos"))


def read_replacements(spark: SparkSession, path: str) -> DataFrame:
    """Ordered rules `source:target`, plain or gzip: ord, source, target."""
    parts = F.split("line", ":", 2)
    rows = _lines(spark, path).where(F.instr("line", ":") > 1)
    return rows.select(F.col("no").alias("ord"), parts[0].alias("source"), parts[1].alias("target"))


def read_protected(spark: SparkSession, path: str) -> DataFrame:
    """Protected phrases, longest first, each once."""
    return _lines(spark, path).select(F.trim("line").alias("phrase")).where("phrase <> ''").distinct().orderBy(F.length("phrase").desc(), "phrase")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary: the line's number is the token's id; an empty file is an error."""
    found = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("token_id", "token"))
    if found.isEmpty():
        raise ValueError(f"empty vocabulary: {path}")
    return found


def _relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^.*?" + root.rstrip("/").removeprefix("file://").replace(".", r"\.") + "/", "")


def build_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root: kind (first folder), path, length, sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(_relative(F.col("path"), root).alias("path"), "length", F.sha2("content", 256).alias("sha256"))
    return rows.select(F.when(F.instr("path", "/") > 0, F.element_at(F.split("path", "/"), 1)).alias("kind"), "path", "length", "sha256")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Lines `hash name` as path, sha256: a leading * of the name dropped, hashes in lower case, the last of equal names wins."""
    parts = F.split(F.trim("line"), r"\s+", 2)
    rows = _lines(spark, path).where(F.size(parts) == 2).select(F.regexp_replace(parts[1], r"^\*", "").alias("path"), F.lower(parts[0]).alias("sha256"), "no")
    return rows.groupBy("path").agg(F.max_by("sha256", "no").alias("sha256"))
