"""Structured Streaming twins of the batch operators: endpoint, captures, stable prefixes, dataset sink, idle sessions, chunks."""

from __future__ import annotations

import logging
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuesmith.operators.segments import EVENTS, Endpoint, Params
from cuesmith.operators.updates import HISTORY, TAIL_TOKENS
from cuesmith.sources.sinks import append_dataset


class _Pickled(StatefulProcessor):
    """Keeps one small Python object per key in value state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "data binary")

    def load(self, fresh):
        return pickle.loads(self.state.get()[0]) if self.state.exists() else fresh

    def keep(self, value) -> None:
        self.state.update((pickle.dumps(value),))

    def close(self) -> None:
        pass


class EndpointProcessor(_Pickled):
    """Speech starts, ends and timeouts; rows of `frame` come in order within a stream, `last` flushes it."""

    def __init__(self, params: Params):
        self.params = params

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, found = self.load(Endpoint(self.params)), []
        frames = pd.concat(list(rows)).sort_values("frame")
        for evidence, last in zip(frames.evidence, frames["last"], strict=True):
            if event := state.feed(bool(evidence), bool(last)):
                found.append((key[0], event[1], event[0], event[2], event[3]))
        self.keep(state)
        yield pd.DataFrame(found, columns=["stream_id", "frame", "kind", "bound", "real_bound"])


def endpoint_stream(frames: DataFrame, params: Params = Params()) -> DataFrame:
    """endpoint() over a stream of (stream_id, frame, evidence, last). State is the counters within the gap, never samples."""
    return frames.groupBy("stream_id").transformWithStateInPandas(EndpointProcessor(params.check()), EVENTS, "Append", "None")


class CaptureProcessor(_Pickled):
    """Capture starts and ends as they come."""

    def __init__(self, mode: str):
        self.mode = mode

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (open_, index), out = self.load((None, 0)), []
        for row in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            ends = row.action == ("start" if self.mode == "toggle" else "end")
            if open_ is None and row.action == "start":
                open_ = row.ts
            elif open_ is not None and ends:
                out.append((key[0], index, open_, row.ts))
                open_, index = None, index + 1
        self.keep((open_, index))
        yield pd.DataFrame(out, columns=["stream_id", "capture_idx", "start_ts", "end_ts"])


def capture_stream(events: DataFrame, mode: str) -> DataFrame:
    """Captures (stream_id, capture_idx, start_ts, end_ts) of a stream of events (stream_id, ts, seq, action), sent when they end."""
    schema = "stream_id string, capture_idx int, start_ts timestamp, end_ts timestamp"
    return events.groupBy("stream_id").transformWithStateInPandas(CaptureProcessor(mode), schema, "Append", "None")


class ChunkProcessor(_Pickled):
    """Blocks of samples as chunks of one size; keeps what doesn't fill a chunk until more comes or the stream is ended."""

    def __init__(self, size: int):
        self.size = size

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (rest, chunk), out = self.load((np.zeros(0, np.int16), 0)), []
        for block in pd.concat(list(rows)).sort_values("pos").itertuples():
            rest = np.concatenate([rest, np.asarray(block.samples, np.int16)])
            whole = len(rest) // self.size * self.size
            ended = whole < len(rest) and block.last
            for at in range(0, len(rest) if ended else whole, self.size):
                out.append((key[0], chunk, rest[at : at + self.size].tolist()))
                chunk += 1
            rest = rest[len(rest) if ended else whole :]
        self.keep((rest, chunk))
        yield pd.DataFrame(out, columns=["stream_id", "chunk", "samples"])


CHUNKS = "stream_id string, chunk long, samples array<smallint>"


def chunk_stream(frames: DataFrame, size: int = 10_240) -> DataFrame:
    """Samples in chunks of `size`, one row a chunk, from frames (stream_id, pos, samples), pos being the first sample's place.

    A stream of frames also has `last`: a chunk is sent as soon as it is full, a shorter one only when a frame ends its stream. The state
    is less than a chunk of samples. A table of frames is cut at the chunks' bounds, whose places follow from pos: one slice for each
    chunk that a frame touches, put together in order.
    """
    if frames.isStreaming:
        return frames.groupBy("stream_id").transformWithStateInPandas(ChunkProcessor(size), CHUNKS, "Append", "None")
    first, n = F.col("pos"), F.size("samples")
    touched = F.sequence(F.floor(first / size), F.floor((first + n - 1) / size))
    cut = lambda c: F.struct(F.greatest(c * size, first).alias("at"), F.slice("samples", F.greatest(c * size - first, F.lit(0)).cast("int") + 1, F.least(c * size + size - F.greatest(c * size, first), F.lit(size)).cast("int")).alias("s"))
    rows = frames.where(n > 0).select("stream_id", F.explode(F.transform(touched, lambda c: F.struct(c.alias("chunk"), cut(c).alias("part")))).alias("x"))
    rows = rows.groupBy("stream_id", F.col("x.chunk").alias("chunk")).agg(F.array_sort(F.collect_list("x.part")).alias("_all"))
    return rows.select("stream_id", "chunk", F.flatten(F.transform("_all", lambda x: x["s"])).alias("samples"))


class IdleProcessor(_Pickled):
    """One timer a key, set anew by every row; when it fires, nothing has come for that long."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count = self.load(0) + sum(map(len, rows))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        self.keep(count)
        yield pd.DataFrame([], columns=["key", "idle_at", "events"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        count = self.load(0)
        self.state.clear()
        yield pd.DataFrame([(str(key[0]), at, count)], columns=["key", "idle_at", "events"])


def idle_alarms(events: DataFrame, seconds: float, key: str = "stream_id") -> DataFrame:
    """An event (key, idle_at, events) for each key of a stream once nothing has come for `seconds` of wall-clock time (0: none): sent by
    a processing-time timer, without a later row. events counts what had come since the last alarm; the next row starts anew."""
    if seconds <= 0:
        return events.select(F.col(key).cast("string").alias(key), F.lit(None).cast("timestamp").alias("idle_at"), F.lit(0).cast("long").alias("events")).where(F.lit(False))
    found = events.select(key).groupBy(key).transformWithStateInPandas(IdleProcessor(seconds), "key string, idle_at timestamp, events long", "Append", "ProcessingTime")
    return found.withColumnRenamed("key", key)


def idle_sessions(events: DataFrame, seconds: int, key: str = "stream_id", late: str = "10 minutes") -> DataFrame:
    """Ends of activity: sessions of a key without an event for `seconds` (0: none). The watermark that bounds the state is ours."""
    if seconds <= 0:
        return events.select(key, F.col("ts").alias("idle_at"), F.lit(0).cast("long").alias("events")).where(F.lit(False))
    source = events.withWatermark("ts", late) if events.isStreaming else events
    session = F.session_window("ts", f"{seconds} seconds")
    return source.groupBy(key, session.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.end").alias("idle_at"), "events")


def frames_in_capture_stream(frames: DataFrame, captures: DataFrame, tail_ms: int, longest_s: int, late_s: int = 600, key: str = "stream_id") -> DataFrame:
    """frames_in_capture() over two streams: frames (ts) with the captures (start_ts, end_ts) they fall in, start <= ts < end + tail.

    A capture is sent once: when it ends, or open, without an end. No capture takes frames later than longest_s after its start, tail
    included; that bound is ours, as are the watermarks: rows may come late_s late, captures also by their own length. So a frame is
    held for longest_s + late_s at most, and a capture for twice that; what was held longer is dropped on both sides.
    """
    f = frames.withWatermark("ts", f"{late_s} seconds").alias("f")
    c = captures.withWatermark("start_ts", f"{late_s + longest_s} seconds").withColumnRenamed(key, "_key").alias("c")
    until = F.timestamp_millis(F.unix_millis("c.end_ts") + tail_ms)
    within = F.expr(f"f.ts >= c.start_ts and f.ts <= c.start_ts + interval {longest_s} seconds")
    return f.join(c, (F.col(f"f.{key}") == F.col("_key")) & within & (F.col("c.end_ts").isNull() | (F.col("f.ts") < until))).drop("_key")


def sink_commits(updates: DataFrame, path: str, checkpoint: str, failed: str | None = None, put=append_dataset):
    """Adds committed segments to a training set, a micro-batch once: its folder is named by the batch, and a replay overwrites it.

    With `failed`, the stream outlives a write that fails: the batch's rows go to that side table with the error, and every later batch
    first tries those again (retry_commits does so after the stream's end). A batch leaves the side table only after its folder is
    whole. Only where the side table can't be written either does the stream stop, with nothing lost, as its offsets aren't committed.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["session_id", "seg_idx"])
        if failed is None:
            return put(rows, f"{path}/batch={number}", "overwrite")
        retry_commits(batch.sparkSession, path, failed, put)
        _try_commit(rows, path, failed, number, put)

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _try_commit(rows: DataFrame, path: str, failed: str, number: int, put) -> bool:
    try:
        put(rows, f"{path}/batch={number}", "overwrite")
    except Exception as e:
        logging.getLogger(__name__).warning("batch %s isn't written, kept in %s: %s", number, failed, e)
        rows.withColumn("commit_error", F.lit(str(e)[:500])).write.mode("overwrite").parquet(f"{failed}/batch={number}")
        return False
    return True


def retry_commits(spark: SparkSession, path: str, failed: str, put=append_dataset) -> int:
    """Writes the batches of the side table again; returns how many of them are still there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(failed)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return 0
    left = 0
    for folder in sorted(str(s.getPath().toString()) for s in system.listStatus(hadoop)):
        number, at = folder.rsplit("batch=", 1)[-1], spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not system.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
            continue  # not whole: its micro-batch is replayed
        try:
            put(spark.read.parquet(folder).drop("commit_error"), f"{path}/batch={number}", "overwrite")
        except Exception as e:
            logging.getLogger(__name__).warning("batch %s isn't written yet: %s", number, e)
            left += 1
            continue
        system.delete(at, True)
    return left


def _alike(rows: list) -> int:
    """Length of the common beginning of sequences."""
    return next((i for i, column in enumerate(zip(*rows, strict=False)) if len(set(column)) > 1), min(map(len, rows)))


STABLE_MARK = re.compile(r"[\s\S]*(?:[，。！？；]|(?<![A-Za-z0-9])[,.!?;]|[,.!?;](?![A-Za-z0-9]))")


class StablePrefixProcessor(_Pickled):
    """The stable part of each update's text; keeps the last snapshots of the running revision epoch."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (history, count), out = self.load(([], 0)), []
        for u in pd.concat(list(rows)).sort_values("sequence").itertuples():
            if u.final_result:
                out.append((key[0], u.sequence, u.text, ""))
                continue
            if u.revision or u.revision_count > count:
                history = []
            count = u.revision_count
            history = [*history, (list(u.tokens), u.text)][-HISTORY:]
            stable = u.text[: u.committed_prefix_chars]
            if len(history) == HISTORY:
                tokens = min(_alike([t for t, _ in history]), max(len(u.tokens) - TAIL_TOKENS, 0))
                chars = min(len("".join(u.tokens[:tokens])), _alike([t for _, t in history]))
                found = STABLE_MARK.match(u.text[:chars])
                stable = max(found.group() if found else "", stable, key=len)
            out.append((key[0], u.sequence, stable, u.text[len(stable) :]))
        self.keep((history, count))
        yield pd.DataFrame(out, columns=["session_id", "sequence", "stable", "unstable"])


def stable_prefix_stream(updates: DataFrame) -> DataFrame:
    """stable_prefix() over a stream of updates with revision and revision_count."""
    schema = "session_id string, sequence int, stable string, unstable string"
    return updates.groupBy("session_id").transformWithStateInPandas(StablePrefixProcessor(), schema, "Append", "None")


class SessionProcessor(_Pickled):
    """Partials, committed segments and the final of a session as numbered updates of its whole transcript."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = {"text": "", "tokens": [], "confidence": 0.0, "segments": 0, "last": "", "revisions": 0, "sequence": 0, "done": False}
        s, out = self.load(fresh), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if s["done"]:
                continue
            text, tokens = s["text"], s["tokens"]
            if r.kind == "partial":
                if not r.text:
                    continue
                text, tokens = text + r.text, [*tokens, *r.tokens]
            elif r.kind == "segment":
                text, tokens = text + r.text, [*tokens, *r.tokens]
                s |= {"text": text, "tokens": tokens, "confidence": s["confidence"] + r.confidence, "segments": s["segments"] + 1}
            final = r.kind == "final"
            if not final and r.kind != "segment" and text == s["last"]:
                continue
            revised = bool(s["last"]) and bool(text) and not text.startswith(s["last"])
            confidence = s["confidence"] / s["segments"] if s["segments"] else (0.0 if final else float(r.confidence))
            s |= {"revisions": s["revisions"] + revised, "sequence": s["sequence"] + 1, "done": final}
            out.append((key[0], s["sequence"], text, list(tokens), len(s["text"]), revised, s["revisions"], confidence, final))
            s["last"] = text or s["last"]
        self.keep(s)
        yield pd.DataFrame(out, columns=SESSION_UPDATES)


SESSION_UPDATES = ["session_id", "sequence", "text", "tokens", "committed_prefix_chars", "revision", "revision_count", "confidence", "final_result"]


def session_updates(rows: DataFrame) -> DataFrame:
    """Updates of sessions from rows (session_id, seq, kind in partial, segment, final; text, tokens, confidence): a commit is always sent,
    a partial only when the text changes, and one final at the end. State is the committed transcript."""
    schema = "session_id string, sequence int, text string, tokens array<string>, committed_prefix_chars int, revision boolean, revision_count int, confidence double, final_result boolean"
    return rows.groupBy("session_id").transformWithStateInPandas(SessionProcessor(), schema, "Append", "None")
