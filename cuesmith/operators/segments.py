"""Capture sessions, speech segments and the endpoint rule."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the endpoint rule, in frames of 10 ms.
START_WINDOW, START_NEEDED, MAYBE_WINDOW = 20, 15, 7
RATE, FRAME = 16_000, 160


def capture_sessions(events: DataFrame, mode: str, key: str = "stream_id") -> DataFrame:
    """Capture intervals (stream_id, capture_idx, start_ts, end_ts) from events (ts, seq, action in start and end).

    hold and start_end: a repeated start and a stray end are ignored. toggle: every start flips the state and ends are ignored.
    A session without an end has a null end_ts.
    """
    own = Window.partitionBy(key).orderBy("ts", "seq")
    if mode == "toggle":
        marks = events.where("action = 'start'").withColumn("_n", F.row_number().over(own))
        marks = marks.withColumn("action", F.when(F.col("_n") % 2 == 1, "start").otherwise("end"))
    elif mode in ("hold", "start_end"):
        marks = events.where("action in ('start', 'end')").withColumn("_last", F.lag("action", 1, "end").over(own))
        marks = marks.where("action <> _last")
    else:
        raise ValueError(f"no capture mode {mode}")
    rows = marks.withColumn("end_ts", F.lead("ts").over(own)).where("action = 'start'")
    return rows.select(key, (F.row_number().over(own) - 1).alias("capture_idx"), F.col("ts").alias("start_ts"), "end_ts")


def frames_in_capture(frames: DataFrame, captures: DataFrame, tail_ms: int, key: str = "stream_id", bucket_s: int = 3600) -> DataFrame:
    """Frames (ts) with the capture they fall in: start <= ts < end + tail. A range join by stream and time bucket.

    An open capture takes all later frames of its stream: it covers the buckets up to the stream's last frame.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    latest = frames.groupBy(key).agg(F.max(micros("ts")).alias("_latest"))
    size = bucket_s * 1_000_000
    ends = captures.join(latest, key).withColumn("_to", F.coalesce(micros("end_ts") + tail_ms * 1000, F.col("_latest") + 1))
    ends = ends.where(F.col("_to") > micros("start_ts")).withColumn("_b", F.explode(F.sequence(F.floor(micros("start_ts") / size), F.floor((F.col("_to") - 1) / size))))
    rows = frames.withColumn("_b", F.floor(micros("ts") / size)).join(ends.drop("_latest"), [key, "_b"])
    return rows.where((micros("ts") >= micros("start_ts")) & (micros("ts") < F.col("_to"))).drop("_b", "_to")


def valid_segments(segments: DataFrame, least_ms: int, most_ms: int) -> DataFrame:
    """Segments with speech of at least `least_ms`, and why they ended: finish, max_duration or end_silence."""
    reason = F.when(F.col("finished"), "finish").when(F.col("speech_ms") >= most_ms, "max_duration").otherwise("end_silence")
    return segments.where((F.col("end_sample") > F.col("start_sample")) & (F.col("speech_ms") > 0) & (F.col("speech_ms") >= least_ms)).withColumn("reason", reason)


def pad_segments(segments: DataFrame, pre: int, tail: int, total: str = "total_samples", key: str = "session_id") -> DataFrame:
    """Audio bounds: `pre` samples before and `tail` after, within the audio and not before the last segment's end."""
    own = Window.partitionBy(key).orderBy("seg_idx")
    rows = segments.withColumn("audio_end_sample", F.least(F.col("end_sample") + tail, F.col(total)))
    last = F.coalesce(F.max("audio_end_sample").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("audio_start_sample", F.greatest(F.greatest(F.col("start_sample") - pre, F.lit(0)), last))


def frame_counters(frames: DataFrame, key: str = "stream_id") -> DataFrame:
    """Adds cum, the running count of speech frames, and silence_run, the frames without evidence up to this one."""
    own = Window.partitionBy(key).orderBy("frame")
    rows = frames.withColumn("cum", F.sum(F.col("evidence").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(own)
    last = F.max(F.when(F.col("evidence"), F.col("_n"))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_n", place).withColumn("silence_run", (F.col("_n") - F.coalesce(last, F.lit(0))).cast("int")).drop("_n")


@dataclass
class Params:
    """Settings of the endpoint rule, in frames."""

    start_margin: int = 30
    end_margin: int = 30
    gap: int = 300
    response_timeout: int = 6_000
    speech_end: int = 800
    longest: int = 6_000
    #: Slots of the frame history; 0 keeps every frame, 256 overwrites as a ring does.
    ring: int = 0
    #: An early sign of the end after so many silent frames (None: no sign); it may come again after pre_end_again frames.
    pre_end: int | None = None
    pre_end_again: int = 100
    #: A late sign so many frames after the end of speech (None: no sign).
    delayed_end: int | None = None
    #: Speech needs this much more than an even probability; energy above this counts.
    threshold: float = 0.0
    energy_threshold: float = 0.0

    @classmethod
    def from_ms(cls, pre_roll: int, tail: int, silence: int, longest: int, **more) -> Params:
        return cls(*(ms * RATE // 1000 // FRAME for ms in (pre_roll, tail, silence)), longest=longest * RATE // 1000 // FRAME, **more)

    def check(self) -> Params:
        if min(self.start_margin, self.end_margin, self.gap, self.response_timeout, self.speech_end, self.longest, self.pre_end_again, self.pre_end or 0, self.delayed_end or 0) < 0:
            raise ValueError("negative frame count")
        if not (math.isfinite(self.energy_threshold) and 0 <= self.threshold <= 1):
            raise ValueError("threshold isn't finite or not within 0 and 1")
        return self


def check_params(settings: DataFrame) -> DataFrame:
    """Rows of settings (columns named as in Params, as many as there are) with `problem`, null where they are sound: a negative or
    missing frame count, a threshold outside 0 to 1, one that isn't finite."""
    has = set(settings.columns)
    counts = [c for c in ("start_margin", "end_margin", "gap", "response_timeout", "speech_end", "longest", "pre_end_again") if c in has]
    optional = [c for c in ("pre_end", "delayed_end") if c in has]
    unsound = [F.when(F.col(c).isNull() | (F.col(c) < 0), f"{c} is negative or missing") for c in counts] + [F.when(F.col(c) < 0, f"{c} is negative") for c in optional]
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    unsound += [F.when(~finite(c), f"{c} isn't finite") for c in ("threshold", "energy_threshold") if c in has]
    unsound += [F.when(~F.col(c).between(0, 1), f"{c} isn't within 0 and 1") for c in ("threshold",) if c in has]
    return settings.withColumn("problem", F.coalesce(*unsound, F.lit(None).cast("string")))


@dataclass
class Endpoint:
    """The endpoint state of one stream, fed frame by frame; it keeps counters only, as far back as its windows reach.

    cum counts speech frames and stands still in a segment longer than the longest. margin is the frame that ended the first end_margin
    silent frames, as long as the silence lasts; delay says how many frames up to this one belong to speech that may be read now.
    """

    params: Params
    frame: int = -1
    cum: list[int] = field(default_factory=list)
    runs: list[int] = field(default_factory=list)
    first: int = 0
    start: int = -1
    maybe: int = -1
    last_end: int = -1
    last_real: int = 0
    segments: int = 0
    margin: int = -1
    delay: int = 0
    signalled: int = -1
    late: bool = False
    status: str = "none"

    def _at(self, counts: list[int], frame: int) -> int:
        frame = max(frame, 0)
        if self.params.ring:
            frame += self.params.ring * ((self.frame - frame) // self.params.ring)
        return counts[frame - self.first] if frame >= self.first else 0

    def _silent(self, frames: int) -> bool:
        """Has the count stood still for so many frames?"""
        return self.frame > frames and self._at(self.cum, self.frame) == self._at(self.cum, self.frame - frames)

    def _open(self, frame: int) -> tuple[str, int, int, int]:
        self.delay = self.params.start_margin + START_WINDOW + 1 if frame - START_WINDOW > self.params.start_margin else frame + 1
        self.segments += 1
        self.start = max(self.last_end, frame - self.delay) + 1
        self.maybe = self.signalled = -1
        self.late = False
        return ("start", frame, self.start, frame - min(START_WINDOW, frame))

    def _close(self, end: int, real: int) -> tuple[str, int, int, int]:
        self.start, self.margin, self.last_end, self.last_real = -1, -1, end, real
        return ("end", self.frame, end, real)

    def _quiet(self, kind: str) -> tuple[str, int, int, int]:
        self.delay, self.late = 0, kind == "delayed_end"
        if kind == "timeout":
            self.signalled = -1
        return (kind, self.frame, self.frame, self.frame)

    def _early(self, window: int) -> tuple[str, int, int, int] | None:
        if self.params.pre_end is None or window <= self.params.gap or self.signalled >= 0 or not self._silent(window):
            return None
        self.signalled = self.frame
        return ("pre_end", self.frame, self.frame, self.frame)

    def feed(self, evidence: bool, last: bool = False) -> tuple[str, int, int, int] | None:
        """One frame; what it brings about: (kind, frame, bound, true bound)."""
        p = self.params
        self.frame += 1
        counts = evidence and not (self.start >= 0 and self.frame - self.start > p.longest)
        self.cum.append((self.cum[-1] if self.cum else 0) + counts)
        self.runs.append(0 if evidence else (self.runs[-1] if self.runs else 0) + 1)
        keep = max(p.gap, START_WINDOW, p.ring, p.end_margin, p.pre_end or 0) + MAYBE_WINDOW + 2
        if len(self.cum) > 2 * keep:
            drop = len(self.cum) - keep
            del self.cum[:drop], self.runs[:drop]
            self.first += drop
        window = max(0, min(p.pre_end or 0, p.speech_end - 1))
        if window < p.gap and self.signalled > 0 and self.start > 0 and self.frame - self.signalled > max(p.pre_end_again, p.gap - window):
            self.signalled = -1
        found = self._waiting(window) if self.start < 0 else self._speaking(window, last)
        if found:
            self.status = found[0]
        return found

    def _waiting(self, window: int) -> tuple[str, int, int, int] | None:
        p, f, now = self.params, self.frame, self._at(self.cum, self.frame)
        self.status = "none"
        if now - self._at(self.cum, f - START_WINDOW) >= START_NEEDED:
            return self._open(f)
        if self.maybe < 0 or f - self.maybe > p.gap:
            self.maybe = -1
        elif now - self._at(self.cum, f - 1) == 1 and now - self._at(self.cum, self.maybe) >= START_NEEDED:
            return self._open(self.maybe + START_WINDOW)
        since = f + 1 - self.last_real
        if self.segments == 0 and f > p.response_timeout:
            return self._quiet("timeout")
        if self.segments and p.delayed_end is not None and not self.late and since > p.delayed_end:
            return self._quiet("delayed_end")
        if self.segments and since > p.speech_end:
            return self._quiet("timeout")
        if self.maybe < 0 and now - self._at(self.cum, f - MAYBE_WINDOW) >= MAYBE_WINDOW:
            self.maybe = f - MAYBE_WINDOW
        return self._early(window) if self.segments else None

    def _speaking(self, window: int, last: bool) -> tuple[str, int, int, int] | None:
        p, f = self.params, self.frame
        if early := self._early(window):
            return early
        if self._silent(p.gap):
            real = f - p.gap - self._at(self.runs, f - p.gap)
            return self._close(real + p.end_margin, real)
        if last:  # speech ends where a silence of end_margin frames was seen, or with the last frame
            margin, self.delay = self.margin, int(self.margin < 0)
            return self._close(margin, margin - p.end_margin) if margin > 0 else self._close(f, f)
        if self.margin < 0:
            still = self._silent(p.end_margin)
            self.margin, self.delay = (f, 0) if still else (-1, 1)
        else:
            still = self._silent(1)
            self.margin, self.delay = (self.margin, 0) if still else (-1, f + 1 - self.margin)
        self.status = "none" if still else "speech"
        return None


EVENTS = "stream_id string, frame long, kind string, bound long, real_bound long"


#: One row a frame: what the endpoint rule made of it, and its counters.
FRAMES = "stream_id string, frame long, evidence boolean, status string, cum long, silence_run int, delay int, margin long"


def endpoint(frames: DataFrame, params: Params = Params()) -> DataFrame:
    """Speech starts, ends, early and late signs of the end and timeouts of frames (stream_id, frame, evidence), one sort per stream; the
    last frame flushes: a segment still open ends where its last silence of end_margin frames was seen, if it lasts, or with the stream.

    The rule is sequential within a stream, so a stream is one group; only its flags are shuffled, never samples, and they come in
    batches, so memory is bounded by the rule's windows.
    """
    row = lambda stream, flag, state, found: (stream, found[1], found[0], *found[2:]) if found else None
    return _passed(frames, params, row, EVENTS)


def endpoint_frames(frames: DataFrame, params: Params = Params()) -> DataFrame:
    """Every frame with the endpoint's status (none, speech, or the event's kind), the speech count, which stands still in a segment beyond
    the longest, the silence run, how many frames may be read as speech, and the frame where the running silence became long (-1: none)."""
    row = lambda stream, flag, s, _: (stream, s.frame, flag, s.status, s.cum[-1], s.runs[-1], s.delay, s.margin)
    return _passed(frames, params, row, FRAMES)


def _passed(frames: DataFrame, params: Params, row, schema: str) -> DataFrame:
    """What row(stream, flag, state, event) gives for each frame, None left out."""
    params.check()
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, waiting, stream = Endpoint(params), None, None
        for part in group:
            stream, rows = part.stream_id.iloc[0], []
            for flag in part.evidence:
                if waiting is not None:
                    rows.append(row(stream, waiting, state, state.feed(waiting)))
                waiting = bool(flag)
            yield pd.DataFrame([r for r in rows if r is not None], columns=columns)
        if waiting is not None:
            found = row(stream, waiting, state, state.feed(waiting, last=True))
            yield pd.DataFrame([found] if found is not None else [], columns=columns)

    whole = frames.select("stream_id", "frame", "evidence").repartition("stream_id").sortWithinPartitions("stream_id", "frame")
    return whole.mapInPandas(_by_stream(run), schema)


def _by_stream(run):
    """Feeds a sorted partition's streams to `run` one after another, batch by batch."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cut() -> Iterator[pd.DataFrame]:
            for batch in batches:
                change = batch.stream_id.ne(batch.stream_id.shift()).cumsum()
                for _, part in batch.groupby(change):
                    yield part

        pieces, ahead = cut(), None
        ahead = next(pieces, None)
        while ahead is not None:
            name, first = ahead.stream_id.iloc[0], ahead
            ahead = None

            def own() -> Iterator[pd.DataFrame]:
                nonlocal ahead
                yield first
                for piece in pieces:
                    if piece.stream_id.iloc[0] != name:
                        ahead = piece
                        return
                    yield piece

            yield from run(own())

    return parts


def segments_from_events(events: DataFrame, params: Params = Params()) -> DataFrame:
    """Segments (stream_id, seg_idx, start_sample, end_sample, speech_ms) from the endpoint's starts and ends."""
    own = Window.partitionBy("stream_id").orderBy("frame")
    rows = events.where("kind in ('start', 'end')").withColumn("_from", F.lag("real_bound").over(own)).withColumn("_audio", F.lag("bound").over(own)).where("kind = 'end'")
    to = lambda c: (F.greatest(c, F.lit(0)) * FRAME).cast("long")
    return rows.select(
        "stream_id",
        (F.row_number().over(own) - 1).alias("seg_idx"),
        to(F.col("_from")).alias("start_sample"),
        to(F.col("real_bound")).alias("end_sample"),
        to(F.col("_audio")).alias("audio_start_sample"),
        to(F.col("bound")).alias("audio_end_sample"),
        ((F.col("real_bound") - F.col("_from")) * 10).cast("long").alias("speech_ms"),
    )


def check_stream_order(tasks: DataFrame, key: str = "worker_id") -> DataFrame:
    """Tasks (type in start, audio, end) with `problem`: audio or end without a start, or a start before the last stream's end."""
    own = Window.partitionBy(key).orderBy("seq")
    last = F.last(F.when(F.col("type").isin("start", "end"), F.col("type")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    open_: Column = F.coalesce(last == "start", F.lit(False))
    problem = F.when((F.col("type") == "start") & open_, "started twice").when((F.col("type") != "start") & ~open_, F.concat(F.col("type"), F.lit(" without start")))
    return tasks.withColumn("problem", problem)
