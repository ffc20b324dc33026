"""Caption cues from transcripts: clause parts, their times, SRT text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.functions import text as X

RATE = 16_000
LEAST_CUE_MS = 500


def samples_to_ms(samples: Column) -> Column:
    return F.floor(samples * 1000 / RATE).cast("long")


def seconds_to_ms(seconds: Column) -> Column:
    return F.round(F.greatest(seconds.cast("double"), F.lit(0.0)) * 1000).cast("long")


def captionable(transcripts: DataFrame) -> DataFrame:
    """Successful transcripts whose text isn't blank."""
    return transcripts.where(F.col("success") & (X.trimmed(F.col("text")) != ""))


def parts(df: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """One row per caption part of a row's text: part_idx from 0, part, n_parts."""
    cut = df.withColumn("_parts", X.split_long(X.split_clauses(F.col(text)), limit))
    kept = [c for c in cut.columns if c != "_parts"]
    return cut.select(*kept, F.size("_parts").alias("n_parts"), F.posexplode("_parts").alias("part_idx", "part"))


def allot_cues(df: DataFrame, key: list[str]) -> DataFrame:
    """Cue times by text length: part_idx, part, start_ms and end_ms (of the segment) become cue_idx, text, start_ms, end_ms.

    A part's share of the segment is at least 500 ms, ends stay within the segment, the last cue ends with it, none is shorter than 1 ms.
    """
    chars = F.greatest(F.length("part"), F.lit(1)).cast("long")
    rows = df.withColumn("_end", F.greatest(F.col("end_ms"), F.col("start_ms") + 1)).withColumn("_chars", chars)
    all_parts = Window.partitionBy(*key)
    so_far = all_parts.orderBy("part_idx").rowsBetween(Window.unboundedPreceding, 0)
    share = F.greatest(F.floor((F.col("_end") - F.col("start_ms")) * F.col("_chars") / F.sum("_chars").over(all_parts)), F.lit(LEAST_CUE_MS))
    stop = F.when(F.col("part_idx") + 1 == F.col("n_parts"), F.col("_end")).otherwise(F.least(F.col("start_ms") + F.sum(share).over(so_far), F.col("_end")))
    rows = rows.withColumn("_stop", stop.cast("long"))
    rows = rows.withColumn("_from", F.coalesce(F.lag("_stop").over(all_parts.orderBy("part_idx")), F.col("start_ms")))
    return rows.select(*key, F.col("part_idx").alias("cue_idx"), F.col("_from").alias("start_ms"), F.greatest("_stop", F.col("_from") + 1).alias("end_ms"), F.col("part").alias("text"))


def strip_last(cues: DataFrame, key: list[str]) -> DataFrame:
    """The trailing period of each recording's last cue dropped."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("start_ms").desc(), F.col("cue_idx").desc())) == 1
    return cues.withColumn("text", F.when(last, X.strip_period(F.col("text"))).otherwise(F.col("text")))


def token_step(times: Column) -> Column:
    """Upper median of the positive gaps between token times, within 0.08 and 0.8; 0.3 where there is none."""
    gaps = F.filter(F.zip_with(F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0))), times, lambda b, a: b - a), lambda d: d > 0)
    gaps = F.sort_array(gaps)
    middle = F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))
    return F.when(F.size(gaps) == 0, F.lit(0.3)).otherwise(F.least(F.greatest(middle, F.lit(0.08)), F.lit(0.8)))


def align_parts(parts_: Column, tokens: Column, end: Column) -> Column:
    """Parts with the times of the tokens that they take: array of (text, start, end).

    tokens: array of (text, ts). Each part takes tokens until its compact length is met; what is over isn't carried on. It ends where the
    next token begins, or one step after its last, at most at `end`. Parts for which no token is left are dropped.
    """
    timed = F.filter(F.transform(tokens, lambda t: F.struct(F.length(X.compact(t["text"])).alias("n"), t["ts"].cast("double").alias("ts"))), lambda t: t["n"] > 0)
    step = token_step(F.transform(timed, lambda t: t["ts"]))
    group = "array<struct<text:string,start:double,end:double>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(group).alias("out"))

    def take(acc: Column, part: Column) -> Column:
        want = F.length(X.compact(part))
        rest = F.slice(timed, acc["at"] + 1, F.greatest(F.size(timed) - acc["at"], F.lit(0)))
        taken = F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(0).alias("got")), lambda s, t: F.when(s["got"] < want, F.struct((s["n"] + 1).alias("n"), (s["got"] + t["n"]).alias("got"))).otherwise(s))["n"]
        stop = acc["at"] + taken
        first, last = F.get(timed, acc["at"])["ts"], F.get(timed, stop - 1)["ts"]
        ends = F.greatest(F.coalesce(F.get(timed, stop)["ts"], F.least(last + step, end)), first)
        row = F.array(F.struct(part.alias("text"), first.alias("start"), ends.alias("end"))).cast(group)
        skip = (want == 0) | (acc["at"] >= F.size(timed))
        return F.when(skip, acc).otherwise(F.struct(stop.alias("at"), F.concat(acc["out"], row).alias("out")))

    return F.when(F.size(timed) == 0, F.array().cast(group)).otherwise(F.aggregate(parts_, start, take, lambda acc: acc["out"]))


def caption(segments: DataFrame, limit: int, key: str = "session_id") -> DataFrame:
    """Cues of transcribed segments: session_id, cue_idx, start_ms, end_ms, text.

    segments: session_id, seg_idx, text, raw_text, tokens, token_timestamps (may be null) and the four sample bounds. Token times are
    used where there are as many as tokens; otherwise a segment's time is shared by text length. The last cue loses its period.
    """
    own = [key, "seg_idx"]
    timed = F.transform(F.arrays_zip(F.col("tokens").alias("text"), F.col("token_timestamps").alias("ts")), lambda t: F.struct(t["text"].alias("text"), t["ts"].alias("ts")))
    usable = F.coalesce((F.size("tokens") > 0) & (F.size("tokens") == F.size("token_timestamps")) & (X.compact(F.col("raw_text")) != ""), F.lit(False))
    seconds = (F.col("audio_end_sample") - F.col("audio_start_sample")) / RATE
    none = F.array().cast("array<struct<text:string,start:double,end:double>>")
    rows = segments.where(X.trimmed(F.col("text")) != "").withColumn("_parts", X.split_long(X.split_clauses(F.col("text")), limit))
    rows = rows.withColumn("_groups", F.when(usable, align_parts(F.col("_parts"), timed, seconds)).otherwise(none))
    offset, stop = samples_to_ms(F.col("audio_start_sample")), samples_to_ms(F.col("audio_end_sample"))
    aligned = rows.where(F.size("_groups") > 0).select(*own, offset.alias("_offset"), F.greatest(stop, offset + 1).alias("_stop"), F.posexplode("_groups").alias("cue_idx", "_g"))
    start = F.least(F.col("_offset") + seconds_to_ms(F.col("_g.start")), F.col("_stop") - 1)
    aligned = aligned.withColumn("start_ms", start).withColumn("end_ms", F.least(F.greatest(F.col("_offset") + seconds_to_ms(F.col("_g.end")), F.col("start_ms") + 1), F.col("_stop")))
    by_tokens = aligned.select(*own, "cue_idx", "start_ms", "end_ms", F.col("_g.text").alias("text"))
    shared = rows.where(F.size("_groups") == 0).select(*own, samples_to_ms(F.col("start_sample")).alias("start_ms"), samples_to_ms(F.col("end_sample")).alias("end_ms"), F.size("_parts").alias("n_parts"), F.posexplode("_parts").alias("part_idx", "part"))
    cues = by_tokens.unionByName(allot_cues(shared, own))
    order = Window.partitionBy(key).orderBy("seg_idx", "cue_idx")
    cues = cues.withColumn("cue_idx", F.row_number().over(order) - 1)
    last = F.lead("cue_idx").over(Window.partitionBy(key).orderBy("cue_idx")).isNull()
    return cues.select(key, "cue_idx", "start_ms", "end_ms", F.when(last, X.strip_period(F.col("text"))).otherwise(F.col("text")).alias("text"))


def render_srt(cues: DataFrame, key: list[str]) -> DataFrame:
    """SRT text of each recording, cues in order."""
    line = F.format_string("%d\n%s --> %s\n%s\n", (F.col("cue_idx") + 1).cast("int"), X.clock(F.col("start_ms")), X.clock(F.col("end_ms")), F.col("text"))
    found = cues.select(*key, F.struct("cue_idx", line.alias("line")).alias("_c")).groupBy(*key).agg(F.array_sort(F.collect_list("_c")).alias("_all"))
    return found.select(*key, F.array_join(F.transform("_all", lambda c: c["line"]), "\n").alias("srt"))
