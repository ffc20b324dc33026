"""Live transcript updates: revisions, stable prefixes, token times, commits, session reports, backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.operators.segments import frames_in_capture

HISTORY, TAIL_TOKENS = 5, 8
SPECIAL = ("<s>", "</s>", "<unk>", "<NOISE>", "<CAT>")


def final_texts(updates: DataFrame) -> DataFrame:
    return updates.where(F.col("final_result") & (F.col("text") != ""))


def drop_repeats(updates: DataFrame, key: str = "session_id", order: str = "sequence") -> DataFrame:
    """Without updates that are neither final nor a commit and whose text equals the one before."""
    last = F.lag("text").over(Window.partitionBy(key).orderBy(order))
    commit = F.col("committed").isNotNull() if "committed" in updates.columns else F.lit(False)
    rows = updates.withColumn("_last", last)
    return rows.where(F.col("final_result") | commit | ~F.col("text").eqNullSafe(F.col("_last"))).drop("_last")


def mark_revisions(updates: DataFrame, key: str = "session_id", order: str = "sequence") -> DataFrame:
    """Adds revision (the last non-empty text isn't a prefix of the new one), revision_count and a new sequence from 1."""
    own = Window.partitionBy(key).orderBy(order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("text") != "", F.col("text")), ignorenulls=True).over(before)
    revised = F.coalesce((F.col("text") != "") & ~F.startswith("text", last), F.lit(False))
    if "inner_revision" in updates.columns:
        revised = revised | F.coalesce("inner_revision", F.lit(False))
    rows = updates.withColumn("revision", revised)
    count = F.sum(F.col("revision").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("revision_count", count.cast("int")).withColumn("new_sequence", F.row_number().over(own))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    short = F.least(F.size(a), F.size(b))
    first = F.array_position(F.slice(same, F.lit(1), short), F.lit(False)).cast("int")
    return F.when(first == 0, short).otherwise(first - 1)


def last_mark(text: Column) -> Column:
    """text up to its last clause mark: full-width ones always, ASCII ones unless between two ASCII letters or digits."""
    stop = r"^[\s\S]*(?:[，。！？；]|(?<![A-Za-z0-9])[,.!?;]|[,.!?;](?![A-Za-z0-9]))"
    return F.regexp_extract(text, stop, 0)


def stable_prefix(updates: DataFrame, key: str = "session_id", order: str = "sequence") -> DataFrame:
    """Adds stable and unstable, the parts of each update's text.

    Within a revision epoch, the last five snapshots' common token prefix less eight tail tokens, at most their common text prefix, cut
    at the last clause mark, but never shorter than the committed prefix. Final updates are stable as a whole.
    """
    own = Window.partitionBy(key).orderBy(order)
    grown = F.coalesce(F.col("revision_count") > F.max("revision_count").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    new = (~F.col("final_result") & (F.col("revision") | grown)).cast("int")
    rows = updates.withColumn("_epoch", F.sum(new).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    snapshots = Window.partitionBy(key, "_epoch", "final_result").orderBy(order).rowsBetween(-(HISTORY - 1), 0)
    rows = rows.withColumn("_seen", F.collect_list(F.struct("tokens", F.filter(F.split("text", ""), lambda c: c != "").alias("chars"))).over(snapshots))
    first = F.get("_seen", F.lit(0))

    def shortest(field: str) -> Column:
        return F.array_min(F.transform("_seen", lambda s: common_prefix(first[field], s[field])))

    tokens = F.least(shortest("tokens"), F.greatest(F.size("tokens") - TAIL_TOKENS, F.lit(0)))
    chars = F.least(F.length(F.array_join(F.slice("tokens", F.lit(1), tokens), "")), shortest("chars"))
    committed = F.left("text", F.col("committed_prefix_chars"))
    inferred = last_mark(F.left("text", chars))
    full = F.size("_seen") >= HISTORY
    stable = F.when(F.col("final_result"), F.col("text")).when(full & (F.length(inferred) >= F.length(committed)), inferred).otherwise(committed)
    rows = rows.withColumn("stable", stable)
    return rows.withColumn("unstable", F.substring("text", F.length("stable") + 1, F.length("text"))).drop("_epoch", "_seen")


def token_times(snapshots: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Times of a session's last tokens from its growing partials: session_id, pos, token, ts.

    A token's deadline is the end of the first snapshot that agrees up to it (repeats of the last tokens don't count), made monotone;
    tokens of one deadline share the time since the one before evenly.
    """
    own = Window.partitionBy(key).orderBy(order)
    end = F.greatest(F.max(F.greatest(F.col("audio_end_s").cast("double"), F.lit(0.0))).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    rows = snapshots.where(F.size("tokens") > 0).withColumn("_end", end)
    rows = rows.withColumn("_same", F.coalesce(F.col("tokens") == F.lag("tokens").over(own), F.lit(False))).withColumn("_last", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())) == 1)
    latest = rows.where("_last").select(key, F.col("tokens").alias("_now"), F.col("_end").alias("_stop"))
    agreed = rows.where(~F.col("_same")).join(latest, key).select(key, "_end", "_stop", common_prefix(F.col("tokens"), F.col("_now")).alias("_n"))
    deadlines = agreed.where("_n > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("pos"), "_end", "_stop").groupBy(key, "pos").agg(F.min(F.least("_end", "_stop")).alias("_due"))
    tokens = latest.select(key, "_stop", F.posexplode("_now").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    timed = tokens.join(deadlines, [key, "pos"], "left").withColumn("_due", F.coalesce("_due", "_stop"))
    by_pos = Window.partitionBy(key).orderBy("pos")
    timed = timed.withColumn("_due", F.max("_due").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy(key, "_due")
    last = F.lag("_due").over(by_pos)
    timed = timed.withColumn("_opens", F.when(last.isNull(), 0.0).when(F.col("_due") > last, last))
    before = F.last("_opens", ignorenulls=True).over(by_pos.rowsBetween(Window.unboundedPreceding, 0))
    share = (F.row_number().over(group.orderBy("pos")) - 1) / F.count("*").over(group)
    return timed.withColumn("_before", before).withColumn("ts", F.col("_before") + (F.col("_due") - F.col("_before")) * share).select(key, "pos", "token", "ts")


def commit_sessions(segments: DataFrame, key: str = "session_id") -> DataFrame:
    """Each session's committed transcript: texts and tokens in order, times with their segment's offset (repeated where a segment has
    none; null where the counts differ), mean confidence."""
    parts = F.array_sort(F.collect_list(F.struct("seg_idx", "text", "tokens", "token_timestamps", "offset_s")))
    rows = segments.groupBy(key).agg(parts.alias("_p"), F.avg("confidence").alias("confidence"), F.count("*").alias("segments"))
    times = F.flatten(F.transform("_p", lambda p: F.coalesce(F.transform(p["token_timestamps"], lambda t: t.cast("double") + p["offset_s"]), F.transform(p["tokens"], lambda _: p["offset_s"].cast("double")))))
    rows = rows.select(key, F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("text"), F.flatten(F.transform("_p", lambda p: p["tokens"])).alias("tokens"), times.alias("_t"), "confidence", "segments")
    return rows.select(key, "text", "tokens", F.when((F.size("tokens") > 0) & (F.size("_t") == F.size("tokens")), F.col("_t")).alias("token_timestamps"), "confidence", "segments")


def with_active(committed: DataFrame, partial: DataFrame, key: str = "session_id") -> DataFrame:
    """Partials (text, tokens, token_timestamps, confidence, offset_s) behind what their session has committed."""
    c = committed.select(key, *[F.col(x).alias(f"_{x}") for x in ("text", "tokens", "token_timestamps", "confidence")])
    rows = partial.join(c, key, "left")
    times = F.coalesce(F.transform("token_timestamps", lambda t: t.cast("double") + F.col("offset_s")), F.transform("tokens", lambda _: F.col("offset_s").cast("double")))
    return rows.select(
        key,
        F.concat(F.coalesce("_text", F.lit("")), F.col("text")).alias("text"),
        F.concat(F.coalesce("_tokens", F.array().cast("array<string>")), F.col("tokens")).alias("tokens"),
        F.concat("_token_timestamps", times).alias("token_timestamps"),
        F.coalesce("_confidence", F.col("confidence").cast("double")).alias("confidence"),
    )


def session_report(updates: DataFrame, segments: DataFrame, key: str = "session_id") -> DataFrame:
    """Partials, revisions and finals of each session, with its segments, tokens and audio."""
    u = updates.groupBy(key).agg(F.count(F.when(~F.col("final_result"), 1)).alias("partials"), F.sum(F.col("revision").cast("int")).alias("revisions"), F.count(F.when(F.col("final_result"), 1)).alias("finals"))
    s = segments.groupBy(key).agg(F.count("*").alias("segments"), F.sum(F.size("tokens")).alias("tokens"), F.sum("audio_ms").alias("audio_ms"))
    return u.join(s, key, "full")


def backlog(events: DataFrame, key: str, order: list[str], delta: str = "delta") -> DataFrame:
    """Adds backlog: the running sum of +1 and -1 that never goes below 0."""
    own = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_s", F.sum(delta).over(own))
    return rows.withColumn("backlog", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(own))).cast("long")).drop("_s")


def merge_pieces(pieces: DataFrame, key: str = "utt", mark: str = "@@") -> DataFrame:
    """Tokens with continuation pieces (@@) joined to the token before; an orphan piece loses its mark."""
    goes_on = F.startswith("token", F.lit(mark))
    own = Window.partitionBy(key).orderBy("pos")
    rows = pieces.withColumn("_word", F.sum(F.when(goes_on & (F.row_number().over(own) > 1), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    bare = F.when(goes_on, F.substring("token", len(mark) + 1, F.length("token"))).otherwise(F.col("token"))
    found = rows.groupBy(key, "_word").agg(F.array_sort(F.collect_list(F.struct("pos", bare.alias("t")))).alias("_all"))
    return found.select(key, (F.col("_word") - 1).alias("pos"), F.array_join(F.transform("_all", lambda x: x["t"]), "").alias("token"))


def detokenize(paths: DataFrame, vocab: DataFrame, key: str = "utt") -> DataFrame:
    """Tokens of paths (utt, pos, id): ids are stored one above the vocabulary's; a missing one becomes <score-id:N>; special ones go."""
    rows = paths.where("id > 0").join(vocab.select((F.col("token_id") + 1).alias("id"), "token"), "id", "left")
    rows = rows.withColumn("token", F.coalesce("token", F.format_string("<score-id:%d>", F.col("id") - 1)))
    return rows.where(~F.col("token").isin(*SPECIAL)).select(key, "pos", "token")


def flag_results(transcripts: DataFrame) -> DataFrame:
    """Adds success (raw text isn't empty); failed rows get a blank text, an error and no confidence."""
    good = F.coalesce(F.col("raw_text") != "", F.lit(False))
    rows = transcripts.withColumn("success", good)
    return rows.withColumns(
        {
            "text": F.when(good, F.col("text")).otherwise(""),
            "confidence": F.when(good, F.col("confidence")).otherwise(F.lit(0.0)),
            "error": F.when(~good, F.coalesce("error", F.lit("empty result"))),
        }
    )


def session_lines(results: DataFrame, captures: DataFrame, key: str = "stream_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Adds lines: the non-blank texts of a capture so far. results: (stream_id, ts, text, ...); captures: start_ts <= ts < end_ts, an open
    one takes all later results. The range join meets by stream and time bucket; order breaks ties in ts."""
    rows = frames_in_capture(results.where(F.trim("text") != ""), captures.select(key, "capture_idx", "start_ts", "end_ts"), 0, key)
    own = Window.partitionBy(key, "capture_idx").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("lines", F.collect_list("text").over(own)).select(*dict.fromkeys([key, "capture_idx", *order, "text", "lines"]))


def english_spacing(words: DataFrame, key: str = "utt") -> DataFrame:
    """Words (utt, pos, text) with blanks between English ones: the first capital, single capitals joined, none after a CJK character,
    one before digits that follow a word."""
    own = Window.partitionBy(key).orderBy("pos")
    bare = F.trim("text")
    last = F.trim(F.lag("text").over(own))
    letters, first = bare.rlike("^[A-Za-z]+$") & (bare == F.col("text")), F.row_number().over(own) == 1
    capital = F.when(first & bare.rlike("^[a-z]"), F.concat(F.upper(F.left(bare, F.lit(1))), F.substring(bare, F.lit(2), F.length(bare)))).otherwise(bare)
    joins = bare.rlike("^[A-Z]$") & F.coalesce(last.rlike("^[A-Z]$"), F.lit(False))
    after_cjk = F.coalesce(last.rlike("[㐀-鿿]$"), F.lit(False))
    blank = F.when(letters & (first | (~after_cjk & ~joins)), " ").when(first & bare.rlike("^[A-Za-z]"), " ")
    blank = blank.when(~first & bare.rlike("^[0-9]") & F.coalesce(last.rlike("^[A-Za-z]+$"), F.lit(False)), " ")
    lead = F.regexp_extract("text", r"^(\s*)", 1)
    spaced = F.concat(F.coalesce(blank, F.when(letters, F.lit("")).otherwise(lead)), F.when(letters | first, capital).otherwise(F.regexp_replace("text", r"^\s+", "")))
    return words.withColumn("text", F.when(bare == "", F.col("text")).otherwise(spaced))


def coalesce_per_mille(words: DataFrame, key: str = "utt") -> DataFrame:
    """Words with a ‰ merged into the unsigned decimal before it."""
    own = Window.partitionBy(key).orderBy("pos")
    merges = (F.trim("text") == "‰") & F.coalesce(F.trim(F.lag("text").over(own)).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.lit(False))
    rows = words.withColumn("_w", F.sum(F.when(merges, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    marked = rows.withColumn("text", F.when(merges, F.trim("text")).otherwise(F.col("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("text").alias("t")))), lambda x: x["t"]), "")
    return marked.groupBy(key, "_w").agg(F.min("pos").alias("pos"), joined.alias("text")).drop("_w")


def midnight_zero(text: Column) -> Column:
    """0: at the beginning of an hour as 00:."""
    return F.regexp_replace(text, "(?<![0-9])0:", "00:")
