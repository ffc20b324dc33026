"""Queries over conversations, events and documents as live updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.operators import captions as C
from cuesmith.operators import segments as S
from cuesmith.operators import updates as U
from cuesmith.plans.catalog import query, table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn cut to growing beginnings: the updates of a session, which restart with every turn."""
    turns = table(spark, sf_dir, "conversations")
    cut = turns.withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    text = F.when(F.col("step") == 0, F.lit("")).when(F.col("step") == 1, F.left("text", F.lit(20))).otherwise(F.col("text"))
    return cut.select(F.col("conv_id").alias("session_id"), (F.col("turn") * 3 + F.col("step")).alias("sequence"), F.coalesce(text, F.lit("")).alias("text"), (F.col("step") == 2).alias("final_result"))


_TURNS = """
turns as (select conv_id as session_id, turn * 3 + step as sequence, coalesce(case step when 0 then '' when 1 then left(text, 20) else text end, '') as text, step = 2 as final_result
          from conversations, (values (0), (1), (2)) s(step))
"""


@query(f"""
with {_TURNS},
seen as (select *, last_value(nullif(text, '') ignore nulls) over (partition by session_id order by sequence rows between unbounded preceding and 1 preceding) as last from turns),
marked as (select *, coalesce(text <> '' and not starts_with(text, last), false) as revision from seen)
select session_id, sequence, length(text)::int as chars, revision, (sum(revision::int) over w)::int as revision_count, (row_number() over w)::int as new_sequence
from marked window w as (partition by session_id order by sequence)
""")
def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision flags and counts of conversations' growing turns."""
    found = U.mark_revisions(_turns(spark, sf_dir))
    return found.select("session_id", "sequence", F.length("text").alias("chars"), "revision", "revision_count", "new_sequence")


@query(f"""
with {_TURNS}, seen as (select *, lag(text) over (partition by session_id order by sequence) as last from turns)
select session_id, count(*) as kept, count(*) filter (final_result and text <> '') as finals from seen
where final_result or text is distinct from last group by session_id
""")
def emitted_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many updates are sent on when repeats are dropped, and how many final texts there are."""
    kept = U.drop_repeats(_turns(spark, sf_dir))
    finals = U.final_texts(kept).groupBy("session_id").agg(F.count("*").alias("finals"))
    return kept.groupBy("session_id").agg(F.count("*").alias("kept")).join(finals, "session_id", "left").select("session_id", "kept", F.coalesce("finals", F.lit(0)).cast("long").alias("finals"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    times = F.when(F.col("turn") % 2 == 0, F.transform(tokens, lambda _, i: i * 0.5))
    return turns.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seg_idx"), "text", tokens.alias("tokens"), times.alias("token_timestamps"), ((F.col("turn") % 4 + 1) / 8).alias("confidence"), (F.col("turn") * 10.0).alias("offset_s"))


@query("""
with seg as (select conv_id, turn, text, list_filter(string_split(text, ' '), lambda w: w <> '') as tokens from conversations where text is not null),
tok as (select conv_id, turn, unnest(tokens) as token, generate_subscripts(tokens, 1) as i from seg),
timed as (select conv_id, sum(turn * 10.0 + case when turn % 2 = 0 then (i - 1) * 0.5 else 0 end) as ts_sum, count(*) as n_tokens from tok group by conv_id)
select seg.conv_id as session_id, sha256(string_agg(text, '' order by turn)) as text_sha256, any_value(coalesce(n_tokens, 0))::int as n_tokens,
       round(any_value(ts_sum), 4) as ts_sum, round(avg((turn % 4 + 1) / 8), 4) as confidence, count(*) as segments
from seg left join timed using (conv_id) group by seg.conv_id
""")
def commit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as committed segments: text, tokens, times and confidence of each session."""
    found = U.commit_sessions(_segments(spark, sf_dir))
    total = F.aggregate("token_timestamps", F.lit(0.0), lambda a, t: a + t)
    return found.select("session_id", F.sha2("text", 256).alias("text_sha256"), F.size("tokens").alias("n_tokens"), F.round(total, 4).alias("ts_sum"), F.round("confidence", 4).alias("confidence"), "segments")


@query("""
with d as (select event_id, user_id, ts, case event_type when 'signup' then 1 when 'view' then 1 else -1 end as delta from events),
s as (select *, sum(delta) over w as s from d window w as (partition by user_id order by ts, event_id))
select event_id, (s - least(0, min(s) over (partition by user_id order by ts, event_id)))::bigint as backlog from s
""")
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as work handed in and done, by user."""
    events = table(spark, sf_dir, "events").withColumn("delta", F.when(F.col("event_type").isin("signup", "view"), 1).otherwise(-1))
    return U.backlog(events, "user_id", ["ts", "event_id"]).select("event_id", "backlog")


def _capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "error", "end")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "ts", F.col("event_id").alias("seq"), action.alias("action")).where("action is not null")


_CAPTURES = """
ev as (select user_id as stream_id, ts, event_id as seq, case event_type when 'click' then 'start' else 'end' end as action from events where event_type in ('click', 'error')),
hold as (select * from (select *, lag(action, 1, 'end') over (partition by stream_id order by ts, seq) as last from ev) where action <> last),
holds as (select 'hold' as mode, stream_id, ts as start_ts, end_ts from (select *, lead(ts) over (partition by stream_id order by ts, seq) as end_ts from hold) where action = 'start'),
flips as (select *, row_number() over (partition by stream_id order by ts, seq) as n from ev where action = 'start'),
toggles as (select 'toggle' as mode, stream_id, ts as start_ts, end_ts from (select *, lead(ts) over (partition by stream_id order by ts, seq) as end_ts from flips) where n % 2 = 1)
"""


@query(f"with {_CAPTURES} select * from holds union all select * from toggles")
def capture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' clicks and errors as starts and ends of captures, in two modes."""
    events = _capture_events(spark, sf_dir)
    rows = [S.capture_sessions(events, mode).select(F.lit(mode).alias("mode"), "stream_id", "start_ts", "end_ts") for mode in ("hold", "toggle")]
    return rows[0].unionByName(rows[1])


@query(f"""
with {_CAPTURES}
select e.user_id as stream_id, e.event_id, h.start_ts from events e join holds h
  on e.user_id = h.stream_id and e.ts >= h.start_ts and e.ts < coalesce(h.end_ts + interval 600 second, timestamp '9999-01-01')
where e.event_type = 'view'
""")
def frames_in_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that fall into a user's captures, with ten minutes of tail."""
    frames = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("stream_id"), "event_id", "ts")
    captures = S.capture_sessions(_capture_events(spark, sf_dir), "hold")
    return S.frames_in_capture(frames, captures, 600_000, bucket_s=86_400).select("stream_id", "event_id", "start_ts")


@query("""
with ev as (select user_id as stream_id, row_number() over (partition by user_id order by ts, event_id) as frame, value > 20 as evidence from events),
c as (select *, sum(evidence::int) over w as cum, max(case when evidence then frame end) over w as last from ev window w as (partition by stream_id order by frame))
select stream_id, frame::int as frame, cum::bigint as cum, (frame - coalesce(last, 0))::int as silence_run from c
""")
def frame_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as frames: running speech count and silence run."""
    return S.frame_counters(_frames(spark, sf_dir)).select("stream_id", "frame", "cum", "silence_run")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    order = F.row_number().over(S.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("stream_id"), order.alias("frame"), (F.col("value") > 20).alias("evidence"))


def _endpoint_sql(gap: int, start_margin: int = 30, end_margin: int = 30, response_timeout: int = 6_000, speech_end: int = 800, longest: int = 6_000) -> str:
    """The endpoint rule frame by frame as a recursive walk: one row a frame and stream, with all that it has counted so far."""
    at = lambda f: f"c[greatest({f}, 0)::int + 1]"
    return f"""
fr as (select user_id as stream, row_number() over o - 1 as f, value > 20 as ev, count(*) over (partition by user_id) = row_number() over o as fin from events window o as (partition by user_id order by ts, event_id)),
walk(stream, f, ev, c, r, st, maybe, last_end, last_real, segs, margin, delay, kind, bound, realb) as (
  select stream, -1::bigint, false, []::bigint[], []::int[], -1::bigint, -1::bigint, -1::bigint, 0::bigint, 0, -1::bigint, 0::bigint, null::varchar, 0::bigint, 0::bigint from fr where f = 0
  union all
  select stream, f, ev, c, r,
    case when kind = 'start' then greatest(last_end, seen - back) + 1 when kind in ('end', 'flush') then -1 else st end,
    case when kind = 'start' then -1 when kind is null and st < 0 and may < 0 and {at("f")} - {at("f - 7")} >= 7 then f - 7 when st < 0 then may else maybe end,
    case when kind = 'end' then rp + {end_margin} when kind = 'flush' then case when margin > 0 then margin else f end else last_end end,
    case when kind = 'end' then rp when kind = 'flush' then case when margin > 0 then margin - {end_margin} else f end else last_real end,
    segs + (coalesce(kind, '') = 'start')::int,
    case when kind in ('end', 'flush') then -1 when st >= 0 and kind is null then case when still then case when margin < 0 then f else margin end else -1 end else margin end,
    case when kind = 'start' then back when kind = 'flush' then (margin < 0)::int when kind = 'timeout' then 0
         when st >= 0 and kind is null then case when still then 0 when margin < 0 then 1 else f + 1 - margin end else delay end,
    coalesce(replace(kind, 'flush', 'end'), case when st >= 0 and not still then 'speech' else 'none' end),
    case kind when 'start' then greatest(last_end, seen - back) + 1 when 'end' then rp + {end_margin} when 'flush' then case when margin > 0 then margin else f end else f end,
    case kind when 'start' then seen - least(20, seen) when 'end' then rp when 'flush' then case when margin > 0 then margin - {end_margin} else f end else f end
  from (
    select *, case when seen - 20 > {start_margin} then {start_margin + 21} else seen + 1 end as back from (
      select *, case when {at("f")} - {at("f - 20")} >= 15 then f else may + 20 end as seen, f - {gap} - r[greatest(f - {gap}, 0)::int + 1] as rp,
        case when margin < 0 then f > {end_margin} and {at("f")} = {at(f"f - {end_margin}")} else f > 1 and {at("f")} = {at("f - 1")} end as still,
        case when st < 0 then
               case when {at("f")} - {at("f - 20")} >= 15 or (may >= 0 and {at("f")} - {at("f - 1")} = 1 and {at("f")} - {at("may")} >= 15) then 'start'
                    when (segs = 0 and f > {response_timeout}) or (segs > 0 and f + 1 - last_real > {speech_end}) then 'timeout' end
             when f > {gap} and {at("f")} = {at(f"f - {gap}")} then 'end' when fin then 'flush' end as kind
      from (
        select w.stream, fr.f, fr.ev, fr.fin, list_append(w.c, coalesce(w.c[-1], 0) + (fr.ev and not (st >= 0 and fr.f - st > {longest}))::int) as c,
          list_append(w.r, case when fr.ev then 0 else coalesce(w.r[-1], 0) + 1 end::int) as r, st, maybe, case when maybe < 0 or fr.f - maybe > {gap} then -1 else maybe end as may,
          last_end, last_real, segs, margin, delay
        from walk w join fr on fr.stream = w.stream and fr.f = w.f + 1))))"""


@query(f"""
with recursive {_endpoint_sql(12, 8, 5, 40, 30, 20)}
select stream::varchar as stream_id, f as frame, ev as evidence, kind as status, c[-1] as cum, r[-1] as silence_run, delay::int as delay, margin from walk where f >= 0
""")
def endpoint_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as frames, each with the endpoint's status and its counters, which stand still beyond the longest segment."""
    frames = _frames(spark, sf_dir).withColumn("stream_id", F.col("stream_id").cast("string"))
    return S.endpoint_frames(frames, S.Params(gap=12, start_margin=8, end_margin=5, response_timeout=40, speech_end=30, longest=20))


@query(f"""
with recursive {_endpoint_sql(4)},
b as (select stream, f, kind, bound, realb, lag(realb) over (partition by stream order by f) as since from walk where kind in ('start', 'end')),
n as (select stream, max(f) + 1 as frames from walk group by stream),
s as (select b.stream, row_number() over (partition by b.stream order by f) - 1 as seg_idx, greatest(since, 0) * 160 as start_sample, greatest(realb, 0) * 160 as end_sample, (realb - since) * 10 as speech_ms, frames * 160 as total_samples
      from b join n using (stream) where kind = 'end'),
e as (select *, least(end_sample + 480, total_samples) as audio_end_sample from s)
select stream::varchar as stream_id, seg_idx::int as seg_idx, start_sample, end_sample, speech_ms, total_samples, audio_end_sample,
       greatest(start_sample - 320, 0, coalesce(max(audio_end_sample) over (partition by stream order by seg_idx rows between unbounded preceding and 1 preceding), 0)) as audio_start_sample
from e
""")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech segments of users' events as frames: the endpoint rule, then padding."""
    frames = _frames(spark, sf_dir).select(F.col("stream_id").cast("string").alias("stream_id"), F.col("frame").cast("long").alias("frame"), "evidence")
    found = S.segments_from_events(S.endpoint(frames, S.Params(gap=4)))
    whole = frames.groupBy("stream_id").agg((F.max("frame") * S.FRAME).alias("total_samples"))
    return S.pad_segments(found.drop("audio_start_sample", "audio_end_sample").join(whole, "stream_id"), 320, 480, key="stream_id")


@query("""
with w as (select doc_id, unnest(string_split(left(text, 100000), ' ')) as token, generate_subscripts(string_split(left(text, 100000), ' '), 1) as pos from documents),
p as (select doc_id, pos, starts_with(token, 't') and pos > 1 as goes, token from w),
g as (select *, sum(case when goes then 0 else 1 end) over (partition by doc_id order by pos) as word from p)
select doc_id, (word - 1)::bigint as pos, string_agg(token, '' order by pos) as token from g group by doc_id, word
""".replace("left(text, 100000)", "text"))
def merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words as pieces, those with a t in front being continuations, joined again."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt"), F.posexplode(F.split("text", " ")).alias("pos", "word"))
    pieces = words.select("utt", "pos", F.when(F.startswith("word", F.lit("t")), F.concat(F.lit("@@"), F.col("word"))).otherwise(F.col("word")).alias("token"))
    return U.merge_pieces(pieces).withColumnRenamed("utt", "doc_id")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's first 4, 8, 12, ... words as up to eight snapshots, the third with a changed word; the last one is the whole turn."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("session_id"), F.filter(F.split("text", " "), lambda w: w != "").alias("w"))
    turns = turns.where("size(w) > 0").withColumn("last", F.least(F.lit(8), F.ceil(F.size("w") / 4)).cast("int"))
    turns = turns.select("session_id", "w", "last", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("seq"))
    tokens = F.when(F.col("seq") == F.col("last"), F.col("w")).otherwise(F.slice("w", F.lit(1), F.col("seq") * 4))
    tokens = F.transform(tokens, lambda t, i: F.when((F.col("seq") == 3) & (i == 9), "changed").otherwise(t))
    return turns.select("session_id", "seq", tokens.alias("tokens"), (F.col("seq") * 0.64).alias("audio_end_s"))


_SNAPSHOTS = """
t as (select conv_id * 1000 + turn as session_id, list_filter(string_split(text, ' '), lambda w: w <> '') as w from conversations where text is not null),
l as (select session_id, least(8, ceil(len(w) / 4))::int as last, w from t where len(w) > 0),
r as (select session_id, w, last, unnest(range(1, last + 1)) as seq from l),
s as (select session_id, seq, case when seq = last then w else w[1:seq * 4] end as w from r),
"""


@query(f"""
with {_SNAPSHOTS}
k as (select session_id, seq, seq * 0.64 as stop, unnest(w) as raw, generate_subscripts(w, 1) as pos from s),
x as (select *, case when seq = 3 and pos = 10 then 'changed' else raw end as token, max(seq) over (partition by session_id) as last from k),
z as (select session_id, pos, token, stop as final from x where seq = last),
a as (select x.session_id, x.seq, x.stop, x.pos, x.token = z.token as same from x join z using (session_id, pos)),
b as (select *, bool_and(same) over (partition by session_id, seq order by pos) as agreed from a),
d as (select session_id, pos, min(stop) as due from b where agreed group by session_id, pos),
m as (select z.session_id, z.pos, token, max(coalesce(due, final)) over (partition by z.session_id order by z.pos) as due from z left join d using (session_id, pos)),
g as (select distinct session_id, due from m),
h as (select *, coalesce(lag(due) over (partition by session_id order by due), 0) as before from g)
select m.session_id, m.pos::int as pos, m.token, round(before + (m.due - before) * (row_number() over (partition by m.session_id, m.due order by m.pos) - 1) / count(*) over (partition by m.session_id, m.due), 4)::double as ts
from m join h on m.session_id = h.session_id and m.due = h.due
""")
def token_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of turns' words from growing snapshots."""
    found = U.token_times(_snapshots(spark, sf_dir))
    return found.withColumn("ts", F.round("ts", 4))


_SAME = "coalesce(list_min(list_filter(range(1, least(len(f), len(x)) + 1), lambda i: f[i] <> x[i])) - 1, least(len(f), len(x)))"


@query(f"""
with {_SNAPSHOTS}
k as (select session_id, seq, list_transform(w, lambda x, i: case when seq = 3 and i = 10 then 'changed' else x end) as tokens from s),
c as (select *, array_to_string(tokens, '') as text from k),
v as (select *, coalesce(not starts_with(text, lag(text) over (partition by session_id order by seq)), false) as revision from c),
e as (select *, sum(revision::int) over (partition by session_id order by seq) as epoch from v),
h as (select *, list(tokens) over w as seen, list(string_split(text, '')) over w as chars from e window w as (partition by session_id, epoch order by seq rows between 4 preceding and current row)),
p as (select *, list_min(list_transform(seen, lambda x: {_SAME.replace("f[", "seen[1][").replace("len(f)", "len(seen[1])")})) as n_tokens,
             list_min(list_transform(chars, lambda x: {_SAME.replace("f[", "chars[1][").replace("len(f)", "len(chars[1])")})) as n_chars from h),
q as (select *, least(length(array_to_string(tokens[1:least(n_tokens, greatest(len(tokens) - 8, 0))], '')), n_chars) as n from p),
m as (select *, coalesce(list_max(list_filter(range(1, n + 1), lambda i: contains('，。！？；', text[i])
        or (contains(',.!?;', text[i]) and not (i > 1 and i < n and regexp_matches(text[i - 1] || text[i + 1], '^[A-Za-z0-9][A-Za-z0-9]$'))))), 0) as mark from q)
select session_id, seq as sequence, revision, (case when len(seen) = 5 then mark else 0 end)::int as stable_chars, (length(text) - case when len(seen) = 5 then mark else 0 end)::int as unstable_chars
from m
""")
def stable_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable and unstable characters of the growing snapshots of turns."""
    rows = _snapshots(spark, sf_dir).select("session_id", F.col("seq").alias("sequence"), "tokens", F.array_join("tokens", "").alias("text"), F.lit(0).alias("committed_prefix_chars"), F.lit(False).alias("final_result"))
    found = U.stable_prefix(U.mark_revisions(rows))
    return found.select("session_id", "sequence", "revision", F.length("stable").alias("stable_chars"), F.length("unstable").alias("unstable_chars"))


@query(f"""
with {_TURNS},
seen as (select *, last_value(nullif(text, '') ignore nulls) over (partition by session_id order by sequence rows between unbounded preceding and 1 preceding) as last from turns),
u as (select session_id, count(*) filter (not final_result) as partials, sum((text <> '' and not starts_with(text, coalesce(last, '')))::int)::bigint as revisions, count(*) filter (final_result) as finals from seen group by session_id),
s as (select conv_id as session_id, count(*) as segments, sum(len(list_filter(string_split(text, ' '), lambda w: w <> '')))::bigint as tokens, sum(turn * 10 + 5)::bigint as audio_ms from conversations where text is not null group by conv_id)
select * from u full join s using (session_id)
""")
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials, revisions and finals of conversations, with their segments, tokens and audio."""
    segments = _segments(spark, sf_dir).withColumn("audio_ms", F.col("seg_idx") * 10 + 5)
    return U.session_report(U.mark_revisions(_turns(spark, sf_dir)), segments)


@query("""
with seg as (select conv_id, turn, text, list_filter(string_split(text, ' '), lambda w: w <> '') as tokens, turn = max(turn) over (partition by conv_id) as last from conversations where text is not null),
n as (select *, len(tokens) as n, turn * 10.0::double * len(tokens) + case when turn % 2 = 0 then len(tokens) * (len(tokens) - 1) / 4 else 0 end as ts from seg)
select conv_id as session_id, sha256(string_agg(text, '' order by turn)) as text_sha256, sum(n)::int as n_tokens,
       round(case when coalesce(sum(n) filter (not last), 0) > 0 then sum(ts) end, 4)::double as ts_sum,
       round(coalesce(avg((turn % 4 + 1) / 8) filter (not last), max((turn % 4 + 1) / 8)), 4)::double as confidence
from n group by conv_id
""")
def active_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last turn as the active partial behind its committed turns."""
    rows = _segments(spark, sf_dir).withColumn("last", F.col("seg_idx") == F.max("seg_idx").over(S.Window.partitionBy("session_id")))
    found = U.with_active(U.commit_sessions(rows.where("not last")), rows.where("last"))
    total = F.aggregate("token_timestamps", F.lit(0.0), lambda a, t: a + t)
    return found.select("session_id", F.sha2("text", 256).alias("text_sha256"), F.size("tokens").alias("n_tokens"), F.round(total, 4).alias("ts_sum"), F.round("confidence", 4).alias("confidence"))


@query(f"""
with {_CAPTURES},
n as (select *, (row_number() over (partition by stream_id order by start_ts) - 1)::int as capture_idx from holds),
r as (select e.user_id as stream_id, n.capture_idx, e.ts, e.event_id, e.event_id::varchar as text from events e join n on e.user_id = n.stream_id and e.ts >= n.start_ts and (n.end_ts is null or e.ts < n.end_ts)
      where e.event_type = 'view' and e.event_id % 7 <> 0)
select stream_id, capture_idx, event_id, string_agg(text, ',') over (partition by stream_id, capture_idx order by ts, event_id rows between unbounded preceding and current row) as lines from r
""")
def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as results within users' captures, every seventh blank: the lines that each one makes the transcript."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    results = views.select(F.col("user_id").alias("stream_id"), "ts", "event_id", F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("event_id").cast("string")).alias("text"))
    captures = S.capture_sessions(_capture_events(spark, sf_dir), "hold")
    return U.session_lines(results, captures, order=("ts", "event_id")).select("stream_id", "capture_idx", "event_id", F.array_join("lines", ",").alias("lines"))


@query("""
with g as (select vec_id, list_sort(list_filter(list_transform(range(2, len(embedding) + 1), lambda i: embedding[i]::double - embedding[i - 1]::double), lambda d: d > 0)) as g from embeddings)
select vec_id, case when len(g) = 0 then 0.3 else least(greatest(g[len(g) // 2 + 1], 0.08), 0.8) end::double as step from g
""")
def token_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual step between a row's values, as if they were token times."""
    return table(spark, sf_dir, "embeddings").select("vec_id", C.token_step(F.col("embedding").cast("array<double>")).alias("step"))
