"""Queries over orders, events, parts and embeddings as segments, paths, words and scores of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesmith.functions import audio as A
from cuesmith.operators import captions, files, labels, scores
from cuesmith.operators import segments as S
from cuesmith.operators import updates as U
from cuesmith.plans.catalog import query, table


@query("""
with s as (select o_custkey as session_id, o_orderkey as seg_idx, o_orderkey * 400 as start_sample, o_orderkey * 400 + o_orderkey % 97 * 800 as end_sample,
                  o_orderkey % 97 * 40 as speech_ms, o_orderstatus = 'F' as finished from orders),
t as (select session_id, max(start_sample) + 20000 as total from s group by session_id),
v as (select *, case when finished then 'finish' when speech_ms >= 3200 then 'max_duration' else 'end_silence' end as reason from s where speech_ms >= 400),
e as (select v.*, least(end_sample + 480, total) as stop from v join t using (session_id))
select session_id, seg_idx, reason, stop as audio_end_sample,
       greatest(start_sample - 320, 0, coalesce(max(stop) over (partition by session_id order by seg_idx rows between unbounded preceding and 1 preceding), 0)) as audio_start_sample
from e
""")
def padded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as segments of customers: the valid ones, why they end, and their padded bounds."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session_id"),
        key.alias("seg_idx"),
        (key * 400).alias("start_sample"),
        (key * 400 + key % 97 * 800).alias("end_sample"),
        (key % 97 * 40).alias("speech_ms"),
        (F.col("o_orderstatus") == "F").alias("finished"),
    )
    whole = rows.groupBy("session_id").agg((F.max("start_sample") + 20_000).alias("total_samples"))
    found = S.pad_segments(S.valid_segments(rows, 400, 3200).join(whole, "session_id"), 320, 480)
    return found.select("session_id", "seg_idx", "reason", "audio_end_sample", "audio_start_sample")


@query("""
with p as (select o_custkey as utt, o_orderkey as pos, o_orderkey % 300 - 5 as id from orders),
v as (select p_partkey + 1 as id, case when p_partkey % 50 = 0 then '<unk>' else p_name end as token from part where p_partkey % 3 <> 1),
t as (select utt, pos, coalesce(token, '<score-id:' || (id - 1) || '>') as token from p left join v using (id) where id > 0)
select * from t where token not in ('<s>', '</s>', '<unk>', '<NOISE>', '<CAT>')
""")
def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of paths as tokens of a vocabulary with gaps."""
    paths = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("utt"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 300 - 5).alias("id"))
    token = F.when(F.col("p_partkey") % 50 == 0, "<unk>").otherwise(F.col("p_name"))
    vocab = table(spark, sf_dir, "part").where("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("token_id"), token.alias("token"))
    return U.detokenize(paths, vocab)


_WORDS = "w as (select o_custkey as utt, o_orderkey as idx, o_orderstatus as text, 2 * row_number() over (partition by o_custkey order by o_orderkey) as source_end, o_orderkey % 6 as mark, o_orderkey % 4 <> 0 as is_end from orders)"


@query(f"""
with {_WORDS}, l as (select *, max(source_end) over (partition by utt) as last from w)
select utt, idx, text, source_end::int as source_end,
       case when is_end and source_end <> last then (case mark when 1 then '，' when 2 then '。' when 3 then '！' when 4 then '？' end) end as mark
from l
""")
def mark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the marks of the characters before their ends, the last character's left open."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) * 2
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("utt"), F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("text"), place.alias("source_end"))
    marks = rows.select("utt", (F.col("source_end") - 1).alias("char_idx"), (F.col("idx") % 6).cast("int").alias("mark"), (F.col("idx") % 4 != 0).alias("is_end"))
    return labels.attach_marks(rows, marks, final=False)


@query("""
select vec_id, coalesce((exp(embedding[1]::double) - exp(embedding[2]::double)) / (exp(embedding[1]::double) + exp(embedding[2]::double)) - (2 * 0.52::double - 1) >= 0 and vec_id % 3 <> 0, false) as speech,
       round(case when vec_id % 10 = 0 then 0 else least(exp(embedding[3]::double * 4), 1) end, 6)::double as confidence
from embeddings
""")
def frame_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech evidence from two scores of each row, and a confidence from a third; every tenth row has no path."""
    rows = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i))
    score = F.when(F.col("vec_id") % 10 != 0, at(2).cast("double") * 4)
    speech = A.speech_evidence(at(0), at(1), F.col("vec_id") % 3 != 0, 0.52)
    return rows.select("vec_id", F.coalesce(speech, F.lit(False)).alias("speech"), F.round(A.path_confidence(score), 6).alias("confidence"))


_RANKED = """
c as (select o_custkey as utt, o_orderkey as last, 2 + o_orderkey % 3 as step, o_orderkey % 7 as token, -o_totalprice / 100000 as acoustic, -(o_orderkey % 13) / 4 as prev from orders where o_orderstatus <> 'F'),
n as (select utt, last, (prev * (step - 1) + acoustic) / step as normalized, token = 0 or step >= 4 as terminal from c
      union all select o_custkey, o_orderkey, -o_totalprice / 200000, true from orders where o_orderstatus = 'F'),
r as (select * from (select *, row_number() over (partition by utt order by normalized desc, last) as rank from n) where rank <= 3)
"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    own = [F.col("o_custkey").alias("utt"), (key % 3 + 2).cast("int").alias("step"), (key % 7).cast("int").alias("token"), F.array(key).alias("path")]
    new = orders.where("o_orderstatus <> 'F'").select(*own, (-F.col("o_totalprice") / 100_000).alias("acoustic"), (-(key % 13) / 4).alias("prev"))
    kept = orders.where("o_orderstatus = 'F'").select(*own, (-F.col("o_totalprice") / 200_000).alias("normalized"), F.lit(True).alias("terminal"))
    return scores.rerank(new, kept, 3, end_token=0, limit=4)


@query(f"with {_RANKED} select utt, last, normalized, terminal, rank::int as rank from r")
def rerank_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One re-ranking step: orders as candidates of customers, finished orders as kept paths, the best three stay."""
    return _ranked(spark, sf_dir).select("utt", F.get("path", F.lit(0)).alias("last"), "normalized", "terminal", "rank")


@query(f"""
with {_RANKED}, o as (select *, row_number() over (partition by utt order by terminal desc, normalized desc) as first from r)
select utt, last, normalized, terminal from o where first = 1
""")
def best_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path of each customer after that step, finished ones first."""
    found = scores.best_path(_ranked(spark, sf_dir), final=True)
    return found.select("utt", F.get("path", F.lit(0)).alias("last"), "normalized", "terminal")


@query("""
with p as (select p_brand || '/' || p_partkey || '.onnx' as path, p_partkey from part)
select path from p order by case p_partkey when 7 then 0 when 5 then 1 else 2 end, path limit 1
""")
def preferred_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that would be loaded as a model, by preferred names."""
    paths = table(spark, sf_dir, "part").select(F.concat(F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".onnx")).alias("path"))
    return files.pick_file(paths, ["7.onnx", "5.onnx"])


@query("select p_brand || '/' || p_partkey as path from part where p_partkey % 13 = 0")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as required files that the listing doesn't have."""
    part = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), "p_partkey")
    return files.missing_files(part.select("path"), part.where("p_partkey % 13 <> 0"))


@query("""
with r as (select conv_id, turn, case when turn % 5 = 0 then '' else text end as raw, text, (turn % 4 + 1) / 8 as confidence from conversations),
f as (select *, coalesce(raw <> '', false) as success from r)
select conv_id, turn, success, length(case when success then text else '' end)::int as chars, case when success then confidence else 0 end::double as confidence,
       case when not success then 'empty result' end as error,
       success and regexp_matches(text, '[^ \t\n\f\r]') as captionable
from f
""")
def result_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as results, every fifth of them empty: success, text, confidence, error, and which ones get captions."""
    turns = table(spark, sf_dir, "conversations")
    raw = F.when(F.col("turn") % 5 == 0, "").otherwise(F.col("text"))
    rows = U.flag_results(turns.select("conv_id", "turn", raw.alias("raw_text"), "text", ((F.col("turn") % 4 + 1) / 8).alias("confidence"), F.lit(None).cast("string").alias("error")))
    shown = captions.captionable(rows).select("conv_id", "turn", F.lit(True).alias("captionable"))
    return rows.join(shown, ["conv_id", "turn"], "left").select("conv_id", "turn", "success", F.length("text").alias("chars"), "confidence", "error", F.coalesce("captionable", F.lit(False)).alias("captionable"))


@query("""
with t as (select user_id as worker_id, event_id as seq, case event_type when 'click' then 'start' when 'error' then 'end' else 'audio' end as type from events),
l as (select *, coalesce(last_value(case when type <> 'audio' then type end ignore nulls) over (partition by worker_id order by seq rows between unbounded preceding and 1 preceding) = 'start', false) as open from t)
select worker_id, seq, type, case when type = 'start' and open then 'started twice' when type <> 'start' and not open then type || ' without start' end as problem from l
""")
def stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as tasks of workers, and what is wrong with their order."""
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "error", "end").otherwise("audio")
    tasks = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker_id"), F.col("event_id").alias("seq"), kind.alias("type"))
    return S.check_stream_order(tasks)


@query("""
with c as (select o_custkey as utt, o_orderkey as pos, o_orderpriority as token, unnest(string_split(o_orderpriority, '')) as ch, generate_subscripts(string_split(o_orderpriority, ''), 1) as i from orders)
select utt, (row_number() over (partition by utt order by pos, i) - 1)::int as char_idx, ch, regexp_matches(ch, '^[0-9]$') and length(token) > 1 as numeric, i > 1 as inner
from c
""".replace("as inner", 'as "inner"').replace("as numeric", 'as "numeric"'))
def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the characters of orders' priorities."""
    tokens = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("utt"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("token"))
    return labels.numeric_features(tokens)


@query("""
with w as (select o_custkey as utt, o_orderkey as pos, case o_orderkey % 4 when 3 then '‰' when 1 then 'x' when 0 then (o_orderkey % 100)::varchar else (o_orderkey % 10) || '.5' end as text from orders),
m as (select *, coalesce(text = '‰' and regexp_matches(lag(text) over (partition by utt order by pos), '^[0-9]+(\\.[0-9]+)?$'), false) as merges from w),
g as (select *, sum(case when merges then 0 else 1 end) over (partition by utt order by pos) as word from m)
select utt, min(pos) as pos, string_agg(text, '' order by pos) as text from g group by utt, word
""")
def per_mille(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as words, of which every fourth is a per-mille sign."""
    key = F.col("o_orderkey")
    text = F.when(key % 4 == 3, "‰").when(key % 4 == 1, "x").when(key % 4 == 0, (key % 100).cast("string")).otherwise(F.concat((key % 10).cast("string"), F.lit(".5")))
    return U.coalesce_per_mille(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("utt"), key.alias("pos"), text.alias("text")))
