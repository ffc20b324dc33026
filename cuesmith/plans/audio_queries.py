"""Queries over embeddings as blocks of samples and as score rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.functions import audio as A
from cuesmith.operators import scores
from cuesmith.plans.catalog import query, table

_PCM = "pcm as (select vec_id, list_transform(embedding, lambda x: round(least(greatest(x::double, -1.0), 1.0) * 32767)::int) as s, embedding from embeddings)"


def _pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.transform("embedding", lambda x: F.round(F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 32767).cast("smallint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", samples.alias("samples"), "embedding")


@query(f"""
with {_PCM}
select vec_id, round(least(list_max(list_transform(s, lambda x: abs(x))) / 32767.0, 1)::double, 4) as level,
       len(s) >= 16 and ln(list_sum(list_transform(s, lambda x: x::bigint * x)) / 16 + 1) > 0 as active,
       round(list_sum(list_transform(s, lambda x: x / 32767.0))::double, 4) as total from pcm
""")
def frame_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, energy gate and scaled sum of each block."""
    total = F.aggregate(A.to_float(F.col("samples")), F.lit(0.0), lambda t, x: t + x)
    return _pcm(spark, sf_dir).select("vec_id", F.round(A.frame_level(F.col("samples")), 4).alias("level"), A.frame_energy(F.col("samples"), 16).alias("active"), F.round(total, 4).alias("total"))


@query(f"""
with {_PCM}, m as (select vec_id, list_transform(range(len(s) // 2), lambda i: (s[2 * i + 1] + s[2 * i + 2])) as t from pcm)
select vec_id, list_transform(t, lambda x: (sign(x) * (abs(x) // 2))::int)::varchar as mono from m
""")
def downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of two channels as one."""
    mono = A.downmix(F.col("samples"), 2)
    return _pcm(spark, sf_dir).select("vec_id", F.concat(F.lit("["), F.array_join(mono.cast("array<string>"), ", "), F.lit("]")).alias("mono"))


@query(f"""
with {_PCM}, k as (select vec_id, s, unnest([48000, 44100]) as rate from pcm),
r as (select vec_id, rate, s, unnest(range(round(len(s) / (rate::double / 16000))::int)) as i from k),
p as (select vec_id, rate, s, i, i * (rate::double / 16000) as place, least(floor(i * (rate::double / 16000))::int, len(s) - 1) as a from r),
v as (select vec_id, rate, i, round(s[a + 1] + (s[least(a + 1, len(s) - 1) + 1] - s[a + 1]) * (place - a)) as x from p)
select vec_id, rate, count(*)::int as n, sum(x)::bigint as total, sum(x * (i + 1))::bigint as weighted from v group by vec_id, rate
""")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 48 and of 44.1 kHz at 16 kHz."""
    rows = _pcm(spark, sf_dir).withColumn("rate", F.explode(F.array(F.lit(48_000), F.lit(44_100))))
    rows = rows.select("vec_id", "rate", A.resample(F.col("samples"), F.col("rate"), 16_000).cast("array<bigint>").alias("r"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda t, x: t + x)
    return rows.select("vec_id", "rate", F.size("r").alias("n"), add("r").alias("total"), add(F.transform("r", lambda x, i: x * (i + 1))).alias("weighted"))


@query(f"""
with {_PCM}, f as (select vec_id, s, unnest(range((len(s) - 16) // 8 + 1)) as k from pcm where len(s) >= 16)
select vec_id, k::int as frame, list_sum(s[8 * k + 1 : 8 * k + 16])::bigint as total from f
""")
def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping frames of 16 samples every 8."""
    rows = _pcm(spark, sf_dir).select("vec_id", F.posexplode(A.frames(F.col("samples"), 16, 8)).alias("frame", "f"))
    return rows.select("vec_id", "frame", F.aggregate(F.col("f").cast("array<bigint>"), F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))


@query("""
with s as (select vec_id, unnest(embedding)::double as score, generate_subscripts(embedding, 1) - 1 as id from embeddings)
select vec_id, id::int as id, round(score, 4) as score, rank::int as rank from (select *, row_number() over (partition by vec_id order by score desc, id) as rank from s) where rank <= 5
""")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest scores of each row."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("id", "score")).withColumn("score", F.col("score").cast("double"))
    return scores.top_k(rows, 5, ["vec_id"]).select("vec_id", "id", F.round("score", 4).alias("score"), "rank")


@query("""
with s as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
m as (select vec_id, e, list_max(e) as top from s),
p as (select vec_id, e, list_transform(e, lambda x: exp(x - top)) as x, top from m),
q as (select vec_id, list_transform(x, lambda v: v / list_sum(x)) as p, len(e) - list_position(list_reverse(e), top) as label from p)
select vec_id, (case when label = 1 and p[1] / p[2] > 0.6 then 0 else label end)::int as label, round(p[1], 4) as p0, round(list_max(p), 4) as best from q
""")
def pick_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from all scores of a row, after softmax."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", A.softmax(F.col("embedding")).alias("p"))
    return rows.select("vec_id", A.pick_label(F.col("p")).alias("label"), F.round(F.get("p", F.lit(0)), 4).alias("p0"), F.round(F.array_max("p"), 4).alias("best"))
