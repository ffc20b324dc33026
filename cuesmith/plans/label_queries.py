"""Queries over labelled characters, word pieces, data sets and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.operators import files, labels
from cuesmith.plans.catalog import query, table
from cuesmith.sources import sinks


@query("select doc_id, len(regexp_extract_all(text, '[0-9]+'))::int as n_spans, length(regexp_replace(text, '[^0-9]', '', 'g'))::bigint as n_chars from documents")
def label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit runs of the documents, labelled character by character, as spans."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    digit = lambda c: F.coalesce(c.rlike("^[0-9]$"), F.lit(False))

    def label(c, i):
        before, after = digit(F.get("chars", i - 1)), digit(F.get("chars", i + 1))
        return F.when(~digit(c), "O").when(before & after, "MA").when(before, "EA").when(after, "BA").otherwise("SA")

    docs = table(spark, sf_dir, "documents").select("doc_id", chars.alias("chars")).select("doc_id", "chars", F.transform("chars", label).alias("labels"))
    spans = docs.select("doc_id", labels.label_spans(F.col("chars"), F.col("labels")).alias("s"))
    width = F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    return spans.select("doc_id", F.size("s").alias("n_spans"), width.alias("n_chars"))


@query("""
with w as (select lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from documents),
d as (select word, count(*) as n from w group by word),
v as (select word as token from d where n >= 5 and length(word) <= 4
      union select '@@' || word from d where n >= 5 and length(word) <= 4),
p as (select word, length(word) as len from d),
s as (select word, len, unnest(range(1, len + 1)) as i from p),
k as (select word, len, i, unnest(range(1, len - i + 2)) as k from s),
m as (select word, len, i, max(k) as k from k join v on v.token = (case when i > 1 then '@@' else '' end) || substr(word, i, k) group by word, len, i),
r as (with recursive walk(word, len, place, n) as (
        select word, len, 1, 0 from p
        union all
        select walk.word, walk.len, (walk.place + m.k)::int, n + 1 from walk join m on m.word = walk.word and m.i = walk.place)
      select * from walk)
select p.word, coalesce(max(case when r.place > p.len then r.n end), 1)::int as n_pieces, max(case when r.place > p.len then 1 else 0 end) = 1 as known
from p join r on p.word = r.word group by p.word
""")
def word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents in pieces, with their short frequent words as vocabulary."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    short = words.where("n >= 5 and length(word) <= 4")
    vocab = short.select(F.col("word").alias("token")).unionByName(short.select(F.concat(F.lit(labels.PIECE_MARK), F.col("word")).alias("token")))
    found = labels.word_pieces(words, vocab)
    return found.select("word", F.size("pieces").alias("n_pieces"), (F.get("pieces", F.lit(0)) != labels.UNKNOWN).alias("known"))


@query("""
with recursive s as (select conv_id, row_number() over (partition by conv_id order by turn) as i, length(text) as n from conversations where text is not null and text <> ''),
walk(conv_id, i, n, chunk, filled) as (
  select conv_id, i, n, 0, n from s where i = 1
  union all
  select s.conv_id, s.i, s.n, walk.chunk + (filled + s.n > 600)::int, case when filled + s.n > 600 then s.n else filled + s.n end from walk join s on s.conv_id = walk.conv_id and s.i = walk.i + 1)
select conv_id, chunk::int as chunk, count(*)::int as n_tokens, sum(n)::bigint as total from walk group by conv_id, chunk
""")
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation dealt to chunks of at most 600 characters, and what each chunk holds."""
    rows = table(spark, sf_dir, "conversations").where("text is not null and text <> ''")
    rows = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("ns"))
    rows = rows.select("conv_id", F.explode(F.arrays_zip("ns", labels.pack_chunks(F.col("ns"), 600).alias("chunk"))).alias("x"))
    return rows.groupBy("conv_id", F.col("x.chunk").alias("chunk")).agg(F.count("*").cast("int").alias("n_tokens"), F.sum("x.ns").alias("total"))


@query("""
select sha256(conv_id || ':' || turn) as id, text, (conv_id * 1000 + turn)::bigint as seconds
from conversations where text is not null and text <> ''
""")
def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as training-set records of successful segments."""
    turns = table(spark, sf_dir, "conversations")
    segments = turns.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seg_idx"),
        F.coalesce(F.col("text") != "", F.lit(False)).alias("success"),
        "text",
        F.col("text").alias("raw_text"),
        *[F.lit(0.0).cast("float").alias(c) for c in ("duration", "inference_latency", "confidence")],
        F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("event_time"),
    )
    return sinks.dataset_rows(segments).select("id", "text", F.unix_seconds("timestamp").alias("seconds"))


@query("""
with f as (select p_partkey, p_brand || '/' || p_partkey as path, sha256(p_name) as sha256 from part),
c as (select path, case when p_partkey % 7 = 0 then 'bad' else sha256 end as want from f where p_partkey % 11 <> 0)
select f.path, case when want is null then 'no entry' when want <> sha256 then 'mismatch' else 'ok' end as status from f left join c using (path)
""")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of a manifest, held against a checksum list with gaps and errors."""
    part = table(spark, sf_dir, "part")
    manifest = part.select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_name", 256).alias("sha256"), "p_partkey")
    checksums = manifest.where("p_partkey % 11 <> 0").select("path", F.when(F.col("p_partkey") % 7 == 0, "bad").otherwise(F.col("sha256")).alias("sha256"))
    return files.verify_manifest(manifest.drop("p_partkey"), checksums).select("path", "status")


@query("""
select kind, case when sum(gap) = 0 then 'ready' else 'missing' end as state, sum(gap)::int as n_missing
from (select p_brand as kind, (p_partkey % 13 = 0)::int as gap from part) group by kind
""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as kinds of files, of which every thirteenth is missing."""
    required = table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").cast("string").alias("path"))
    found = files.readiness(required, required.where("cast(path as int) % 13 <> 0"))
    return found.select("kind", "state", F.size("missing").alias("n_missing"))
