"""Queries over documents as transcripts: captions, clauses, marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.functions import text as X
from cuesmith.operators import captions as C
from cuesmith.plans.catalog import query, table

LIMIT, MS_PER_CHAR = 24, 60

_MARKS = X.CLAUSE_MARKS
_TRIM = r"regexp_replace({}, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')"


def _trim(x: str) -> str:
    return _TRIM.format(x)


#: Every document's clauses and parts, numbered; RE2 counts code points, as Java does outside of surrogates.
PARTS = rf"""
clauses as (
  select doc_id, text, n_chars, lang, source, i as clause_no, {_trim("c")} as clause
  from (select doc_id, text, n_chars, lang, source, unnest(cs) as c, generate_subscripts(cs, 1) as i
        from (select *, regexp_extract_all({_trim("text")}, '[^{_MARKS}]*[{_MARKS}]|[^{_MARKS}]+') as cs from documents))
  where {_trim("c")} <> ''),
pieces as (
  select doc_id, n_chars, clause_no, j as piece_no, {_trim("p")} as part
  from (select doc_id, n_chars, clause_no, unnest(ps) as p, generate_subscripts(ps, 1) as j
        from (select *, regexp_extract_all(clause, '(?s).{{{LIMIT - 1},{LIMIT + 6}}}?[\s\x0B\p{{Z}}{X.SOFT_MARKS}]|(?s).{{{LIMIT + 8}}}|(?s).+') as ps from clauses))
  where {_trim("p")} <> ''),
parts as (
  select doc_id, n_chars * {MS_PER_CHAR} as end_ms, row_number() over (partition by doc_id order by clause_no, piece_no) - 1 as part_idx,
         count(*) over (partition by doc_id) as n_parts, part from pieces)
"""

CUES = rf"""
with {PARTS},
sized as (select *, greatest(end_ms, 1) as stop, sum(greatest(length(part), 1)) over (partition by doc_id) as total from parts),
shares as (select *, greatest(stop * greatest(length(part), 1) // total, 500) as share from sized),
ends as (select *, case when part_idx + 1 = n_parts then stop else least(sum(share) over (partition by doc_id order by part_idx), stop) end as till from shares),
cues as (select doc_id, part_idx as cue_idx, coalesce(lag(till) over (partition by doc_id order by part_idx), 0)::bigint as start_ms, till, n_parts, part from ends)
select doc_id, cue_idx::int as cue_idx, start_ms, greatest(till, start_ms + 1)::bigint as end_ms,
       case when cue_idx + 1 = n_parts then regexp_replace(part, '[\s\x0B\p{{Z}}]*[{X.PERIODS}][\s\x0B\p{{Z}}]*$', '') else part end as text
from cues
"""


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).cast("long").alias("start_ms"), (F.col("n_chars") * MS_PER_CHAR).alias("end_ms"))
    return C.strip_last(C.allot_cues(C.parts(docs, LIMIT), ["doc_id"]), ["doc_id"])


@query(CUES)
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a recording of 60 ms a character: its caption cues."""
    return _cues(spark, sf_dir)


def _clock_sql(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query(f"""
with cue as ({CUES})
select doc_id, sha256(string_agg(printf('%d', cue_idx + 1) || chr(10) || {_clock_sql("start_ms")} || ' --> ' || {_clock_sql("end_ms")} || chr(10) || text || chr(10), chr(10) order by cue_idx)) as srt_sha256,
       count(*) as n_cues
from cue group by doc_id
""")
def srt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SRT text of each document's cues, as its checksum, and the number of cues."""
    cues = _cues(spark, sf_dir)
    texts = C.render_srt(cues, ["doc_id"])
    return texts.select("doc_id", F.sha2("srt", 256).alias("srt_sha256"), F.size(F.regexp_extract_all("srt", F.lit(" --> "), F.lit(0))).cast("long").alias("n_cues"))


@query(rf"""
with {PARTS}
select lang, source, count(*) as n_clauses, sum(length(clause))::bigint as chars,
       sum(length(regexp_replace(clause, '[\s\x0B\p{{Z}}{_MARKS}]', '', 'g')))::bigint as compact_chars, max(length(clause))::bigint as longest
from clauses group by lang, source
""")
def clause_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of the documents by language and source."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.explode(X.split_clauses(F.col("text"))).alias("clause"))
    return docs.groupBy("lang", "source").agg(
        F.count("*").alias("n_clauses"),
        F.sum(F.length("clause")).alias("chars"),
        F.sum(F.length(X.compact(F.col("clause")))).alias("compact_chars"),
        F.max(F.length("clause")).cast("long").alias("longest"),
    )


_FULL = "translate(text, '.,!', '。，！')"
_FORMS = "replace(replace(replace({}, '。', chr(1) || chr(1) || '.' || chr(1)), '，', chr(1) || chr(1) || ',' || chr(1)), '！', chr(1) || chr(1) || '!' || chr(1))"


@query(rf"""
with marked as (select doc_id, {_FORMS.format(_FULL)} as t, text from documents),
once as (select doc_id, text, regexp_replace(t, '(^|[^\s\x0B\p{{Z}}\x01])\x01([^\s\x0B\p{{Z}}\x01])', '\1 \2', 'g') as t from marked),
twice as (select doc_id, text, regexp_replace(t, '(^|[^\s\x0B\p{{Z}}\x01])\x01([^\s\x0B\p{{Z}}\x01])', '\1 \2', 'g') as t from once)
select doc_id, replace(t, chr(1), '') as marked, text as plain, regexp_replace(text, '[\s\x0B\p{{Z}}]*[{X.PERIODS}][\s\x0B\p{{Z}}]*$', '') as stripped from twice
""")
def english_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with full-width marks put in, turned back with and without spacing, and without their last period."""
    docs = table(spark, sf_dir, "documents")
    full = F.translate("text", ".,!", "。，！")
    return docs.select("doc_id", X.english_marks(full).alias("marked"), X.plain_marks(full).alias("plain"), X.strip_period(F.col("text")).alias("stripped"))
