"""Queries over whole labelled utterances: made from the tables' keys and texts, so that SQL knows what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.functions import transcripts as R
from cuesmith.functions.expressions import WORDS
from cuesmith.operators import transcripts
from cuesmith.plans.catalog import query, table
from cuesmith.plans.clause_queries import _digit_words
from cuesmith.plans.number_queries import ZH, _english, _spelled


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: a small file is one task, and its rows are much work each."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


RULES = (("东西", "物品"), ("品多", "品太多"), ("千克", "公斤"), ("嗯", ""))


def _rules():
    return F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in RULES])


def _tagged(text, kind):
    """Number labels of the characters of text, all one span."""
    n = F.length(text)
    return F.when(n == 1, f"S{kind}").otherwise(F.concat(F.lit(f"B{kind}"), F.repeat(F.lit(f" M{kind}"), n - 2), F.lit(f" E{kind}")))


def _outside(text):
    return F.rtrim(F.repeat(F.lit("O "), F.length(text)))


@query("""
with p as (select *, o_orderkey % 999 + 1 as a, o_custkey % 99 + 1 as b, o_orderkey % 9 as kind, o_custkey % 3 <> 0 as final from orders)
select o_orderkey,
  case kind
    when 0 then '共' || a || '元' || case when o_orderkey % 4 = 0 then '' else case o_orderkey % 4 when 1 then '，' when 2 then '。' else '！' end end || '给' || b || '人' || case when final then '？' else '' end
    when 1 then ' Call ' || o_orderkey || ', ' || a || case when a > 100 then ' percent' else '%' end || case when final then '.' else '' end
    when 2 then '物品太多重' || a || '公斤' || case when final then '。' else '' end
    when 3 then a || '.' || o_orderkey || '‰' || case when final then '。' else '' end
    when 4 then '00:' || lpad((10 + o_custkey % 50)::varchar, 2, '0') || case when final then '.' else '' end
    when 5 then '网址WW' || o_orderkey || '.com' || case when final then '。' else '' end
    when 6 then ' Route ' || o_orderkey || ' to X' || case when final then '!' else '' end
    when 7 then o_orderkey::varchar
    else '要保' || zh || '元' || case when final then '。' else '' end end as text
from (select *, translate(b::varchar, '0123456789', '零一二三四五六七八九') as zh from p)
""")
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled utterances around order keys, normalised whole: amounts with marks, two English clauses, replaced words, per mille,
    midnight, web addresses, mixed text, bare digits, protected phrases; two of three have ended."""
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 9
    a, b = _spelled(key % 999 + 1), _spelled(F.col("o_custkey") % 99 + 1)
    digits = F.translate(key.cast("string"), "0123456789", ZH)
    read = F.translate((F.col("o_custkey") % 99 + 1).cast("string"), "0123456789", ZH)
    minutes = _spelled(F.col("o_custkey") % 50 + 10)
    lit = F.lit
    call = F.concat(lit("call "), _digit_words(key))
    percent = F.concat(_english(key % 999 + 1), lit(" percent"))
    said = [
        (F.concat_ws(" ", lit("共"), a, lit("元 给"), b, lit("人")), F.concat_ws(" ", lit("O"), _tagged(a, "A"), lit("O O"), _tagged(b, "A"), lit("O"))),
        (F.concat_ws(" ", call, percent), _outside(F.concat(call, percent))),
        (F.concat_ws(" ", lit("嗯 东 西多"), F.concat(lit("重"), a), lit("千克")), F.concat_ws(" ", lit("O O O O O"), _tagged(a, "A"), lit("O O"))),
        (F.concat_ws(" ", a, lit("点"), digits, lit("‰")), F.concat_ws(" ", _tagged(a, "A"), lit("SC"), _tagged(digits, "B"), lit("O"))),
        (F.concat_ws(" ", lit("零点"), F.concat(minutes, lit("分"))), _tagged(F.concat(lit("零点"), minutes, lit("分")), "D")),
        (F.concat_ws(" ", lit("网址 W W"), key.cast("string"), lit("点 com")), _outside(F.concat(lit("网址WW点com"), key.cast("string")))),
        (F.concat_ws(" ", lit("route"), digits, lit("to X")), F.concat_ws(" ", lit("O O O O O"), _tagged(digits, "B"), lit("O O O"))),
        (digits, _tagged(digits, "B")),
        (F.concat(lit("要保"), read, lit(" 元")), F.concat_ws(" ", lit("O O"), _tagged(read, "A"), lit("O"))),
    ]
    pick = lambda of: F.coalesce(*[F.when(kind == i, of(s)) for i, s in enumerate(said)])
    rows = _spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", "o_custkey", F.split(pick(lambda s: s[0]), " ").alias("tokens"), F.split(pick(lambda s: s[1]), " ").alias("num_labels"))
    n = F.size("tokens")
    at_call = F.length(key.cast("string"))  # the last digit of a call

    def mark(_, i):
        last = i == n - 1
        return (
            F.when((kind == 0) & (i == 2), (key % 4).cast("int"))
            .when((kind == 1) & (i == at_call), 1)
            .when(last, F.when(kind == 0, 4).when(kind == 6, 3).otherwise(2))
            .otherwise(0)
        )

    rows = rows.withColumn("mark_labels", F.transform("tokens", mark))
    spans = F.array(F.concat(lit("保"), read))
    return transcripts.normalise_transcripts(rows, _rules(), spans, F.col("o_custkey") % 3 != 0).select("o_orderkey", "text")


@query("""
with m as (select conv_id, turn, w, generate_subscripts(w, 1) as i, unnest(w) as x
           from (select conv_id, turn, regexp_extract_all(text, '[A-Za-z]+[^A-Za-z]?') as w from conversations where text is not null)),
t as (select conv_id, turn, i, len(w) as n, regexp_extract(x, '^[A-Za-z]+') as word, regexp_extract(x, '[,.!?]$') as mark from m),
p as (select *, lag(word) over u as before, lag(mark) over u as closed from t window u as (partition by conv_id, turn order by i)),
s as (select *, case when i = 1 then upper(word[1]) || word[2:] else word end as raised,
             case when i = 2 then upper(before[1]) || before[2:] else before end as last from p),
b as (select *, case when i > 1 and (closed <> '' or (regexp_full_match(raised, '[A-Z]') and regexp_full_match(last, '[A-Z]'))) then '' else ' ' end as blank from s)
select conv_id, turn, string_agg(blank || raised || case when i = n then '.' when mark = ',' then ', ' else mark end, '' order by i) as text
from b group by conv_id, turn
""")
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversation turns as spoken ASCII words with the marks after them as labels: clauses, capitals, blanks and marks."""
    turns = _spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[A-Za-z]+[^A-Za-z]?"), F.lit(0)).alias("w")).where("size(w) > 0")
    label = lambda x: F.when(F.endswith(x, F.lit(",")), 1).when(F.endswith(x, F.lit(".")), 2).when(F.endswith(x, F.lit("!")), 3).when(F.endswith(x, F.lit("?")), 4).otherwise(0)
    rows = turns.select("conv_id", "turn", F.transform("w", lambda x: F.regexp_extract(x, "^[A-Za-z]+", 0)).alias("tokens"), F.array().cast("array<string>").alias("num_labels"), F.transform("w", label).alias("mark_labels"))
    return transcripts.normalise_transcripts(rows).select("conv_id", "turn", "text")


@query("""
with p as (select *, p_size % 3 as kind from part)
select p_partkey,
  case kind when 0 then '甲:' || 1 || '|' || p_size || '号:' || (length(p_size::varchar) + 2) || '|丁:' || (length(p_size::varchar) + 3)
            when 1 then 'box:3|' || p_size || ' :' || (length(p_size::varchar) + 4) || '|kits:' || (length(p_size::varchar) + 8)
            else '乙:1|' || p_size || '乙:' || (length(p_size::varchar) + 2) end as words
from p
""")
def replaced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules across words, chained rules and word bounds around part sizes, with the source ends of the words that come out."""
    size, kind = F.col("p_size").cast("string"), F.col("p_size") % 3
    n = F.length(size)
    word = lambda text, upto: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit("text").alias("kind"), (F.lit(upto) if isinstance(upto, int) else upto).cast("int").alias("upto"))
    words = (
        F.when(kind == 0, F.array(word(F.concat(F.lit("甲"), size), n + 1), word("丙丁", n + 3)).cast(WORDS))
        .when(kind == 1, F.array(word("box", 3), word(F.concat(size, F.lit(" items")), n + 8)).cast(WORDS))
        .otherwise(F.array(word(F.concat(F.lit("乙"), size, F.lit("甲")), n + 2)).cast(WORDS))
    )
    chained = F.array(*[F.struct(a.alias("source"), b.alias("target")) for a, b in ((F.concat(size, F.lit("丙")), F.concat(size, F.lit("号"))), (F.lit("items"), F.lit("kits")), (F.lit("kit"), F.lit("bag")), (F.concat(size, F.lit("甲")), F.concat(size, F.lit("乙"))))])
    out = R.replace_words(words, chained)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(out, lambda w: F.concat_ws(":", w["text"], w["upto"].cast("string"))), "|").alias("words"))
