"""Queries over whole clauses and spoken addresses, made from the tables' keys, so that SQL knows the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.functions import clauses as K
from cuesmith.functions import expressions as E
from cuesmith.functions import numbers as N
from cuesmith.operators import labels as B
from cuesmith.plans.catalog import query, table
from cuesmith.plans.number_queries import UNITS, ZH, _english, _spelled

RANKS = list(N.EN_ORDINALS)[:19]


def _digit_words(n):
    return F.array_join(F.transform(F.filter(F.split(n.cast("string"), ""), lambda d: d != ""), lambda d: F.get(F.array(*map(F.lit, UNITS)), d.cast("int"))), " ")


@query("""
with p as (select p_partkey as k, p_size as s, p_partkey % 8 as r, p_partkey % 12 + 1 as h, p_size % 59 + 1 as m, p_partkey % 200 as a,
                  p_partkey % 19 + 1 as d, p_partkey % 9 + 21 as t from part)
select k as p_partkey,
       case r when 0 then ' Call ' || k
              when 1 then ' May ' || d || case d when 1 then 'st' when 2 then 'nd' when 3 then 'rd' else 'th' end || ', ' || (19 + s)
              when 2 then case when h = 9 and m = 11 then ' 911' else h || ':' || printf('%02d', m) end || ' pm'
              when 3 then a || case when a > 100 then ' percent' else '%' end
              when 4 then s || '.' || k
              when 5 then s || '/3'
              when 6 then ' The ' || t || case t when 21 then 'st' when 22 then 'nd' when 23 then 'rd' else 'th' end
              else (k * 37 % 999 + 10)::varchar end as text,
       case r when 0 then 2 when 1 then 4 when 2 then 2 when 3 then 2 when 4 then 3 when 6 then 2 else 1 end as parts
from p
""")
def english_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, dates, times, percents, decimals, fractions, ordinals and cardinals in English words, written."""
    k, s = F.col("p_partkey"), F.col("p_size")
    rank = lambda i: F.get(F.array(*map(F.lit, RANKS)), (i - 1).cast("int"))
    said = [
        F.concat(F.lit("call "), _digit_words(k)),
        F.concat(F.lit("May "), rank(k % 19 + 1), F.lit(" nineteen "), _english(s)),
        F.concat(_english(k % 12 + 1), F.lit(" "), _english(s % 59 + 1), F.lit(" p m")),
        F.concat(_english(k % 200), F.lit(" percent")),
        F.concat(_english(s), F.lit(" point "), _digit_words(k)),
        F.concat(_english(s), F.lit(" third")),
        F.concat(F.lit("the twenty "), rank(k % 9 + 1)),
        _english(k * 37 % 999 + 10),
    ]
    spoken = F.coalesce(*[F.when(k % 8 == i, t) for i, t in enumerate(said)])
    found = table(spark, sf_dir, "part").select("p_partkey", K.en_clause(F.split(spoken, " ")).alias("found"))
    return found.select("p_partkey", F.array_join(F.transform("found", lambda x: x["text"]), "").alias("text"), F.size("found").alias("parts"))


@query("""
select p_partkey, case when p_partkey % 3 = 0 then '看|W|W|shop|' || p_partkey || '|点|com' when p_partkey % 3 = 1 then '网址|WW|shop|' || p_partkey || '|.com'
                       else '邮箱|ME|点|' || p_partkey || '|.org|X' end as words
from part
""")
def web_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken addresses with a part's key in them, and other tokens that stay."""
    k = F.col("p_partkey")
    spoken = F.when(k % 3 == 0, F.concat(F.lit("看 W W shop "), k, F.lit(" 点 com"))).when(k % 3 == 1, F.concat(F.lit("网址 W W shop "), k, F.lit(" 点 com"))).otherwise(F.concat(F.lit("邮箱 M E 点 "), k, F.lit(" 点 org X")))
    words = K.web_words(F.split(spoken, " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(words, lambda x: x["text"]), "|").alias("words"))


@query("""
select o_orderkey, case o_orderkey % 4 when 0 then '' when 1 then '。' when 2 then '.' else '？' end as mark from orders
""")
def final_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last mark of bare digit readings, Chinese counts, Latin texts and Chinese questions around order keys."""
    key = F.col("o_orderkey")
    spoken, kind = F.translate(key.cast("string"), "0123456789", ZH), key % 4
    raw = F.when(kind == 0, spoken).when(kind == 1, F.concat(F.lit("共计"), spoken)).when(kind == 2, "ok then").otherwise(F.concat(spoken, F.lit("吗")))
    tokens = F.when(kind == 2, F.array(F.lit("ok"), F.lit("then"))).otherwise(F.filter(F.split(raw, ""), lambda c: c != ""))
    rendered = F.when(kind == 2, " Ok then").otherwise(N.zh_digits(raw))
    labels = F.transform(F.filter(F.split(raw, ""), lambda c: c != ""), lambda c: F.when(F.contains(F.lit(ZH), c), "MB").otherwise("O"))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.final_mark(tokens, rendered, labels, F.when(kind == 3, 4).otherwise(F.when(kind == 1, 2).otherwise(1))).alias("mark"))


@query("""
with words as (select distinct unnest(string_split(p_type, ' ')) as token from part where p_type is not null)
select token, case when len(token) % 2 = 0 then lower(token) else regexp_replace(trim(regexp_replace(token, '(.)', ' @@\\1', 'g')), '^@@', '') end as pieces
from words where token <> ''
""")
def mapped_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the words of part types: those of even length from a piece map, the others letter by letter."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("token")).where("token <> ''")
    letters = words.select(F.explode(F.filter(F.split("token", ""), lambda c: c != "")).alias("token")).distinct()
    vocab = letters.unionAll(letters.select(F.concat(F.lit(B.PIECE_MARK), "token").alias("token")))
    even = words.where(F.length("token") % 2 == 0).distinct().select(F.col("token").alias("source"), F.array(F.lower("token")).alias("pieces"))
    return B.lookup_pieces(words, vocab, even).select("token", F.array_join("pieces", " ").alias("pieces"))


@query("""
select o_orderkey, case o_orderkey % 5 when 0 then a || '%' when 1 then b || '/' || a when 2 then a || '+' || b || '=' when 3 then a || '.' || o_orderkey
                                       else '共点' || a end as text
from (select *, o_orderkey % 999 + 1 as a, o_custkey % 99 + 1 as b from orders)
""")
def zh_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cents, fractions, sums, decimals and other labelled spans of Chinese text, written."""
    key = F.col("o_orderkey")
    a, b = _spelled(key % 999 + 1), _spelled(F.col("o_custkey") % 99 + 1)
    tagged = lambda text, kind: F.when(F.length(text) == 1, f"S{kind}").otherwise(F.concat(F.lit(f"B{kind}"), F.repeat(F.lit(f" M{kind}"), F.length(text) - 2), F.lit(f" E{kind}")))
    mark = lambda text: (F.lit(text), "C")
    digits = F.translate(key.cast("string"), "0123456789", ZH)
    spans = [
        [mark("百分之"), (a, "A")],
        [(a, "A"), mark("分之"), (b, "A")],
        [(a, "A"), mark("加"), (b, "A"), mark("等于")],
        [(a, "A"), mark("点"), (digits, "B")],
    ]
    by_kind = lambda f, other: F.coalesce(*[F.when(key % 5 == i, f(s)) for i, s in enumerate(spans)], other)
    text = by_kind(lambda s: F.concat(*[t for t, _ in s]), F.concat(F.lit("共点"), a))
    labels = by_kind(lambda s: F.concat_ws(" ", *[tagged(t, k) for t, k in s]), F.concat(F.lit("O SC "), tagged(a, "A")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.filter(F.split(text, ""), lambda c: c != "").alias("chars"), F.split(labels, " ").alias("labels"))
    pieces = rows.select("o_orderkey", E.convert_spans(F.col("chars"), F.col("labels")).alias("pieces"))
    written = E.zh_semantics(F.col("pieces"))
    return pieces.select("o_orderkey", F.array_join(F.transform(written, lambda p: p["text"]), "").alias("text"))


@query("select o_orderkey, '合' || (o_orderkey % 999 + 1) || '|元整' as words from orders")
def token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts whose first character shares a token with the word before: one word; the unit is a word of its own."""
    a = _spelled(F.col("o_orderkey") % 999 + 1)
    tokens = F.filter(F.array(F.concat(F.lit("合"), F.left(a, F.lit(1))), F.substring(a, F.lit(2), F.length(a)), F.lit("元整")), lambda t: t != "")
    labels = F.when(F.length(a) == 1, "O SA O O").otherwise(F.concat(F.lit("O BA"), F.repeat(F.lit(" MA"), F.length(a) - 2), F.lit(" EA O O")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tokens.alias("tokens"), F.split(labels, " ").alias("labels"))
    chars = F.filter(F.split(F.array_join("tokens", ""), ""), lambda c: c != "")
    pieces = rows.select("o_orderkey", "tokens", E.zh_semantics(E.convert_spans(chars, F.col("labels"))).alias("pieces"))
    words = E.coalesce_within_tokens(E.merge_on_tokens(F.col("pieces"), F.col("tokens")), F.col("tokens"))
    return pieces.select("o_orderkey", F.array_join(F.transform(words, lambda w: w["text"]), "|").alias("words"))
