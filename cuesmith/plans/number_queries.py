"""Queries over spoken numbers, made from keys and dates of the tables by translation, so that SQL knows the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.functions import numbers as N
from cuesmith.plans.catalog import query, table

ZH = "零一二三四五六七八九"
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


@query("select o_orderkey, o_orderkey::varchar as digits from orders")
def zh_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys read digit by digit in Chinese, and back."""
    orders = table(spark, sf_dir, "orders")
    spoken = F.translate(F.col("o_orderkey").cast("string"), "0123456789", ZH)
    return orders.select("o_orderkey", N.zh_digits(spoken).alias("digits"))


def _spelled(n):
    """A number below 10,000 with 千, 百 and 十, each zero in between as 零 once (leading ones none)."""
    text = F.lit("")
    for unit, mark in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        digit = (F.floor(n / unit) % 10).cast("int")
        text = F.concat(text, F.when(digit == 0, F.lit("零")).otherwise(F.concat(F.substring(F.lit(ZH), digit + 1, F.lit(1)), F.lit(mark))))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "零+", "零"), "零$", ""), "^零", "")


@query("""
select l_orderkey, l_linenumber, case when k < 10000 then k::varchar else format('{:,}', k) end as cardinal, k as value
from (select l_orderkey, l_linenumber, l_orderkey % 9999 * 10000 + l_partkey % 9998 + 1 as k from lineitem)
""")
def zh_cardinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of up to eight digits spelled with 万, and back."""
    lines = table(spark, sf_dir, "lineitem")
    high, low = F.col("l_orderkey") % 9999, F.col("l_partkey") % 9998 + 1
    spoken = F.concat(F.when(high > 0, F.concat(_spelled(high), F.lit("万"), F.when(low < 1000, "零").otherwise(""))).otherwise(""), _spelled(low))
    said = lines.select("l_orderkey", "l_linenumber", spoken.alias("spoken"))
    return said.select("l_orderkey", "l_linenumber", N.zh_cardinal(F.col("spoken")).alias("cardinal"), N.zh_value(F.col("spoken")).alias("value"))


@query("""
select o_orderkey, case when m = 0 then h || '点' else h || ':' || printf('%02d', m) end as clock
from (select o_orderkey, o_orderkey % 24 as h, o_custkey % 60 as m from orders)
""")
def zh_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock times in Chinese, with 半, 刻 and 整 where they fit, in digits."""
    orders = table(spark, sf_dir, "orders")
    h, m = F.col("o_orderkey") % 24, F.col("o_custkey") % 60
    say = lambda n: F.when(n == 0, "零").otherwise(_spelled(n))
    minute = F.when(m == 0, "整").when(m == 30, "半").when(m == 15, "一刻").when(m == 45, "三刻").otherwise(F.concat(_spelled(m), F.lit("分")))
    said = orders.select("o_orderkey", F.concat(say(h), F.lit("点"), minute).alias("spoken"))
    return said.select("o_orderkey", N.zh_time(F.col("spoken")).alias("clock"))


def _english(n):
    """Words of a number below one million."""
    units, tens = F.array(*map(F.lit, UNITS)), F.array(*map(F.lit, TENS))
    at = lambda a, i: F.get(a, i.cast("int"))

    def small(k):
        below = F.when(k % 100 < 20, F.when(k % 100 > 0, at(units, k % 100)).otherwise("")).otherwise(F.concat_ws(" ", at(tens, F.floor(k % 100 / 10) - 2), F.when(k % 10 > 0, at(units, k % 10))))
        return F.trim(F.concat_ws(" and ", F.when(k >= 100, F.concat(at(units, F.floor(k / 100)), F.lit(" hundred"))), F.when(below != "", below)))

    high, low = F.floor(n / 1000), n % 1000
    return F.when(n == 0, "zero").otherwise(F.trim(F.concat_ws(" ", F.when(high > 0, F.concat(small(high), F.lit(" thousand"))), F.when(low > 0, small(low)))))


@query("""
select p_partkey, v as value, v::varchar || case when v % 100 between 10 and 20 then 'th' when v % 10 = 1 then 'st' when v % 10 = 2 then 'nd' when v % 10 = 3 then 'rd' else 'th' end as ordinal,
       19 + p_size as year, p_size::varchar as digits
from (select p_partkey, p_size, p_partkey * 37 % 999999 as v from part)
""")
def en_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in English words, words after nineteen added as cardinals are, sizes digit by digit; and back."""
    part = table(spark, sf_dir, "part").withColumn("v", F.col("p_partkey") * 37 % 999_999)
    units = F.array(*map(F.lit, UNITS))
    value = N.en_cardinal(F.split(_english(F.col("v")), " "))
    year = F.concat(F.lit("nineteen "), F.when(F.col("p_size") > 0, _english(F.col("p_size"))).otherwise("hundred"))
    spoken = F.transform(F.split(F.col("p_size").cast("string"), ""), lambda d: F.get(units, d.try_cast("int")))
    digits = F.filter(spoken, lambda w: w.isNotNull())
    return part.select("p_partkey", value.alias("value"), F.concat(value.cast("string"), N.ordinal_suffix(value)).alias("ordinal"), N.en_year(F.split(year, " ")).cast("int").alias("year"), N.en_digits(digits).alias("digits"))
