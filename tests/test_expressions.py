"""Labelled Chinese number spans, the symbols between them and words on token bounds, case by case."""

from pyspark.sql import functions as F

from cuesmith.functions import expressions as E

#: Characters, labels, the written pieces.
CASES = [
    ("十二元", "BA EA O", "12|元"),
    ("三百", "MA EA", "300"),
    ("两五", "BB EB", "两|五"),
    ("五六", "BB EB", "56"),
    ("八点半", "BD MD ED", "8:30"),
    ("万", "E", "1万"),
    ("百分之五点零五", "BC MC EC SA SC BB EB", "5.05%"),
    ("三分之二", "SA BC O SA", "2|/|3"),
    ("万分之二", "E BC O SA", "万min之2"),
    ("不大于五", "O BC EC SA", "不|大于|5"),
    ("点五", "SC SA", "点|5"),
    ("三点一四", "SA SC BB EB", "3|.|14"),
    ("三点十四", "SA SC BA EA", "3|.|十4"),
    ("三五", "SA SB", "3| 5"),
    ("三五", "SB SA", "3|5"),
    ("三五摄氏度", "SB SA BC MC EC", "3| 5|℃"),
    ("一点三五摄氏度", "SA SC SB SA BC MC EC", "1|.|3|5|℃"),
    ("一点零五", "SA SC SA SB", "1|.|0|5"),
    ("八点半五", "BD MD ED SA", "8:30| 5"),
    ("负三减二", "SC SA SC SA", "-|3|-|2"),
    ("", "", ""),
]


def test_expressions(spark):
    rows = spark.createDataFrame([(i, list(c), k.split()) for i, (c, k, _) in enumerate(CASES)], "i int, c array<string>, k array<string>")
    pieces = E.zh_semantics(E.convert_spans(F.col("c"), F.col("k")))
    found = rows.select("i", F.array_join(F.transform(pieces, lambda p: p["text"]), "|").alias("o")).orderBy("i").collect()
    assert [r.o for r in found] == [w for _, _, w in CASES]
    none = spark.sql("select cast(null as array<string>) as c, cast(null as array<string>) as k")
    assert none.select(E.zh_semantics(E.convert_spans(F.col("c"), F.col("k"))).alias("o")).first().o is None


def test_words_on_tokens(spark):
    row = spark.createDataFrame([(list("共三百点五元整"), "O BA EA O O O O".split(), ["共三", "百", "点五", "元整"])], "c array<string>, k array<string>, t array<string>")
    words = E.merge_on_tokens(E.convert_spans(F.col("c"), F.col("k")), F.col("t"))
    found = row.select(words.alias("w"), E.coalesce_within_tokens(words, F.col("t")).alias("v")).first()
    assert [tuple(w) for w in found.w] == [("共300", "text", 3), ("点五", "text", 5), ("元整", "text", 7)]
    assert found.v == found.w
    split = spark.createDataFrame([("[('ab', 'number', 2), ('c', 'text', 3), ('d', 'text', 4)]",)], "x string")
    given = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(k).alias("kind"), F.lit(u).alias("upto")) for t, k, u in [("ab", "number", 2), ("c", "text", 3), ("d", "text", 4)]])
    joined = split.select(E.coalesce_within_tokens(given, F.array(F.lit("abc"), F.lit("d"))).alias("v")).first().v
    assert [tuple(w) for w in joined] == [("abc", "number", 3), ("d", "text", 4)]
    # a span that stayed as spoken is cut at token ends
    kept = spark.createDataFrame([(list("大于五"), "BC MC EC".split(), ["大", "于五"])], "c array<string>, k array<string>, t array<string>")
    cut = kept.select(E.merge_on_tokens(E.convert_spans(F.col("c"), F.col("k")), F.col("t")).alias("w")).first().w
    assert [tuple(w) for w in cut] == [("大", "number", 1), ("于五", "number", 3)]
