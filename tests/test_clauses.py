"""Clause rules, spoken addresses, last marks and the piece map, case by case."""

import pytest
from pyspark.sql import functions as F

from cuesmith.functions import clauses as K
from cuesmith.operators import labels as B


def written(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parts = K.en_clause(F.split("t", " "))
    return [r.o for r in rows.select("i", F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("o")).orderBy("i").collect()]


CASES = {
    "call five oh two": " Call 502",
    "call": " Call ",
    "call bob": None,
    "June second nineteen ninety": " June 2nd, 109",
    "june second two thousand and six": " June 2 2006",
    "june second of all": " June 2 of all",
    "june twenty second two thousand six": " June twenty second 2006",
    "june second": None,
    "seven thirty p m": "7:30 pm",
    "nine eleven a m": " 911 am",
    "twelve oh a m": "12 oh am",
    "five oh six a m": "5:06 am",
    "two oh a m": "20 am",
    "ninety percent": "90%",
    "one hundred one percent": "101 percent",
    "three point one oh four": "3.104",
    "point five": None,
    "three quarter": "3/4",
    "three quarters": None,
    "the forty first": " The 41st",
    "two hundredth": "200th",
    "one two oh": "120",
    "seven": None,
    "seventeen": "17",
    "two thousand and six": "2006",
    "plain talk": None,
    "l'amour one": None,
    "": None,
}


def test_english_clauses(spark):
    assert dict(zip(CASES, written(spark, CASES), strict=True)) == CASES


def test_part_ends(spark):
    row = spark.range(1).select(K.en_clause(F.array(*map(F.lit, "July third two thousand".split()))).alias("o")).first().o
    assert [(p.text, p.kind, p.upto) for p in row] == [(" July", "text", 1), (" 3rd", "number", 2), (", ", "mark", 2), ("2000", "number", 4)]
    assert spark.sql("select cast(null as array<string>) as w").select(K.en_clause(F.col("w")).alias("o")).first().o is None


@pytest.mark.parametrize(
    ("spoken", "words"),
    [
        ("网址 W W W cats 点 org", "网址|WWW|cats|.org"),
        ("网址 a 点 b 点 9", "网址|a|点|b|点|9"),
        ("邮箱 点 A B C", "邮箱|.A|BC"),
        ("邮箱 A 点", "邮箱|A|点"),
        ("去 A B", "去|A|B"),
        ("网址", "网址"),
    ],
)
def test_web_words(spark, spoken, words):
    found = spark.createDataFrame([(spoken,)], "t string").select(K.web_words(F.split("t", " ")).alias("o")).first().o
    assert "|".join(w.text for w in found) == words
    assert found[-1].upto == len(spoken.split())


@pytest.mark.parametrize(
    ("tokens", "rendered", "labels", "mark", "expected"),
    [
        ("三 点 五", "3.5", "SA SC SA", 2, ""),
        ("一 百 二 十 点 五", "120.5", "BA MA MA EA SC SA", 2, "."),
        ("负 三 点 五", "-3.5", "SC SA SC SA", 2, "."),
        ("十 二", "12", "BA EA", 2, ""),
        ("五 洞", "50", "BB EB", 2, "."),
        ("三 点 半", "3:30", "BD MD ED", 2, ""),
        ("三 点 十 分", "3:10", "BD MD MD ED", 2, "."),
        ("十 二 三", "12 3", "BA EA SB", 2, ""),
        ("几 点", "几点", "O O", 4, "？"),
        ("hello", " Hello", "O O O O O", 0, "."),
        ("好 ok", "好ok", "O O O", 0, ""),
        ("五 元", "5元", "SA O", 1, "，"),
    ],
)
def test_final_mark(spark, tokens, rendered, labels, mark, expected):
    row = spark.createDataFrame([(tokens.split(), rendered, labels.split(), mark)], "t array<string>, r string, l array<string>, m int")
    args = F.col("t"), F.col("r"), F.col("l"), F.col("m")
    assert row.select(K.final_mark(*args).alias("o")).first().o == expected
    assert row.select(K.final_mark(*args, final=False).alias("o")).first().o == ""


def test_piece_map(spark):
    tokens = spark.createDataFrame([("whole",), ("好ab",), ("a b",), (" ",), ("zz",), ("ab",), ("ab",)], "token string")
    vocab = spark.createDataFrame([("a",), ("@@b",), ("b",), ("好",)], "token string")
    known = spark.createDataFrame([("whole", ["one", "two"]), ("ab", ["AB"])], "source string, pieces array<string>")
    found = {r.token: r.pieces for r in B.lookup_pieces(tokens, vocab, known).collect()}
    assert found == {"whole": ["one", "two"], "好ab": ["好", "AB"], "a b": ["a", "b"], " ": ["[UNK]"], "zz": ["[UNK]"], "ab": ["AB"]}
