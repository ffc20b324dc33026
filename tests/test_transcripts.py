"""The normalisation of labelled transcripts: each stage on words with source ends, and whole utterances."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuesmith.functions import transcripts as R
from cuesmith.functions.expressions import WORDS
from cuesmith.operators.transcripts import normalise_transcripts, utterances


def arrays(spark, rows):
    """Rows of (words, anything) with the words as WORDS."""
    return spark.createDataFrame([(i, w) for i, w in enumerate(rows)], f"i int, w {WORDS}")


def found(df, column):
    return [[tuple(x) for x in r.o] for r in df.select("i", column.alias("o")).orderBy("i").collect()]


def rules(*pairs):
    return F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in pairs]).cast("array<struct<source:string,target:string>>")


REPLACED = [
    # a rule's target is another rule's source, but not an earlier one's
    ([("w1", "text", 2)], [("w1", "w2"), ("w2", "w3"), ("d", "w1")], [("w3", "text", 2)]),
    # words of ASCII letters are hit whole
    ([("overrun run", "text", 11)], [("run", "walk")], [("overrun ", "text", 8), ("walk", "text", 11)]),
    ([("run_2 run", "text", 9)], [("run", "walk")], [("run_2 ", "text", 6), ("walk", "text", 9)]),
    # across two words: what is left of the first and of the last one keeps its kind
    ([("甲乙", "number", 2), ("丙丁", "mark", 4)], [("乙丙", "戊己庚")], [("甲", "number", 1), ("戊己庚", "text", 3), ("丁", "mark", 4)]),
    # a word in between goes
    ([("甲", "text", 1), ("12", "number", 3), ("乙", "text", 4), ("x", "text", 5)], [("甲12乙", "丙")], [("丙", "text", 4), ("x", "text", 5)]),
    # an empty target leaves no word; what is left of a first word ends as far on as it is long
    ([("嗯", "text", 1), ("300元", "number", 4)], [("嗯", ""), ("元", "块")], [("300", "number", 3), ("块", "text", 4)]),
    # every hit, from left to right; the target isn't searched again
    ([("a·a", "text", 3)], [("·", "··")], [("a", "text", 1), ("··", "text", 2), ("a", "text", 3)]),
    ([("--- -", "text", 5)], [("--", "-")], [("-", "text", 2), ("- -", "text", 5)]),
    # what was written before a place counts for its bounds
    ([("x。x。", "text", 4)], [("x。", "y")], [("y", "text", 2), ("x。", "text", 4)]),
    ([("😀a😀a", "text", 4)], [("a", "bc")], [("😀", "text", 1), ("bc", "text", 2), ("😀", "text", 3), ("bc", "text", 4)]),
    ([("same", "text", 4)], [("", "x"), ("other", "y")], [("same", "text", 4)]),
    ([], [("a", "b")], []),
]


def test_replaced_words(spark):
    df = spark.createDataFrame([(i, w, r) for i, (w, r, _) in enumerate(REPLACED)], f"i int, w {WORDS}, r array<struct<source:string,target:string>>")
    assert found(df, R.replace_words(F.col("w"), F.col("r"))) == [want for _, _, want in REPLACED]


def slow_replace(words, table):
    """One character at a time, each with the word it is in."""
    for source, target in table:
        since = 0
        while source:
            text, starts, at = "".join(w[0] for w in words), [], 0
            for w in words:
                starts.append(at)
                at += len(w[0])
            hits = [
                i
                for i in range(since, len(text) - len(source) + 1)
                if text.startswith(source, i)
                and not (re.match("[A-Za-z0-9_]", source) and i and re.match("[A-Za-z0-9_]", text[i - 1]))
                and not (re.match("[A-Za-z0-9_]", source[-1]) and re.match("[A-Za-z0-9_]", text[i + len(source) : i + len(source) + 1]))
            ]
            if not hits:
                break
            a, b = hits[0], hits[0] + len(source)
            first = min(k for k, w in enumerate(words) if starts[k] + len(w[0]) > a)
            last = max(k for k in range(len(words)) if starts[k] < b)
            head, tail = words[first][0][: a - starts[first]], words[last][0][b - starts[last] :]
            kept = (words[first - 1][2] if first else 0) + len(head)
            middle = [(head, words[first][1], kept), (target, "text", max(kept, words[last][2] - len(tail))), (tail, words[last][1], words[last][2])]
            words, since = words[:first] + [w for w in middle if w[0]] + words[last + 1 :], a + len(target)
    return words


def test_replaced_words_at_random(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ab一- ") for _ in range(rng.randrange(n)))
    rows = []
    for i in range(300):
        words, upto = [], 0
        for _ in range(rng.randrange(5)):
            upto += rng.randrange(1, 4)
            words.append((some(5) or "a", rng.choice(("text", "number")), upto))
        rows.append((i, words, [(some(4), some(4)) for _ in range(rng.randrange(4))]))
    df = spark.createDataFrame(rows, f"i int, w {WORDS}, r array<struct<source:string,target:string>>")
    assert found(df, R.replace_words(F.col("w"), F.col("r"))) == [slow_replace(w, r) for _, w, r in rows]


def test_spaced_words(spark):
    said = ["u s a", "Q R S", "see Q R 好 cat 12 3.5 ok!", "好 Q R", "odd x", "9 lives", "q R"]
    rows = [[(t, "text", k + 1) for k, t in enumerate(s.split(" "))] for s in said]
    want = [" U s a", " QRS", " See QR好cat 123.5ok!", "好QR", " Odd x", "9 lives", " QR"]
    got = found(arrays(spark, rows), R.spaced_words(F.col("w")))
    assert ["".join(w[0] for w in g) for g in got] == want
    assert [[w[2] for w in g] for g in got] == [[w[2] for w in r] for r in rows]


def test_clause_words(spark):
    tokens = "call five six then twenty percent two of them".split()
    marks = [0, 0, 1, 0, 0, 2, 0, 0, 4]
    ends = [sum(map(len, tokens[: i + 1])) for i in range(len(tokens))]
    words = [(" " + t, "text", e) for t, e in zip(tokens, ends, strict=True)]
    df = spark.createDataFrame([(0, words, tokens, marks), (1, words, tokens, [0] * 9), (2, words, [*tokens[:-1], "l'un"], marks)], f"i int, w {WORDS}, t array<string>, m array<int>")
    first, none, other = found(df, R.clause_words(F.col("w"), F.col("t"), F.col("m")))
    assert first == [(" Call", "text", 4), (" 56", "number", 11), ("then", "text", 15), (" twenty", "text", 21), (" percent", "text", 28), ("two", "text", 31), *words[7:]]
    assert none == words and other == words


def test_per_mille_words(spark):
    rows = [[(t, "text", k + 1) for k, t in enumerate(s.split("|"))] for s in ("3.5|‰", "3.|‰|‰", ".|‰", "a|‰|7|‰", "-3|‰", ".5|‰|x")]
    got = found(arrays(spark, rows), R.per_mille_words(F.col("w")))
    assert ["|".join(w[0] for w in g) for g in got] == ["3.5‰", "3.‰|‰", ".|‰", "a|‰|7‰", "-3|‰", ".5‰|x"] and got[0] == [("3.5‰", "text", 2)]


#: Tokens, number labels of the characters, mark labels of the tokens, is it final, what is written.
UTTERANCES = [
    ("共|三百|元", "O BA EA O", "0 0 2", True, "共|300|元|。"),
    ("共|三百|元", "O BA EA O", "0 1 2", False, "共|300|，|元"),
    ("共三|百|元", "O BA EA O", "1 3 4", True, "共300|！|元|？"),
    ("call|five|six|yes", "O O O O O O O O O O O O O O", "0 0 1 0", True, " Call| 56|, |yes|."),
    ("see|you|at|noon", "O O O O O O O O O O O O", "0 3 0 4", True, " See| you|!|at| noon|."),
    ("v|二", "SA SB", "0 2", True, " V| 2|."),  # an ASCII character's label counts for nothing
    ("零点|十分", "BD MD MD ED", "0 2", True, "00:10|."),
    ("网址|W|W|cats|点|org", " ".join("O" * 12), "0 0 0 0 0 2", True, "网址|WW|cats|.org|。"),
    ("三|点|五", "SA SC SA", "0 0 2", True, "3|.|5"),
    ("千分之|五", "BC MC EC SA", "0 2", True, "5‰|。"),
    ("好|cat|ok", "O O O O O O O", "0 0 2", True, "好|cat| ok|。"),
    ("东西|多少", "O O O O", "1 4", True, "物品|，|多少|？"),
    ("保|三百", "O BA EA", "0 2", True, "保|三百|。"),
    ("|好|", "O", "1 2 3", True, "好|。"),
    ("", "", "", True, ""),
]


def test_utterances(spark):
    data = [(i, t.split("|") if t else [], n.split(), [int(x) for x in m.split()], f, "kept") for i, (t, n, m, f, _) in enumerate(UTTERANCES)]
    rows = spark.createDataFrame([*data, (99, None, None, None, True, "kept")], "utt int, tokens array<string>, num_labels array<string>, mark_labels array<int>, done boolean, text2 string")
    got = normalise_transcripts(rows, rules(("东西", "物品")), F.array(F.lit("保三百")), F.col("done")).orderBy("utt").collect()
    assert ["|".join(r.words) for r in got] == [*(u[4] for u in UTTERANCES), ""]
    assert all(r.text == "".join(r.words) and r.text2 == "kept" for r in got)
    ascii_marks = normalise_transcripts(rows.where("utt = 2"), english=True).first()
    assert ascii_marks.text == "共300!元?"


@pytest.mark.parametrize("final", [True, False])
def test_labelled_characters(spark, final):
    chars = [(7, 0, "共", 0, "O", 0), (7, 1, "三", 1, "BA", 0), (7, 2, "百", 1, "EA", 1), (7, 3, "元", 2, "O", 2), (8, 0, "o", 0, "O", 0), (8, 1, "k", 0, "O", 1)]
    df = spark.createDataFrame(chars[::-1], "utt long, pos int, ch string, token_pos int, num_label string, mark_label int")
    rows = utterances(df)
    assert [tuple(r) for r in rows.orderBy("utt").collect()] == [(7, ["共", "三百", "元"], ["O", "BA", "EA", "O"], [0, 1, 2]), (8, ["ok"], ["O", "O"], [1])]
    got = {r.utt: r.text for r in normalise_transcripts(rows, final=final).collect()}
    assert got == ({7: "共300，元。", 8: " Ok."} if final else {7: "共300，元", 8: " Ok"})
    assert normalise_transcripts(rows.limit(0)).count() == 0
