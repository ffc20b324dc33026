"""Spoken numbers as column expressions: Chinese cardinals, digit readings and clock times; English cardinals, ordinals, years, digits."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits with their spoken forms, units, English number words.
ZH_DIGITS = {0: "零〇洞", 1: "一壹幺", 2: "二贰两", 3: "三叁", 4: "四肆", 5: "五伍", 6: "六陆", 7: "七柒", 8: "八捌", 9: "九玖"}
ZH_SMALL = {10: "十拾", 100: "百佰", 1_000: "千仟"}
ZH_LARGE = {10_000: "万萬", 100_000_000: "亿億", 1_000_000_000_000: "兆"}
ZH_TAILS = "万萬亿億"
EN_CARDINALS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
EN_ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
    "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16, "seventeenth": 17,
    "eighteenth": 18, "nineteenth": 19, "twentieth": 20, "thirtieth": 30, "fortieth": 40, "fiftieth": 50, "sixtieth": 60,
    "seventieth": 70, "eightieth": 80, "ninetieth": 90, "hundredth": 100, "thousandth": 1_000, "millionth": 1_000_000,
}
EN_DENOMINATORS = {"half": 2, "third": 3, "quarter": 4}

ZH_DIGIT_CHARS = "".join(ZH_DIGITS.values()) + "0123456789"


def _map(values: dict[str, int]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}L" for k, v in values.items()) + ")")


def _by_char(groups: dict[int, str]) -> dict[str, int]:
    return {c: value for value, chars in groups.items() for c in chars}


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def bind(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def zh_digits(text: Column) -> Column:
    """Spoken digits one by one as ASCII digits; other characters stay."""
    flat = _by_char(ZH_DIGITS)
    return F.translate(text, "".join(flat), "".join(map(str, flat.values())))


def zh_value(text: Column) -> Column:
    """The number that a Chinese numeral spells, null where it isn't one or leaves 64 bits."""
    digits, small, large = _map(_by_char(ZH_DIGITS) | {str(i): i for i in range(10)}), _map(_by_char(ZH_SMALL)), _map(_by_char(ZH_LARGE))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("section"), none.alias("number"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        d, s, g = F.try_element_at(digits, c), F.try_element_at(small, c), F.try_element_at(large, c)
        section = F.try_add(acc["section"], F.try_multiply(F.coalesce(acc["number"], F.lit(1).cast("long")), s))
        total = F.try_add(acc["total"], F.try_multiply(F.try_add(acc["section"], F.coalesce(acc["number"], zero)), g))
        state = lambda t, sec, n, ok: F.struct(t.alias("total"), sec.alias("section"), n.alias("number"), ok.alias("ok"))
        return (
            F.when(d.isNotNull(), state(acc["total"], acc["section"], d, acc["ok"]))
            .when(s.isNotNull(), state(acc["total"], section, none, acc["ok"] & section.isNotNull()))
            .when(g.isNotNull(), state(total, zero, none, acc["ok"] & total.isNotNull()))
            .otherwise(state(acc["total"], acc["section"], acc["number"], F.lit(False)))
        )

    by_units = F.aggregate(_chars(text), start, step, lambda a: F.when(a["ok"], F.try_add(F.try_add(a["total"], a["section"]), F.coalesce(a["number"], zero))))
    plain = zh_digits(text)
    by_digits = F.when(plain.rlike("^[0-9]+$"), F.expr("1") * plain.try_cast("long"))
    units = "".join(chain(ZH_SMALL.values(), ZH_LARGE.values()))
    return F.when(text.rlike(f"[{units}]"), by_units).when(text != "", by_digits)


def grouped(value: Column) -> Column:
    return F.format_number(value, 0)


def zh_cardinal(text: Column) -> Column:
    """A Chinese numeral in digits: grouped by thousands from 10,000 on; a single 万 or 亿 at the end stays as the unit; else the text."""

    def parts(t: Column) -> Column:
        tail, head = F.right(t, F.lit(1)), F.left(t, F.length(t) - 1)
        once = tail.rlike(f"^[{ZH_TAILS}]$") & (F.length(t) - F.length(F.replace(t, tail, F.lit(""))) == 1)
        coefficient = zh_value(F.when(once, F.when(head == "", F.lit("一")).otherwise(head)))
        return F.struct(t.alias("text"), tail.alias("tail"), coefficient.alias("coefficient"), zh_value(t).alias("value"))

    def render(p: Column) -> Column:
        short = F.when(F.abs(p["coefficient"]) >= 1_000, grouped(p["coefficient"])).otherwise(p["coefficient"].cast("string"))
        whole = F.when(F.abs(p["value"]) < 10_000, p["value"].cast("string")).otherwise(grouped(p["value"]))
        return F.when(p["coefficient"].isNotNull(), F.concat(short, p["tail"])).otherwise(F.coalesce(whole, p["text"]))

    return bind(bind(text, parts), render)


def zh_time(text: Column) -> Column:
    """A spoken clock time as H:MM; the hour alone keeps its mark; what isn't a time stays."""
    split = r"^([^点时]+)([点时])([\s\S]*)$"

    def parts(t: Column) -> Column:
        return F.struct(t.alias("text"), *[F.regexp_extract(t, split, i).alias(n) for i, n in enumerate(("hour", "mark", "rest"), 1)])

    def values(p: Column) -> Column:
        spoken = F.regexp_replace(p["rest"], "[钟分]$", "")
        minute = F.when(spoken == "半", 30).when(spoken == "一刻", 15).when(spoken == "三刻", 45).otherwise(zh_value(spoken))
        bare_zero = spoken.isin("零", "〇", "洞") & (spoken == p["rest"])
        return F.struct(p["text"].alias("text"), p["mark"].alias("mark"), p["rest"].alias("rest"), zh_cardinal(p["hour"]).alias("hour"), F.when(~bare_zero, minute).alias("minute"))

    def render(p: Column) -> Column:
        return (
            F.when((p["mark"] == "") | ~p["hour"].rlike("^[0-9,]+$"), p["text"])
            .when(p["rest"].isin("", "整"), F.concat(p["hour"], p["mark"]))
            .when(p["minute"].isNull(), p["text"])
            .otherwise(F.concat(p["hour"], F.lit(":"), F.lpad(p["minute"].cast("string"), 2, "0")))
        )

    return bind(bind(bind(text, parts), values), render)


def en_cardinal(words: Column) -> Column:
    """The number that English words (an array) spell; null where a word isn't a number word or none is."""
    units = _map(EN_CARDINALS)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("now"), F.lit(False).alias("some"), F.lit(True).alias("ok"))

    def step(a: Column, w: Column) -> Column:
        value = F.try_element_at(units, w)
        state = lambda total, now, ok=None: F.struct(total.alias("total"), now.alias("now"), F.lit(True).alias("some"), (a["ok"] if ok is None else ok).alias("ok"))
        times = lambda k: F.greatest(a["now"], one) * F.lit(k).cast("long")
        return (
            F.when(w == "and", a)
            .when(value.isNotNull(), state(a["total"], a["now"] + value))
            .when(w == "hundred", state(a["total"], times(100)))
            .when(w == "thousand", state(a["total"] + times(1_000), zero))
            .when(w == "million", state(a["total"] + times(1_000_000), zero))
            .otherwise(state(a["total"], a["now"], F.lit(False)))
        )

    return F.aggregate(words, start, step, lambda a: F.when(a["ok"] & a["some"], a["total"] + a["now"]))


def _init(words: Column) -> Column:
    return F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def en_ordinal(words: Column) -> Column:
    """The number that English words with an ordinal at their end spell."""
    last = F.try_element_at(words, F.lit(-1))
    value = F.try_element_at(_map(EN_ORDINALS), last)
    before = en_cardinal(_init(words))
    return F.when(F.size(words) == 1, value).when(last.isin("hundredth", "thousandth", "millionth"), before * value).otherwise(before + value)


def en_year(words: Column) -> Column:
    """A year in words: a cardinal, or a century and what follows."""
    century, rest = en_cardinal(F.slice(words, 1, 1)), en_cardinal(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))))
    return F.coalesce(en_cardinal(words), F.when((F.size(words) >= 2) & century.between(1, 99), century * 100 + rest))


def en_digits(words: Column) -> Column:
    """Digit words one by one; null where one isn't a digit."""
    digits = F.transform(words, lambda w: F.try_element_at(_map({w: n for w, n in EN_CARDINALS.items() if n < 10}), w).cast("string"))
    return F.when((F.size(words) > 0) & ~F.exists(digits, lambda d: d.isNull()), F.array_join(digits, ""))


def en_fraction(words: Column) -> Column:
    """A numerator and half, third or quarter as n/d."""
    below = F.try_element_at(_map(EN_DENOMINATORS), F.try_element_at(words, F.lit(-1)))
    above = en_cardinal(_init(words))
    return F.when(above.isNotNull() & below.isNotNull(), F.concat_ws("/", above.cast("string"), below.cast("string")))


def ordinal_suffix(value: Column) -> Column:
    unit = value % 10
    return F.when((value % 100).between(10, 20), "th").when(unit == 1, "st").when(unit == 2, "nd").when(unit == 3, "rd").otherwise("th")
