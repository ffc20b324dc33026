"""Rules over whole clauses as column expressions: English numbers in words, spoken web addresses, the last mark of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesmith.functions import numbers as N
from cuesmith.functions.numbers import bind

# Months, marks by label, Chinese marks, characters that spoken numbers are made of, symbols that call for Chinese marks.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MARKS = {1: ", ", 2: ".", 3: "!", 4: "?"}
ZH_MARKS = {1: "，", 2: "。", 3: "！", 4: "？"}
ZH_COUNTERS = "十拾百佰千仟万萬亿億兆"
ZH_NUMBER_TALK = "十百千万亿兆点时分秒年月日号第负正半整刻加减等于大小比之"
ZH_SYMBOLS = "‰÷℃℉"
CJK = "[㐀-鿿]"


def part(text: Column | str, upto: Column | int, kind: str = "number") -> Column:
    """A piece of a written clause and the number of source words up to its end."""
    text, upto = (F.lit(v) if isinstance(v, (str, int)) else v for v in (text, upto))
    return F.struct(text.cast("string").alias("text"), F.lit(kind).alias("kind"), upto.cast("int").alias("upto"))


def _blank(text: Column) -> Column:
    return F.concat(F.lit(" "), text.cast("string"))


def _from(words: Column, i: Column | int) -> Column:
    """The words from place i (from 1) on."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.slice(words, i, F.greatest(F.size(words) - i + 1, F.lit(0)))


def _upto(words: Column, n: Column) -> Column:
    return F.slice(words, F.lit(1), F.greatest(n, F.lit(0)))


def _first(places: Column, rule) -> Column:
    """What rule gives for the first place for which it isn't null."""
    return F.get(F.filter(F.transform(places, rule), lambda r: r.isNotNull()), F.lit(0))


def _between(low: Column, high: Column) -> Column:
    """The numbers from low to high, none where high is less."""
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _is_ordinal(word: Column) -> Column:
    return word.isin(*N.EN_ORDINALS)


def _date(w: Column, n: Column, capital: Column) -> Column:
    month = _blank(F.initcap(F.get(w, F.lit(0))))

    def parse(split: Column) -> Column:
        return F.struct(split.alias("split"), N.en_ordinal(F.slice(w, F.lit(2), split - 1)).alias("day"), N.en_year(_from(w, split + 1)).alias("year"))

    def rule(p: Column) -> Column:
        split, day, year = p["split"], p["day"], p["year"]
        ending = F.concat(day.cast("string"), N.ordinal_suffix(day))
        full = F.array(part(month, 1, "text"), part(_blank(ending), split), part(", ", split, "mark"), part(year, n))
        short = F.array(part(F.concat(month, _blank(day)), 2, "text"))
        rest = F.transform(_between(split + 1, n), lambda i: part(_blank(F.get(w, i - 1)), i, "text"))
        words = F.transform(_between(F.lit(1), split), lambda i: part(F.when(i == 1, month).otherwise(_blank(F.get(w, i - 1))), i, "text"))
        written, likely = F.array(part(_blank(year), n)), F.coalesce(year.between(1000, 9999), F.lit(False))
        return (
            F.when(day.isNull(), None)
            .when(capital & year.isNotNull(), full)
            .when((split == 2) & _is_ordinal(F.get(w, F.lit(1))), F.concat(short, F.when(likely, written).otherwise(rest)))
            .when(likely, F.concat(words, written))
        )

    return F.when(F.get(w, F.lit(0)).isin(*MONTHS) & (n >= 4), _first(_between(F.lit(2), n - 1), lambda split: bind(parse(split), rule)))


def _clock(w: Column, n: Column) -> Column:
    inside = n - 2
    said = _upto(w, inside)
    half = part(_blank(F.concat(F.get(w, inside), F.get(w, inside + 1))), n, "text")

    def parse(split: Column) -> Column:
        return F.struct(split.alias("split"), N.en_cardinal(_upto(w, split)).alias("hour"), N.en_cardinal(F.slice(w, split + 1, inside - split)).alias("minute"))

    def rule(p: Column) -> Column:
        hour, minute, word = p["hour"], p["minute"], F.get(w, p["split"])
        return F.when(
            hour.between(0, 23) & minute.between(1, 59),
            F.array(part(F.concat(hour.cast("string"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")), inside), half),
        ).when(
            (hour >= 10) & (p["split"] == inside - 1) & word.isin("zero", "oh"),
            F.array(part(hour, p["split"]), part(_blank(word), inside, "text"), half),
        )

    digits = N.en_digits(said)
    found = (
        F.when(F.array_join(said, " ") == "nine eleven", F.array(part(" 911", inside), half))
        .otherwise(F.coalesce(_first(_between(F.lit(1), inside - 1), lambda split: bind(parse(split), rule)), F.when(digits.isNotNull(), F.array(part(digits, inside), half))))
    )
    return F.when((n >= 4) & F.get(w, n - 2).isin("a", "p") & (F.get(w, n - 1) == "m"), found)


#: What each rule asks for at least: how the clause begins or ends, a point in it, or nothing but number words.
_LIKELY = "|".join(
    [
        rf"^(?:call|{'|'.join(MONTHS)})(?: |\z)",
        rf"(?:^| )(?:[ap] m|percent|{'|'.join([*N.EN_DENOMINATORS, *N.EN_ORDINALS])})\z",
        r"(?:^| )point(?: |\z)",
        rf"^(?:(?:and|hundred|thousand|million|{'|'.join(N.EN_CARDINALS)})(?: |\z))++\z",
    ]
)


def en_clause(words: Column) -> Column:
    """An English clause (an array of words) with its numbers written: parts (text, kind, upto), null where no rule holds.

    In this order: call and digits, month and day and year, a.m. and p.m., percent, point, fraction, ordinal, digits, cardinal, year.
    Words that aren't ASCII letters throughout, empty clauses and null give null.
    """

    def rules(c: Column) -> Column:
        w, n, capital = c["w"], c["n"], c["capital"]
        last, rest = F.get(w, n - 1), N.en_digits(_from(w, 2))
        call = F.when((F.get(w, F.lit(0)) == "call") & ((n == 1) | rest.isNotNull()), F.array(part(" Call", 1, "text"), part(_blank(F.coalesce(rest, F.lit(""))), n)))
        before = N.en_cardinal(_upto(w, n - 1))
        percent = F.when(
            (last == "percent") & before.isNotNull(), F.array(part(before, n - 1), F.when(before > 100, part(" percent", n, "text")).otherwise(part("%", n)))
        )
        at = F.array_position(w, "point").cast("int")
        whole, decimals = N.en_cardinal(_upto(w, at - 1)), N.en_digits(_from(w, at + 1))
        point = F.when((at > 1) & whole.isNotNull() & decimals.isNotNull(), F.array(part(whole, at - 1), part(".", at), part(decimals, n)))
        below = F.try_element_at(N._map(N.EN_DENOMINATORS), last)
        fraction = F.when((n >= 2) & below.isNotNull() & before.isNotNull(), F.array(part(F.concat_ws("/", before.cast("string"), below.cast("string")), n)))
        the = (F.get(w, F.lit(0)) == "the") & (n > 2)
        rank = N.en_ordinal(F.when(the, _from(w, 2)).otherwise(w))
        ranked = F.concat(rank.cast("string"), N.ordinal_suffix(rank))
        ordinal = F.when((n >= 2) & _is_ordinal(last) & rank.isNotNull(), F.when(the, F.array(part(" The", 1, "text"), part(_blank(ranked), n))).otherwise(F.array(part(ranked, n))))
        digits, cardinal, year = N.en_digits(w), N.en_cardinal(w), N.en_year(w)
        plain = F.coalesce(F.when(n > 1, digits), F.when((n > 1) | (cardinal >= 10), cardinal.cast("string")), F.when(n > 1, year.cast("string")))
        found = F.coalesce(call, _date(w, n, capital), _clock(w, n), percent, point, fraction, ordinal, F.when(plain.isNotNull(), F.array(part(plain, n))))
        return F.when((n > 0) & F.array_join(w, " ").rlike(_LIKELY) & F.forall(w, lambda x: x.rlike(r"^[a-z]+\z")), found)

    lower = F.transform(words, lambda x: F.lower(x))
    return bind(F.struct(lower.alias("w"), F.size(words).alias("n"), F.coalesce(F.get(words, F.lit(0)).rlike("^[A-Z]"), F.lit(False)).alias("capital")), rules)


def web_words(tokens: Column) -> Column:
    """A spoken address (tokens that begin with 网址 or 邮箱) as words (text, upto): single capitals in a row joined, the last 点
    before a word of letters a dot in front of it. Other token arrays stay one word a token; null stays null."""
    n = F.size(tokens)
    at = lambda i: F.get(tokens, i - 1)

    def write(dot: Column) -> Column:
        initial = lambda i: at(i).rlike(r"^[A-Z]\z")
        starts = F.filter(_between(F.lit(1), n), lambda i: (i == 1) | (~(i == dot + 1) & ~(initial(i) & initial(i - 1) & (i != dot + 2))))
        texts = F.transform(_between(F.lit(1), n), lambda i: F.when(i == dot, ".").otherwise(at(i)))

        def word(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1) - 1, n)
            return F.struct(F.array_join(F.slice(texts, start, end - start + 1), "").alias("text"), end.alias("upto"))

        return F.transform(starts, word)

    last = (n + 1 - F.array_position(F.reverse(tokens), "点")).cast("int")
    dot = F.when((last < n) & at(last + 1).rlike(r"^[A-Za-z]+\z"), last).otherwise(-2)
    plain = F.transform(tokens, lambda t, i: F.struct(t.alias("text"), (i + 1).alias("upto")))
    return F.when(F.get(tokens, F.lit(0)).rlike("^(网址|邮箱)"), bind(dot, write)).otherwise(plain)


def mark_rules(tokens: Column, rendered: Column, labels: Column) -> Column:
    """What decides about marks: does the text take Chinese ones (chinese), is it a bare number or the like, which ends in nothing (bare),
    is it Latin and so ends in a period (latin). Arguments as for final_mark."""
    digit = N.ZH_DIGIT_CHARS
    talk, one_by_one, counted = (f"[{c}]" for c in (digit + ZH_NUMBER_TALK, digit.replace("两", ""), digit + ZH_COUNTERS))
    raw = F.array_join(tokens, "")
    has = lambda text, chars: F.regexp_like(text, F.lit(chars))
    only = lambda text, chars: F.regexp_like(text, F.lit(rf"^{chars}*\z"))
    chinese = has(rendered, f"{CJK}|[{ZH_SYMBOLS}]") | F.coalesce(has(F.try_element_at(tokens, F.lit(-1)), f"(?!{talk}){CJK}"), F.lit(False))
    kinds = F.transform(F.filter(labels, lambda x: F.length(x) == 2), lambda x: F.right(x, F.lit(1)))
    decimal = (
        has(raw, "点") & ~has(raw, "^负|[百千万]分之") & F.array_contains(kinds, "C") & ~F.array_contains(kinds, "D")
        & ~F.exists(labels, lambda x: x.isin("O", "E", "<unk>")) & has(rendered, r"^[0-9]{1,2}\.[0-9]+\z")
    )
    integer = has(rendered, r"^[0-9]{1,2}\z") & has(raw, f"[{digit}]") & ~has(raw, "洞")
    sequence = (raw != "") & only(raw, one_by_one) & ~has(raw, "洞")
    split = has(rendered, r"^[0-9]+( [0-9]+)+\z") & only(raw, counted)
    clock = has(rendered, ":") & has(raw, "[点时]") & ~has(raw, "分") & only(raw, talk)
    pointless = has(raw, "点") & ~has(rendered, "[.:]") & only(raw, talk)
    bare = decimal | integer | sequence | split | clock | pointless | (F.size(tokens) == 0)
    return F.struct(chinese.alias("chinese"), bare.alias("bare"), (has(raw, "[A-Za-z]") & ~has(raw, CJK)).alias("latin"))


def final_mark(tokens: Column, rendered: Column, labels: Column, mark: Column, final: bool = True) -> Column:
    """The mark after a text's last word, "" for none.

    tokens are the spoken ones, rendered the written text, labels those of the characters (O, or a place and a kind A to D), mark the
    last character's mark label. Latin text ends in a period; bare numbers, short decimals and clock times, and a 点 that gave
    neither point nor colon, end in nothing. A text that isn't final has no last mark yet.
    """

    def choose(rule: Column) -> Column:
        label = F.when(rule["bare"], 0).when(F.lit(final) & rule["latin"] & mark.isNotNull(), 2).otherwise(mark)
        written = lambda marks: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in marks.items() for v in kv]), label.cast("int")), F.lit(""))
        return F.when(rule["chinese"], written(ZH_MARKS)).otherwise(written(MARKS))

    return F.when(F.lit(final), bind(mark_rules(tokens, rendered, labels), choose)).otherwise("")
