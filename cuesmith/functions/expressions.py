"""Labelled Chinese number spans as column expressions: spans by their labels, their digits, and the symbols between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesmith.functions import numbers as N
from cuesmith.functions.clauses import ZH_COUNTERS, _between
from cuesmith.functions.numbers import bind

# Symbols of spoken operators and units, symbols that follow what is spoken after them.
SYMBOLS = {
    "点": ".", "加": "+", "加上": "+", "减": "-", "减去": "-", "负": "-", "乘": "×", "乘以": "×", "除": "÷", "除以": "÷",
    "等于": "=", "大于": ">", "小于": "<", "比": ":", "摄氏度": "℃", "华氏度": "℉",
}
PREFIXES = {"百分之": "%", "千分之": "‰", "万分之": "/10000"}
DEGREES = ["摄氏度", "华氏度"]
TEN_THOUSANDTH = "万min之"

PIECE = "struct<source:string,text:string,category:string,kind:string>"
PLACES, KINDS = "BMES", "ABCD"


def _pick(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in values.items()) + ")"), key)


def _piece(source: Column, text: Column, category: Column | None, kind: Column | str = "number") -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(source.alias("source"), text.alias("text"), (F.lit(None) if category is None else category).cast("string").alias("category"), kind.alias("kind"))


def convert_spans(chars: Column, labels: Column) -> Column:
    """Pieces (source, text, category, kind) of characters by their labels: a place (B, M, E or S) and a kind (A cardinal, B digits,
    C symbol, D clock time), O outside. A span goes from B or M over M to E; a lone E 万 is a cardinal, 分之 labelled BC O a symbol.

    One regular expression finds the spans: each label is one letter, written before its character. Characters without a label are
    outside; null gives null.
    """
    code = {place + kind: chr(ord("a") + 4 * k + p) for k, kind in enumerate(KINDS) for p, place in enumerate(PLACES)} | {"E": "E"}
    one = r"[\s\S]"
    spans = [f"[{b}{m}]{one}(?:{m}{one})*(?:{e}{one})?" for b, m, e in ([code[p + k] for p in "BME"] for k in KINDS)]
    rule = "|".join([f"{code['BC']}分\\.之", *spans, one + one])
    coded = F.transform(labels, lambda label: F.coalesce(_pick(code, label), F.lit(".")))
    pairs = F.filter(F.zip_with(chars, coded, lambda c, k: F.concat(F.coalesce(k, F.lit(".")), c)), lambda x: x.isNotNull())

    def split(match: Column) -> Column:
        letter = F.left(match, F.lit(1))
        kind = F.coalesce(*[F.when(letter.isin(*[code[p + k] for p in PLACES]), k) for k in KINDS], F.when(match == "E万", "A"))
        return F.struct(F.regexp_replace(match, f"{one}({one})", "$1").alias("source"), kind.alias("category"))

    def write(span: Column) -> Column:
        source, kind = span["source"], span["category"]
        text = F.when(kind == "A", N.zh_cardinal(source)).when(kind == "B", N.zh_digits(source)).when(kind == "D", N.zh_time(source)).otherwise(source)
        plain = kind.isNull() | ((kind == "B") & ~_one_by_one(source))
        single = F.transform(F.filter(F.split(source, ""), lambda c: c != ""), lambda c: _piece(c, c, None, "text"))
        return F.when(plain, single).otherwise(F.array(_piece(source, text, kind)))

    return F.flatten(F.transform(F.regexp_extract_all(F.array_join(pairs, ""), F.lit(f"({rule})"), F.lit(1)), lambda m: bind(split(m), lambda s: F.get(F.transform(F.array(s), write), F.lit(0)))))


def _one_by_one(source: Column) -> Column:
    return source.rlike(rf"^[{N.ZH_DIGIT_CHARS.replace('两', '')}]*\z")


def _number(piece: Column) -> Column:
    return F.coalesce(piece["category"].isin("A", "B"), F.lit(False))


def _last(pieces: Column) -> Column:
    return F.try_element_at(pieces, F.lit(-1))


def _leading(pieces: Column, holds) -> Column:
    """How many pieces from the first on hold."""
    at = F.array_position(F.transform(pieces, holds), False).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(pieces))


def zh_semantics(pieces: Column) -> Column:
    """Pieces with the symbols between numbers written: operators, points, per cent and the like, fractions turned round, and blanks
    between numbers that don't belong together.

    A fold over each stretch of number pieces and the one piece before it, which is all that its rules look at; other pieces stay. So
    the work follows the length of the stretches, not that of the utterance.
    """

    def write(all_: Column) -> Column:
        numeric = lambda i: F.coalesce(F.get(all_, i)["category"].isNotNull(), F.lit(False))
        heads = F.filter(F.transform(all_, lambda p, i: i), lambda i: ~(numeric(i) & numeric(i - 1)))

        def stretch(head: Column, end: Column) -> Column:
            before = F.least(head, F.lit(1))
            written = bind(F.slice(all_, head - before + 1, end - head + before), _with_symbols)
            return F.slice(written, before + 1, F.size(written))

        def group(head: Column, k: Column) -> Column:
            end = F.coalesce(F.get(heads, k + 1), F.size(all_))
            return F.when(numeric(head), stretch(head, end)).otherwise(F.array(F.get(all_, head)).cast(f"array<{PIECE}>"))

        return F.flatten(F.transform(heads, group))

    return bind(pieces, write)


def _with_symbols(pieces: Column) -> Column:
    n = F.size(pieces)
    at = lambda i: F.get(pieces, i)
    rest = lambda i: F.slice(pieces, i + 1, F.greatest(n - i, F.lit(0)))

    def prefixed(out: Column, i: Column) -> Column:
        said = F.slice(pieces, i + 2, _leading(rest(i + 1), lambda p: p["category"].isNotNull()))
        texts = F.transform(
            said,
            lambda p, k: F.when(p["source"] == "分之", "/")
            .otherwise(F.coalesce(_pick(SYMBOLS, p["source"]), F.when((k > 0) & (F.get(said, k - 1)["source"] == "点"), N.zh_digits(p["source"])), p["text"])),
        )
        source = F.concat(at(i)["source"], F.array_join(F.transform(said, lambda p: p["source"]), ""))
        piece = _piece(source, F.concat(F.array_join(texts, ""), _pick(PREFIXES, at(i)["source"])), _last(said)["category"])
        return _state(F.array_append(out, piece), i + 1 + F.size(said))

    def turned(out: Column, i: Column) -> Column:
        above, below, mark = at(i + 1), _last(out), at(i)
        whole = F.array(_piece(F.concat(below["source"], mark["source"], above["source"]), F.concat(F.lit(TEN_THOUSANDTH), above["text"]), above["category"]))
        three = F.array(_piece(below["source"], above["text"], above["category"]), _piece(mark["source"], F.lit("/"), F.lit("C")), _piece(above["source"], below["text"], below["category"]))
        return _state(F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.when(below["source"] == "万", whole).otherwise(three)), i + 2)

    def symbol(out: Column, i: Column) -> Column:
        p, before = at(i), _last(out)
        negated = F.coalesce(before["text"].endswith("不"), F.lit(False))
        alone = (p["source"] == "点") & ~(_number(before) & _number(at(i + 1)))
        piece = F.when(negated, p).when(alone, _piece(p["source"], p["text"], None, "text")).otherwise(_piece(p["source"], _pick(SYMBOLS, p["source"]), p["category"]))
        return _state(F.array_append(out, piece), i + 1)

    def plain(out: Column, i: Column) -> Column:
        p, before = at(i), _last(out)
        run = _leading(F.reverse(out), _number)
        own, ahead = F.slice(out, F.size(out) - run + 1, run), _leading(rest(i), _number)
        decimal = F.coalesce(F.when(F.size(out) > run, F.get(out, F.size(out) - run - 1)["text"] == "."), F.lit(False))
        zeros = (before["category"] == "A") & (p["category"] == "B") & decimal & F.forall(own, lambda x: x["source"].rlike(r"^[零〇洞0]*\z"))
        single = lambda xs: F.forall(xs, lambda x: F.length(x["source"]) == 1)
        degrees = lambda q: F.coalesce(q["source"].isin(*DEGREES), F.lit(False))
        singles = decimal & degrees(at(i + ahead)) & single(own) & single(F.slice(pieces, i + 1, ahead))
        suffix = (before["category"] == "B") & (p["category"] == "A") & degrees(at(i + 1))
        joins = _one_by_one(F.concat(before["source"], p["source"])) & (singles | ~(suffix | ((before["category"] == "A") & (p["category"] == "B") & ~zeros)))
        after_time = (before["category"] == "D") & (
            (before["text"] != before["source"]) | before["source"].rlike(rf"^[{N.ZH_DIGIT_CHARS}{ZH_COUNTERS}]*\z|[{N.ZH_DIGIT_CHARS}]\z")
        )
        parted = _number(p) & F.when(_number(before), ~joins).otherwise(F.coalesce(after_time, F.lit(False)))
        text = F.when(_number(p) & (before["text"] == "."), N.zh_digits(p["source"])).otherwise(p["text"])
        return _state(F.array_append(out, _piece(p["source"], F.when(parted, F.concat(F.lit(" "), text)).otherwise(text), p["category"], p["kind"])), i + 1)

    def step(state: Column, i: Column) -> Column:
        out, p = state["out"], at(i)
        mark = F.coalesce(p["category"] == "C", F.lit(False))
        return (
            F.when(i < state["next"], state)
            .when(mark & p["source"].isin(*PREFIXES) & _number(at(i + 1)), prefixed(out, i))
            .when(mark & (p["source"] == "分之") & _number(_last(out)) & _number(at(i + 1)), turned(out, i))
            .when(mark & p["source"].isin(*SYMBOLS), symbol(out, i))
            .otherwise(plain(out, i))
        )

    start = _state(F.array(), F.lit(0))
    return F.when(pieces.isNotNull(), F.aggregate(F.transform(_between(F.lit(1), n), lambda i: i - 1), start, step, lambda s: s["out"]))


def _state(out: Column, following: Column) -> Column:
    return F.struct(out.cast(f"array<{PIECE}>").alias("out"), following.cast("int").alias("next"))


def _ends(tokens: Column) -> Column:
    """Characters up to the end of each token."""
    start = F.array().cast("array<int>")
    return F.aggregate(tokens, start, lambda ends, t: F.array_append(ends, F.coalesce(_last(ends), F.lit(0)) + F.length(t)))


def _word(text: Column, kind: Column | str, upto: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(text.alias("text"), kind.alias("kind"), upto.cast("int").alias("upto"))


WORDS = "array<struct<text:string,kind:string,upto:int>>"


def _extended(words: Column, text: Column, kind: Column | str, upto: Column) -> Column:
    """Words with text added to the last one."""
    return F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(_word(F.concat(_last(words)["text"], text), kind, upto)))


def merge_on_tokens(pieces: Column, tokens: Column) -> Column:
    """Words (text, kind, upto in characters) of pieces: one that begins inside a token goes on with the word before, which is plain
    text then; one that stayed as spoken is cut at the ends of tokens inside it."""

    def words(ends: Column) -> Column:
        def step(state: Column, p: Column) -> Column:
            found, start = state["words"], state["at"]
            end = start + F.length(p["source"])
            inside = F.when(p["text"] == p["source"], F.filter(ends, lambda e: (e > start) & (e < end))).otherwise(F.array().cast("array<int>"))
            kind = F.when(p["category"].isNotNull(), "number").otherwise(p["kind"])
            stops = F.array_append(inside, end)

            def fragment(stop: Column, k: Column) -> Column:
                begin = F.coalesce(F.get(stops, k - 1), start)
                return _word(F.when(F.size(stops) == 1, p["text"]).otherwise(F.substring(p["source"], begin - start + 1, stop - begin)), kind, stop)

            parts = F.transform(stops, fragment)
            goes_on = (F.size(found) > 0) & (start > 0) & ~F.array_contains(ends, start)
            first = F.get(parts, F.lit(0))
            joined = F.concat(_extended(found, first["text"], "text", first["upto"]), F.slice(parts, F.lit(2), F.size(parts) - 1))
            return F.struct(F.when(goes_on, joined).otherwise(F.concat(found, parts)).cast(WORDS).alias("words"), end.alias("at"))

        return F.aggregate(pieces, F.struct(F.array().cast(WORDS).alias("words"), F.lit(0).alias("at")), step, lambda s: s["words"])

    return bind(_ends(tokens), words)


def coalesce_within_tokens(words: Column, tokens: Column) -> Column:
    """Words that end inside a token joined with what follows; the first one's kind stays."""

    def joined(ends: Column) -> Column:
        def step(found: Column, w: Column) -> Column:
            last = _last(found)
            inside = F.coalesce((last["upto"] > 0) & ~F.array_contains(ends, last["upto"]), F.lit(False))
            return F.when(inside, _extended(found, w["text"], last["kind"], w["upto"])).otherwise(F.array_append(found, w)).cast(WORDS)

        return F.aggregate(words, F.array().cast(WORDS), step)

    return bind(_ends(tokens), joined)
