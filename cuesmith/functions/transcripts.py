"""Written words of an utterance as column expressions: arrays of (text, kind, upto), upto the spoken characters up to a word's end.

Every stage takes and gives such an array, so the marks, which are labelled by spoken characters, find their words at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesmith.functions import clauses as K
from cuesmith.functions.clauses import CJK, _between
from cuesmith.functions.expressions import WORDS, _ends, _last, _word
from cuesmith.functions.numbers import bind
from cuesmith.functions.text import quoted

LETTERS = r"^[A-Za-z]+\z"
#: Leading and closing white space of any alphabet.
LEAD, TRAIL = r"(?U)^\s+", r"(?U)\s+\z"


def joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), "")


def spoken_words(tokens: Column) -> Column:
    """Tokens as words of their own."""
    return bind(_ends(tokens), lambda ends: F.transform(tokens, lambda t, i: _word(t, "text", F.get(ends, i)))).cast(WORDS)


def bounded(source: Column) -> Column:
    """A pattern for source that neither splits an ASCII word at its left nor at its right."""
    return F.concat(F.when(source.rlike("^[A-Za-z0-9_]"), "(?<![A-Za-z0-9_])").otherwise(""), quoted(source), F.when(source.rlike(r"[A-Za-z0-9_]\z"), "(?![A-Za-z0-9_])").otherwise(""))


def replace_words(words: Column, rules: Column) -> Column:
    """Ordered literal rules (source, target), each on what the earlier ones left, on ASCII word bounds, hit by hit from left to right.

    A hit may lie in several words: what stands before it in the first word and after it in the last one stay words of their own kinds,
    the target is a word of text between them. Its end is the last word's less what stays of that, but not before what stays of the
    first. An empty target leaves no word; the search goes on after the target. Rules with an empty source do nothing.
    """

    def apply(found: Column, rule: Column) -> Column:
        source, target = rule["source"], rule["target"]
        hits = F.size(F.split(joined(found), quoted(source), -1)) - 1

        def hit(state: Column, _: Column) -> Column:
            since = state["since"]

            def replaced(rest: Column) -> Column:
                # one character before the place to search from is context only
                pattern = F.concat(F.when(since > 0, "(?s)^(.+?)").otherwise("(?s)^(.*?)"), bounded(source))
                at = F.greatest(since - 1, F.lit(0)) + F.length(F.call_function("regexp_extract", rest, pattern, F.lit(1)))
                return F.when(F.regexp_like(rest, pattern), bind(at, lambda a: _searched(_spliced(state["words"], a, a + F.length(source), target), a + F.length(target)))).otherwise(state)

            text = joined(state["words"])
            return bind(F.substring(text, F.greatest(since, F.lit(1)), F.length(text)), replaced)

        return F.when((source != "") & F.contains(joined(found), source), F.aggregate(_between(F.lit(1), hits), _searched(found, F.lit(0)), hit, lambda s: s["words"])).otherwise(found)

    return F.aggregate(rules, words.cast(WORDS), apply)


def _searched(words: Column, since: Column) -> Column:
    return F.struct(words.cast(WORDS).alias("words"), since.cast("int").alias("since"))


def _spliced(words: Column, begin: Column, end: Column, target: Column) -> Column:
    """Words with the rendered characters begin to end replaced."""
    start = F.array().cast("array<int>")
    stops = F.aggregate(words, start, lambda acc, w: F.array_append(acc, F.coalesce(_last(acc), F.lit(0)) + F.length(w["text"])))

    def cut(stop: Column) -> Column:
        first = F.array_position(F.transform(stop, lambda s: s > begin), True).cast("int")
        starts = F.zip_with(stop, words, lambda s, w: s - F.length(w["text"]))
        last = F.size(F.filter(starts, lambda s: s < end))  # starts ascend
        a, b = F.get(words, first - 1), F.get(words, last - 1)
        prefix = F.left(a["text"], begin - F.get(starts, first - 1))
        suffix = F.substring(b["text"], end - F.get(starts, last - 1) + 1, F.length(b["text"]))
        kept = F.coalesce(F.get(words, first - 2)["upto"], F.lit(0)) + F.length(prefix)
        parts = F.array(_word(prefix, a["kind"], kept), _word(target, "text", F.greatest(kept, b["upto"] - F.length(suffix))), _word(suffix, b["kind"], b["upto"]))
        return F.concat(F.slice(words, F.lit(1), first - 1), F.filter(parts, lambda w: w["text"] != ""), F.slice(words, last + 1, F.size(words) - last))

    return bind(stops, cut)


def midnight_zero(text: Column) -> Column:
    """0: at the beginning of an hour as 00:."""
    return F.regexp_replace(text, "(?<![0-9])0:", "00:")


def spaced_words(words: Column) -> Column:
    """Blanks before English words: the first one with a capital, single capitals joined, none after a CJK character, one before digits
    that follow a word."""
    capital = lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30))

    def spaced(all_: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            first, text = i == 0, w["text"]
            bare = F.regexp_replace(text, LEAD, "")
            raised = F.when(first & bare.rlike("^[A-Za-z]"), capital(bare)).otherwise(bare)
            before = F.regexp_replace(F.regexp_replace(F.coalesce(F.get(all_, i - 1)["text"], F.lit("")), LEAD, ""), TRAIL, "")
            before = F.when(i == 1, capital(before)).otherwise(before)
            joins = raised.rlike(r"^[A-Z]\z") & before.rlike(r"^[A-Z]\z")
            letters, after_word = text.rlike(LETTERS), before.rlike(LETTERS)
            blank = (
                F.when(letters, F.when(first | ~(before.rlike(rf"{CJK}\z") | joins), " ").otherwise(""))
                .when((first & bare.rlike("^[A-Za-z]")) | (~first & bare.rlike("^[0-9]") & after_word), " ")
                .otherwise(F.regexp_extract(text, r"(?U)^(\s*)", 1))
            )
            return _word(F.when(bare == "", text).otherwise(F.concat(blank, raised)), w["kind"], w["upto"])

        return F.transform(all_, one)

    return bind(words, spaced)


def clause_words(words: Column, tokens: Column, marks: Column) -> Column:
    """Utterances of ASCII words only, clause by clause: a clause ends after a token labelled with a mark (1 to 4) and at the end.

    A clause for which en_clause has a writing takes it, others keep their words; the first blank of each clause but the first goes.
    """
    ends, n = _ends(tokens), F.size(tokens)

    def write(upto: Column) -> Column:
        stops = F.filter(_between(F.lit(1), n), lambda i: (i == n) | F.coalesce(F.get(marks, i - 1).between(1, 4), F.lit(False)))

        def bounds(begin: Column, stop: Column) -> Column:
            start = F.coalesce(F.get(upto, begin - 1), F.lit(0))
            return F.struct(begin.alias("begin"), stop.alias("stop"), start.alias("start"), F.get(upto, stop - 1).alias("end"))

        def clause(c: Column) -> Column:
            written = F.transform(K.en_clause(F.slice(tokens, c["begin"] + 1, c["stop"] - c["begin"])), lambda p: _word(p["text"], p["kind"], F.get(upto, c["begin"] + p["upto"] - 1)))
            own = F.filter(words, lambda w: (w["upto"] > c["start"]) & (w["upto"] <= c["end"]))
            return F.coalesce(written.cast(WORDS), own.cast(WORDS))

        def put(out: Column, part: Column) -> Column:
            first = F.get(part, F.lit(0))
            bare = F.concat(F.array(_word(F.regexp_replace(first["text"], "^ ", ""), first["kind"], first["upto"])), F.slice(part, F.lit(2), F.size(part) - 1))
            return F.concat(out, F.when((F.size(out) > 0) & (F.size(part) > 0), bare).otherwise(part)).cast(WORDS)

        parts = bind(stops, lambda all_: F.transform(all_, lambda stop, k: bind(bounds(F.coalesce(F.get(all_, k - 1), F.lit(0)), stop), clause)))
        return F.aggregate(parts, F.array().cast(WORDS), put)

    return F.when((n > 0) & F.forall(tokens, lambda t: t.rlike(LETTERS)), bind(ends, write)).otherwise(words)


def address_words(words: Column, tokens: Column) -> Column:
    """The words of a spoken web address or mailbox, which replace all others; other utterances keep theirs."""
    found = bind(_ends(tokens), lambda ends: F.transform(K.web_words(tokens), lambda w: _word(w["text"], "text", F.get(ends, w["upto"] - 1))))
    return F.when(F.get(tokens, F.lit(0)).rlike("^(网址|邮箱)"), found.cast(WORDS)).otherwise(words)


def per_mille_words(words: Column) -> Column:
    """A word ‰ merged into the unsigned decimal before it."""
    decimal = lambda w: w["text"].rlike(r"^(?=\.?[0-9])[0-9]*\.?[0-9]*\z")

    def merged(all_: Column) -> Column:
        joins = lambda i: F.coalesce((F.get(all_, i)["text"] == "‰") & decimal(F.get(all_, i - 1)), F.lit(False))
        return F.filter(
            F.transform(all_, lambda w, i: F.when(joins(i), F.lit(None)).when(joins(i + 1), _word(F.concat(w["text"], F.lit("‰")), w["kind"], F.get(all_, i + 1)["upto"])).otherwise(w)),
            lambda w: w.isNotNull(),
        )

    return bind(words, merged).cast(WORDS)


def character_marks(tokens: Column, marks: Column) -> Column:
    """The tokens' mark labels as labels of the characters: each at its token's last one, 0 elsewhere."""
    return F.flatten(F.transform(tokens, lambda t, i: F.concat(F.array_repeat(F.lit(0), F.length(t) - 1), F.array(F.get(marks, i)))))


def marked_words(words: Column, labels: Column, chinese: Column, final: Column) -> Column:
    """Words with the mark that each one's last spoken character is labelled with (1 to 4; 0 where no token ends).

    None after a mark, nor before a mark with the same end; the utterance's last character has its mark only when final.
    """
    by_label = lambda marks: F.create_map(*[F.lit(v) for kv in marks.items() for v in kv])
    last = F.size(labels)

    def marked(all_: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            label, after = F.get(labels, w["upto"] - 1), F.get(all_, i + 1)
            mark = F.try_element_at(F.when(chinese, by_label(K.ZH_MARKS)).otherwise(by_label(K.MARKS)), label)
            open_ = (w["kind"] == "mark") | F.coalesce((after["kind"] == "mark") & (after["upto"] == w["upto"]), F.lit(False)) | (w["upto"] <= 0)
            shown = ~open_ & mark.isNotNull() & (final | (w["upto"] != last))
            return F.when(F.coalesce(shown, F.lit(False)), F.array(w, _word(mark, "mark", w["upto"]))).otherwise(F.array(w)).cast(WORDS)

        return F.flatten(F.transform(all_, one))

    return bind(words, marked)
