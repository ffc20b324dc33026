"""Column expressions over transcript text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clause marks, those of them that are soft breaks, and periods.
CLAUSE_MARKS = ".?!,;:，。？！；："
SOFT_MARKS = ",;:，；："
PERIODS = ".。．"

# Full-width marks and what replaces them; | stands for a place that may take a blank.
ENGLISH_MARKS = {
    "》": "||>|",
    "《": "|<||",
    "：": "||:|",
    "；": "||;|",
    "“": '|"||',
    "”": '||"|',
    "‘": "|'||",
    "’": "||'|",
    "！": "||!|",
    "…": "||...||",
    "（": "|(||",
    "）": "||)|",
    "【": "|[||",
    "】": "||]|",
    "、": "||,|",
    "。": "||.|",
    "，": "||,|",
    "？": "||?|",
}
# Marks mapped one to one without spacing.
PLAIN_MARKS = ("，。！？；：、", ",.!?;:,")

BLANK = r"\s"
SPACE_MARK = "\u0000"


def english_marks(text: Column) -> Column:
    """Full-width marks as ASCII ones with blanks around them; a lone spacing mark between two non-blanks becomes one blank."""
    for mark, form in ENGLISH_MARKS.items():
        text = F.replace(text, F.lit(mark), F.lit(form.replace("|", SPACE_MARK)))
    text = F.regexp_replace(text, rf"(?U)(?<![\s{SPACE_MARK}]){SPACE_MARK}(?=[^\s{SPACE_MARK}])", " ")
    # a text that begins with a lone mark gets its blank, too
    return F.replace(text, F.lit(SPACE_MARK), F.lit(""))


def plain_marks(text: Column) -> Column:
    return F.translate(text, *PLAIN_MARKS)


def strip_period(text: Column) -> Column:
    """One period at the end, with the blanks around it, dropped; other texts untouched."""
    return F.regexp_replace(text, rf"(?U)\s*[{PERIODS}]\s*\z", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), trimmed), lambda s: s != "")


def split_clauses(text: Column) -> Column:
    """Clauses, each up to and with its mark, trimmed; blank ones dropped."""
    return _pieces(trimmed(text), rf"[^{CLAUSE_MARKS}]*[{CLAUSE_MARKS}]|[^{CLAUSE_MARKS}]+")


def split_long(clauses: Column, limit: int) -> Column:
    """Clauses cut at the first soft break from `limit` (8 at least) code points on, or at limit + 8."""
    n = max(8, limit)
    pattern = rf"(?U)[\s\S]{{{n - 1},{n + 6}}}?[\s{SOFT_MARKS}]|[\s\S]{{{n + 8}}}|[\s\S]+"
    return F.flatten(F.transform(clauses, lambda c: _pieces(c, pattern)))


def compact(text: Column) -> Column:
    """Text without blanks and clause marks."""
    return F.regexp_replace(text, rf"(?U)[\s{CLAUSE_MARKS}]", "")


def valid_hotword(word: Column) -> Column:
    """1 to 64 ASCII letters, digits and ` +#.-_/`, one letter at least."""
    return word.rlike(r"^(?=.*[A-Za-z])[A-Za-z0-9 +#.\-_/]{1,64}\z")


def compact_key(word: Column) -> Column:
    """A hotword's letters in lower case without ASCII blanks."""
    return F.lower(F.regexp_replace(word, r"[ \t\n\f\r]", ""))


def rewriting_hotword(word: Column) -> Column:
    """Does a hotword take part in rewriting: two bytes of key at least, and a capital or one of ` +#.-_/`."""
    return (F.octet_length(compact_key(word)) >= 2) & word.rlike(r"[A-Z +#.\-_/]")


def bounded(pattern: Column) -> Column:
    """A pattern that is found on ASCII word bounds only, whatever the case."""
    return F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), pattern, F.lit(r"(?![A-Za-z0-9])"))


def quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\](){}.*+?^$|#\-&~])", r"\\$1")


def _replacement(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def rewrite(text: Column, rules: Column) -> Column:
    """Rules (from_text, to_text), in order, applied one after another on ASCII word bounds without regard to case."""
    return F.aggregate(rules, text, lambda acc, r: F.regexp_replace(acc, bounded(quoted(r["from_text"])), _replacement(r["to_text"])))


def normalise_hotwords(text: Column, rules: Column) -> Column:
    """Rules (key, word): the key's letters, even where ASCII blanks part them, become the hotword."""

    def spaced(key: Column) -> Column:
        return F.array_join(F.transform(F.split(key, ""), quoted), r"[ \t\n\f\r]*")

    return F.aggregate(rules, text, lambda acc, r: F.regexp_replace(acc, bounded(spaced(r["key"])), _replacement(r["word"])))


def finish_text(text: Column, rewrites: Column, hotwords: Column, marks: bool = True, final: Column | None = None) -> Column:
    """Rewrites, hotword forms, ASCII marks, and for final texts no trailing period."""
    text = normalise_hotwords(rewrite(text, rewrites), hotwords)
    if marks:
        text = english_marks(text)
    return text if final is None else F.when(final, strip_period(text)).otherwise(text)


def clock(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm."""
    part = lambda divisor, base: (F.floor(ms / divisor) % base).cast("int")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("int"), part(60_000, 60), part(1_000, 60), (ms % 1_000).cast("int"))


