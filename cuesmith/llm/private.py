"""Personal data: patterned entities, and terms that reveal them by corpus co-occurrence (information-theoretic sanitisation).

Only DataFrame operations; nothing runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.llm.common import row_ids, save

#: Kinds in the order of their spans; terms are what the method adds.
KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns, written so that the engine never tries the same characters twice: a match begins where the last one ended or where no
#: character before could begin it, and repeats don't give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A part of at most 255 in an address.
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"\p{L}+"
#: Letters of a term, what is taken off a count of texts that hold entity and term, and the share of an entity's information that a term may reveal.
LEAST_LETTERS, DISCOUNT, DISCLOSURE = 1, 0.5, 0.9
#: What each kind's values are grouped by: an email's host, a network's two first parts, a card's issuer, a number's first digits.
GROUPS = {"email": "@.*$", "ip": r"^[0-9]+\.[0-9]+\.", "card": "^[0-9]{6}", "phone": "^[0-9]{5}"}


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    # Luhn: from the right, every second digit doubled, its own digits added
    place = F.sequence(F.lit(1), n)
    total = F.aggregate(place, F.lit(0), lambda s, i: s + _luhn(F.substring(F.reverse(digits), i, F.lit(1)).cast("int"), i))
    card = n.between(13, 19) & (F.when(n.between(13, 19), total % 10).otherwise(1) == 0)
    return F.when(kind == 0, True).when(kind == 1, value.rlike(rf"^{BYTE}(\.{BYTE}){{3}}$")).when(kind == 2, card).otherwise(n.between(9, 15))


def _luhn(digit: Column, place: Column) -> Column:
    twice = digit * 2
    return F.when(place % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)


def _found(text: Column, kind: int, pattern: str) -> Column:
    """All matches in order, each with the length of the gap before it."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    at = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(F.lit(kind).alias("kind"), F.length(g).cast("long").alias("gap"), v.alias("value")))
    return F.transform(at, lambda m, i: F.struct(m["kind"].alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["value"].alias("value")))


def _placed(found: DataFrame) -> DataFrame:
    """Matches (rid, kind, i, gap, value) with start and end, in code points."""
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("value").cast("long")
    start = F.coalesce(F.sum(F.col("gap") + size).over(before), F.lit(0)) + F.col("gap")
    return found.withColumn("start", start).withColumn("end", F.col("start") + size)


def matched(texts: DataFrame) -> DataFrame:
    """The texts (rid, text) that hold personal data, with all matches of the patterns, sound or not, as `m`: one scan, no shuffle."""
    some = texts.where(F.contains("text", F.lit("@")) | F.rlike("text", F.lit("[0-9]")))
    found = F.concat(*[_found(F.col("text"), k, PATTERNS[name]) for k, name in enumerate(KINDS[:4])])
    return some.select("rid", "text", found.alias("m")).where(F.exists("m", lambda x: _valid(x["kind"], x["value"])))


def entity_spans(found: DataFrame) -> DataFrame:
    """Personal data in the texts of matched(): rows (rid, kind, start, end, value), by kind the leftmost matches that don't overlap."""
    placed = _placed(found.select("rid", F.explode("m").alias("m")).select("rid", "m.*"))
    return placed.where(_valid(F.col("kind"), F.col("value"))).select("rid", "kind", "start", "end", "value")


def _entities(spans: DataFrame) -> DataFrame:
    """Rows (rid, entity), each once: every value found and the group it belongs to."""
    kind = F.col("kind")
    value = F.when(kind == 0, F.lower("value")).when(kind == 1, F.col("value")).otherwise(F.regexp_replace("value", "[^0-9]", ""))
    named = spans.select("rid", "kind", value.alias("value"))
    group = F.lit(None)
    for k, name in enumerate(KINDS[:4]):
        group = F.when(kind == k, F.regexp_extract("value", GROUPS[name], 0)).otherwise(group)
    entity = F.explode(F.array(F.concat_ws(":", kind, "value"), F.concat_ws(":", kind, F.lit("group"), group)))
    return named.select("rid", entity.alias("entity")).distinct()


def disclosing_terms(texts: DataFrame, found: DataFrame, spans: DataFrame, discount: float = DISCOUNT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """Terms that reveal too much of an entity in a text that holds both, rows (rid, term), and the texts (rid, text) that hold entities.

    An entity is a value found, in lower case or its digits, or the group of values that it belongs to (GROUPS), which is shared by more
    texts. Of the -log2 p(e) bits that an entity holds a term reveals log2 p(e | t) - log2 p(e). All counts are of different texts, so
    that copies are no evidence, and `discount` is taken off the texts that hold both, so that a term met once tells less than one met
    often. Entities that the same texts hold are judged as one: a list of addresses doesn't meet each of its words once an address.
    """
    marks = texts.select("rid", F.xxhash64("text").alias("mark"))
    firsts = save(marks.groupBy("mark").agg(F.min("rid").alias("rid")).select("rid"))
    copies = save(marks.select("rid").join(firsts, "rid", "left_anti"))
    total = F.lit(max(firsts.count(), 1))
    entities = save(_entities(spans))
    holders = save(found.select("rid", "text").join(entities.select("rid").distinct(), "rid", "left_semi"))
    # what the texts of an entity are: their number and two sums over their ids' bits
    held = F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("rid")), F.bit_xor(F.xxhash64("rid", F.lit(1))))
    classes = entities.join(copies, "rid", "left_anti").groupBy("entity").agg(held.alias("held"), F.count("*").alias("n_entity"))
    of_text = save(entities.join(classes, "entity").select("rid", "held", "n_entity").distinct())
    least = F.pow(F.col("n_entity") / total, F.lit(1.0 - disclosure))
    # a term in more texts than this can't reveal any entity of the text; only rarer ones meet the text's entities
    limit = F.max((F.col("n_entity") - F.lit(discount)) / least) * F.lit(1.000001)
    counts = _terms(texts.join(copies, "rid", "left_anti")).groupBy("term").agg(F.count("*").alias("n_term"))
    words = _terms(holders.join(of_text.groupBy("rid").agg(limit.alias("limit")), "rid"), "rid", "limit")
    rare = save(words.join(counts, "term").where(F.col("n_term") <= F.col("limit")).select("rid", "term", "n_term"))
    met = rare.join(of_text, "rid")
    pairs = met.join(copies, "rid", "left_anti").groupBy("held", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    pairs = pairs.where((F.col("n_both") - F.lit(discount)) / F.col("n_term") >= least).select("held", "term")
    return save(met.select("rid", "held", "term").join(pairs, ["held", "term"], "left_semi").select("rid", "term").distinct()), holders


def _terms(texts: DataFrame, *keep: str) -> DataFrame:
    """Each text's different terms."""
    words = texts.select(*keep, F.explode(F.array_distinct(F.split(F.lower("text"), r"\P{L}+"))).alias("term"))
    return words.where(F.length("term") >= LEAST_LETTERS)


def term_spans(holders: DataFrame, told: DataFrame) -> DataFrame:
    """Where the terms (rid, term) stand in their texts: rows (rid, kind, start, end)."""
    texts = holders.join(told.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode(_found(F.col("text"), len(KINDS) - 1, TERM)).alias("m")).select("rid", "m.*")
    placed = _placed(texts).withColumn("term", F.lower("value"))
    return placed.join(told, ["rid", "term"]).select("rid", "kind", "start", "end")


def _outside(spans: Column) -> Column:
    """The spans without terms inside others: an address's own letters aren't terms beside it."""
    base = F.filter(spans, lambda s: s["kind"] < len(KINDS) - 1)
    last = F.lit(len(KINDS) - 1)
    return F.filter(spans, lambda s: (s["kind"] != last) | ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _is(kind: int):
    return lambda k: k == kind


def private_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", discount: float = DISCOUNT, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per row of docs: rid, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and `found` (kind, start, end) in order.

    Emails, addresses, card numbers and phone numbers are found by pattern in every whole text; kinds may overlap one another. Terms that reveal
    an entity (disclosing_terms) are spans of kind `term` in the texts that hold that entity, outside of its other spans; texts without
    personal data stay as they are. Null and empty texts have none. Repeated rows have equal spans. Other columns aren't read. docs must be a plain scan. Spans are
    in code points, end exclusive.
    """
    rows = row_ids(docs).select("rid", F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    texts = rows.where("text is not null").select("rid", "text")
    found = save(matched(texts))
    base = save(entity_spans(found))
    told, holders = disclosing_terms(texts, found, base, discount, disclosure)
    spans = base.select("rid", "kind", "start", "end").unionByName(term_spans(holders, told))
    per_row = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("found")).withColumn("found", _outside(F.col("found")))
    out = rows.select("rid", "doc_id").join(per_row, "rid", "left")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    base_only = F.filter("found", lambda s: s["kind"] < len(KINDS) - 1)
    return out.withColumn("found", F.coalesce("found", none)).select("rid", "doc_id", *counts, F.sha2(_joined(base_only), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "found")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """docs with personal data generalised to its kind, as in [EMAIL], and disclosing terms to [TERM]; docs' own columns.

    Of spans that overlap, the one that begins first stands (of equals, the kind listed first), and the others' rests go with it.
    """
    name = "rid"
    while name in docs.columns:
        name += "_"
    spans = private_spans(docs, id_col, text, **settings).where("size(found) > 0").select(F.col("rid").alias(name), F.col("found").alias(f"{name}_found"))
    joined = row_ids(docs, name).join(spans, name, "left")
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(f"{name}_found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))

    def put(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.element_at(labels, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate(ordered, start, put, lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))))
    return joined.withColumn(text, F.when(F.col(f"{name}_found").isNull(), F.col(text)).otherwise(cleaned)).select(*docs.columns)
