"""Labelled characters and tokens: spans, features, marks, word pieces, chunks."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.functions import transcripts
from cuesmith.functions.clauses import ZH_MARKS

# The label that begins, goes on with and ends a span of each category, and single ones.
CATEGORIES = "ABCD"
UNKNOWN, PIECE_MARK = "[UNK]", "@@"

_SPANS = "array<struct<start:int,end:int,category:string>>"


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def label_spans(chars: Column, labels: Column) -> Column:
    """Spans (start, end, category) of labels: B or M, then M, up to E of one category; singles; a broken run ends before the break.

    分之 begun as a fraction is a span of two; a stray E on 万 is a span of category A.
    """
    begins = _lookup({f"{x}{c}": c for x in "BM" for c in CATEGORIES})
    single = _lookup({f"{x}{c}": c for x in "SE" for c in CATEGORIES})
    none, empty = F.lit(None).cast("string"), F.array().cast(_SPANS)
    state = lambda spans, at, cat, skip: F.struct(spans.alias("spans"), at.cast("int").alias("at"), cat.alias("cat"), skip.cast("int").alias("skip"))
    span = lambda a, b, c: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), c.alias("category"))).cast(_SPANS)

    def step(s: Column, i: Column) -> Column:
        label, char = F.get(labels, i), F.get(chars, i)
        goes_on, ends = label == F.concat(F.lit("M"), s["cat"]), label == F.concat(F.lit("E"), s["cat"])
        spans = F.when(s["cat"].isNull(), s["spans"]).otherwise(F.concat(s["spans"], span(s["at"], i, s["cat"])))  # a broken run ends here
        one, group = F.try_element_at(single, label), F.try_element_at(begins, label)
        fraction = (label == "BC") & (F.get(labels, i + 1) == "O") & (char == "分") & (F.get(chars, i + 1) == "之")
        fresh = (
            F.when(F.coalesce(fraction, F.lit(False)), state(F.concat(spans, span(i, i + 2, F.lit("C"))), F.lit(0), none, i + 2))
            .when(group.isNotNull(), state(spans, i, group, F.lit(0)))
            .when(one.isNotNull(), state(F.concat(spans, span(i, i + 1, one)), F.lit(0), none, F.lit(0)))
            .when((label == "E") & (char == "万"), state(F.concat(spans, span(i, i + 1, F.lit("A"))), F.lit(0), none, F.lit(0)))
            .otherwise(state(spans, F.lit(0), none, F.lit(0)))
        )
        return (
            F.when(i < s["skip"], s)
            .when(F.coalesce(goes_on, F.lit(False)), s)
            .when(F.coalesce(ends, F.lit(False)), state(F.concat(s["spans"], span(s["at"], i + 1, s["cat"])), F.lit(0), none, F.lit(0)))
            .otherwise(fresh)
        )

    n = F.size(labels)
    found = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), state(empty, F.lit(0), none, F.lit(0)), step, lambda s: F.when(s["cat"].isNull(), s["spans"]).otherwise(F.concat(s["spans"], span(s["at"], n, s["cat"]))))
    return F.when(n > 0, found).otherwise(empty)


def protect(text: Column, labels: Column, phrases: Column) -> Column:
    """labels with O wherever one of the phrases stands in text."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    hits = F.flatten(F.transform(phrases, lambda p: F.transform(F.filter(starts, lambda i: F.substring(text, i, F.length(p)) == p), lambda i: F.struct(i.alias("a"), (i + F.length(p)).alias("b")))))
    return F.transform(labels, lambda label, i: F.when(F.exists(hits, lambda h: (i + 1 >= h["a"]) & (i + 1 < h["b"])), F.lit("O")).otherwise(label))


def numeric_features(tokens: DataFrame, key: str = "utt") -> DataFrame:
    """Per character of tokens (utt, pos, token): is it a numeric character of a longer token; isn't it the token's first."""
    chars = tokens.select(key, "pos", F.length("token").alias("_n"), F.posexplode(F.filter(F.split("token", ""), lambda c: c != "")).alias("_i", "ch"))
    order = Window.partitionBy(key).orderBy("pos", "_i")
    numeric = F.col("ch").rlike("^[0-9零〇一二三四五六七八九十百千万亿两]$") & (F.col("_n") > 1)
    return chars.select(key, (F.row_number().over(order) - 1).alias("char_idx"), "ch", numeric.alias("numeric"), (F.col("_i") > 0).alias("inner"))


def attach_marks(words: DataFrame, labels: DataFrame, final: bool, key: str = "utt") -> DataFrame:
    """Words (utt, idx, text, source_end) with the mark of the character before their end: labels (utt, char_idx, mark, is_end) count on
    token ends only, 1 to 4 mean a mark, and the last character's counts only when final."""
    marks = F.array(*[F.lit(ZH_MARKS[label]) for label in range(1, 5)])
    last = Window.partitionBy(key)
    known = labels.withColumn("_last", F.max("char_idx").over(last)).where(F.col("is_end") & F.col("mark").between(1, 4))
    if not final:
        known = known.where("char_idx <> _last")
    known = known.select(key, (F.col("char_idx") + 1).alias("source_end"), F.element_at(marks, F.col("mark")).alias("mark"))
    return words.join(known, [key, "source_end"], "left").select(key, "idx", "text", "source_end", "mark")


def word_pieces(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Each different word's pieces, greedily the longest in the vocabulary (token), inner ones with @@ in front; [UNK] where one fails.

    All substrings of the different words meet the vocabulary in one hash join; the fold then takes the longest at each place.
    """
    whole = words.select("word").where("word <> ''").distinct()
    n = F.length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.struct(i.alias("i"), k.alias("k")))))
    parts = whole.select("word", F.explode(spans).alias("s")).select("word", "s.i", "s.k", F.concat(F.when(F.col("s.i") > 1, PIECE_MARK).otherwise(""), F.substring("word", F.col("s.i"), F.col("s.k"))).alias("token"))
    longest = parts.join(vocab.select("token").distinct(), "token").groupBy("word", "i").agg(F.max("k").alias("k"))
    fits = longest.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("i", "k"))).alias("fits"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def take(s: Column, i: Column) -> Column:
        k = F.try_element_at(F.col("fits"), i)
        piece = F.concat(F.when(i > 1, PIECE_MARK).otherwise(""), F.substring(F.col("word"), i, k))
        return F.when((i == s["at"]) & k.isNotNull(), F.struct((i + k).alias("at"), F.concat(s["out"], F.array(piece)).alias("out"))).otherwise(s)

    pieces = F.aggregate(F.sequence(F.lit(1), n), start, take, lambda s: F.when(s["at"] > n, s["out"]).otherwise(F.array(F.lit(UNKNOWN))))
    rows = whole.join(fits, "word", "left")
    return rows.select("word", F.when(F.col("fits").isNull(), F.array(F.lit(UNKNOWN))).otherwise(pieces).alias("pieces"))


def lookup_pieces(tokens: DataFrame, vocab: DataFrame, maplist: DataFrame) -> DataFrame:
    """Each different token's pieces: those of the map (source, pieces) for the whole token, else run by run, where a run is one CJK
    character or other characters without white space; runs that the map doesn't have go through word_pieces. [UNK] where there is no run."""
    known = maplist.groupBy("source").agg(F.min("pieces").alias("mapped"))
    whole = tokens.select("token").distinct().join(known.withColumnRenamed("source", "token"), "token", "left")
    runs = F.regexp_extract_all("token", F.lit(r"(?U)([㐀-鿿]|[^\s㐀-鿿]+)"), F.lit(1))
    parts = whole.where("mapped is null").select("token", F.posexplode(runs).alias("at", "word"))
    found = parts.select("word").distinct().join(known.withColumnRenamed("source", "word"), "word", "left")
    greedy = word_pieces(found.where("mapped is null"), vocab)
    each = found.join(greedy, "word", "left").select("word", F.coalesce("mapped", "pieces").alias("pieces"))
    split = parts.join(each, "word").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("at", "pieces"))).alias("all"))
    joined = F.flatten(F.transform("all", lambda x: x["pieces"]))
    return whole.join(split, "token", "left").select("token", F.coalesce("mapped", joined, F.array(F.lit(UNKNOWN))).alias("pieces"))


def pack_chunks(sizes: Column, limit: int = 510) -> Column:
    """Chunk number of each token, whole tokens of the given piece counts filling chunks of at most `limit`."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("filled"), F.array().cast("array<int>").alias("out"))

    def put(s: Column, n: Column) -> Column:
        full = (s["filled"] > 0) & (s["filled"] + n > limit)
        chunk = s["chunk"] + full.cast("int")
        return F.struct(chunk.alias("chunk"), (F.when(full, 0).otherwise(s["filled"]) + n).alias("filled"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes.cast("array<int>"), start, put, lambda s: s["out"])


def replace_words(text: Column, rules: Column) -> Column:
    """Ordered literal rules (source, target), each applied to what the earlier ones left, on ASCII word bounds, in their own case."""
    whole = F.array(F.struct(text.alias("text"), F.lit("text").alias("kind"), F.length(text).alias("upto")))
    return F.when(text.isNotNull(), transcripts.joined(transcripts.replace_words(whole, rules)))
