"""The whole normalisation of labelled transcripts, one row an utterance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesmith.functions import clauses as K
from cuesmith.functions import expressions as E
from cuesmith.functions import transcripts as R
from cuesmith.functions.text import plain_marks
from cuesmith.operators.labels import protect


def utterances(labelled: DataFrame, key: str = "utt") -> DataFrame:
    """Characters (utt, pos, ch, token_pos, num_label, mark_label) as rows (utt, tokens, num_labels, mark_labels), marks one a token: that
    of its last character. One shuffle by utterance."""
    rows = labelled.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "ch", "token_pos", "num_label", "mark_label"))).alias("c"))
    last = F.filter("c", lambda x, i: F.coalesce(F.get("c", i + 1)["token_pos"] != x["token_pos"], F.lit(True)))
    token = lambda x: F.array_join(F.transform(F.filter("c", lambda y: y["token_pos"] == x["token_pos"]), lambda y: y["ch"]), "")
    return rows.select(key, F.transform(last, token).alias("tokens"), F.transform("c", lambda x: x["num_label"]).alias("num_labels"), F.transform(last, lambda x: x["mark_label"]).alias("mark_labels"))


def normalise_transcripts(rows: DataFrame, rules: Column | None = None, phrases: Column | None = None, final: Column | bool = True, english: bool = False) -> DataFrame:
    """rows (utt, tokens, num_labels, mark_labels, ...) with `text`, as written, and `words`, its words and marks in order.

    tokens are the spoken ones, num_labels has one label a character (O, or a place and a kind), mark_labels one label a token (1 to 4:
    a mark). In this order: protected phrases, ASCII characters without number labels, number spans and symbols, words on token bounds,
    the replacement rules, words within tokens, midnight, English spacing, English clauses, web addresses, per mille, marks. final tells
    which utterances have ended: only these get their last mark. english writes Chinese marks as ASCII ones.

    Empty and null tokens count for nothing, with their mark labels; number labels are those of the characters that are left, missing
    ones O. An utterance without characters, or null, gives an empty text and no words. Each row is worked out by itself, without a shuffle.
    """
    final = F.lit(final) if isinstance(final, bool) else final
    none = lambda kind: F.array().cast(f"array<{kind}>")
    col = F.col
    filled = F.filter(F.arrays_zip(F.coalesce("tokens", none("string")).alias("t"), F.coalesce("mark_labels", none("int")).alias("m")), lambda x: x["t"] != "")
    out = rows.withColumn("_pairs", filled)
    out = out.withColumns({"_tokens": F.transform("_pairs", lambda x: x["t"]), "_marks": F.transform("_pairs", lambda x: F.coalesce(x["m"], F.lit(0)).cast("int"))})
    out = out.withColumn("_raw", F.array_join("_tokens", ""))
    out = out.withColumn("_chars", F.filter(F.split("_raw", ""), lambda c: c != ""))
    labels = F.transform("_chars", lambda c, i: F.coalesce(F.get("num_labels", i), F.lit("O")))
    out = out.withColumn("_labels", labels if phrases is None else protect(col("_raw"), labels, phrases))
    spoken = F.zip_with("_chars", "_labels", lambda c, k: F.when(c.rlike(r"^[\x00-\x7f]"), "O").otherwise(k))
    out = out.withColumn("_spoken", spoken)
    numbers = E.merge_on_tokens(E.zh_semantics(E.convert_spans(col("_chars"), col("_spoken"))), col("_tokens"))
    # without a labelled character, the words are the tokens
    words = F.when(F.exists("_spoken", lambda k: k != "O"), numbers).otherwise(R.spoken_words(col("_tokens")))
    out = out.withColumn("_words", words)
    if rules is not None:
        out = out.withColumn("_words", R.replace_words(col("_words"), rules))
    out = out.withColumn("_words", E.coalesce_within_tokens(col("_words"), col("_tokens")))
    hours = F.transform("_words", lambda w: E._word(R.midnight_zero(w["text"]), w["kind"], w["upto"]))
    out = out.withColumn("_words", R.spaced_words(F.when(F.contains("_raw", F.lit("零点")), hours).otherwise(col("_words"))))
    head = F.get("_words", F.lit(0))
    spaced = F.concat(F.array(E._word(F.concat(F.lit(" "), head["text"]), head["kind"], head["upto"])), F.slice("_words", F.lit(2), F.size("_words") - 1))
    latin = col("_raw").rlike("^[A-Za-z]") & ~F.startswith(head["text"], F.lit(" "))
    out = out.withColumn("_words", F.when(F.coalesce(latin, F.lit(False)), spaced).otherwise(col("_words")).cast(E.WORDS))
    out = out.withColumn("_words", R.per_mille_words(R.address_words(R.clause_words(col("_words"), col("_tokens"), col("_marks")), col("_tokens"))))
    written = out.withColumn("_rule", K.mark_rules(col("_tokens"), R.joined(col("_words")), col("_labels")))
    n = F.size("_chars")
    closing = F.when(col("_rule.bare"), 0).when(final & col("_rule.latin"), 2)
    written = written.withColumn("_place", R.character_marks(col("_tokens"), col("_marks"))).withColumn("_place", F.transform("_place", lambda m, i: F.when(i == n - 1, F.coalesce(closing, m)).otherwise(m)))
    marked = R.marked_words(col("_words"), col("_place"), col("_rule.chinese"), final)
    texts = F.transform(marked, lambda w: plain_marks(w["text"]) if english else w["text"])
    done = written.withColumn("words", F.when(n > 0, texts).otherwise(none("string")))
    return done.select(*rows.columns, F.array_join("words", "").alias("text"), "words")
