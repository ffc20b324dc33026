"""Lexicons of hotwords and rewrites: merging, imports, order, candidates."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.functions import text as X

#: A hotword's longest compact key.
LONGEST = 64


def dedupe_hotwords(words: DataFrame) -> DataFrame:
    """Trimmed, valid words (word, ord, ...), the first of each spelling without regard to case."""
    rows = words.withColumn("word", X.trimmed(F.col("word"))).where(X.valid_hotword(F.col("word")))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("word")).orderBy("ord"))).where("_n = 1").drop("_n")


def all_hotwords(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Hotwords of named sources (word, ord), earlier sources first, deduplicated: word, ord, origin."""
    found = None
    for i, (origin, df) in enumerate(sources):
        part = df.select("word", F.struct(F.lit(i).alias("source"), F.col("ord").cast("long").alias("at")).alias("ord"), F.lit(origin).alias("origin"))
        found = part if found is None else found.unionByName(part)
    return dedupe_hotwords(found)


def merge_rules(user: DataFrame, builtin: DataFrame) -> DataFrame:
    """Rewrites (from_text, to_text): the user's, and built-in ones whose exact source the user's don't have; trimmed, empty ones dropped."""
    kept = builtin.join(user.select("from_text"), "from_text", "left_anti").withColumn("origin", F.lit("builtin"))
    rows = kept.unionByName(user.withColumn("origin", F.lit("user")))
    rows = rows.withColumn("from_text", X.trimmed(F.col("from_text"))).withColumn("to_text", X.trimmed(F.col("to_text")))
    return rows.where("from_text <> '' and to_text <> ''")


def hotword_rules(words: DataFrame) -> DataFrame:
    """Rules (key, word) of the hotwords that take part in rewriting, the first word of each key."""
    rows = words.where(X.rewriting_hotword(F.col("word"))).withColumn("key", X.compact_key(F.col("word")))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("ord"))).where("_n = 1").drop("_n")


def ordered_rules(rules: DataFrame, source: str) -> DataFrame:
    """All rules as one array column `rules`, longest source first in bytes, then by source. For rule tables that are small by nature."""
    others = [c for c in rules.columns if c != source]
    entry = F.struct((-F.octet_length(source)).alias("_len"), F.col(source), *others)
    return rules.agg(F.array_sort(F.collect_list(entry)).alias("rules"))


def dictionary_report(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("origin").agg(F.count("*").alias("n_words"), F.count(F.when(X.rewriting_hotword(F.col("word")), 1)).alias("n_rewriting"))


def candidate_rules(texts: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """Which rules (key, word) can match in which texts: (id, key, word).

    A text's runs of ASCII letters and digits are joined, where only ASCII blanks part them, into all sequences of up to 64 characters;
    the lower-case sequences meet the rules' keys in one hash join, instead of every rule being tried on every text. A row holds one
    word and what can follow it, so that long texts make many rows but no large ones.
    """
    # plain classes only: a repeated group would recurse once a word, beyond the stack on long texts
    runs = F.split("text", r"[^A-Za-z0-9 \t\n\f\r]+")
    rows = texts.select(key, F.explode(runs).alias("_run")).select(key, F.filter(F.split(F.lower("_run"), r"[ \t\n\f\r]+"), lambda w: w != "").alias("_w")).where("size(_w) > 0")
    # one row a word, with the words from there on that can take part: each has a letter, so no more than the longest key's letters
    most = min(LONGEST, rules.agg(F.max(F.length("key"))).first()[0] or 0)
    rows = rows.select(key, F.explode(F.transform("_w", lambda _, i: F.array_join(F.slice("_w", i + 1, most), " "))).alias("_t"))
    # twice the longest key's letters hold it with all its blanks; a word cut there makes a sequence that is longer than any key
    rows = rows.withColumn("_t", F.substring("_t", 1, most * 2))
    rows = rows.select(key, F.regexp_extract("_t", "^(?: ?[a-z0-9]){1,%d}(?![a-z0-9])" % LONGEST, 0).alias("_t")).where("_t <> ''")
    ends = F.split("_t", " ")
    grams = F.transform(F.sequence(F.lit(1), F.size(ends)), lambda n: F.array_join(F.slice(ends, F.lit(1), n), ""))
    found = rows.select(key, F.explode(grams).alias("key")).where(F.length("key") >= 2)
    return found.join(rules.select("key", "word"), "key").select(key, "key", "word").distinct()


VISITS = "root string, file string, visit_ord int"


def resolve_imports(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Import closure: rows (root, file, visit_ord), imports before the file that names them, each file once for a root.

    edges: (src, dst, pos), roots: (root). Which files a root reaches is found level by level: the files of one level meet the edges in
    one join, those found before fall out, and each level is checkpointed, so neither the number of ways nor their length matters. Then
    each root's reached edges are walked depth first, in the order of pos (then name), every file at its first visit: that cuts cycles.
    A walk holds one root's edges. Repeated edges and roots count once; files without edges are leaves.
    """
    links, start = edges.select("src", "dst", "pos").distinct(), roots.select("root").distinct()
    level = start.select("root", F.col("root").alias("file"))
    found = level
    while True:
        after = level.join(links, level["file"] == links["src"]).select("root", F.col("dst").alias("file")).distinct()
        level = checkpointed(after.join(found, ["root", "file"], "left_anti"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    reached = found.join(links, found["file"] == links["src"]).select("root", "src", "dst", "pos")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("src", "string"), ("dst", "string"), ("pos", links.schema["pos"].dataType))]

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        root = group["root"].iloc[0]
        children: dict = {}
        for row in group[group["src"].notna()].sort_values(["pos", "dst"]).itertuples():
            children.setdefault(row.src, []).append(row.dst)
        seen, order, open_ = {root}, [], [(root, iter(children.get(root, [])))]
        while open_:
            file, rest = open_[-1]
            if (child := next((c for c in rest if c not in seen), None)) is None:
                order.append(file)
                open_.pop()
            else:
                seen.add(child)
                open_.append((child, iter(children.get(child, []))))
        return pd.DataFrame({"root": root, "file": order, "visit_ord": range(len(order))})

    return reached.unionByName(start.select("root", *none)).groupBy("root").applyInPandas(walk, VISITS)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's spark.checkpoint.dir; a session on one machine without one uses a temporary folder."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
