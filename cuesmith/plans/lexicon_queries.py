"""Queries over names as lexicons and documents as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.functions import text as X
from cuesmith.operators import lexicon as L
from cuesmith.plans.catalog import query, table


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), F.col("n_nationkey").alias("ord"))
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("word"), F.col("r_regionkey").alias("ord"))
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("word"), F.col("p_partkey").alias("ord"))
    return L.all_hotwords(("builtin", nations), ("user", regions), ("imported", parts))


_VALID = r"regexp_matches(w, '^[A-Za-z0-9 +#.\-_/]{1,64}$') and regexp_matches(w, '[A-Za-z]')"
_LEXICON = rf"""
src as (select trim(n_name) as w, 0 as s, n_nationkey as o, 'builtin' as origin from nation
        union all select trim(r_name), 1, r_regionkey, 'user' from region
        union all select trim(p_name), 2, p_partkey, 'imported' from part),
lex as (select w as word, s, o, origin from (select *, row_number() over (partition by lower(w) order by s, o) as n from src where {_VALID}) where n = 1)
"""


@query(f"with {_LEXICON} select word, origin from lex")
def merge_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotwords of nations, regions and parts, the first spelling of each."""
    return _words(spark, sf_dir).select("word", "origin")


@query(rf"with {_LEXICON} select origin, count(*) as n_words, count(*) filter (length(replace(word, ' ', '')) >= 2 and regexp_matches(word, '[A-Z +#.\-_/]')) as n_rewriting from lex group by origin")
def dictionary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dictionary_report(_words(spark, sf_dir))


@query(rf"""
with {_LEXICON},
k as (select word, lower(replace(word, ' ', '')) as key, s, o from lex where length(replace(word, ' ', '')) >= 2 and regexp_matches(word, '[A-Z +#.\-_/]')),
f as (select * from (select *, row_number() over (partition by key order by s, o) as n from k) where n = 1)
select word, key, (row_number() over (order by strlen(word) desc, word) - 1)::int as place from f
""")
def rule_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotwords that take part in rewriting, one of each key, in the order in which they are tried."""
    rules = L.ordered_rules(L.hotword_rules(_words(spark, sf_dir)).select("word", "key"), "word")
    return rules.select(F.posexplode("rules").alias("place", "r")).select("r.word", "r.key", "place")


@query("""
with p as (select p_partkey, ' ' || p_name || ' ' || p_size as f, case when p_partkey % 9 = 0 then ' ' else p_brand end as t, p_type as u from part),
own as (select f, u from p where p_partkey % 20 = 0),
every as (select f, t, 'builtin' as origin from p where f not in (select f from own) union all select f, u, 'user' from own)
select trim(f) as from_text, trim(t) as to_text, origin from every where trim(t) <> ''
""")
def merged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as built-in rewrites, some of them blank, and every twentieth as a user's."""
    part = table(spark, sf_dir, "part").withColumn("from_text", F.concat(F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string")))
    builtin = part.select("from_text", F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.col("p_brand")).alias("to_text"))
    return L.merge_rules(part.where("p_partkey % 20 = 0").select("from_text", F.col("p_type").alias("to_text")), builtin)


#: Rewrites of frequent words of the documents.
TERMS = {"the": "THE", "of": "XOFX", "und": "UND", "der": "D.E.R", "les": "L$S", "and": "A\\ND"}


def _rewritten(text: str) -> str:
    """RE2 has no look-around: every character that may bound a word is doubled, so that each word has its own, and halved at the end."""
    text = f"regexp_replace({text}, '([^A-Za-z0-9])', '\\1\\1', 'g')"
    for source, target in sorted(TERMS.items(), key=lambda t: (-len(t[0]), t[0])):
        form = "".join(c if c.isalnum() else c * 2 for c in target).replace("\\", "\\\\")
        text = f"regexp_replace({text}, '(^|[^A-Za-z0-9])(?i:{source})($|[^A-Za-z0-9])', '\\1{form}\\2', 'g')"
    return f"regexp_replace({text}, '(?s)([^A-Za-z0-9])[^A-Za-z0-9]', '\\1', 'g')"


@query(f"select doc_id, sha256({_rewritten('text')}) as text_sha256 from documents")
def rewrite_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with frequent words rewritten on word bounds, longest rule first."""
    rules = sorted(TERMS.items(), key=lambda t: (-len(t[0]), t[0]))
    column = F.array(*[F.struct(F.lit(a).alias("from_text"), F.lit(b).alias("to_text")) for a, b in rules])
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.rewrite(F.col("text"), column), 256).alias("text_sha256"))


@query(r"""
with k as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) as key from benchmark),
u as (select doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:[ \t\n\f\r]+[A-Za-z0-9]+)*'))) as run from documents),
w as (select doc_id, regexp_split_to_array(run, '[ \t\n\f\r]+') as w from u),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w),
g as (select distinct doc_id, array_to_string(w[i : i + n], '') as key from (select *, unnest(range(0, least(len(w) - i + 1, most))) as n from p, (select least(64, max(length(key))) as most from k)) where length(array_to_string(w[i : i + n], '')) <= most)
select doc_id, key from g join k using (key) where length(key) >= 2
""")
def hotword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of the benchmark stand in which documents, blanks inside them allowed, found by one join instead of trying every rule."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("word"))
    rules = terms.select(F.lower("word").alias("key"), F.lower("word").alias("word")).distinct().where(F.length("key").between(2, L.LONGEST))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.candidate_rules(texts, rules).select(F.col("id").alias("doc_id"), "key")


@query("""
with files as (select 'common' as file, -1 as r, -1 as n union all select n_name, n_regionkey, n_nationkey from nation
               union all select r_name, r_regionkey, 1000000 from region union all select 'world', 1000000, 1000000)
select 'world' as root, file, (row_number() over (order by r, n) - 1)::int as visit_ord from files
""")
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon that imports regions, which import nations, which all import one file and the lexicon again: in the order of their visits."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edge = lambda df, src, dst, pos: df.select(src.alias("src"), dst.alias("dst"), pos.cast("int").alias("pos"))
    zero, one = F.lit(0), F.lit(1)
    edges = edge(region, F.lit("world"), F.col("r_name"), F.col("r_regionkey"))
    edges = edges.unionByName(edge(nation.join(region, nation.n_regionkey == region.r_regionkey), F.col("r_name"), F.col("n_name"), F.col("n_nationkey")))
    edges = edges.unionByName(edge(nation, F.col("n_name"), F.lit("common"), zero)).unionByName(edge(nation, F.col("n_name"), F.lit("world"), one))
    return L.resolve_imports(edges, spark.range(1).select(F.lit("world").alias("root")))


@query(rf"select doc_id, sha256(case when doc_id % 3 = 0 then t else regexp_replace(t, '[\s\x0B\p{{Z}}]*[{X.PERIODS}][\s\x0B\p{{Z}}]*$', '') end) as text_sha256 from (select doc_id, {_rewritten('text')} as t from documents)")
def finished_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the chain of a final text: rewrites, hotword forms, marks, and for two of three the last period."""
    rules = sorted(TERMS.items(), key=lambda t: (-len(t[0]), t[0]))
    rewrites = F.array(*[F.struct(F.lit(a).alias("from_text"), F.lit(b).alias("to_text")) for a, b in rules])
    hotwords = F.array(F.struct(F.lit("zqxzq").alias("key"), F.lit("ZQXzq").alias("word")))
    text = X.finish_text(F.col("text"), rewrites, hotwords, final=F.col("doc_id") % 3 != 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("text_sha256"))
