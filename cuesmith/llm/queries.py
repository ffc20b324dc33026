"""The registered queries of the training-data operators, each over its whole table, and the same results as DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.llm import centroids, exact, jaccard, mixing, neighbours, packing, passages, periodic, private, repetition, sharding, suffix, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    """The place of the tokenizers file with 49k word pieces."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition_report(documents(spark, sf_dir), carry=["doc_id"])
    return found.select("doc_id", "repetition.*")


@query
def op9_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary(), end_id=2, with_ids=False)


SHARDS = 24


@query
def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(documents(spark, sf_dir), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_radix_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir)).drop("rid")


ORACLE["op3_radix_exact_dedup"] = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""


@query
def op10_golden_ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query
def op1_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _base32_sql(hexes: str) -> str:
    """DuckDB's hex SHA-1 as base32."""
    bits = [f"('0x' || substr({hexes}, {g * 5 + 1}, 5))::int" for g in range(8)]
    return " || ".join(f"substr('{warc.BASE32}', (({b}) >> {shift}) % 32 + 1, 1)" for b in bits for shift in (15, 10, 5, 0))


ORACLE["op1_warc_zstd"] = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
     q as (select page_id, strlen(html) as payload_bytes, h, min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes, {_base32_sql("h")} as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from q
"""


@query
def op8_size_aware_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).drop("rid")


ORACLE["op8_size_aware_jaccard"] = r"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as shingle from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (shingle) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from shared join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
reach(a, b) as (select doc_id, doc_id from documents union select a, y from reach join links on b = x)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from (select a as doc_id, min(b) as component_id from reach group by a) left join n using (doc_id)
"""


@query
def op6_interval_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir)).drop("rid")


@query
def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(documents(spark, sf_dir))


@query
def op7_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.private_spans(documents(spark, sf_dir)).drop("rid", "found")


def _placed_sql(name: str, source: str) -> str:
    """Matches v with the gaps before them, numbered within (doc_id, kind), as spans [s, e)."""
    return f"""
{name}_m as (select doc_id, kind, unnest(v) as v, unnest(g[1 : len(v)]) as gap, generate_subscripts(v, 1) as i from {source} where len(v) > 0),
{name} as (select doc_id, kind, v, s, s + length(v) as e, regexp_replace(v, '[^0-9]', '', 'g') as d
  from (select *, (coalesce(sum(length(gap) + length(v)) over (partition by doc_id, kind order by i rows between unbounded preceding and 1 preceding), 0) + length(gap))::bigint as s from {name}_m))"""


_PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_FOUND = " union all ".join(f"select doc_id, {k} as kind, regexp_extract_all(text, '{p}') as v, regexp_split_to_array(text, '{p}') as g from docs" for k, p in enumerate(_PATTERNS))
_NAMES = "(case kind " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(private.KINDS)) + " end)"

ORACLE["op7_disclosing_terms"] = rf"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
found as ({_FOUND}),
{_placed_sql("placed", "found")},
base as (select * from placed where case kind when 0 then true
  when 1 then list_max(list_transform(string_split(v, '.'), lambda x: x::hugeint)) <= 255
  when 2 then length(d) between 13 and 19 and list_sum(list_transform(range(length(d)), lambda i: case when i % 2 = 1 then 2 * d[length(d) - i]::int // 10 + 2 * d[length(d) - i]::int % 10 else d[length(d) - i]::int end)) % 10 = 0
  else length(d) between 9 and 15 end),
named as (select doc_id, kind, case kind when 0 then lower(v) when 1 then v else d end as v from base),
ent as (select distinct doc_id, unnest([kind || ':' || v, kind || ':group:' || case kind when 0 then v[strpos(v, '@'):] when 1 then split_part(v, '.', 1) || '.' || split_part(v, '.', 2) || '.' when 2 then v[:6] else v[:5] end]) as entity from named),
sizes as (select entity, count(distinct text) as n_entity from ent join docs using (doc_id) group by entity),
terms as (select * from (select doc_id, text, unnest(list_distinct(regexp_split_to_array(lower(text), '\P{{L}}+'))) as term from docs) where length(term) >= {private.LEAST_LETTERS}),
pairs as (select entity, term, count(distinct text) as n_both from ent join terms using (doc_id) group by entity, term),
counts as (select term, count(distinct text) as n_term from terms group by term),
told as (select entity, term from pairs join sizes using (entity) join counts using (term)
  where (n_both - {private.DISCOUNT}) / n_term >= pow(n_entity / (select count(distinct text) from documents), {1.0 - private.DISCLOSURE})),
per as (select distinct doc_id, term from ent join told using (entity)),
words as (select doc_id, 4 as kind, regexp_extract_all(text, '\p{{L}}+') as v, regexp_split_to_array(text, '\p{{L}}+') as g from docs where doc_id in (select doc_id from per)),
{_placed_sql("word", "words")},
spans as (select doc_id, kind, s, e from base union all select word.doc_id, kind, s, e from word join per on word.doc_id = per.doc_id and lower(v) = term
  where not exists (select 1 from base b where b.doc_id = word.doc_id and b.s < word.e and word.s < b.e))
select docs.doc_id, {", ".join(f"count(*) filter (kind = {k}) as n_{n}" for k, n in enumerate(private.KINDS[:4]))},
       sha256(coalesce(string_agg({_NAMES} || ':' || s || ':' || e, ',' order by kind, s) filter (kind < 4), '')) as base_sha256,
       coalesce(string_agg({_NAMES} || ':' || s || ':' || e, ',' order by kind, s), '') as spans
from docs left join spans using (doc_id) group by docs.doc_id
"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


#: Rows of embeddings whose id this divides are queries.
QUERY_EVERY = 100


@query
def op11_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(embeddings(spark, sf_dir), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE["op11_collision_counting"] = f"""
with v as (select vec_id, embedding::double[] as x from embeddings
           where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
d as (select q.vec_id as query_id, v.vec_id, sqrt(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (v.x[i] - q.x[i]) * (v.x[i] - q.x[i])))) as score
      from v q join v on q.vec_id <> v.vec_id and len(q.x) = len(v.x) where q.vec_id % {QUERY_EVERY} = 0),
r as (select *, row_number() over (partition by query_id order by score, vec_id)::int as rank from d)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@query
def op12_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.kmeans(embeddings(spark, sf_dir))


def _round_sql(r: int) -> str:
    """Vectors with their nearest centroids of round r, and the centroids after it."""
    return f"""
d{r} as (select v.vec_id, v.x, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::bigint as distance from v cross join c{r} c),
a{r} as materialized (select vec_id, any_value(x) as x, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d{r} group by vec_id),
s{r} as (select cluster, i, sum(x[i]) as total, count(*) as n from a{r} cross join (select unnest(range(1, 65)) as i) group by cluster, i),
n{r} as (select cluster, list((total - ((total % n) + n) % n) // n order by i) as x from s{r} group by cluster),
c{r + 1} as materialized (select cluster, coalesce(n{r}.x, c{r}.x) as x from c{r} left join n{r} using (cluster))"""


ORACLE["op12_pivot_table"] = f"""
with v as materialized (select vec_id, list_transform(embedding, lambda c: floor(1024 * c::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
c0 as materialized (select (row_number() over (order by h) - 1)::int as cluster, x::hugeint[] as x from (select x, sha256('3:' || vec_id) as h from v order by h limit 8)),
{",".join(_round_sql(r) for r in range(11))}
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
       sha256(array_to_string(c10.x, ',')) as centroid_sha256
from a10 join c10 using (cluster)
"""


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """From where on and with which period the query repeats a text of n words; None for most ids and for null."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


@query
def op13_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(documents(spark, sf_dir), rewrite=repeated_tail, carry=["doc_id"])
    return found.select("doc_id", "periodic.*").drop("runs")
