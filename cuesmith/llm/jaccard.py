"""Near duplicates by an exact n-gram Jaccard join, size-aware: small sets enumerate pairs of rare shingles, large sets scan inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesmith.llm.common import U64, mix, row_ids, save, shingles, small_batches, text_buffers
from cuesmith.llm.graph import components

#: Words of a shingle; links need 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Documents from which a shingle is common: common ones come last in the order of shingles.
COMMON = 32
#: Lists up to this long give all their pairs; longer ones link neighbours first.
LONG = 8
#: 64-bit words of a set's parity bitmap: as many bits as differ between two bitmaps, at least, do members between their sets.
PARITY = 16
#: Most common shingles, the most frequent ones, that tasks are told of; it bears on speed only.
MOST_COMMON = 1 << 20
#: A longer list (a hot one) is dealt out into sublists of about this many documents.
SUBLIST = 4096
#: Added to the places of entries that are in sublists.
DEALT = 1 << 30
#: Rows of a hot list's share that are compared with another share at once.
ROWS = 256
#: Shingles that a task gathers before it sends them on.
GATHERED = 1 << 22
#: Largest size that the boundary between small and large sets may take.
MOST_SMALL = 64

DOC = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("parity", T.ArrayType(T.LongType()))])
BLOB = T.StructType([T.StructField("bucket", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("tag", "rid", "n", "at")]])
COUNT = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hits", T.LongType())])
PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("bucket", "tag", "n", "at", "before")]])
LINK = T.StructType(PAIR.fields[:2])


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n must share with any set it links to."""
    return -(-PERCENT * n // 100)


def overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shingles that sets of n and m must share to link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def planes(x: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then their second bytes, ...: sorted or alike numbers then compress well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for s in shingles(*text_buffers(batch.column(column)), WORDS):
        yield np.unique(s)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, high, low, parity = [], [], [], []
        with np.errstate(over="ignore"):
            for s in _sets(batch, 2):
                n.append(len(s))
                high.append(int(mix(s).sum()))
                low.append(int(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum()))
                odd = np.bincount((s >> U64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        as_long = lambda x: pa.array(np.array(x, U64).view(np.int64))
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * PARITY), pa.array(np.concatenate(parity)) if parity else pa.array([], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), as_long(high), as_long(low), bits], DOC.names)


class _Seen:
    """Sets that a task has met, so that it sends each different set once."""

    def __init__(self):
        self.seen: set[tuple[int, int]] = set()

    def new(self, s: np.ndarray) -> bool:
        if not len(s):
            return False
        with np.errstate(over="ignore"):
            mark = (int(mix(s).sum()), len(s))
        if mark in self.seen:
            return False
        self.seen.add(mark)
        return True


def _count_keys(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The upper halves of all shingle hashes, sorted, by ranges."""

    def out(waiting: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(waiting)).astype("<u4")
        cut = np.searchsorted(keys, (np.arange(buckets + 1, dtype=U64) << U64(32)) // U64(buckets))
        full = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([planes(keys[cut[i] : cut[i + 1]]) for i in full], pa.binary())], ["bucket", "tag"])

    waiting, n, seen = [], 0, _Seen()
    for batch in batches:
        for s in _sets(batch, 0):
            if seen.new(s):
                waiting.append((s >> U64(32)).astype(np.uint32))
                n += len(s)
            if n >= GATHERED:
                yield out(waiting)
                waiting, n = [], 0
    if n:
        yield out(waiting)


def _common_keys(group: pa.Table) -> pa.Table:
    """Keys of a range in COMMON documents or more, and on a row without key the number of keys and of hits they make on one another."""
    keys = np.sort(np.concatenate([unplanes(b, "<u4") for b in group.column("tag").to_pylist()]))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n = np.diff(np.append(first, len(keys)))
    some = n >= COMMON
    light = n[~some]
    return pa.table({"key": pa.array([None, *keys[first][some].tolist()], pa.int64()), "n": pa.array([int(light.sum()), *n[some].tolist()], pa.int64()), "hits": pa.array([int((light * light).sum()), *[0] * int(some.sum())], pa.int64())})


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """Largest size of a small set: the one whose work, subsets of small sets and list entries scanned for the others, is least."""
    best, cost = 0, None
    for b in range(MOST_SMALL + 1):
        work = 0.0
        for n, many in sizes.items():
            p = n - int(needed(np.int64(n))) + 1
            work += many * ((p + 1) * p / 2 if n <= b else 0)
            work += many * (p * (1 + list_length) if 4 * n >= 3 * (b + 1) else 0)
        if cost is None or work < cost:
            best, cost = b, work
    return best


def _postings(batches: Iterator[pa.RecordBatch], buckets: int, small: int, common: np.ndarray, counts: np.ndarray, sublist: int) -> Iterator[pa.RecordBatch]:
    """List entries of each different set: for large sets, and small ones that may link to them, its rarest shingles; for small sets
    also all pairs of them. tag: 32 bits of the key, beside the bucket; at: the shingle's place in the set's order (pairs: none).
    Entries of hot lists also go whole, dealt by row to buckets below 0, with the 64-bit shingle and the one before it in the order as tag."""
    waiting: list[tuple[np.ndarray, ...]] = []
    hot: list[tuple[np.ndarray, ...]] = []
    n_waiting, seen = 0, _Seen()

    def whole() -> Iterator[pa.RecordBatch]:
        if not hot:
            return
        key, rid, n, at, before = (np.concatenate(c) for c in zip(*hot, strict=True))
        hot.clear()
        share = (mix(rid.astype(U64)) % U64(buckets)).astype(np.int64)
        order = np.lexsort((rid, key, share))
        share = share[order]
        cut = np.searchsorted(share, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        key, before = key.astype("<u8")[order], before.astype("<u8")[order]
        columns = [rid.astype("<i8")[order], n.astype("<u4")[order], at.astype("<i4")[order]]
        tags = [planes(np.concatenate([key[cut[i] : cut[i + 1]], before[cut[i] : cut[i + 1]]])) for i in full]
        yield pa.RecordBatch.from_arrays([pa.array((-1 - full).astype(np.int32)), pa.array(tags, pa.binary()), *[pa.array([planes(c[cut[i] : cut[i + 1]]) for i in full], pa.binary()) for c in columns]], BLOB.names)

    def out() -> pa.RecordBatch:
        key, rid, n, at = (np.concatenate(c) for c in zip(*waiting, strict=True))
        bucket = ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        columns = [(key & U64(0xFFFFFFFF)).astype("<u4")[order], rid.astype("<i8")[order], n.astype("<u4")[order], at.astype("<i4")[order]]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array([planes(c[cut[i] : cut[i + 1]]) for i in full], pa.binary()) for c in columns]], BLOB.names)

    for batch in batches:
        rids = batch.column(0).to_numpy()
        for rid, s in zip(rids, _sets(batch, 1), strict=True):
            if not seen.new(s):
                continue
            n = len(s)
            p = n - int(needed(np.int64(n))) + 1
            place = np.zeros(n, np.int64)
            if len(common):
                k = (s >> U64(32)).astype(np.uint32)
                i = np.minimum(np.searchsorted(common, k), len(common) - 1)
                place = np.where(common[i] == k, counts[i], 0)
                s, place = (x[np.lexsort((s, place))] for x in (s, place)) if place.any() else (np.sort(s), place)
            else:
                s = np.sort(s)
            keys = []
            if 4 * n >= 3 * (small + 1):
                at = np.arange(p)
                head, most = s[:p], place[:p]
                keys.append((mix(head ^ U64(1)), at))
                # a long list is dealt out twice, by different shares of the rows, so that its sublists overlap
                long = np.flatnonzero(most > sublist)
                if len(long):
                    hot.append((head[long], np.full(len(long), rid), np.full(len(long), n), at[long], np.where(long > 0, head[long - 1], U64(0))))
                    n_waiting += len(long)
                    parts = (most[long] // sublist + 1).astype(U64)
                    for salt in (U64(3), U64(5)):
                        share = mix(np.array([rid], np.int64).astype(U64) ^ salt)[0] % parts
                        keys.append((mix(mix(head[long] ^ salt) ^ share), at[long] + DEALT))
                    keys[0] = (np.delete(keys[0][0], long), np.delete(at, long))
            if n <= small:
                q = min(n, p + 1)
                if q == 1:
                    keys.append((mix(s[:1] ^ U64(7)), np.full(1, -1)))
                else:
                    i, j = np.triu_indices(q, 1)
                    with np.errstate(over="ignore"):
                        keys.append((mix(s[i] * U64(0x9E3779B97F4A7C15) + s[j]), np.full(len(i), -1)))
            for key, at in keys:
                waiting.append((key, np.full(len(key), rid), np.full(len(key), n), at))
                n_waiting += len(key)
            if n_waiting >= GATHERED // 4:
                yield out()
                yield from whole()
                waiting, n_waiting = [], 0
    if n_waiting:
        yield out()
        yield from whole()


def _may_link(n, m, i, j):
    """Size and position filters of a pair that meets in a list at places i and j."""
    fits = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    return fits & ((i < 0) | (1 + np.minimum(n - i, m - j) - 1 >= overlap(n, m)))


def _meet(group: pa.Table, small: int) -> pa.Table:
    """Pairs that meet in the lists of a bucket. Lists of up to LONG rows give all their pairs; of longer ones neighbours by size and
    by two random orders, and their entries (b null), for the pairs that links between neighbours leave open. Of hot lists' sublists no
    entries; those of the whole lists come from the buckets below 0, in bucket -1."""
    if group.num_rows and group.column("bucket")[0].as_py() < 0:
        return _whole_entries(group)
    column = lambda c, kind: np.concatenate([unplanes(b, kind) for b in group.column(c).to_pylist()])
    tag, rid, n, at = column("tag", "<u4").astype(np.int64), column("rid", "<i8"), column("n", "<u4").astype(np.int64), column("at", "<i4").astype(np.int64)
    dealt = at >= DEALT
    at[dealt] -= DEALT
    kind = (at < 0).astype(np.int64)
    tag = tag * 2 + kind

    def ordered(*by):
        order = np.lexsort((*by, tag))
        return tag[order], rid[order], n[order], at[order]

    order = np.lexsort((rid, n, tag))
    tag, rid, n, at, dealt = tag[order], rid[order], n[order], at[order], dealt[order]
    first = np.flatnonzero(np.append(True, tag[1:] != tag[:-1])) if len(tag) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(tag)))
    keep = np.repeat(size > 1, size)
    long = np.repeat(size > LONG, size)[keep]
    tag, rid, n, at, dealt = tag[keep], rid[keep], n[keep], at[keep], dealt[keep]
    found = []

    def pairs(t, r, k, i, d, where=None):
        same = t[d:] == t[:-d]
        if where is not None:
            same &= where[d:]
        same = np.flatnonzero(same)
        ok = _may_link(k[same], k[same + d], i[same], i[same + d])
        ok &= (i[same] < 0) | (np.maximum(k[same], k[same + d]) > small)
        x, y = r[same[ok]], r[same[ok] + d]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y])

    for d in range(1, min(LONG, len(tag))):
        if not (tag[d:] == tag[:-d]).any():
            break
        pairs(tag, rid, n, at, d, ~long)
    lists = (tag[long], rid[long], n[long], at[long])
    if long.any():
        tag, rid, n, at = lists
        pairs(*lists, 1)
        for salt in (U64(11), U64(13)):
            pairs(*ordered(mix(rid.astype(U64) ^ salt)), 1)
    if dealt.any():
        lists = tuple(c[~dealt[long]] for c in lists)
    both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    bucket = np.full(len(lists[0]), group.column("bucket")[0].as_py() if group.num_rows else 0)
    blank = pa.nulls(len(both), pa.int64())
    entries = [*[pa.array(c) for c in (bucket, lists[0], lists[2], lists[3])], pa.nulls(len(bucket), pa.int64())]
    return pa.table({"a": pa.concat_arrays([pa.array(both[:, 0]), pa.array(lists[1])]), "b": pa.concat_arrays([pa.array(both[:, 1]), pa.nulls(len(bucket), pa.int64())])} | {c: pa.concat_arrays([blank, e]) for c, e in zip(("bucket", "tag", "n", "at", "before"), entries, strict=True)})


def _whole_entries(group: pa.Table) -> pa.Table:
    """Hot lists' entries as rows: a, b null, bucket -1, tag the shingle, n, at, and the shingle before it (null: it is the first)."""
    tags = [unplanes(b, "<i8") for b in group.column("tag").to_pylist()]
    key, before = np.concatenate([t[: len(t) // 2] for t in tags]), np.concatenate([t[len(t) // 2 :] for t in tags])
    rid, n, at = (np.concatenate([unplanes(b, kind) for b in group.column(c).to_pylist()]).astype(np.int64) for c, kind in (("rid", "<i8"), ("n", "<u4"), ("at", "<i4")))
    columns = [pa.array(rid), pa.nulls(len(rid), pa.int64()), pa.array(np.full(len(rid), -1)), *map(pa.array, (key, n, at)), pa.array(before, mask=at == 0)]
    return pa.Table.from_arrays(columns, PAIR.names)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(_sets(batch, 2), _sets(batch, 3), strict=True):
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(bool(len(x)) and 100 * common >= PERCENT * (len(both) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], LINK.names).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows of texts (rid, text) whose whole shingle sets link."""
    left = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify, LINK)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rid: str | None = None, sublist: int = SUBLIST, with_component: bool = False) -> DataFrame:
    """One row per row of docs: rid, doc_id, n_shingles, component_id (the smallest doc_id that links reach); with_component adds
    component, which tells components apart where doc_ids are null or repeated (null: a text without words).

    A document's set is its distinct 5-word shingles of A-Z-lower-cased words (fewer words: the whole sequence as one). Two link when
    their Jaccard similarity is 0.75 or more. The join is exact but for 64-bit hash collisions:

    1. Shingles in 32 documents or more are counted over all documents; a set's order puts them last, by count.
    2. A set's rarest shingles (by that order, as many as it may miss of a partner's, plus one) meet its partner's in an inverted list.
       Small sets instead enumerate the pairs among one shingle more: partners share two of them. The boundary is the size at which the
       estimated work is least; a pair of a small and a large set meets in the lists.
    3. Pairs that pass size and position filters are verified on whole texts.
    4. Long lists (hot shingles, groups of thousands of copies) first link neighbours in three orders, hot ones within sublists; only
       entries of lists that then still hold several components are paired across components, hot lists whole, share by share, filtered
       by parity bitmaps, so no link between components is lost.

    Equal sets are one class, found by a 128-bit sum; each task sends a set once. Null, empty or wordless text: n_shingles 0, its own
    component. Null doc_ids are passed over by the minimum; a component of only nulls is null. Repeated rows link with one another.
    Other columns aren't read. docs must be a plain scan, or have row numbers in column `rid`.
    """
    rows = docs if rid else row_ids(docs)
    texts = small_batches(rows).select(F.col(rid or "rid").alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = save(texts.mapInArrow(_describe, DOC))
    splits = texts.rdd.getNumPartitions()
    buckets = max(16, 2 * splits)

    counted = texts.select("text").mapInArrow(partial(_count_keys, buckets=buckets), "bucket int, tag binary").groupBy("bucket").applyInArrow(_common_keys, COUNT)
    counted = save(counted)
    total = counted.where("key is null").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).first()
    top = counted.where("key is not null").orderBy(F.col("n").desc(), "key").limit(MOST_COMMON).toPandas()
    sizes = known.where(f"n between 1 and {2 * MOST_SMALL}").groupBy("n").count().collect()
    small = boundary({r["n"]: r["count"] for r in sizes}, (total.hits or 0) / max(total.n or 0, 1))
    top = top.sort_values("key")
    common, counts = top["key"].to_numpy().astype(np.uint32), top["n"].to_numpy().astype(np.int64)

    lists = texts.select("rid", "text").mapInArrow(partial(_postings, buckets=buckets, small=small, common=common, counts=counts, sublist=sublist), BLOB)

    def meet(group: pa.Table) -> pa.Table:
        return _meet(group, small)

    met = save(lists.groupBy("bucket").applyInArrow(meet, PAIR))

    classes = save(known.where("n > 0").groupBy("high", "low", "n").agg(F.min("rid").alias("cls"), F.min("doc_id").alias("least")))
    of = save(known.where("n > 0").join(classes.drop("least"), ["high", "low", "n"]).select("rid", "cls"))
    as_class = lambda df, c: df.join(of.select(F.col("rid").alias(c), F.col("cls").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    pairs = as_class(as_class(met.where("b is not null").select("a", "b").distinct(), "a"), "b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links = save(verified(pairs, texts.select("rid", "text")))
    reached = save(components(links))

    parity = known.select(F.col("rid").alias("cls"), "parity")
    open_ = _open_pairs(met, of, reached, parity, small, sublist)
    if open_ is not None:
        links = links.unionByName(verified(open_, texts.select("rid", "text")))
        reached = save(components(links))

    named = classes.join(reached.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    out = known.join(named.select("high", "low", "n", "component_id", "component"), ["high", "low", "n"], "left")
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *["component"] * with_component)


def _open_pairs(met: DataFrame, of: DataFrame, reached: DataFrame, parity: DataFrame, small: int, sublist: int) -> DataFrame | None:
    """Pairs of classes in different components that share a long list and pass the filters; None where no list holds two components.

    Hot lists are joined share by share (_open_shares). Beside size and position, sets' parity bitmaps must differ in no more bits than
    members may differ between sets that link, so that hardly a pair comes through that doesn't.
    """
    entries = met.where("b is null").select("bucket", "tag", F.col("a").alias("rid"), "n", "at", "before")
    entries = entries.join(of, "rid").join(reached.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = entries.groupBy("bucket", "tag").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("before").alias("first"), F.max("before").alias("last"), F.count("before").alias("later"), F.count("*").alias("many"))
    # where the same shingle comes before in all sets, they all meet in its list
    mixed = mixed.where("lo < hi and not (later = many and first = last)").select("bucket", "tag", "many")
    entries = save(entries.join(mixed, ["bucket", "tag"]).select("bucket", "tag", "many", "cls", "component", "n", "at", "before").distinct().join(parity, "cls"))
    if entries.isEmpty():
        return None
    plain = entries.where("bucket >= 0")
    x, y = plain.alias("x"), plain.alias("y")
    n, m, i, j = F.col("x.n"), F.col("y.n"), F.col("x.at"), F.col("y.at")
    fits = (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & ((i < 0) | ((F.least(n - i, m - j)) * (100 + PERCENT) >= (n + m) * PERCENT)) & ((i < 0) | (F.greatest(n, m) > small))
    differ = F.aggregate(F.zip_with("x.parity", "y.parity", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, b: t + b)
    fits &= differ * (100 + PERCENT) <= (n + m) * (100 - PERCENT)
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.tag") == F.col("y.tag")) & (F.col("x.component") < F.col("y.component"))
    found = x.join(y, meet & fits).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
    return save(found.unionByName(_open_shares(entries.where("bucket < 0"), small, sublist)).distinct())


def _open_shares(hot: DataFrame, small: int, sublist: int) -> DataFrame:
    """The pairs of hot lists: each list's rows are dealt into shares of about `sublist`, and every two shares meet in a group of their own."""
    hot = hot.withColumn("parts", F.expr(f"many div {sublist} + 1")).withColumn("share", F.pmod(F.xxhash64("cls"), "parts"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    hot = hot.select("tag", F.least("share", "other").alias("x"), F.greatest("share", "other").alias("y"), "share", "cls", "component", "n", "at", "before", "parity")

    def meet(group: pa.Table) -> pa.Table:
        return _meet_shares(group, small)

    return hot.groupBy("tag", "x", "y").applyInArrow(meet, LINK)


def _meet_shares(group: pa.Table, small: int) -> pa.Table:
    """Pairs of one share with another, or with itself, that pass the filters. Sets with the same shingle before this one in their
    orders meet in that one's list, so they are passed over here."""
    column = lambda c: group.column(c).to_numpy()
    share, cls, component, n, at = (column(c) for c in ("share", "cls", "component", "n", "at"))
    before, first = group.column("before").fill_null(0).to_numpy(), at == 0
    parity = group.column("parity").combine_chunks()
    parity = (parity.combine_chunks() if isinstance(parity, pa.ChunkedArray) else parity).flatten().to_numpy().view(U64).reshape(len(cls), PARITY)
    x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
    order = np.argsort(n, kind="stable")
    left, right = order[share[order] == x], order[share[order] == y]
    found = [np.zeros((0, 2), np.int64)]
    for k in range(0, len(left), ROWS):
        i = left[k : k + ROWS]
        # sizes that may link to these rows' are a run of the other share
        lo = np.searchsorted(n[right] * 100, PERCENT * n[i[0]])
        hi = np.searchsorted(n[right] * PERCENT, 100 * n[i[-1]], side="right")
        j = right[lo:hi]
        ok = component[i][:, None] != component[j][None, :]
        ok &= (before[i][:, None] != before[j][None, :]) | first[i][:, None] | first[j][None, :]
        if x == y:
            ok &= cls[i][:, None] < cls[j][None, :]
        p, q = np.nonzero(ok)
        p, q = i[p], j[q]
        fits = _may_link(n[p], n[q], at[p], at[q]) & (np.maximum(n[p], n[q]) > small)
        p, q = p[fits], q[fits]
        for c in range(0, len(p), 1 << 16):
            a, b = p[c : c + (1 << 16)], q[c : c + (1 << 16)]
            differ = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
            close = differ * (100 + PERCENT) <= (n[a] + n[b]) * (100 - PERCENT)
            found.append(np.stack([np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])], 1)[close])
    both = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": both[:, 0], "b": both[:, 1]})


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id (of repeats of it, the first); docs' own columns and whole rows."""
    name = "rid"
    while name in docs.columns:
        name += "_"
    numbered = row_ids(docs, name)
    found = near_duplicates(numbered, id_col, text, rid=name, with_component=True)
    wordless = F.when(F.col("n_shingles") == 0, F.col("rid"))
    stays = save(found.groupBy("component", wordless.alias("own")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias(name)).select(name))
    return numbered.join(stays, name, "left_semi").drop(name)
