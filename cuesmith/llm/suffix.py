"""Repeated substrings by an enhanced suffix array cut into groups: common-prefix intervals by a stack scan, with left-extension tests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesmith.llm.common import BYTE, POWERS, STEP, U64, discard, mix, row_ids, save, small_batches, text_buffers
from cuesmith.llm.jaccard import planes, unplanes

#: Bytes of an anchor's gram.
GRAM = 20
#: Places of an anchor among GATHERED ones from which they don't go to the anchor's bucket, only their number does; and places in such a packet.
MANY, PACKET = 1 << 10, 1 << 10
#: Places of one anchor that a task sorts; anchors with more are dealt out in shares.
GROUP = 1 << 15
GATHERED = 1 << 18
#: Bytes of a share's contexts whose strings are hashed at once; a string begins at about half of them.
HOT_STEP = 1 << 19
#: Bytes of contexts in a partition and in a group of small anchors, about; an anchor of more bytes is a group of its own.
PARTITION, BUCKET = 32 << 20, 4 << 20

ANCHORS = T.StructType([T.StructField("bucket", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("key", "rid", "at", "n")]])
SHARED = T.StructType([T.StructField("rid", T.LongType()), T.StructField("at", T.LongType()), T.StructField("anchor", T.LongType()), T.StructField("n", T.LongType())])
PLACES = T.StructType([*SHARED.fields, T.StructField("rids", T.BinaryType()), T.StructField("ats", T.BinaryType())])
CONTEXTS = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("at", T.LongType()), T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType()), T.StructField("claim", T.LongType()), T.StructField("n", T.LongType())])
RUNS = T.StructType([T.StructField("rid", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
HOT = T.StructType([*RUNS.fields, T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("known", T.BooleanType())])
REPEATS = T.StructType([T.StructField("length", T.LongType()), T.StructField("n", T.LongType()), T.StructField("places", T.ArrayType(T.StructType([T.StructField("rid", T.LongType()), T.StructField("at", T.LongType())])))])
CUT = T.StructType([T.StructField("rid", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


def gram_hashes(data: np.ndarray, n: int, codes: np.ndarray = BYTE) -> np.ndarray:
    """A rolling hash of data[i:i+n] for each i."""
    if len(data) < n:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        up, down = POWERS.get(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(codes[data] * up[: len(data)], out=total[1:])
        return mix((total[n:] - total[:-n]) * down[: len(data) - n + 1])


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i, from running minima within blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(U64).max, U64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in data, and hashes, of the grams that are the smallest of some `least`-byte string inside one text.

    Which gram of a string is the smallest (the first, of equals) depends on the string alone, so all copies of a string hold an
    anchor at the same place. data is at most a few MB.
    """
    w = least - GRAM + 1
    h = gram_hashes(data, GRAM)
    if len(h) < w:
        return np.zeros(0, np.int64), h[:0]
    low = U64((1 << max(1, len(h).bit_length())) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=U64)
    inside = np.zeros(len(h) - w + 1, bool)
    edge = np.zeros(len(inside) + 1, np.int32)
    size = np.diff(offsets)
    long = np.flatnonzero(size >= least)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, np.minimum(offsets[long + 1] - least + 1, len(inside)), -1)
    inside = np.cumsum(edge[:-1]) > 0
    at = np.unique(window_minima(key, w)[inside] & low).astype(np.int64)
    return at, h[at]


def pieces(offsets: np.ndarray, overlap: int, most: int = STEP // 4) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges (first byte, first row, offsets from that byte) of whole rows, or of parts of a long row that overlap by `overlap` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        last = min(last, n)
        a, b = int(offsets[first]), int(offsets[last])
        if last - first > 1 or b - a <= most:
            yield a, first, offsets[first : last + 1] - a
        else:
            for start in range(a, max(a + 1, b - overlap), most):
                yield start, first, np.array([0, min(b, start + most + overlap) - start], np.int64)
        first = last


def _find_anchors(batches: Iterator[pa.RecordBatch], buckets: int, least: int, often: int = MANY) -> Iterator[pa.RecordBatch]:
    """Anchors by bucket of their hash, mixed, as anchors are the smallest hashes. Those found `often` among GATHERED are dealt to
    other buckets in packets of one anchor, and their number (n) goes to the anchor's own: no bucket grows with one anchor's places."""
    waiting, n, turn = [], 0, 0

    def packed(bucket: np.ndarray, key: np.ndarray, rid: np.ndarray | None, at: np.ndarray | None, size: np.ndarray | None) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        full, cut = _runs(bucket[order])
        columns = [pa.nulls(len(full), pa.binary()) if c is None else pa.array([planes(x) for x in np.split(c.astype(k)[order], cut[1:])][: len(full)], pa.binary()) for c, k in ((key, "<u8"), (rid, "<i8"), (at, "<i4"), (size, "<i8"))]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *columns], ANCHORS.names)

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        key, rid, at = (np.concatenate(c) for c in zip(*waiting, strict=True))
        known, number, size = np.unique(key, return_inverse=True, return_counts=True)
        many = size >= often
        bucket = (mix(key) >> U64(32)) * U64(buckets) >> U64(32)
        few = ~many[number]
        yield packed(bucket[few].astype(np.int64), key[few], rid[few], at[few], None)
        if many.any():
            yield packed(((mix(known[many]) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64), known[many], None, None, size[many])
            key, rid, at = key[~few], rid[~few], at[~few]
            order = np.argsort(key, kind="stable")
            key, rid, at = key[order], rid[order], at[order]
            turn = turn or int(mix(rid[:1].astype(U64))[0] >> U64(40))
            for one in np.split(np.arange(len(key)), _runs(key)[1][1:]):
                for i in range(0, len(one), PACKET):
                    turn += 1
                    part = one[i : i + PACKET]
                    yield packed(np.full(len(part), buckets + turn % buckets), key[part], rid[part], at[part], None)

    for batch in batches:
        rids = batch.column(0).to_numpy()
        data, offsets = text_buffers(batch.column(1))
        before = (-1, np.zeros(0, np.int64))
        for a, row, at in pieces(offsets, least - 1):
            found, h = anchors(data[a : a + at[-1]], at, least)
            own = row + np.searchsorted(at, found, side="right") - 1
            place = a + found - offsets[own]
            if before[0] == row:  # a long text's next part: what the two have in common counts once
                fresh = ~np.isin(place, before[1])
                own, place, h = own[fresh], place[fresh], h[fresh]
            before = (row, place)
            if len(place):
                waiting.append((h, rids[own], place))
                n += len(place)
            if n >= GATHERED:
                yield from out()
                waiting, n = [], 0
    if n:
        yield from out()


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of sorted x, and where each begins."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[first], first


def _share(group: pa.Table, buckets: int) -> pa.Table:
    """Places whose anchor is found elsewhere, too, with the number of its places; packets as they are (rids, ats), and of the anchors that
    came in packets somewhere a row with their number alone."""

    def column(c: str, kind: str, rows: list[bool]) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *[unplanes(b, kind) for b, some in zip(group.column(c).to_pylist(), rows, strict=True) if some]])

    def rows(places: dict) -> pa.Table:
        return pa.Table.from_arrays([pa.nulls(len(places["anchor"]), pa.binary() if c[-1] == "s" else pa.int64()) if c not in places else pa.array(places[c]) for c in PLACES.names], PLACES.names)

    if group.column("bucket")[0].as_py() >= buckets:
        anchor = [unplanes(b, "<i8")[0] for b in group.column("key").to_pylist()]
        return rows({"anchor": np.array(anchor), "rids": group.column("rid").combine_chunks(), "ats": group.column("at").combine_chunks()})
    placed = [b is not None for b in group.column("rid").to_pylist()]
    key, rid, at = column("key", "<u8", placed), column("rid", "<i8", placed), column("at", "<i4", placed).astype(np.int64)
    order = np.lexsort((at, rid, key))
    key, rid, at = key[order], rid[order], at[order]
    counted = [not p for p in placed]
    hot, more = column("key", "<u8", counted), column("n", "<i8", counted)
    known, number = np.unique(np.concatenate([key, hot]), return_inverse=True)
    size = np.zeros(len(known), np.int64)
    np.add.at(size, number, np.append(np.ones(len(key), np.int64), more))
    n, hot = size[number[: len(key)]], np.unique(hot)
    keep = n > 1
    found = rows({"rid": rid[keep], "at": at[keep], "anchor": key[keep].view(np.int64), "n": n[keep]})
    return pa.concat_tables([found, rows({"anchor": hot.view(np.int64), "n": size[np.searchsorted(known, hot)]})])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places as rows, those of packets, too."""
    for batch in batches:
        yield batch.filter(batch.column("rid").is_valid()).select(SHARED.names)
        packets = batch.filter(batch.column("rids").is_valid()).select(["rids", "ats", "anchor", "n"]).to_pylist()
        for i in range(0, len(packets), 64):
            found = [(unplanes(p["rids"], "<i8"), unplanes(p["ats"], "<i4").astype(np.int64), np.full(len(p["rids"]) // 8, p["anchor"]), np.full(len(p["rids"]) // 8, p["n"])) for p in packets[i : i + 64]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], SHARED.names)


def _contexts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The bytes around each place: so many before and from it as a repeated string that holds the anchor can reach; claim: how many
    bytes before it a string may begin that holds none of the text's earlier places."""
    kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 2

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], CONTEXTS.names)

    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        rows = []
        for i, (rid, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            text, last = data[offsets[i] : offsets[i + 1]].tobytes(), -1
            for p in sorted(places, key=lambda p: p["at"]):
                at = p["at"]
                rows.append((p["anchor"], rid, at, text[max(0, at - least + GRAM) : at][::-1], text[at : at + least], at - last - 1, p["n"]))
                last = at
            if len(rows) >= 1 << 14:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width), size


def common_prefixes(strings: list[bytes], width: int) -> np.ndarray:
    """Length of the common prefix of each string and the one before it (the first: 0)."""
    if not strings:
        return np.zeros(0, np.int64)
    out = [np.zeros(1, np.int64)]
    for a in range(0, len(strings) - 1, 1 << 15):
        rows, size = _matrix(strings[a : a + (1 << 15) + 1], width)
        differ = rows[1:] != rows[:-1]
        out.append(np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(size[1:], size[:-1])))
    return np.concatenate(out)


def prefix_intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The nodes (first, last, length) of the common-prefix interval tree, by one scan with a stack; children come before parents."""
    stack = [(0, 0)]  # (length, first)
    n = len(lcp)
    for i in range(1, n + 1):
        now = int(lcp[i]) if i < n else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield first, i - 1, length
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(left: list[bytes], right: list[bytes], group: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Maximal repeat groups of at least `least` bytes around anchors: (members, how far each reaches left, how far all reach right).

    left: reversed bytes before each anchor; right: bytes from it; both sorted by (group, right), an enhanced suffix array of each group.
    A node of its interval tree whose members extend left alike is a repeat as a whole; one with diverse extensions is split by sorting
    its members' reversed left sides, where each member's longest common extension is with a neighbour.
    """
    width = least
    ahead, back = common_prefixes(right, width), common_prefixes(left, width)
    ahead[1:][group[1:] != group[:-1]] = 0
    for first, last, length in prefix_intervals(ahead):
        need = least - length
        if length < GRAM or need > least - GRAM:
            continue
        if last - first == 1:
            if back[last] >= need:
                yield np.array([first, last]), np.array([back[last]] * 2), length
            continue
        alike = int(back[first + 1 : last + 1].min())
        if alike >= least - GRAM:
            yield np.arange(first, last + 1), np.full(last - first + 1, alike), length
            continue
        order = sorted(range(first, last + 1), key=left.__getitem__)
        both = common_prefixes([left[i] for i in order], width)
        reach = np.maximum(both, np.append(both[1:], 0))
        keep = reach >= need
        if keep.any():
            # neighbours with a shorter common extension belong to different repeats
            parts = np.cumsum(both < need)[keep]
            members, reach = np.array(order)[keep], reach[keep]
            for p in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1):
                yield members[p], reach[p], length


def _ordered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    anchor, rid, at, claim = (group.column(c).to_numpy() for c in ("anchor", "rid", "at", "claim"))
    left, right = group.column("left").to_pylist(), group.column("right").to_pylist()
    by = np.argsort(anchor, kind="stable")
    order = []
    for part in np.split(by, np.flatnonzero(np.diff(anchor[by])) + 1):
        order += sorted(part.tolist(), key=right.__getitem__)
    return anchor[order], rid[order], at[order], claim[order], [left[i] for i in order], [right[i] for i in order]


def _cover(group: pa.Table, least: int) -> pa.Table:
    """What repeats cover around each place."""
    anchor, rid, at, _, left, right = _ordered(group)
    lo, hi = at.copy(), at.copy()
    for members, reach, length in maximal_repeats(left, right, anchor, least):
        lo[members] = np.minimum(lo[members], at[members] - reach)
        hi[members] = np.maximum(hi[members], at[members] + length)
    some = hi > lo
    rid, lo, hi = rid[some], lo[some], hi[some]
    order = np.lexsort((lo, rid))
    return pa.table(dict(zip(RUNS.names, _merged(rid[order], lo[order], hi[order]), strict=True)))


def _merged(rid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted runs with those that touch or overlap in one row made one."""
    if not len(rid):
        return rid, lo, hi
    # a row's runs lie in a range of their own, so that one running maximum serves all rows
    span = int(hi.max()) + 2
    number = np.cumsum(np.append(0, rid[1:] != rid[:-1]))
    start, stop = lo + number * span, np.maximum.accumulate(hi + number * span)
    first = np.append(True, start[1:] > stop[:-1])
    return rid[first], lo[first], (stop - number * span)[np.append(np.flatnonzero(first)[1:] - 1, len(rid) - 1)]


def _cover_hot(group: pa.Table, least: int, step: int = HOT_STEP) -> Iterator[pa.RecordBatch]:
    """One share of a hot anchor's places: the runs that repeats within the share cover; and the hashes of the strings around its places
    that they leave open (known: false), beside each different string that they find repeated (known: true; of strings that lie far
    apart in the order, once for each `step` bytes). Hashes are made for `step` bytes of contexts at a time."""
    anchor, rid, at, claim, left, right = _ordered(group)
    n, reach = len(rid), least - GRAM  # a string begins 0 to reach bytes before the anchor
    edge = np.zeros((n, reach + 2), np.int32)
    for members, far, length in maximal_repeats(left, right, anchor, least):
        np.add.at(edge, (members, np.full(len(members), least - length)), 1)
        np.add.at(edge, (members, far + 1), -1)
    rows = max(1, step // (reach + least))
    for i in range(0, n, rows):
        yield _open_strings(*(x[i : i + rows] for x in (rid, at, claim, left, right, edge)), least)


def _open_strings(rid: np.ndarray, at: np.ndarray, claim: np.ndarray, left: list[bytes], right: list[bytes], edge: np.ndarray, least: int) -> pa.RecordBatch:
    n, reach = len(rid), least - GRAM
    before, ahead = (np.fromiter(map(len, x), np.int64, n) for x in (left, right))
    back = np.arange(reach + 1)
    there = (back <= before[:, None]) & (least - back <= ahead[:, None])
    known = (np.cumsum(edge, axis=1)[:, :-1] > 0) & there
    lo = np.where(known, back, -1).max(axis=1)
    hi = np.where(known, least - back, -1).max(axis=1)
    some = lo >= 0
    text = np.frombuffer(b"".join(x.ljust(reach, b"\0")[::-1] + y.ljust(least, b"\0") for x, y in zip(left, right, strict=True)), np.uint8)
    h = [gram_hashes(text, least, c).view(np.int64) for c in (BYTE, BYTE[::-1].copy())]
    row, b = np.nonzero(there & (back <= claim[:, None]))
    place = row * (reach + least) + reach - b
    found = known[row, b]
    h1, h2 = h[0][place], h[1][place]
    # of repeated strings, one of each kind
    first = np.zeros(len(row), bool)
    seen = np.flatnonzero(found)
    first[seen[np.unique(h1[seen], return_index=True)[1]]] = True
    put = ~found | first
    start = at[row[put]] - b[put]
    none = pa.nulls(int(some.sum()), pa.int64())
    join = lambda x, y: pa.concat_arrays([x, y])
    return pa.RecordBatch.from_pydict(
        {
            "rid": np.concatenate([rid[some], rid[row[put]]]),
            "lo": np.concatenate([at[some] - lo[some], start]),
            "hi": np.concatenate([at[some] + hi[some], start + least]),
            "h1": join(none, pa.array(h1[put])),
            "h2": join(none, pa.array(h2[put])),
            "known": join(pa.nulls(int(some.sum()), pa.bool_()), pa.array(found[put])),
        }
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        rows = []
        for i, (rid, runs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            lo, hi = np.array([[r["lo"], r["hi"]] for r in runs], np.int64).T
            order = np.argsort(lo, kind="stable")
            _, lo, hi = _merged(np.zeros(len(lo), np.int64), lo[order], hi[order])
            edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((rid, len(text) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], CUT.names)


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return row_ids(small_batches(docs)).select("rid", F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))


def _shared(texts: DataFrame, least: int) -> DataFrame:
    """Places (rid, at) of anchors that are found twice or more, with the anchor and the number of its places; a written table."""
    buckets = max(16, 2 * texts.rdd.getNumPartitions())
    found = texts.select("rid", "text").mapInArrow(partial(_find_anchors, buckets=buckets, least=least), ANCHORS)

    def share(group: pa.Table) -> pa.Table:
        return _share(group, buckets)

    found = save(found.groupBy("bucket").applyInArrow(share, PLACES), free=True)
    numbers = found.where("rid is null and rids is null").select("anchor", "n")
    packets = found.where("rids is not null").drop("n").join(numbers, "anchor")
    shared = save(found.where("rid is not null").unionByName(packets).mapInArrow(_unpacked, SHARED), free=True)
    discard(found)
    return shared


def _grouped(around: DataFrame, places: int, least: int):
    """Contexts grouped for sorting: small anchors by buckets of about BUCKET bytes, each larger anchor alone, in partitions of about
    PARTITION bytes, whatever the number of places."""
    width = 2 * least - GRAM + 48
    buckets = max(16, places * width // BUCKET)
    small = F.col("n") * width < BUCKET // 4
    around = around.withColumn("bucket", F.when(small, F.pmod(F.col("anchor"), F.lit(buckets))).otherwise(F.col("anchor"))).withColumn("alone", ~small)
    parts = max(16, places * width // PARTITION)
    return around.repartition(parts, "alone", "bucket").groupBy("alone", "bucket")


def remove_repeats(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text: str = "text", with_text: bool = False, group: int = GROUP) -> DataFrame:
    """One row per row of docs: rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining bytes: kept).

    A byte goes if a string of `least` bytes that covers it also starts anywhere else, in the same text or another.

    1. Anchors: the smallest 20-byte gram of each `least`-byte string, by a rolling hash. All copies of a string hold the same anchor, so
       repeats can only lie around anchors found twice, about one place in ninety.
    2. Texts without such anchors are done. Of equal texts all are repeats of each other (if long enough), and one stands for them.
    3. The bytes around the others' shared anchors go to groups by anchor, as many groups and partitions as their bytes ask for. Each group's right sides are sorted into an enhanced suffix
       array whose interval tree, scanned with a stack, gives all maximal repeats with all their places (maximal_repeats).
    4. Places of an anchor that is found more than `group` times are dealt out in shares, each sorted alone; what repeats within a share
       is known then. Only strings that are still open are counted across shares, by 128-bit hashes with map-side sums.

    Null and empty texts, and those shorter than `least`, lose nothing. Repeated rows are copies of one another. Other columns aren't
    read. docs must be a plain scan. Long texts are read in overlapping parts.
    """
    texts = _texts(docs, id_col, text)
    known = save(texts.select("rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    copies = known.groupBy("sha").agg(F.count("*").alias("n"), F.min("rid").alias("first"))
    known_copies = known.where(f"n_bytes >= {least}").join(copies.where("n > 1"), "sha").select("rid", (F.col("rid") != F.col("first")).alias("extra"))
    copies = save(known_copies)

    shared = _shared(texts, least)
    places = shared.join(copies.where("extra"), "rid", "left_anti").groupBy("rid").agg(F.collect_list(F.struct("at", "anchor", "n")).alias("places"))
    kept = save(texts.select("rid", "text").join(places, "rid"), free=True)

    def cover(table: pa.Table) -> pa.Table:
        return _cover(table, least)

    of = lambda hot: kept.withColumn("places", F.filter("places", lambda p: (p["n"] > group) == hot)).where("size(places) > 0")
    around = of(False).mapInArrow(partial(_contexts, least=least), CONTEXTS)
    runs = _grouped(around, shared.count(), least).applyInArrow(cover, RUNS)
    hot = of(True)
    if not hot.isEmpty():

        def cover_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _cover_hot(pa.Table.from_batches(batches), least)

        places = hot.mapInArrow(partial(_contexts, least=least), CONTEXTS)
        share = F.pmod(F.xxhash64("rid", "at"), F.ceil(F.col("n") / group))
        parts = max(16, shared.where(F.col("n") > group).count() * 2 * least // PARTITION)
        places = places.withColumn("share", share).repartition(parts, "anchor", "share")
        strings = save(places.groupBy("anchor", "share").applyInArrow(cover_hot, HOT), free=True)
        of_strings = strings.where("h1 is not null")
        twice = of_strings.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("known").alias("known")).where("n > 1 or known").select("h1", "h2")
        open_ = of_strings.where("not known").join(twice, ["h1", "h2"])
        runs = runs.unionByName(strings.where("h1 is null").select("rid", "lo", "hi")).unionByName(open_.select("rid", "lo", "hi"))
    runs = save(runs, free=True)
    discard(shared)

    whole = copies.select("rid")
    # a text that stands for its copies is gone as a whole, like them
    per_text = runs.join(whole, "rid", "left_anti").groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    cut = kept.select("rid", "text").join(per_text, "rid").mapInArrow(_cut, CUT)
    cut = cut.unionByName(known.join(whole, "rid").select("rid", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit(b"").alias("kept")))
    out = known.join(cut if with_text else cut.drop("kept"), "rid", "left")
    columns = ["rid", "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    if with_text:
        out = out.join(texts.select("rid", "text"), "rid")
        columns.append(F.coalesce("kept", "text").alias("kept"))
    return out.select(*columns)


def repeat_groups(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """Maximal repeat groups around anchors: length, n and places (rid, at) of all occurrences, the string beginning at `at`.

    A group's strings are equal for `length` bytes, at least `least`, no longer than fits around an anchor (2 * least - 20), and don't
    all extend alike within that range. A repeat that holds several anchors gives a group for each. Anchors at more than `group` places
    aren't in it (remove_repeats covers them).
    """
    texts = _texts(docs, id_col, text)
    shared = _shared(texts, least)
    places = shared.where(F.col("n") <= group).groupBy("rid").agg(F.collect_list(F.struct("at", "anchor", "n")).alias("places"))

    def groups(table: pa.Table) -> pa.Table:
        anchor, rid, at, _, left, right = _ordered(table)
        rows = []
        for members, reach, length in maximal_repeats(left, right, anchor, least):
            shortest = int(reach.min())
            rows.append((shortest + length, len(members), [{"rid": int(rid[i]), "at": int(at[i] - shortest)} for i in members]))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.struct([("rid", pa.int64()), ("at", pa.int64())]))))], REPEATS.names)

    around = texts.select("rid", "text").join(places, "rid").mapInArrow(partial(_contexts, least=least), CONTEXTS)
    return _grouped(around, shared.count(), least).applyInArrow(groups, REPEATS)
