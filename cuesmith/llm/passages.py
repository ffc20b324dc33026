"""Near-duplicate passages by compact windows: Cartesian trees over min-hashes of shingles, joined by interval across hash functions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesmith.llm.common import BYTE_LOWER, POWERS, STEP, U64, discard, mix, row_ids, save, small_batches, span_hashes, steps, text_buffers, window_hashes, words_of
from cuesmith.llm.graph import components
from cuesmith.llm.jaccard import PERCENT, planes, unplanes
from cuesmith.llm.suffix import window_minima

WORDS = 5
#: Fewest words of a passage, hash functions of the first order, how many of them must meet, and those of the second, where one is enough.
LEAST_WORDS, HASHES, MEET, HOT_HASHES = 50, 6, 2, 4
#: Windows with one signature up to which all their pairs are taken; more are linked to neighbours in two orders first.
ALL_PAIRS = 16
#: Occurrences from which a shingle is hot, and the most hot shingles, the most frequent ones, that tasks are told of; it bears on speed only.
HOT, MOST_HOT = 16, 1 << 20
#: Bits of the table in which tasks look hot shingles up.
HOT_BITS = 27
#: A longer list of a hot shingle is dealt out into sublists of about this many windows, and joined share by share where it stays open.
SUBLIST = 4096
#: How far apart, in words, two meetings may shift one passage against the other and still belong together.
SHIFT = 64
GATHERED = 1 << 17
COUNTED = 1 << 21

LOOK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("tag", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("rid", "doc_id", "n", "high", "low")]])
COUNT = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
KINDS = {"key": "<u8", "rid": "<i8", "l": "<u4", "c": "<u4", "r": "<u4", "k": "<u1", "whole": "<u8", "content": "<u8"}
BLOB = T.StructType([T.StructField("bucket", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in KINDS]])
MEETING = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "k", "la", "ca", "ra", "lb", "cb", "rb", "long", "key")])
OPEN = T.StructType([*[T.StructField(c, T.LongType()) for c in ("key", "rid", "component", "many", "l", "c", "r")], T.StructField("near", T.BinaryType())])
PART = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "la", "ra", "lb", "rb")])
FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "doc_id", "other_id", "start_a", "end_a", "start_b", "end_b", "shared", "total")])


def text_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """5-word shingles of all texts: hashes, and for each text the number of shingles before it and of its words."""
    starts, ends, cut = words_of(data, offsets)
    h = window_hashes(span_hashes(data, starts, ends, BYTE_LOWER), WORDS)
    n = np.diff(cut)
    row = np.repeat(np.arange(len(n)), n)
    whole = row[: len(h)] == row[WORDS - 1 :] if len(h) else np.zeros(0, bool)
    return h[whole], np.append(0, np.cumsum(np.maximum(n - WORDS + 1, 0))), n


def compact_windows(value: np.ndarray, cut: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, l, c, r): in text value[cut[i]:cut[i + 1]], every run from [l, c] to [c, r] has its smallest value, the first of equals, at c.

    Only runs of `least` values or more count. Such a window's c is the smallest of some `least` values in a row, and the nearest
    smaller values that bound it are such places, too; so a stack pass over these few places builds the Cartesian tree's useful nodes.
    Equal values without a smaller one between them are one node, that of the first, so a word said a hundred times gives one window.
    """
    none = np.zeros(0, np.int64)
    if len(value) < least:
        return none, none, none, none
    low = U64((1 << max(1, len(value).bit_length())) - 1)
    key = (value & ~low) | np.arange(len(value), dtype=U64)
    edge = np.zeros(len(value) + 1, np.int32)
    long = np.flatnonzero(np.diff(cut) >= least)
    np.add.at(edge, cut[long], 1)
    np.add.at(edge, cut[long + 1] - least + 1, -1)
    inside = np.cumsum(edge[:-1])[: len(value) - least + 1] > 0
    at = np.unique(window_minima(key, least)[inside] & low).astype(np.int64)
    text = np.searchsorted(cut, at, side="right") - 1
    places, values = at.tolist(), value[at].tolist()
    begin, end = cut[text].tolist(), (cut[text + 1] - 1).tolist()
    left, right, stack, here = [-1] * len(places), end[:], [], -1
    for i, (p, v) in enumerate(zip(places, values, strict=True)):
        if begin[i] != here:
            here, stack = begin[i], []
        while stack and stack[-1][1] > v:
            right[stack.pop()[0]] = p - 1
        if stack and stack[-1][1] == v:
            stack[-1][2] = p
            continue
        left[i] = stack[-1][2] + 1 if stack else here
        stack.append([i, v, p])
    base, left, right = cut[text], np.array(left, np.int64), np.array(right, np.int64)
    own = left >= 0
    return text[own], (left - base)[own], (at - base)[own], (right - base)[own]


# ---------------------------------------------------------------- classes of texts, hot shingles


def _look(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each text its number of shingles and a 128-bit sum of its placed shingles; of texts that the task hasn't met the upper halves
    of the shingle hashes, sorted, by ranges."""
    waiting, n, seen = [], 0, set()

    def out() -> pa.RecordBatch:
        keys = np.sort(np.concatenate(waiting)).astype("<u4")
        cut = np.searchsorted(keys, (np.arange(buckets + 1, dtype=U64) << U64(32)) // U64(buckets))
        full = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([planes(keys[cut[i] : cut[i + 1]]) for i in full], pa.binary()), *[pa.nulls(len(full), pa.int64())] * 5], LOOK.names)

    for batch in batches:
        data, offsets = text_buffers(batch.column(2))
        for a, b in steps(offsets, STEP // 2):
            at = offsets[a : b + 1]
            tokens, cut, _ = text_shingles(data[at[0] : at[-1]], at - at[0])
            size = np.diff(cut)
            place = mix((np.arange(len(tokens)) - np.repeat(cut[:-1], size)).astype(U64))
            sums = []
            with np.errstate(over="ignore"):
                for salt in (U64(21), U64(22)):
                    total = np.append(U64(0), np.cumsum(mix(tokens + mix(place ^ salt)), dtype=U64))
                    sums.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
            fresh = np.zeros(b - a, bool)
            for i, mark in enumerate(zip(size.tolist(), *(s.tolist() for s in sums), strict=True)):
                fresh[i] = mark not in seen
                seen.add(mark)
            waiting.append((tokens[np.repeat(fresh, size)] >> U64(32)).astype(np.uint32))
            n += len(waiting[-1])
            ids = [c.slice(a, b - a) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary()), *ids, pa.array(size), *map(pa.array, sums)], LOOK.names)
            if n >= COUNTED:
                yield out()
                waiting, n = [], 0
    if n:
        yield out()


def _hot_keys(group: pa.Table) -> pa.Table:
    keys = np.sort(np.concatenate([unplanes(b, "<u4") for b in group.column("tag").to_pylist()]))
    first, n = _runs(keys)
    some = n >= HOT
    return pa.table({"key": keys[first][some].astype(np.int64), "n": n[some].astype(np.int64)})


class _Hot:
    """The shingles that are hot, looked up in a table of bits: a few others count as hot, too, the same ones in every task."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.bits = np.zeros(1 << (HOT_BITS - 3), np.uint8)
        at = keys >> np.uint32(32 - HOT_BITS)
        np.bitwise_or.at(self.bits, at >> np.uint32(3), np.left_shift(1, at & np.uint32(7)).astype(np.uint8))

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        at = tokens >> U64(64 - HOT_BITS)
        return (self.bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1

    def count(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(tokens), np.int64)
        k = (tokens >> U64(32)).astype(np.uint32)
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.counts[i], 0)


def hot_segments(hot: np.ndarray, cut: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in runs of `least` within a text of which two thirds or more are hot; the cut of these places into segments, which don't
    cross texts and, where they stay long enough, begin and end with hot places; and the segments' texts."""
    none = np.zeros(0, np.int64)
    if len(hot) < least:
        return none, np.zeros(1, np.int64), none
    total = np.append(0, np.cumsum(hot))
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    dense = (3 * (total[least:] - total[:-least]) >= 2 * least) & (text[: len(hot) - least + 1] == text[least - 1 :])
    edge = np.zeros(len(hot) + 1, np.int32)
    at = np.flatnonzero(dense)
    edge[at] += 1
    edge[at + least] -= 1
    place = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(place):
        return none, np.zeros(1, np.int64), none
    begin = np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (text[place[1:]] != text[place[:-1]])))
    first, last = place[begin], place[np.append(begin[1:], len(place)) - 1]
    warm = np.flatnonzero(hot)
    from_hot, to_hot = warm[np.searchsorted(warm, first)], warm[np.searchsorted(warm, last, side="right") - 1]
    trim = to_hot - from_hot + 1 >= least
    first, last = np.where(trim, from_hot, first), np.where(trim, to_hot, last)
    size = last - first + 1
    parts = np.append(0, np.cumsum(size))
    return np.repeat(first - parts[:-1], size) + np.arange(parts[-1]), parts, text[first]


# ---------------------------------------------------------------- windows and meetings


def _linked(rid: np.ndarray, content: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs within each run [first, first + size) of equal signatures, sorted by content: all of a short run. In a long one, the
    first window of each content stands for the others, which meet one after another, and those that stand meet neighbours in two orders
    of the rows, the same ones in all lists. With them, whether the run is a long one, and which windows stand."""
    n = len(rid)
    run = np.repeat(np.arange(len(first)), size)
    long = (size > ALL_PAIRS)[run] if len(first) else np.zeros(0, bool)
    stands = np.ones(n, bool)
    stands[1:] = (run[1:] != run[:-1]) | (content[1:] != content[:-1])
    out = []
    for d in range(1, min(ALL_PAIRS, n)):
        i = np.flatnonzero((run[d:] == run[:-d]) & ~long[d:])
        if not len(i) and not (run[d:] == run[:-d]).any():
            break
        out.append(np.stack([i, i + d]))
    if long.any():
        at = np.flatnonzero(long & ~stands)
        out.append(np.stack([at - 1, at]))
        at = np.flatnonzero(long & stands)
        for order in (at[np.lexsort((by, run[at]))] for by in (rid[at], mix(rid[at].astype(U64) ^ U64(17)))):
            same = run[order[1:]] == run[order[:-1]]
            out.append(np.stack([order[:-1][same], order[1:][same]]))
    both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return both, long[both[0]], stands


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def _blobs(c: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Windows by bucket of their signature."""
    bucket = ((mix(c["key"]) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    order = np.lexsort((c["rid"], c["key"], bucket))
    c, bucket = {k: v[order] for k, v in c.items()}, bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array([planes(c[k][cut[i] : cut[i + 1]].astype(kind)) for i in full], pa.binary()) for k, kind in KINDS.items()]], BLOB.names)


def _find_windows(batches: Iterator[pa.RecordBatch], buckets: int, least: int, keys: np.ndarray, counts: np.ndarray, sublist: int) -> Iterator[pa.RecordBatch]:
    """Windows in two orders: whole texts with hot shingles last, and hot segments with hot shingles first.

    The smallest value of a passage that isn't all hot is thus that of a shingle with short lists. `whole` names the list where a hot
    one is dealt out into sublists (twice, by different shares of the rows, so that they overlap); 1: the second time, 0: it isn't.
    `content` is a hash of a hot window's shingles.
    """
    waiting, n, is_hot = [], 0, _Hot(keys, counts)

    def put(k, key, rid, l, c, r, content=None, whole=None):
        nonlocal n
        none = np.zeros(len(key), U64)
        waiting.append({"key": key, "rid": rid, "l": l, "c": c, "r": r, "k": np.full(len(key), k), "whole": none if whole is None else whole, "content": none if content is None else content})
        n += len(key)

    def out() -> pa.RecordBatch:
        return _blobs({x: np.concatenate([w[x] for w in waiting]) for x in KINDS}, buckets)

    top = U64(1 << 63)
    for batch in batches:
        rids = batch.column(0).to_numpy()
        data, offsets = text_buffers(batch.column(1))
        for a, b in steps(offsets, STEP // 2):
            at = offsets[a : b + 1]
            tokens, cut, _ = text_shingles(data[at[0] : at[-1]], at - at[0])
            hot = is_hot(tokens)
            place, parts, owner = hot_segments(hot, cut, least)
            if len(place):
                up, down = POWERS.get(len(tokens) + 1)
                with np.errstate(over="ignore"):
                    total = np.append(U64(0), np.cumsum(mix(tokens ^ U64(23)) * up[: len(tokens)], dtype=U64))
            for k in range(HASHES + HOT_HASHES):
                salt = mix(np.array([k + 1], U64))[0]
                if k < HASHES:
                    value = (mix(tokens ^ salt) >> U64(1)) | (hot.astype(U64) << U64(63))
                    text, l, c, r = compact_windows(value, cut, least)
                    at_c, base = cut[text] + c, np.zeros(len(text), np.int64)
                elif len(place):
                    value = np.where(hot[place], U64(0), top) | (mix(tokens[place] ^ salt) >> U64(1))
                    part, l, c, r = compact_windows(value, parts, least)
                    at_c, text = parts[part] + c, owner[part]
                    base = place[parts[part]] - cut[text]
                else:
                    break
                keep = value[at_c] < top
                text, l, c, r, at_c, base = (x[keep] for x in (text, l, c, r, at_c, base))
                if not len(text):
                    continue
                key, rid, l, c, r = mix(value[at_c] ^ salt), rids[a + text], l + base, c + base, r + base
                if k < HASHES:
                    put(k, key, rid, l, c, r)
                    continue
                with np.errstate(over="ignore"):
                    content = mix((total[cut[text] + r + 1] - total[cut[text] + l]) * down[cut[text] + l] + (r - l).astype(U64))
                many = is_hot.count(tokens[place[at_c]])
                short = many <= sublist
                put(k, *(x[short] for x in (key, rid, l, c, r, content)))
                if not short.all():
                    key, rid, l, c, r, content, shares = (x[~short] for x in (key, rid, l, c, r, content, (many // sublist + 1).astype(U64)))
                    for salt2, whole in ((U64(3), key), (U64(5), np.ones(len(key), U64))):
                        put(k, mix(key ^ mix((mix(rid.astype(U64) ^ salt2) % shares) ^ (salt2 << U64(40)))), rid, l, c, r, content, whole)
            if n >= GATHERED:
                yield out()
                waiting, n = [], 0
    if n:
        yield out()


def _join_bucket(group: pa.Table) -> pa.Table:
    """The meetings of a bucket, and of lists that are too long for all pairs the windows that stand (b null, lb the content)."""
    c = {k: np.concatenate([unplanes(x, kind) for x in group.column(k).to_pylist()]) for k, kind in KINDS.items()}
    c["content"] = np.where(c["k"] < HASHES, c["rid"].view(U64), c["content"])
    order = np.lexsort((c["rid"], c["content"], c["key"]))
    c = {k: v[order] for k, v in c.items()}
    first, size = _runs(c["key"])
    (i, j), long, stands = _linked(c["rid"], c["content"], first, size)
    apart = c["rid"][i] != c["rid"][j]
    i, j, long = i[apart], j[apart], long[apart] | (c["k"][i[apart]] >= HASHES)
    i, j = np.where(c["rid"][i] > c["rid"][j], j, i), np.where(c["rid"][i] > c["rid"][j], i, j)
    pairs = [c["rid"][i], c["rid"][j], c["k"][i], c["l"][i], c["c"][i], c["r"][i], c["l"][j], c["c"][j], c["r"][j], long, np.zeros(len(i))]
    # a list that is dealt out may be short in one task's share and long as a whole
    e = np.flatnonzero(stands & (c["whole"] != 1) & (np.repeat(size > ALL_PAIRS, size) | (c["whole"] > 1)))
    none, whole = np.zeros(len(e)), np.where(c["whole"] > 1, c["whole"], c["key"])
    rest = [c["rid"][e], none, c["k"][e], c["l"][e], c["c"][e], c["r"][e], c["content"][e].view(np.int64), none, none, none, whole[e].view(np.int64)]
    columns = [pa.array(np.concatenate([x.astype(np.int64), y.astype(np.int64)])) for x, y in zip(pairs, rest, strict=True)]
    columns[1] = pa.concat_arrays([pa.array(pairs[1].astype(np.int64)), pa.nulls(len(e), pa.int64())])
    return pa.Table.from_arrays(columns, MEETING.names)


# ---------------------------------------------------------------- lists that stay open


def _near(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Open windows with 32 bits of each shingle that a run of `least` around the window's smallest one can reach (0: none there)."""
    for batch in batches:
        tokens, cut, _ = text_shingles(*text_buffers(batch.column("text")))
        tokens, rows = np.maximum(tokens >> U64(32), U64(1)).astype("<u4"), []
        for i, windows in enumerate(batch.column("windows").to_pylist()):
            for w in windows:
                lo, hi = max(w["l"], w["c"] - least + 1), min(w["r"], w["c"] + least - 1)
                near = np.zeros(2 * least - 1, "<u4")
                at = lo - w["c"] + least - 1
                near[at : at + hi - lo + 1] = tokens[cut[i] + lo : cut[i] + hi + 1]
                rows.append((*[w[c] for c in OPEN.names[:-1]], near.tobytes()))
            if len(rows) >= 1 << 14:
                yield _table(rows, OPEN)
                rows = []
        yield _table(rows, OPEN)


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() for f in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], schema.names)


def fewest_shared(least: int) -> int:
    """Shingles that two runs of `least` must share to be similar."""
    return -(-PERCENT * 2 * least // (100 + PERCENT))


def fewest_different(near: np.ndarray, least: int) -> np.ndarray:
    """Of each row the least number of different values in a run of `least` places without a 0."""
    order = np.argsort(near, axis=1, kind="stable")
    sorted_ = np.take_along_axis(near, order, 1)
    again = np.zeros(near.shape, np.int16)  # 1 + the place of the equal value before, 0 for the first
    np.put_along_axis(again, order[:, 1:], np.where(sorted_[:, 1:] == sorted_[:, :-1], order[:, :-1] + 1, 0).astype(np.int16), 1)
    few = np.full(len(near), least)
    for s in range(near.shape[1] - least + 1):
        run = slice(s, s + least)
        n = (again[:, run] <= s).sum(axis=1)
        few = np.where((near[:, run] > 0).all(axis=1), np.minimum(few, n), few)
    return few


def _meet_shares(group: pa.Table, least: int) -> pa.Table:
    """Windows of one share that may hold a passage of one in another share: of other components, with a run of `least` places around the
    one's smallest shingle that the other holds nearly as many of as similar runs share (two fewer). A longer similar passage holds such
    a run, too, which meets in the list of its own smallest shingle.

    Places say little where a shingle is repeated: a run of one shingle lies in any window that holds it. So the different shingles that
    both windows hold must be three quarters of those of either one's poorest run, too; similar runs' union isn't smaller than that."""
    column = lambda c: group.column(c).to_numpy()
    share, rid, component, l, r = (column(c) for c in ("share", "rid", "component", "l", "r"))
    near = np.frombuffer(b"".join(group.column("near").to_pylist()), "<u4").reshape(len(rid), 2 * least - 1)
    marks = np.where(near > 0, np.maximum(near >> np.uint32(16), 1), 0).astype(np.uint16)
    few, sorted_ = fewest_different(near, least), np.sort(near, axis=1)
    different = np.where(np.diff(sorted_, axis=1, prepend=np.uint32(0)) > 0, np.maximum(sorted_ >> np.uint32(16), 1), 0).astype(np.uint16)
    same = group.column("x")[0] == group.column("y")[0]
    left, right = np.flatnonzero(share == group.column("x")[0].as_py()), np.flatnonzero(share == group.column("y")[0].as_py())
    enough, found, held = fewest_shared(least) - 2, [np.zeros((6, 0), np.int64)], np.zeros(1 << 16, bool)
    for i in left:
        j = right[component[right] > component[i] if same else component[right] != component[i]]
        if not len(j):
            continue
        held[marks[i]] = True
        held[0] = False
        for at in range(0, len(j), 1 << 13):
            q = j[at : at + (1 << 13)]
            q = q[4 * held[different[q]].sum(axis=1) >= 3 * np.maximum(few[q], few[i])]
            total = np.zeros((len(q), 2 * least), np.int16)
            np.cumsum(held[marks[q]], axis=1, out=total[:, 1:])
            q = q[(total[:, least:] - total[:, :least]).max(axis=1) >= enough]
            p = np.full(len(q), i)
            a, b = np.where(rid[p] < rid[q], p, q), np.where(rid[p] < rid[q], q, p)
            found.append(np.stack([rid[a], rid[b], l[a], r[a], l[b], r[b]]))
        held[marks[i]] = False
    return pa.Table.from_arrays([pa.array(c) for c in np.unique(np.concatenate(found, axis=1), axis=1)], PART.names)


def _node(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _both_ways(found: DataFrame) -> DataFrame:
    """Verified rows seen from each side: (rid, start, end, other, other_start, other_end)."""
    side = lambda x, y: found.select(F.col(x).alias("rid"), F.col(f"start_{x}").alias("start"), F.col(f"end_{x}").alias("end"), F.col(y).alias("other"), F.col(f"start_{y}").alias("other_start"), F.col(f"end_{y}").alias("other_end"))
    return side("a", "b").unionByName(side("b", "a"))


def _met_windows(windows: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of windows (key, rid, c) of one list whose smallest shingles lie in one verified passage of the two texts."""
    inside = lambda c, start, end: F.col(c).between(F.col(start), F.col(end) - WORDS)
    held = found.select("a", "b", "start_a", "end_a", "start_b", "end_b").distinct()
    one = windows.select("key", F.col("rid").alias("a"), F.col("c").alias("ca"))
    other = windows.select("key", F.col("rid").alias("b"), F.col("c").alias("cb"))
    met = one.join(held, "a").where(inside("ca", "start_a", "end_a")).join(other, ["key", "b"]).where(inside("cb", "start_b", "end_b"))
    return met.select(_node("key", "a", "ca").alias("a"), _node("key", "b", "cb").alias("b"))


def _open_parts(windows: DataFrame, found: DataFrame, texts: DataFrame, least: int, sublist: int) -> DataFrame | None:
    """Candidates (a, b, la, ra, lb, rb) from lists whose windows verified passages don't hold together, every two components' windows
    compared; None where there is no such list. Windows of a list are linked where one verified passage holds both their smallest
    shingles: whatever else their texts share doesn't count. Of a component's windows of equal content, one stands for all. Lists are
    dealt into shares, and every two shares meet in a group of their own."""
    windows = save(windows.distinct())
    reached = components(_met_windows(windows, found)).withColumnRenamed("node", "id")
    entries = windows.withColumn("id", _node("key", "rid", "c")).join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    grouped = save(entries.groupBy("key", "content", "component").agg(F.min(F.struct("rid", "l", "c", "r")).alias("w")).select("key", "component", "w.*"))
    discard(windows)
    mixed = grouped.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many")).where("lo < hi").select("key", "many")
    entries = save(grouped.join(mixed, "key"))
    discard(grouped)
    if entries.isEmpty():
        return None
    per_text = entries.groupBy("rid").agg(F.collect_set(F.struct(*OPEN.names[:-1])).alias("windows"))
    hot = texts.select("rid", "text").join(per_text, "rid").select("text", "windows").mapInArrow(partial(_near, least=least), OPEN)
    hot = hot.withColumn("parts", F.expr(f"many div {sublist} + 1")).withColumn("share", F.pmod(F.xxhash64("rid"), "parts"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    hot = hot.select("key", F.least("share", "other").alias("x"), F.greatest("share", "other").alias("y"), "share", "rid", "component", "l", "r", "near")

    def meet(group: pa.Table) -> pa.Table:
        return _meet_shares(group, least)

    parts = save(hot.groupBy("key", "x", "y").applyInArrow(meet, PART))
    discard(entries)
    return parts


# ---------------------------------------------------------------- verification

#: What a place without a match costs against 1 for a match, from lenient to strict; the next is tried where a run as a whole isn't similar enough.
COSTS = (1, 2, 3, 4, 6, 12, 1 << 40)


def best_run(match: np.ndarray, cost: int = COSTS[0]) -> tuple[int, int]:
    """The run of places with the largest sum of 1 for a match and -cost for none: cut anywhere, cost / (cost + 1) of it match."""
    total = np.append(0, np.cumsum(np.where(match, 1, -cost)))
    end = int(np.argmax(total - np.minimum.accumulate(total)))
    return int(np.argmin(total[: end + 1])), end


def _at_least(first: int, last: int, size: int, least: int) -> tuple[int, int]:
    """[first, last) widened to `least` places, to the right and then to the left, as far as there are places."""
    last = min(size, max(last, first + least))
    return max(0, min(first, last - least)), last


def similar_runs(p: np.ndarray, q: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Runs p[s:e] and q[t:f] of `least` or more whose sets have a Jaccard similarity of 0.75 or more, with shared and total: from each
    best run on to both sides of it, and into it at stricter costs where it isn't similar enough as a whole."""
    known, number = np.unique(np.concatenate([p, q]), return_inverse=True)
    p, q = number[: len(p)], number[len(p) :]

    def marks(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(known), bool)
        out[x] = True
        return out

    match, few = marks(q)[p], least * 3 // 4
    matches = np.append(0, np.cumsum(match))
    todo = [(0, len(p), 0)]
    while todo:
        lo, hi, level = todo.pop()
        if matches[hi] - matches[lo] < few:
            continue
        s, e = best_run(match[lo:hi], COSTS[level])
        s, e = lo + s, lo + e
        if e - s < few:
            continue
        t, f = best_run(marks(p[s:e])[q], COSTS[level])
        a, b = best_run(marks(q[t:f])[p[s:e]], COSTS[level])  # what the run owes to other places of q falls off
        s, e = s + a, s + b
        (i, j), (x, y) = _at_least(s, e, len(p), least), _at_least(t, f, len(q), least)
        one, other = marks(p[i:j]), marks(q[x:y])
        shared, total = int((one & other).sum()), int((one | other).sum())
        if min(j - i, y - x) >= least and 100 * shared >= PERCENT * total:
            yield i, j, x, y, shared, total
        elif level + 1 < len(COSTS):
            todo.append((s, e, level + 1))
        todo += [(lo, s, level), (e, hi, level)]


def _widest(parts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The candidates that don't lie within another one on both sides."""
    kept: list[tuple[int, int, int, int]] = []
    for p in sorted(parts, key=lambda p: (p[0] - p[1] + p[2] - p[3], p)):
        if not any(k[0] <= p[0] and p[1] <= k[1] and k[2] <= p[2] and p[3] <= k[3] for k in kept):
            kept.append(p)
    return kept


def _clipped(data: np.ndarray, offsets: np.ndarray, low: list[int], high: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the bytes of its words low to high - 1."""
    starts, ends, cut = words_of(data, offsets)
    parts = []
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        last = min(cut[i] + b, cut[i + 1])
        parts.append(data[starts[cut[i] + a] : ends[last - 1]])
    return np.concatenate([np.zeros(0, np.uint8), *parts]), np.cumsum([0, *map(len, parts)])


def _reach(parts: list[list[dict]], left: str, right: str) -> tuple[list[int], list[int]]:
    """Of each row the words that the shingles of all its candidates take on one side: first and one past the last."""
    return [min(p[left] for p in row) for row in parts], [max(p[right] for p in row) + WORDS for row in parts]


def _clip_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose text_a is cut to the words that they need; from_a is the first one's number."""
    for batch in batches:
        data, at = text_buffers(batch.column("text_a"))
        low, high = _reach(batch.column("parts").to_pylist(), "la", "ra")
        for first, last in steps(at, STEP // 2):
            found, cut = _clipped(data[at[first] : at[last]], at[first : last + 1] - at[first], low[first:last], high[first:last])
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(found)]).cast(pa.binary())
            rest = [batch.column(c).slice(first, last - first) for c in ("a", "b", "id_a", "parts")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(low[first:last], pa.int64()), text], ["a", "b", "id_a", "parts", "from_a", "text_a"])


CLIPPED = "a long, b long, id_a long, parts array<struct<la:long,ra:long,lb:long,rb:long>>, from_a long, text_a binary"


def _passages(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Verified passages of candidate pairs, on the texts' own words, cut to those that the candidates need. A candidate within another
    one is passed over."""
    for batch in batches:
        (x_data, x_at), (y_data, y_at) = (text_buffers(batch.column(c)) for c in ("text_a", "text_b"))
        columns = [batch.column(c).to_pylist() for c in ("a", "b", "id_a", "id_b", "from_a", "parts")]
        low, high = _reach(columns[-1], "lb", "rb")
        rows = []
        for first, last in steps(x_at + y_at, STEP // 2):
            x, xc, _ = text_shingles(x_data[x_at[first] : x_at[last]], x_at[first : last + 1] - x_at[first])
            y, yc, _ = text_shingles(*_clipped(y_data[y_at[first] : y_at[last]], y_at[first : last + 1] - y_at[first], low[first:last], high[first:last]))
            for i, (a, b, id_a, id_b, from_a, parts) in enumerate(zip(*(c[first:last] for c in columns), strict=True)):
                x0, y0 = xc[i] - from_a, yc[i] - low[first + i]
                for la, ra, lb, rb in _widest([(p["la"], p["ra"], p["lb"], p["rb"]) for p in parts]):
                    p, q = x[x0 + la : min(x0 + ra + 1, xc[i + 1])], y[y0 + lb : min(y0 + rb + 1, yc[i + 1])]
                    for s, e, t, f, shared, total in similar_runs(p, q, least):
                        rows.append((a, b, id_a, id_b, la + s, la + e + WORDS - 1, lb + t, lb + f + WORDS - 1, shared, total))
        yield _table(rows, FOUND)


def _verified(parts: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """The passages of candidates (a, b, la, ra, lb, rb), written; each pair's candidates are one row, which takes along the words of a
    that they need, and then meets b's text."""
    candidates = save(parts.groupBy("a", "b").agg(F.collect_set(F.struct("la", "ra", "lb", "rb")).alias("parts")))
    needed = candidates.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    texts = texts.join(needed, "rid", "left_semi")
    left = texts.select(F.col("rid").alias("a"), F.col("doc_id").alias("id_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rid").alias("b"), F.col("doc_id").alias("id_b"), F.col("text").alias("text_b"))
    clipped = candidates.join(left, "a").select("a", "b", "id_a", "parts", "text_a").mapInArrow(_clip_left, CLIPPED)
    found = save(clipped.join(right, "b").mapInArrow(partial(_passages, least=least), FOUND).distinct())
    discard(candidates)
    return found


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its words and different shingles."""
    for batch in batches:
        tokens, cut, n = text_shingles(*text_buffers(batch.column(1)))
        different = [len(np.unique(tokens[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(different, pa.int64())], ["rid", "words", "shingles"])


def near_duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, sublist: int = SUBLIST) -> DataFrame:
    """Pairs of documents with a near-duplicate passage: doc_id, other_id, the passages' words [start, end) in each, shared and total shingles,
    and class_id, the same for all passages that rows link: a class's rows name every text that holds it, and where.

    Passages have at least `least_words` words on both sides, and their sets of 5-word shingles a Jaccard similarity of 0.75 or more.

    1. Texts with equal shingles in equal order (A-Z in either case, any blanks) are copies; the first stands for them.
    2. Shingles are counted over all texts. Six hash functions give every shingle a value, hot shingles behind all others; compact windows
       (l, c, r) group all runs of a text whose min-hash is at c. Four more do so, hot shingles first, in segments that are mostly hot.
       Of two similar passages, either the hot shingles or the others are as similar as the whole.
    3. Windows of equal signature meet: all pairs of up to 16. Meetings of two texts whose windows overlap, at about one shift, are joined
       over the hash functions; two must meet, or one of the four. At a similarity of 0.75 at least two of six meet with a probability of
       99.5 %, one of four with 99.6 %; equal passages always meet. In longer lists windows of equal content meet one after another,
       and the first ones of each content meet neighbours in two orders, within sublists where hot.
    4. Candidates are verified on whole texts and cut to the runs that match best.
    5. Within a long list, windows are linked where one verified passage holds both their smallest shingles. Long lists that these links
       leave in several components are joined whole, share by share, every two components' windows that share enough shingles around
       their smallest one; so no link between components is lost, whatever else the texts share. Where a list holds very many mostly
       hot, yet different segments, this join is quadratic in that list.

    So texts that share a passage with up to 16 others have a row each; of more, all are reached over rows. Copies are pairs of their
    first row and each other row, whole. Documents without such a passage have no row. Null, empty and short texts have none. Repeated
    rows are copies. Null doc_ids stay null in the pairs. Other columns aren't read. docs must be a plain scan.
    """
    least = least_words - WORDS + 1
    texts = row_ids(small_batches(docs)).select("rid", F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = max(16, 2 * texts.rdd.getNumPartitions())
    looked = save(texts.mapInArrow(partial(_look, buckets=buckets), LOOK))
    top = looked.where("bucket is not null").groupBy("bucket").applyInArrow(_hot_keys, COUNT).orderBy(F.col("n").desc(), "key").limit(MOST_HOT).toPandas().sort_values("key")
    copies = save(_copies(looked.where(f"n >= {least}")))
    one = texts.join(copies.select("rid"), "rid", "left_anti")

    find = partial(_find_windows, buckets=buckets, least=least, keys=top["key"].to_numpy().astype(np.uint32), counts=top["n"].to_numpy().astype(np.int64), sublist=sublist)
    discard(looked)
    met = save(one.select("rid", "text").mapInArrow(find, BLOB).groupBy("bucket").applyInArrow(_join_bucket, MEETING))
    found = _verified(_candidates(met.where("b is not null").drop("key")), texts, least)
    windows = met.where("b is null").select("key", F.col("a").alias("rid"), F.col("la").alias("l"), F.col("ca").alias("c"), F.col("ra").alias("r"), F.col("lb").alias("content"))
    more = None if windows.isEmpty() else _open_parts(windows, found, texts, least, sublist)
    discard(met)
    if more is not None:
        found = save(found.unionByName(_verified(more, texts, least)).distinct())
        discard(more)
    found = _with_classes(found, least_words)

    firsts = texts.join(copies.select(F.col("first").alias("rid")).distinct(), "rid", "left_semi").select("rid", "text").mapInArrow(_whole, "rid long, words long, shingles long")
    zero, words = F.lit(0).cast("long"), F.col("words")
    same = copies.join(firsts.withColumnRenamed("rid", "first"), "first")
    same = same.select(F.col("first_id").alias("doc_id"), F.col("doc_id").alias("other_id"), zero.alias("start_a"), words.alias("end_a"), zero.alias("start_b"), words.alias("end_b"), F.col("shingles").alias("shared"), F.col("shingles").alias("total"), F.xxhash64("first", zero, words).alias("class_id"))
    return found.drop("a", "b").unionByName(same)


def _with_classes(found: DataFrame, least_words: int) -> DataFrame:
    """Rows with class_id: one for all passages that rows link, or that lie in one text and have least_words words or more in common."""
    spans = save(_both_ways(found).select("rid", "start", "end").distinct())
    before = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    furthest = spans.withColumn("far", F.max(F.struct("end", "start")).over(before)).where(F.least("end", "far.end") - F.col("start") >= least_words)
    one = furthest.select(_node("rid", "start", "end").alias("a"), _node("rid", "far.start", "far.end").alias("b"))
    links = found.select(_node("a", "start_a", "end_a").alias("a"), _node("b", "start_b", "end_b").alias("b"))
    reached = components(one.unionByName(links)).select(F.col("node").alias("id"), F.col("component").alias("class_id"))
    discard(spans)
    return found.withColumn("id", _node("a", "start_a", "end_a")).join(reached, "id", "left").withColumn("class_id", F.coalesce("class_id", "id")).drop("id")


def _copies(known: DataFrame) -> DataFrame:
    """Rows (rid, doc_id, first, first_id) whose shingles equal those of an earlier row, the first of them."""
    first = known.groupBy("n", "high", "low").agg(F.min(F.struct("rid", "doc_id")).alias("f"), F.count("*").alias("m")).where("m > 1")
    return known.join(first, ["n", "high", "low"]).where("rid <> f.rid").select("rid", "doc_id", F.col("f.rid").alias("first"), F.col("f.doc_id").alias("first_id"))


def _candidates(meetings: DataFrame) -> DataFrame:
    """Meetings joined over the hash functions: (a, b, la, ra, lb, rb) of overlapping windows at about one shift, met often enough; a
    meeting in a long list is enough, as only a few of its pairs are tried."""
    shift = F.col("ca") - F.col("cb")
    pair = Window.partitionBy("a", "b").orderBy(shift, "ca", "k")
    before = pair.rowsBetween(Window.unboundedPreceding, -1)
    apart = (F.col("la") > F.max("ra").over(before)) | (F.abs(shift - F.lag(shift).over(pair)) > SHIFT)
    joined = meetings.withColumn("new", F.when(apart, 1).otherwise(0)).withColumn("part", F.sum("new").over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = [f(c).alias(c) for c, f in (("la", F.min), ("ra", F.max), ("lb", F.min), ("rb", F.max))]
    met = joined.groupBy("a", "b", "part").agg(F.count_distinct("k").alias("met"), F.max("long").alias("long"), *bounds)
    return met.where(f"met >= {MEET} or long = 1").select("a", "b", "la", "ra", "lb", "rb")
