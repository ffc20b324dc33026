"""The ten operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuesmith.llm import common, exact, jaccard, mixing, packing, passages, private, queries, repetition, sharding, suffix, warc
from cuesmith.llm.graph import components
from tests.llm import brute
from tests.llm.conftest import frame, messy_texts, words


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- shared


def test_words_and_hashes():
    texts = messy_texts()
    data, offsets = common.text_buffers(pa.array(texts))
    starts, ends, cut = common.words_of(data, offsets)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(starts[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]], strict=True)]
        assert got == brute.WORD.findall(t or "")
    by_word = defaultdict(set)
    for a, b, h in zip(starts, ends, common.span_hashes(data, starts, ends), strict=True):
        by_word[raw[a:b]].add(int(h))
    assert all(len(h) == 1 for h in by_word.values()) and len({min(h) for h in by_word.values()}) == len(by_word)
    assert len({len(x) for x in (texts, list(common.shingles(data, offsets)))}) == 1


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 101 + i) for i in range(50)]
    loose = [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    links = chain + star + loose + [(5, 5), (3, 4)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in want.items() if x in got} and all(x in got or c == x for x, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 WARC


def pages(spark, rows_):
    return spark.createDataFrame(rows_, "page_id long, url string, html string, digest string, payload int")


def test_warc_round_trip(spark, written):
    rng = random.Random(1)
    texts = [None, "", "", "é", "a" * 3_000_000, "same", "same", "same"] + [f"<html>{words(rng, 80)}</html>" for _ in range(60)]
    df = written(pages(spark, [(i, f"http://x/{i}\r\nInjected: 1" if i % 3 else None, t, "d", 1) for i, t in enumerate(texts)]))
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    first = {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        first.setdefault(data, i)
        r = got[i]
        import base64

        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[data] == i else ("revisit", first[data]))
    assert len(got) == len(texts)
    assert warc.round_trip(written(pages(spark, []))).count() == 0
    twice = warc.round_trip(written(pages(spark, [(1, "u", "t", "", 0), (1, "u", "t", "", 0), (None, "u", "t", "", 0), (2, "u", "t", "", 0)])))
    assert rows(twice, "page_id", "record_type", "refers_to") == [(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1)]
    least = warc.read_archives(common.save(warc.write_archives(written(pages(spark, [(1, "u", "abc", "", 0), (2, "u", "abc", "", 0), (3, "u", "abcd", "", 0), (4, "u", "abcd", "", 0)])), least_bytes=4)))
    assert rows(least, "record_id", "record_type") == [(f"<urn:page:{i}>", "revisit" if i == 4 else "response") for i in range(1, 5)]


def test_warc_checks():
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>"), ("WARC-Date", warc.DATE)]
    data = warc.archive([warc.record(fields, b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc" + bytes([i])) for i in range(40)])
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    found = list(warc.frames(data))
    assert len(found) == 40 and warc.parse(found[5][1], 0)[1].endswith(b"abc\x05")
    size = int.from_bytes(data[4:8], "little")
    raw_dictionary = __import__("zstandard").ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=1 << 20)
    plain = data[:4] + len(raw_dictionary).to_bytes(4, "little") + raw_dictionary + data[8 + size :]
    assert [c for _, c in warc.frames(plain)] == [c for _, c in found]
    for broken in (data[:-5], data + b"xyz", data + b"\x51\x2a\x4d\x18\x09\0\0\0cut off", data[:8] + b"\0" * 8, data[: 8 + size] + b"junkjunkjunk"):
        with pytest.raises((warc.WarcError, __import__("zstandard").ZstdError)):
            list(warc.frames(broken))
    good = warc.record(fields, b"abc")
    for content in (good[:-1], good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"urn:page", b"urn:\xff"), b""):
        with pytest.raises(warc.WarcError):
            warc.parse(content, 0)


# ---------------------------------------------------------------- 2 passages


def test_compact_windows():
    rng = np.random.default_rng(5)
    for least in (1, 2, 5, 17):
        sizes = [0, 1, 40, 3, 120, 16]
        cut = np.append(0, np.cumsum(sizes))
        value = rng.integers(0, 1 << 62, cut[-1]).astype(np.uint64)
        got = set(zip(*(x.tolist() for x in passages.compact_windows(value, cut, least)), strict=True))
        want = set()
        for t, n in enumerate(sizes):
            v = value[cut[t] : cut[t + 1]].tolist()
            for c in range(n):
                a, b = c, c
                while a and v[a - 1] > v[c]:
                    a -= 1
                while b + 1 < n and v[b + 1] > v[c]:
                    b += 1
                if b - a + 1 >= least:
                    want.add((t, a, c, b))
        assert got == want


def test_passages(messy, empty, repeated):
    found = passages.near_duplicate_passages(messy).collect()
    texts = dict(pairs(messy))
    low = {i: [w.translate(brute.LOWER) for w in brute.WORD.findall(t or "")] for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        p, q = low[r.doc_id][r.start_a : r.end_a], low[r.other_id][r.start_b : r.end_b]
        a, b = brute.shingles(" ".join(p)), brute.shingles(" ".join(q))
        assert (len(a & b), len(a | b)) == (r.shared, r.total) and 4 * r.shared >= 3 * r.total and min(len(p), len(q)) >= 50
        parent[find(r.doc_id)] = find(r.other_id)
    runs = defaultdict(set)
    for i, w in low.items():
        for k in range(len(w) - 49):
            runs[tuple(w[k : k + 50])].add(i)
    assert any(len(s) > 16 for s in runs.values())
    assert all(len({find(i) for i in s}) == 1 for s in runs.values())
    assert passages.near_duplicate_passages(empty).count() == 0
    long = Counter(t for _, t in pairs(repeated) if len(brute.WORD.findall(t or "")) >= 50)
    whole = [r for r in passages.near_duplicate_passages(repeated).collect() if r.start_a == r.start_b == 0 and r.shared == r.total]
    assert len(whole) >= sum(n - 1 for n in long.values()) > 0 and any(n > 1 for n in long.values())


def test_passages_of_copies_in_other_letters(spark, written):
    """Copies that differ in letter case, blanks or a last newline, all in one task, pair with one another and with a third text."""
    rng = random.Random(41)
    text = words(rng, 80)
    texts = [text, text.upper(), text.replace(" ", "\n"), text + "\n", words(rng, 60) + " " + text, text]
    found = passages.near_duplicate_passages(written(frame(spark, texts), 1)).collect()
    linked = _reached(found, range(6))
    assert {linked(i) for i in range(6)} == {0} and all(r.shared == r.total == 76 for r in found)
    assert all({r.doc_id, r.other_id} == {4, *({r.doc_id, r.other_id} - {4})} or (r.start_a, r.end_a, r.start_b, r.end_b) == (0, 80, 0, 80) for r in found)


def _reached(found, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        a, b = find(r.doc_id), find(r.other_id)
        parent[max(a, b)] = min(a, b)
    return find


def test_equal_passages_around_a_common_phrase(spark, written):
    """Pairs with an equal passage, most of which is a phrase that all texts hold: each pair is found, and nothing else linked."""
    rng = random.Random(5)
    phrase, texts = words(rng, 30, 40000), []
    for _ in range(150):
        passage = f"{words(rng, 10, 40000)} {phrase} {words(rng, 10, 40000)}"
        texts += [f"{words(rng, 60, 40000)} {passage} {words(rng, 60, 40000)}" for _ in range(2)]
    found = passages.near_duplicate_passages(written(frame(spark, texts), 5)).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in found} == {frozenset((2 * i, 2 * i + 1)) for i in range(150)}


def test_passages_of_hot_lists(spark, written):
    """Documents of any three of eight passages in other orders and near copies of one: all that share a passage are linked, in shares, too."""
    rng = random.Random(6)
    blocks = [words(rng, 52, 40000) for _ in range(8)]
    texts = [f"{words(rng, 9, 40000)} {blocks[i % 8]} {words(rng, 9, 40000)}" for i in range(240)]
    core = words(rng, 110, 40000).split()
    for _ in range(80):
        w = core[:]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    df = written(frame(spark, texts), 5)
    for sublist in (20, 4096):
        find = _reached(passages.near_duplicate_passages(df, sublist=sublist).collect(), range(len(texts)))
        assert [find(i) for i in range(240)] == [i % 8 for i in range(240)] and {find(i) for i in range(240, 320)} == {240}


def test_open_lists(spark, written):
    """Phrases of 40 words in many texts: the few pairs whose surroundings are alike are found among all of a list that stays open."""
    rng = random.Random(8)
    phrase, texts = words(rng, 43, 40000), []
    for i in range(60):
        around = [words(rng, 30, 40000) for _ in range(2)]
        texts += [f"{around[0]} {phrase} {around[1]}"] * (i % 2) + [f"{around[0]} {phrase} {around[1]} {words(rng, 20, 40000)}"]
    found = passages.near_duplicate_passages(written(frame(spark, texts), 3), sublist=16).collect()
    low = [t.split() for t in texts]
    links = {frozenset((a, b)) for a in range(len(texts)) for b in range(a) if low[a][:40] == low[b][:40]}
    assert links <= {frozenset((r.doc_id, r.other_id)) for r in found}


def test_open_candidates_by_different_shingles():
    """Runs of few shingles, over and over, meet no richer window that happens to hold them; no pair with similar runs is left out."""
    rng, least, width = np.random.default_rng(3), 8, 15

    def candidates(near):
        n = len(near)
        number = pa.array(range(n), pa.int64())
        same = lambda x: pa.array([x] * n, pa.int64())
        table = pa.table({"key": same(1), "x": same(0), "y": same(0), "share": same(0), "rid": number, "component": number, "l": same(0), "r": same(width - 1), "near": [x.astype("<u4").tobytes() for x in near]})
        found = passages._meet_shares(table, least)
        return set(zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True))

    value = lambda shape, most: (rng.integers(1, most + 1, shape) << 16 | rng.integers(0, 2)).astype(np.uint32)
    rich = np.arange(1, width + 1, dtype=np.uint32) << 16
    poor = np.where(np.arange(width) < least, rich[0], 0)
    assert candidates([rich, poor]) == set() and candidates([rich, rich[::-1]]) == {(0, 1)} and candidates([poor, poor]) == {(0, 1)}

    kinds = [value(width, most) for most in (1, 2, 3, 6, 12, 30) for _ in range(8)]
    near = [np.where(rng.random(width) < 0.2, value(width, 6), x) for x in kinds for _ in range(2)]
    got, enough = candidates(near), passages.fewest_shared(least) - 2
    runs = [[set(x[s:e].tolist()) for s in range(width) for e in range(s + least, width + 1)] for x in near]
    for i, j in itertools.combinations(range(len(near)), 2):
        places = max(np.isin(near[j][s : s + least], near[i]).sum() for s in range(width - least + 1)) >= enough
        similar = any(4 * len(p & q) >= 3 * len(p | q) for p in runs[i] for q in runs[j])
        assert not (places and similar) or (i, j) in got, (i, j)
    assert 100 < len(got)


def test_passage_recall(spark, written):
    """Passages of 60 to 120 words with scattered edits: of the pairs whose best common passage has a similarity of 0.75 or more, found."""
    rng = random.Random(12)
    texts, similar = [], []
    for _ in range(240):
        n = rng.randrange(60, 120)
        passage = words(rng, n, 40000).split()
        other = passage[:]
        for place in rng.sample(range(n), rng.randrange(4)):
            other[place] = f"e{rng.randrange(10**7)}"
        a, b = brute.shingles(" ".join(passage)), brute.shingles(" ".join(other))
        similar.append(4 * len(a & b) >= 3 * len(a | b))
        texts += [" ".join([words(rng, 50, 40000), *w, words(rng, 70, 40000)]) for w in (passage, other)]
    found = {frozenset((r.doc_id, r.other_id)) for r in passages.near_duplicate_passages(written(frame(spark, texts), 4)).collect()}
    hits = [frozenset((2 * i, 2 * i + 1)) in found for i, s in enumerate(similar) if s]
    assert len(hits) > 120 and sum(hits) >= 0.98 * len(hits)


@pytest.mark.parametrize("footers", [False, True])
def test_passages_around_a_common_phrase(spark, written, footers):
    """Pairs whose passages hold a phrase common to all texts, which may share a footer, too, and other passages besides."""
    rng = random.Random(14)
    phrase, footer, other = words(rng, 43, 40000).split(), words(rng, 60, 40000), [words(rng, 70, 40000) for _ in range(4)]
    texts, whole = [], []
    for i in range(60):
        head, tail = words(rng, 14, 40000).split(), words(rng, 14, 40000).split()
        passage, changed = [*head, *phrase, *tail], [*head[:-1], f"e{i}", *phrase, *tail[:-1], f"f{i}"]
        a, b = brute.shingles(" ".join(passage)), brute.shingles(" ".join(changed))
        whole.append(4 * len(a & b) >= 3 * len(a | b))
        for k, w in enumerate((passage, changed)):
            texts.append(" ".join([words(rng, 30, 40000), *w, words(rng, 40, 40000), *([other[(i + k) % 4], footer] if footers else [])]))
    assert all(whole)
    found = passages.near_duplicate_passages(written(frame(spark, texts), 4)).collect()
    at = phrase[20]
    place = [t.split().index(at) for t in texts]
    pairs_ = {frozenset((r.doc_id, r.other_id)) for r in found if r.start_a <= place[r.doc_id] < r.end_a and r.start_b <= place[r.other_id] < r.end_b}
    assert [frozenset((2 * i, 2 * i + 1)) in pairs_ for i in range(60)] == [True] * 60
    if footers:
        last = [len(t.split()) - 30 for t in texts]
        classes = {r.class_id for r in found if r.start_a <= last[r.doc_id] < r.end_a}
        members = {d for r in found if r.class_id in classes for d in (r.doc_id, r.other_id)}
        assert len(classes) == 1 and members == set(range(120))


def test_passage_classes(spark, written):
    rng = random.Random(15)
    shared, rare = words(rng, 70), words(rng, 60)
    texts = [words(rng, 40) + " " + shared + " " + words(rng, 40) for _ in range(40)] + [words(rng, 50) + " " + rare for _ in range(3)]
    found = passages.near_duplicate_passages(written(frame(spark, texts), 4)).collect()
    members = defaultdict(set)
    for r in found:
        members[r.class_id] |= {r.doc_id, r.other_id}
    assert sorted(map(len, members.values())) == [3, 40] and set(range(40)) in members.values()


# ---------------------------------------------------------------- 3 exact dedup


@pytest.mark.parametrize("first, hot, groups", [(2, 1024, 1024), (128, 1024, 1024), (16, 3, 2), (128, 3, 1024), (128, 3, 1 << 20)])
def test_exact(messy, empty, repeated, monkeypatch, first, hot, groups):
    """Level widths; hot groups that are sent to all tasks, few of them, many, and too many bytes of them."""
    for name, value in (("FIRST_BYTES", first), ("HOT_ROWS", hot), ("HOT_GROUPS", groups)):
        monkeypatch.setattr(exact, name, value)
    texts = pairs(messy)
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    want = sorted(((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts), key=repr)
    assert rows(exact.exact_groups(messy), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact.exact_groups(empty).count() == 0
    kept = exact.exact_groups(repeated).where("kept").count()
    assert kept == len({t or "" for _, t in pairs(repeated)})
    left = exact.drop_exact_duplicates(repeated)
    assert left.columns == repeated.columns and Counter(t or "" for _, t in pairs(left)).most_common(1)[0][1] == 1 and left.count() == kept


# ---------------------------------------------------------------- 4 sharding


def test_feistel():
    for n in (0, 1, 2, 3, 7, 64, 1000, 4097):
        x = np.arange(n)
        p = sharding.permute(x, n, 5)
        assert sorted(p) == list(range(n)) and (sharding.permute(p, n, 5, back=True) == x).all()
        shard, slot = sharding.locate(x, n, 24)
        assert (sharding.row_at(shard, slot, n, 24) == x).all()
    big = (1 << 62) - np.arange(1, 5)
    assert (sharding.permute(sharding.permute(big, 1 << 62), 1 << 62, back=True) == big).all()


def test_shards(messy, empty, repeated, written):
    got = sharding.shard(messy, 24).collect()
    texts = dict(pairs(messy))
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shard(written(messy, 5), 24)
    assert rows(again, "doc_id", "shard", "slot") == sorted(((r.doc_id, r.shard, r.slot) for r in got), key=repr)
    where = {r.row_number: (r.shard, r.slot) for r in got}
    shard, slot = sharding.locate(np.arange(len(got)), len(got), 24)
    assert all(where[i] == (shard[i], slot[i]) for i in range(len(got)))
    assert sharding.shard(empty, 24).count() == 0 and sharding.shard(repeated, 24).count() == 44


# ---------------------------------------------------------------- 5 quality


def test_repetition(messy, empty, repeated):
    found = repetition.repetition_report(messy)
    assert found.columns == [*messy.columns, "repetition"]
    got = {r.doc_id: r.repetition for r in found.collect()}
    for i, t in pairs(messy):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.repetition(t or "")
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    kept = repetition.keep_unrepetitive(messy)
    assert kept.columns == messy.columns and 0 < kept.count() < messy.count()
    assert repetition.repetition_report(empty).count() == 0 and repetition.repetition_report(repeated).count() == 44


def test_repetition_verdict():
    rng = random.Random(21)
    texts = [t or "" for t in messy_texts() if len(t or "") < 20000]
    for _ in range(250):
        block, lines = words(rng, rng.randrange(3, 30), 300), []
        for _ in range(rng.randrange(1, 9)):
            lines.append(block if rng.random() < 0.3 else words(rng, rng.randrange(40), rng.choice((20, 4000))))
        texts.append(rng.choice(("\n", "\n\n", " \n", " ")).join(lines))
    found = repetition.measure(*common.text_buffers(pa.array(texts)))
    kept = [bool(k) for k in found["kept"]]
    for i, t in enumerate(texts):
        *shares, keep = brute.repetition_verdict(t, repetition.NGRAM_LIMITS, repetition.LINE_LIMIT, repetition.LINE_CHAR_LIMIT)
        assert np.allclose([found[c][i] for c in ("dup_ngram_chars", "dup_lines", "dup_line_chars")], shares) and kept[i] == keep
    assert 30 < sum(kept) < len(kept) - 30


def test_repetition_in_steps(messy):
    texts = [t for _, t in pairs(messy)]
    data, offsets = common.text_buffers(pa.array(texts))
    whole = repetition.measure(data, offsets)
    parts = [repetition.measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in common.steps(offsets, 3000)]
    for k, v in whole.items():
        assert np.allclose(np.concatenate([p[k] for p in parts]).astype(float), v.astype(float))


# ---------------------------------------------------------------- 6 suffix arrays


@pytest.mark.parametrize("group", [4096, 3])
def test_repeats(spark, written, empty, repeated, group):
    rng = random.Random(11)
    block = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = [t for t in messy_texts() if t is None or len(t) < 5000]
    for _ in range(14):
        a, n = rng.randrange(500), rng.randrange(150, 400)
        texts.append(words(rng, 20) + block[a : a + n] + words(rng, 15) + block[a + 20 : a + n // 2])
    texts += ["ab" * 400, "ab" * 350 + "x", "é" * 101, block, block[:199], block[1:]]
    df = written(frame(spark, texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, group=group).collect()}
    want = brute.repeats(texts, 200)
    assert {i: w for i, w in enumerate(want) if got[i] != w} == {}
    if group == 3:
        assert suffix.remove_repeats(empty).count() == 0
        again = suffix.remove_repeats(repeated, with_text=True).collect()
        assert len(again) == 44 and all(r.n_bytes - r.n_removed == len(r.kept) for r in again)


def test_hot_share_in_steps():
    """A full share of a hot anchor is hashed within bounded memory, and steps of any size find the same."""
    rng = random.Random(6)
    core = rng.randbytes(90)

    def share(n):
        kinds = [(core[:30] + rng.randbytes(150), core[30:] + rng.randbytes(140)) for _ in range(n - n // 4)]
        kinds += rng.sample(kinds, n // 4)  # some contexts twice
        left, right = zip(*kinds, strict=True)
        same = lambda x: pa.array([x] * n, pa.int64())
        return pa.table({"anchor": same(7), "rid": pa.array(range(n), pa.int64()), "at": same(1000), "left": left, "right": right, "claim": same(500), "n": same(n)})

    def found(batches):
        rows = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in suffix.HOT.names}
        runs = np.array([h is None or h != h for h in rows["h1"]])
        known = np.array([k is True for k in rows["known"]])
        return (
            set(zip(*(rows[c][runs].tolist() for c in ("rid", "lo", "hi")), strict=True)),
            sorted(zip(*(rows[c][~runs & ~known].tolist() for c in ("rid", "lo", "hi")), strict=True)),
            {t.as_py() for b in batches for t in b.filter(b.column("known").fill_null(False)).column("h1")},
        )

    table = share(600)
    assert found(list(suffix._cover_hot(table, 200, step=3000))) == found(list(suffix._cover_hot(table, 200, step=1 << 30)))

    table = share(suffix.GROUP)
    tracemalloc.start()
    strings = sum(b.num_rows for b in suffix._cover_hot(table, 200))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert strings > 4_000_000 and peak < 250e6, (strings, peak)


def dealt_anchors(texts, buckets, **limits):
    ids, batch = pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())
    return list(suffix._find_anchors(iter([pa.RecordBatch.from_arrays([ids, batch], ["rid", "text"])]), buckets, 200, **limits))


def test_anchors_are_dealt_evenly():
    """Neither the anchors' hashes, which are small ones, nor an anchor that most texts hold fill one bucket."""
    rng = random.Random(12)
    common_ = rng.randbytes(300)
    for texts in ([rng.randbytes(3000) for _ in range(300)], [rng.randbytes(150) + common_ + rng.randbytes(150) for _ in range(3000)]):
        held = np.zeros(32, np.int64)
        for b in dealt_anchors(texts, 16):
            for bucket, at in zip(b.column("bucket").to_pylist(), b.column("at").to_pylist(), strict=True):
                held[bucket] += len(at or b"") // 4
        assert held.sum() > 5000 and held.max() < 0.3 * held.sum(), held


def test_anchors_found_often_in_one_task_only():
    rng = random.Random(13)
    passage = rng.randbytes(300)
    batches = [b for n in (100, 10) for b in dealt_anchors([rng.randbytes(90) + passage + rng.randbytes(90) for _ in range(n)], 4, often=64)]
    found = pa.Table.from_batches(batches)
    groups = [suffix._share(found.filter(pa.array([x == i for x in found.column("bucket").to_pylist()])), 4) for i in set(found.column("bucket").to_pylist())]
    found = pa.concat_tables(groups).to_pylist()
    number = {r["anchor"]: r["n"] for r in found if r["rid"] is None and r["rids"] is None}
    packets = pa.Table.from_pylist([r | {"n": number[r["anchor"]]} if r["rids"] else r for r in found if r["rid"] is not None or r["rids"]], schema=groups[0].schema)
    rows = [tuple(r.values()) for b in suffix._unpacked(packets.to_batches()) for r in b.to_pylist()]
    held = Counter(anchor for _, _, anchor, _ in rows)
    assert number and all(held[a] == 110 for a in number)
    assert all(n == held[a] for _, _, a, n in rows)


def test_repeats_held_by_most_texts(spark, written):
    rng = random.Random(14)
    passage = words(rng, 60)
    texts = [words(rng, 12) + passage[: rng.choice((150, 230, 290))] + words(rng, 12) for _ in range(1800)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(written(frame(spark, texts), parts=1), group=500).collect()}
    assert got == dict(enumerate(brute.repeats(texts, 200)))


def test_interval_tree():
    rng = random.Random(2)
    for _ in range(30):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(2, 30)))
        lcp = suffix.common_prefixes(strings, 12)
        prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp.tolist() == [0] + [prefix(a, b) for a, b in zip(strings, strings[1:], strict=False)]
        want = set()
        for i in range(len(strings)):
            for j in range(i + 1, len(strings)):
                n = int(lcp[i + 1 : j + 1].min())
                if n and (i == 0 or lcp[i] < n) and (j + 1 == len(strings) or lcp[j + 1] < n):
                    want.add((i, j, n))
        assert set(suffix.prefix_intervals(lcp)) == want


def test_repeat_groups(spark, written):
    rng = random.Random(4)
    block = "".join(rng.choice("abcdefgh ") for _ in range(260))
    df = written(frame(spark, [words(rng, 30) + f"{i}" + block + f"{i}" + words(rng, 9) for i in range(5)] + [words(rng, 50)]))
    texts = {r.rid: r.text.encode() for r in common.row_ids(df.drop("rid")).select("rid", "text").collect()}
    found = suffix.repeat_groups(df).collect()
    assert found
    for r in found:
        assert r.n == len(r.places) and len({texts[p.rid][p.at : p.at + r.length] for p in r.places}) == 1 and r.length >= 200
    assert max(r.n for r in found) == 5


# ---------------------------------------------------------------- 7 personal data

SAMPLES = [
    "mail a.b+c@x-y.example.com, b@c.d_x@y.z and a@b",
    "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 0001.2.3.04",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 12 34 5678901234567890123",
    "call +1 (555) 123-4567 now, +49 89 1234567890123456, +1-2",
    "é\U0001f600 x@y.zz ü 4111111111111111\n+44 20 7946 0958",
    "1" * 5000 + "@" * 50 + "a." * 3000 + "b@" + "c." * 3000 + "d",
    "",
    None,
    "nothing here",
]


def test_private(spark, written, empty, repeated):
    df = written(frame(spark, SAMPLES))
    got = {r.doc_id: r for r in private.private_spans(df).collect()}
    for i, t in enumerate(SAMPLES):
        want = brute.private(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[i]
        assert r.spans == text, t and t[:60]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in private.KINDS[:4]]
    clean = private.sanitise(df)
    assert clean.columns == df.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[3].startswith("call [PHONE] now") and texts[8] == SAMPLES[8] and texts[7] is None
    assert private.private_spans(empty).count() == 0 and private.private_spans(repeated).count() == 44


def test_disclosing_terms(spark, written):
    rng = random.Random(9)
    holders = [f"{words(rng, 15)} Zanzibar report {i} for ann@example.com {words(rng, 5)}" for i in range(6)]
    plain = [f"{words(rng, 15)} the report of {i}" for i in range(60)] + ["Zanzibar is an island"]
    copies = ["bob@example.com only here Quixotic"] * 9
    df = written(frame(spark, holders + plain + copies))
    got = {r.doc_id: r.spans for r in private.private_spans(df).collect()}
    for i, t in enumerate(holders):
        at = t.index("Zanzibar")
        assert f"term:{at}:{at + 8}" in got[i] and "report" not in [t[slice(*map(int, s.split(":")[1:]))] for s in got[i].split(",")]
    # texts without the entity stay as they are, and copies of one text are no evidence
    assert all("term" not in got[i] for i in range(6, len(got)))


def test_terms_of_groups(spark, written):
    """A term that goes with a host is found though each address stands once; a term of one text is found where texts are many."""
    rng = random.Random(10)
    holders = [f"{words(rng, 15)} Acmecorp desk of p{'abcdefgh'[i]}@acme.example {words(rng, 5)}" for i in range(8)]
    plain = [f"{words(rng, 9)} desk of {i}" for i in range(1200)]
    one = "Kowalczyk writes from kow@else.example, signed kow"
    df = written(frame(spark, [*holders, *plain, one, one]))
    got = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in private.private_spans(df).collect()}
    for i, t in enumerate(holders):
        assert [t[int(a) : int(b)] for k, a, b in got[i] if k == "term"] == ["Acmecorp"]
    assert all(not got[i] for i in range(8, 1208))
    for i in (1208, 1209):
        assert [one[int(a) : int(b)] for k, a, b in got[i] if k == "term"] == ["Kowalczyk", "writes", "from", "signed", "kow"]
    assert all(k == "email" for i in range(8) for k, *_ in {r.doc_id: [s.split(":") for s in r.spans.split(",")] for r in private.private_spans(df, discount=99.0).collect()}[i])


# ---------------------------------------------------------------- 8 Jaccard join


def near(spark, n=60):
    rng = random.Random(13)
    core = words(rng, 90).split()
    texts = []
    for _ in range(n):
        w = core[:]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    far = " ".join(w if i % 9 else f"q{i}" for i, w in enumerate(core))
    short = ["a b c d e f", "a b c d e f g", "A b c d e F", "a b c", "a B c", "a b c d", "a b c d e"] + [" ".join("abcdefghijklmnop"[: 9 + i % 4]) for i in range(9)]
    return texts + [far] * 2 + short


@pytest.mark.parametrize("most_small", [0, 64])
def test_jaccard(spark, written, messy, empty, repeated, monkeypatch, most_small):
    monkeypatch.setattr(jaccard, "MOST_SMALL", most_small)
    for df in [written(frame(spark, near(spark)), 4), messy] + [repeated] * (most_small > 0):
        texts = pairs(df)
        want = Counter((i, *c) for (i, _), c in zip(texts, brute.components(texts), strict=True))
        got = Counter(tuple(r) for r in jaccard.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect())
        assert got == want
    if most_small:
        assert jaccard.near_duplicates(empty).count() == 0
        left = jaccard.drop_near_duplicates(messy)
        assert left.columns == messy.columns
        found = [c for (i, t), c in zip(pairs(messy), brute.components(pairs(messy)), strict=True)]
        assert left.count() == len({c for n, c in found if n}) + sum(n == 0 for n, _ in found)


def test_jaccard_hot_lists(spark, written):
    """Sublists of hot shingles, and a chain of open components."""
    df = written(frame(spark, near(spark, 150)), 6)
    texts = pairs(df)
    want = {i: c for (i, _), c in zip(texts, brute.components(texts), strict=True)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, sublist=20).collect()} == want


def test_near_duplicates_of_null_and_repeated_ids(spark, written):
    """Unlike texts stay though their ids are null or equal; of linked ones, one stays."""
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows_ = [(None, one), (None, two), (None, two + " c"), (7, " ".join(f"d{i}" for i in range(30))), (7, " ".join(f"e{i}" for i in range(30))), (None, None), (None, "")]
    kept = jaccard.drop_near_duplicates(written(spark.createDataFrame(rows_, "doc_id long, text string"), 2)).collect()
    assert len(kept) == 6 and sum((r.text or "").startswith("b0") for r in kept) == 1


def test_jaccard_isolated_pairs_of_hot_passages(spark, written):
    """Two documents each of any four of nine blocks, in other orders: pairs that nothing but hot shingles links, and no chain."""
    rng = random.Random(31)
    blocks = [words(rng, 60) for _ in range(9)]
    texts = []
    for chosen in itertools.combinations(range(9), 4):
        for order in (chosen, chosen[::-1]):
            texts.append(" ".join(blocks[k] for k in order))
    rng.shuffle(texts)
    df = written(frame(spark, texts), 4)
    want = {i: c for (i, _), c in zip(pairs(df), brute.components(pairs(df)), strict=True)}
    assert Counter(c for _, c in want.values()).most_common(1)[0][1] == 2 and len(set(want.values())) == len(texts) // 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, sublist=8).collect()} == want


def test_boundary():
    assert jaccard.boundary({5: 1000, 40: 1000}, 50.0) >= 5 and jaccard.boundary({}, 1.0) == 0


# ---------------------------------------------------------------- 9 packing


def test_word_encoder():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(queries.vocabulary()), packing.WordEncoder(queries.vocabulary())
    texts = [*messy_texts()[:60], "Hello,world! it's <|endoftext|>, I'll... x y\x85z don't's. 'S A's, É, ﬁ 12.5, x\x1cy ΑΣ ΣΑΣ. İ a?! b?!?!", "A.,;:"]
    for batch in (texts, texts[::-1]):
        data, offsets = common.text_buffers(pa.array(batch))
        ids, cut = own.encode(data, offsets)
        for i, t in enumerate(batch):
            assert ids[cut[i] : cut[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_fullest():
    rng = random.Random(6)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 60) for _ in range(rng.randrange(9)))
        room = rng.randrange(1, 120)
        sums = {0}
        for x, n in counts.items():
            sums |= {s + x * k for s in sums for k in range(1, n + 1)}
        picked = packing.fullest(counts, room)
        assert all(n <= counts[x] for x, n in picked) and sum(x * n for x, n in picked) == max(s for s in sums if s <= room)


def test_pack(messy, empty, repeated):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.vocabulary())
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in pairs(messy)}
    found = packing.pack(messy, queries.vocabulary(), end_id=2, capacity=512, pool=16).collect()
    own, windows = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.ids == want[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        own[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for start, n in sorted(own[i]):
            assert start == at
            at += n
        assert at == len(ids)
    fills = []
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
        fills.append(at)
    assert sum(fills) / len(fills) > 0.9 * 512
    assert packing.pack(empty, queries.vocabulary(), 2).count() == 0 and packing.pack(repeated, queries.vocabulary(), 2).count() >= 44


# ---------------------------------------------------------------- 10 mixing


def filled(sizes, weights=(5, 2, 1), copies=3):
    """Targets by filling up in rounds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > copies * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(copies * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("block", [7, 256])
def test_mix(messy, empty, repeated, block):
    for df in (messy, repeated):
        got = mixing.mix(df, block=block).collect()
        size = Counter()
        for r in got:
            size[r.source] += r["size"]
        want = filled(size)
        assert len(got) == df.count()
        taken = Counter()
        for r in got:
            assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
            taken[r.source] += r.taken
        for s, t in want.items():
            assert abs(taken[s] - t) <= max(3 * block, 1), (s, taken[s], t)
        texts = Counter((i, len(brute.WORD.findall(t or ""))) for i, t in pairs(df))
        assert texts == Counter((r.doc_id, r["size"]) for r in got)
    assert rows(mixing.mix(messy, block=block), "doc_id", "taken") == rows(mixing.mix(messy, block=block), "doc_id", "taken")
    assert mixing.mix(empty).count() == 0


def test_mix_of_many_small_sources(spark, written):
    """Sources of less than a block reach their targets beside a large one."""
    rng = random.Random(43)
    sources = [(f"s{k:03}", words(rng, rng.randrange(1, 100))) for k in range(200)] + [("t", words(rng, 300)) for _ in range(60)] + [(None, "a b c")]
    df = written(spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(sources)], "doc_id long, text string, source string"), 2)
    target, taken = {}, Counter()
    for r in mixing.mix(df).collect():
        target[r.source] = r.target
        taken[r.source] += r.taken
    assert len(target) == 202 and all(abs(taken[s] - t) <= 1 for s, t in target.items())
    slots = mixing.schedule(mixing.targets(df.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("source_size"))), 28000).collect()
    places = defaultdict(list)
    for r in slots:
        places[r.source].append(r.place)
    assert len({r.slot for r in slots}) == len(slots) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r.source: r.need for r in slots} == {s: len(p) for s, p in places.items()}


def test_apply_mix(messy, empty):
    taken = {r.doc_id: r.taken for r in mixing.mix(messy).collect()}
    mixed = mixing.apply_mix(messy)
    assert mixed.columns == messy.columns and mixing.apply_mix(empty).count() == 0
    got, texts = Counter(), dict(pairs(messy))
    for r in mixed.collect():
        w = brute.WORD.findall(r.text)
        assert w == brute.WORD.findall(texts[r.doc_id])[: len(w)] and r.n_chars == len(r.text)
        got[r.doc_id] += len(w)
    assert got == Counter({i: t for i, t in taken.items() if t})


def test_targets_reshare(spark):
    sizes = {"a": 1, "b": 1000, "c": 10, "d": 5, None: 400}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert all(abs(got[s] - t) < 1e-9 * max(t, 1) for s, t in filled(sizes).items())


def test_n_words(spark):
    texts = messy_texts() + ["a", " a", "a ", "a\x1cb c", "\x0b\x0c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r.n for r in df.select("i", mixing.n_words(F.col("text")).alias("n")).orderBy("i").collect()] == [len(brute.WORD.findall(t or "")) for t in texts]


def test_private_sql(spark, tmp_path):
    """The registered SQL against the query, with terms that reveal entities."""
    import duckdb

    rng = random.Random(9)
    texts = [f"{words(rng, 15)} Zanzibar Éclair {i} for ann@example.com {words(rng, 5)} zanzibar" for i in range(6)]
    texts += [f"{words(rng, 15)} the report of {i}" for i in range(30)] + ["Zanzibar is an island", "+49 89 1234567 ann@example.com"] + [t for t in SAMPLES if t is None or len(t) < 5000]
    frame(spark, texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op7_disclosing_terms"](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = connection.execute(queries.ORACLE["op7_disclosing_terms"])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want and any("term:" in r[-1] for r in want)
