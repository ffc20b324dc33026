"""Periodic runs against brute force: the grammar's extensions, the runs, and the registered query."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cuesmith.llm import periodic, queries
from tests.llm import brute
from tests.llm.conftest import DOCS, frame, messy_texts, words


def slow_runs(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sequence(rng):
    if rng.random() < 0.3:
        return [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randrange(120))]
    out = []
    for _ in range(rng.randrange(1, 5)):
        block = [rng.randrange(rng.choice((2, 4, 50))) for _ in range(rng.randrange(1, 30))]
        out += (block * rng.randrange(1, 12))[: rng.randrange(1, 150)]
    return out


def joined(texts):
    return np.array([x for t in texts for x in t], np.int64), np.append(0, np.cumsum([len(t) for t in texts]))


@pytest.mark.parametrize("seed", range(8))
def test_runs_and_extensions(seed):
    rng = random.Random(seed)
    for _ in range(12):
        texts = [sequence(rng) for _ in range(rng.randrange(1, 12))]
        ids, cut = joined(texts)
        want = [(k, *r) for k, t in enumerate(texts) for r in slow_runs(t)]
        assert [tuple(r) for r in periodic.find_runs(ids, cut).tolist()] == want
        assert [tuple(r) for r in periodic.find_runs(ids, cut, least=8, times=4).tolist()] == [(k, *r) for k, t in enumerate(texts) for r in slow_runs(t, 8, 4)]
        line, _ = periodic._joined(ids, cut, np.arange(len(texts)))
        grammar = periodic.Grammar(line)
        ends = np.array([sorted(rng.sample(range(1, len(line)), 2)) for _ in range(40)] if len(line) > 3 else np.zeros((0, 2), int))
        for a, b, ahead, behind in zip(*ends.T, grammar.extend(*ends.T), grammar.extend(*ends.T, back=True), strict=True):
            n = next(n for n in range(len(line)) if b + n >= len(line) or line[a + n] != line[b + n])
            m = next(m for m in range(len(line)) if line[a - m - 1] != line[b - m - 1])
            assert (ahead, behind) == (n, m)


def test_grammar_is_small():
    rng = np.random.default_rng(1)
    for line in (np.zeros(50_000, np.int64), np.arange(50_000) % 37, rng.integers(0, 3, 50_000), rng.integers(0, 50_000, 50_000)):
        grammar = periodic.Grammar(np.concatenate([[-1], line, [-2]]))
        assert sum(len(x[1]) for x in grammar.levels) < 6 * len(line) and len(grammar.levels) < 60
        differ = np.flatnonzero(line[:-37] != line[37:])
        assert grammar.extend(np.array([1]), np.array([38])).tolist() == [differ[0] if len(differ) else len(line) - 37]


def expected(doc_id, text):
    w = brute.WORD.findall(text or "")
    found = queries.repeated_tail(doc_id, len(w))
    if found:
        a, p = found
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = slow_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def repetitive_texts():
    rng = random.Random(9)
    out = messy_texts()[:30] + ["na " * 3000, "a b c " * 9, "a b c " * 8 + "a", "x y " * 30, "ab\tab\n" * 50, None, "", " \n ", words(rng, 3000)]
    for _ in range(40):
        block = words(rng, rng.randrange(1, 40), 30)
        out.append(words(rng, rng.randrange(60)) + "\n " + " ".join([block] * rng.randrange(1, 9)) + "  " + words(rng, rng.randrange(60)))
    return out


def test_registered_query(spark, tmp_path):
    texts = repetitive_texts()
    ids = [*range(len(texts) - 6), None, None, 3, 3, 7, 7]
    frame(spark, texts, ids).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_recompression(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted((expected(i, t) for i, t in zip(ids, texts, strict=True)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and sum(r[1] > 0 for r in want) > 20
    h = zlib.crc32(b"7")
    assert any(queries.repeated_tail(i, 100) for i in range(60)) and (h % 10 == 0) == (queries.repeated_tail(7, 100) is not None)


def test_operator_keeps_columns(spark, written, empty):
    df = written(frame(spark, ["a b c d " * 10, None]).withColumnRenamed("found", "periodic"))
    got = periodic.periodic_runs(df)
    assert got.columns == [c for c in df.columns if c != "periodic"] + ["periodic"]
    rows = {r.doc_id: r for r in got.collect()}
    assert [tuple(x) for x in rows[0].periodic.runs] == [(0, 40, 4)] and rows[0].text == "a b c d " * 10 and rows[1].periodic.n_runs == 0
    assert periodic.periodic_runs(empty).count() == 0
    assert len(DOCS.split(",")) == len(df.columns)
