"""The pipeline's stages, each on what the one before it kept, against brute force."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from cuesmith.llm import common, repetition
from tests.llm import brute
from tests.llm.conftest import words
from tests.llm.test_operators import filled

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    base = [words(rng, rng.choice((10, 25, 60, 200))) for _ in range(50)]
    near = [" ".join(w if i % 40 else f"n{rng.randrange(10**6)}" for i, w in enumerate(t.split())) for t in base[30:40]]
    texts = base + base[:8] + base[5:7] * 5 + near + [words(rng, 30) + ("\nagain and again" * 30), None, "", "a " * 80]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages(spark, tables):
    path, rows = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact duplicates", "near duplicates", "mixing", "packing"]
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = common.save(out)
        kept.append([tuple(r) for r in docs.collect()])
    data, offsets = common.text_buffers(pa.array([r[1] for r in rows]))
    sound = [r for r, ok in zip(rows, repetition.measure(data, offsets)["kept"], strict=True) if ok]
    assert sorted(kept[0]) == sorted(sound) and 40 < len(sound) < len(rows)
    last = {r[1]: r for r in sorted(sound)}
    assert sorted(kept[1]) == sorted(last.values())
    found = brute.components([r[:2] for r in kept[1]])
    assert sorted(r[0] for r in kept[2]) == sorted({c for _, c in found}) and len(kept[2]) < len(kept[1])
    sizes, taken = Counter(), Counter()
    for r in kept[2]:
        sizes[r[3]] += len(brute.WORD.findall(r[1]))
    for r in kept[3]:
        taken[r[3]] += len(brute.WORD.findall(r[1]))
        assert r[4] == len(r[1])
    assert all(abs(taken[s] - t) <= 1 for s, t in filled(sizes).items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert sum(r.start == 0 for r in pieces) == len(kept[3]) and {r.doc_id for r in pieces} == {r[0] for r in kept[3]}


def test_registered(spark, tables):
    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert names["pipeline"](spark, tables[0]).count() > 30
