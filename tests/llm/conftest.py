import random

import pytest

#: A schema with more columns, some named as the operators' own.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, size long, n long, kept boolean, found string"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def messy_texts():
    """Copies, near copies, shared passages, junk, empty, wordless and null texts, a long one."""
    rng = random.Random(7)
    base = [words(rng, rng.choice((1, 3, 5, 8, 30, 120, 400))) for _ in range(40)]
    passage = words(rng, 70)
    texts = base + base[:6] + base[3:5] * 12
    for t in base[20:34]:
        w = t.split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [words(rng, 60) + " " + passage + "\n" + words(rng, 40) for _ in range(24)]
    texts += [None, None, "", "", " \n\t ", "x", "X", "é" * 500, "a " * 300, "line one\n" * 40, words(rng, 30000), "  nbsp word"]
    rng.shuffle(texts)
    return texts


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t), 5, 6, 7, False, "z") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def written(spark, tmp_path_factory):
    """Writes a frame as a table in several files and reads it again, as operators ask for a plain scan."""

    def put(df, parts=3):
        path = str(tmp_path_factory.mktemp("table") / "t")
        df.repartition(parts).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return put


@pytest.fixture(scope="session")
def messy(spark, written):
    return written(frame(spark, messy_texts()))


@pytest.fixture(scope="session")
def empty(spark, written):
    return written(frame(spark, []))


@pytest.fixture(scope="session")
def repeated(spark, written):
    """Whole rows twice, null ids, one id for different texts."""
    texts = messy_texts()[:20]
    return written(frame(spark, texts + texts + ["same id", "same id too", "null id", None], [*range(20), *range(20), 7, 7, None, None]))
