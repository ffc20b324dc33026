import re

import duckdb
import pytest

from cuesmith.operators import lexicon as L
from cuesmith.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation part orders events documents embeddings benchmark conversations".split()
NAMES = (
    "padded_segments path_tokens mark_words frame_evidence rerank_paths best_paths preferred_file missing_files result_flags stream_order numeric_features "
    "per_mille token_times stable_prefix session_report active_partials rule_order merged_rules resample chunk_totals"
).split()


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    found = catalog.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def _brute(text, keys):
    hits = set()
    for run in re.findall(r"[A-Za-z0-9]+(?:[ \t\n\f\r]+[A-Za-z0-9]+)*", text or ""):
        words = run.lower().split()
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + max(map(len, keys))) + 1):
                if (gram := "".join(words[i:j])) in keys:
                    hits.add(gram)
    return hits


def test_candidates_over_whole_texts(spark):
    """Runs of several words, words past the longest key, long texts without a mark, blank and null texts, repeated rows."""
    texts = [(1, "Neo Vim and n e o v i m, neovim."), (2, "a b" * 3000), (3, None), (4, ""), (5, "neo-vim x11 X 1 1"), (5, "neo-vim x11 X 1 1"), (6, "ab" * 40 + " ab"), (7, "word " * 20000 + "neo\nvim")]
    keys = ["neovim", "x11", "ab", "aba", "word", "wordneo"]
    rules = spark.createDataFrame([(k, k) for k in keys], "key string, word string")
    found = L.candidate_rules(spark.createDataFrame(texts, "id int, text string"), rules)
    assert sorted((r.id, r.key) for r in found.collect()) == sorted({(i, k) for i, t in texts for k in _brute(t if i != 7 else "word word neo\nvim", keys)})
    assert L.candidate_rules(spark.createDataFrame(texts, "id int, text string"), rules.limit(0)).count() == 0


def test_whole_turns(spark):
    """Snapshots of a turn end with all its words."""
    want = spark.read.parquet(f"{SF}/conversations.parquet").where("text is not null").selectExpr("sum(size(filter(split(text, ' '), w -> w <> '')))").first()[0]
    assert catalog.QUERIES["token_times"](spark, SF).count() == want
