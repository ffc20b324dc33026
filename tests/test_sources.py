"""Readers, sinks and file reports on small files made here."""

import gzip
import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from cuesmith.functions import audio as A
from cuesmith.operators import files, labels
from cuesmith.sources import readers as R
from cuesmith.sources import sinks


def test_wav(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(R.wav_bytes([1, -2, 300, -32768], 8000, 2))
    floats = struct.pack("<4f", 0.5, -2.0, 1.0, 0.0)
    head = b"RIFF" + struct.pack("<I", 36 + len(floats)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 16000, 64000, 4, 32) + b"data" + struct.pack("<I", len(floats))
    (tmp_path / "f.wav").write_bytes(head + floats)
    wide = struct.pack("<2i", 5 << 16, -(7 << 16))
    head = b"RIFF" + struct.pack("<I", 36 + len(wide)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 64000, 4, 32) + b"data" + struct.pack("<I", len(wide))
    (tmp_path / "w.wav").write_bytes(head + wide)
    (tmp_path / "broken.wav").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in R.ingest_wav(spark, str(tmp_path)).collect()}
    assert (got["a.wav"].channels, got["a.wav"].rate, got["a.wav"].bits, got["a.wav"].samples) == (2, 8000, 16, [1, -2, 300, -32768])
    assert got["f.wav"].samples == [16383, -32767, 32767, 0] and got["w.wav"].samples == [5, -7]
    assert got["broken.wav"].error and got["broken.wav"].samples is None


def test_samples(spark):
    df = spark.createDataFrame([([1, 2, -3, -4, 5],), ([],)], "s array<smallint>")
    row = df.select(A.downmix(F.col("s"), 2).alias("m"), A.frame_level(F.col("s")).alias("l"), A.frames(F.col("s"), 2, 2).alias("f"), A.frame_energy(F.col("s")).alias("e")).collect()
    assert row[0].m == [1, -3, 5] and row[0].f == [[1, 2], [-3, -4]] and not row[0].e and row[1].m == [] and row[1].l == 0 and row[1].f == []
    loud = spark.createDataFrame([([-32768] * 160,), ([0] * 160,)], "s array<smallint>").select(A.frame_level(F.col("s")).alias("l"), A.frame_energy(F.col("s")).alias("e")).collect()
    assert [(r.l, r.e) for r in loud] == [(1.0, True), (0.0, False)]
    moved = spark.createDataFrame([([0, 10, 20, 30],)], "s array<smallint>")
    assert moved.select(A.resample(F.col("s"), 8000, 16000).alias("r")).first().r == [0, 5, 10, 15, 20, 25, 30, 30]
    scores = spark.createDataFrame([([0.1, 0.1],), ([0.1, 0.9],), ([0.6, 0.7],)], "s array<double>")
    assert [r.l for r in scores.select(A.pick_label(F.col("s")).alias("l")).collect()] == [0, 1, 0]


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "main.dict.yaml").write_text("name: x\nimport_tables:\n  - dicts/en\n  - custom/terms # comment\nother: y\n...\n# c\nGPT\t100\n\ngpt\nOpen AI\n中文\n")
    (tmp_path / "rules.txt").write_text("a:b\nb:c:d\n:x\nplain\n")
    with gzip.open(tmp_path / "protected.txt.gz", "wt") as f:
        f.write("ab\nabcd\n\nab\n")
    (tmp_path / "vocab.txt").write_text("<s>\nhello\nworld\n")
    (tmp_path / "empty.txt").write_text("")
    assert [r.word for r in R.read_lexicon(spark, str(tmp_path / "main.dict.yaml")).orderBy("ord").collect()] == ["GPT", "Open AI"]
    assert [(r.dst, r.pos) for r in R.lexicon_imports(spark, str(tmp_path / "main.dict.yaml")).orderBy("pos").collect()] == [("dicts/en.dict.yaml", 0), ("custom/terms.dict.yaml", 1)]
    assert [(r.source, r.target) for r in R.read_replacements(spark, str(tmp_path / "rules.txt")).orderBy("ord").collect()] == [("a", "b"), ("b", "c:d")]
    assert [r.phrase for r in R.read_protected(spark, str(tmp_path / "protected.txt.gz")).collect()] == ["abcd", "ab"]
    assert {r.token: r.token_id for r in R.read_vocab(spark, str(tmp_path / "vocab.txt")).collect()} == {"<s>": 0, "hello": 1, "world": 2}
    with pytest.raises(Exception, match="empty vocabulary"):
        R.read_vocab(spark, str(tmp_path / "empty.txt")).collect()


def test_manifest(spark, tmp_path):
    for name, data in (("asr/a.onnx", b"1"), ("asr/deep/b.onnx", b"2"), ("vad/c.bin", b"3")):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_bytes(data)
    sums = [f"{hashlib.sha256(b'0').hexdigest()}  asr/a.onnx", f"{hashlib.sha256(b'1').hexdigest().upper()} *asr/a.onnx", f"{'0' * 64} vad/c.bin"]
    (tmp_path / "sums").write_text("\n".join(sums))
    manifest = R.build_manifest(spark, str(tmp_path / "root"))
    got = {r.path: r.status for r in files.verify_manifest(manifest, R.read_checksums(spark, str(tmp_path / "sums"))).collect()}
    assert got == {"asr/a.onnx": "ok", "asr/deep/b.onnx": "no entry", "vad/c.bin": "mismatch"}
    required = spark.createDataFrame([("asr", "asr/a.onnx"), ("vad", "vad/c.bin"), ("vad", "vad/d.bin")], "kind string, path string")
    assert {r.kind: (r.state, r.missing) for r in files.readiness(required, manifest).collect()} == {"asr": ("ready", []), "vad": ("missing", ["vad/d.bin"])}
    assert [r.path for r in files.missing_files(required, manifest).collect()] == ["vad/d.bin"]
    assert files.pick_file(manifest, ["c.bin"]).first().path == "vad/c.bin" and files.pick_file(manifest, ["no"]).first().path == "asr/a.onnx"


def test_sinks(spark, tmp_path):
    row = ("s", True, "t", "r", ["t"], None, 1.0, 0.1, 0.9, None)
    from cuesmith.sources.schemas import TRANSCRIPTS

    df = spark.createDataFrame([row, ("u", False, "", "", [], None, 0.0, 0.0, 0.0, "bad")], TRANSCRIPTS)
    sinks.write_transcripts(df, str(tmp_path / "t"))
    assert '"token_timestamps":null' in "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))
    assert R.read_transcripts(spark, str(tmp_path / "t")).orderBy("session_id").collect() == df.orderBy("session_id").collect()
    segments = df.withColumn("seg_idx", F.lit(0)).withColumn("event_time", F.lit("2025-01-02 03:04:05").cast("timestamp"))
    sinks.append_dataset(segments, str(tmp_path / "d"))
    back = spark.read.json(str(tmp_path / "d"))
    assert back.count() == 1 and str(back.first().day) == "2025-01-02"
    sinks.write_srt(spark.createDataFrame([("a", "1\nx")], "session_id string, srt string"), str(tmp_path / "srt"))
    assert (tmp_path / "srt" / "session_id=a").exists()


def test_labels(spark):
    cases = [("一二分之三万", ["BA", "EA", "BC", "O", "SB", "E"]), ("abcd", ["BA", "MA", "MB", "O"]), ("ab", ["O", "BD"]), ("", [])]
    df = spark.createDataFrame([(list(t), n) for t, n in cases], "c array<string>, l array<string>")
    got = [[(s.start, s.end, s.category) for s in r.s] for r in df.select(labels.label_spans(F.col("c"), F.col("l")).alias("s")).collect()]
    assert got == [[(0, 2, "A"), (2, 4, "C"), (4, 5, "B"), (5, 6, "A")], [(0, 2, "A"), (2, 3, "B")], [(1, 2, "D")], []]
    text = spark.createDataFrame([("x二分之一y", ["A"] * 6)], "t string, l array<string>")
    assert text.select(labels.protect(F.col("t"), F.col("l"), F.array(F.lit("分之"))).alias("p")).first().p == ["A", "A", "O", "O", "A", "A"]
    words = spark.createDataFrame([("codex",), ("zz",), ("co",)], "word string")
    vocab = spark.createDataFrame([("co",), ("@@d",), ("@@dex",), ("c",), ("@@ex",)], "token string")
    assert {r.word: r.pieces for r in labels.word_pieces(words, vocab).collect()} == {"codex": ["co", "@@dex"], "zz": ["[UNK]"], "co": ["co"]}
    sizes = spark.createDataFrame([([200, 310, 1, 510, 5],)], "n array<int>")
    assert sizes.select(labels.pack_chunks(F.col("n")).alias("c")).first().c == [0, 0, 1, 2, 3]
    rules = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in (("a", "b"), ("b", "c"), ("d", "a"), ("cat", "dog"))])
    assert [r.t for r in spark.createDataFrame([("a",), ("copycat cat",)], "t string").select(labels.replace_words(F.col("t"), rules).alias("t")).collect()] == ["c", "copycat dog"]
