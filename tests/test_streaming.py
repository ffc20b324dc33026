"""Streaming jobs against their batch twins on the same rows."""

import random

from pyspark.sql import functions as F

from cuesmith.operators import segments as S
from cuesmith.streaming import jobs


def stream(spark, df, path, parts):
    """A file stream that gives df's rows (ordered by a column n) in as many micro-batches as parts."""
    rows = df.orderBy("n").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).drop("n")


def drain(df, spark, name, tmp_path, mode="append"):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def test_endpoint(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for s in "ab":
        flags, on = [], False
        for _ in range(300):
            on = on ^ (rng.random() < 0.05)
            flags.append(on)
        rows += [(i, s, i, f, i == len(flags) - 1) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "n long, stream_id string, frame long, evidence boolean, last boolean")
    live = drain(jobs.endpoint_stream(stream(spark, df, str(tmp_path / "in"), 3), S.Params(gap=12)), spark, "live_endpoint", tmp_path)
    batch = S.endpoint(df, S.Params(gap=12))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect())) and batch.where("kind = 'end'").count() > 2


def test_captures(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("xy"), f"2025-01-01 00:{i // 60:02d}:{i % 60:02d}", i, rng.choice(["start", "end", "start"])) for i in range(120)]
    df = spark.createDataFrame(rows, "n long, stream_id string, ts string, seq long, action string").withColumn("ts", F.col("ts").cast("timestamp"))
    for mode in ("hold", "toggle"):
        live = drain(jobs.capture_stream(stream(spark, df, str(tmp_path / f"in_{mode}"), 3), mode), spark, f"live_{mode}", tmp_path / mode)
        batch = S.capture_sessions(df, mode).where("end_ts is not null")
        assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_sink_and_chunks(spark, tmp_path):
    rows = [(i, f"s{i % 2}", i // 2, True, f"t{i}", "r", 1.0, 0.1, 0.5, "2025-01-01 00:00:00") for i in range(6)]
    df = spark.createDataFrame(rows, "n long, session_id string, seg_idx long, success boolean, text string, raw_text string, duration double, inference_latency double, confidence double, event_time string").withColumn("event_time", F.col("event_time").cast("timestamp"))
    out = str(tmp_path / "set")
    q = jobs.sink_commits(stream(spark, df, str(tmp_path / "in"), 2), out, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and spark.read.json(f"{out}/*/*").count() == 6
    frames = spark.createDataFrame([("a", 0, [1, 2, 3]), ("a", 3, [4, 5])], "stream_id string, pos long, samples array<smallint>")
    assert [(r.chunk, r.samples) for r in jobs.chunk_stream(frames, 2).orderBy("chunk").collect()] == [(0, [1, 2]), (1, [3, 4]), (2, [5])]
    tasks = spark.createDataFrame([("w", i, t) for i, t in enumerate(["audio", "start", "audio", "start", "end", "end"])], "worker_id string, seq int, type string")
    assert [r.problem for r in S.check_stream_order(tasks).orderBy("seq").collect()] == ["audio without start", None, None, "started twice", None, "end without start"]


def test_idle(spark):
    events = spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:00:05"), ("a", "2025-01-01 00:01:00")], "stream_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = jobs.idle_sessions(events, 30).orderBy("idle_at").collect()
    assert [(str(r.idle_at), r.events) for r in got] == [("2025-01-01 00:00:35", 2), ("2025-01-01 00:01:30", 1)]
    assert jobs.idle_sessions(events, 0).count() == 0


def test_stable_prefix(spark, tmp_path):
    from cuesmith.operators import updates as U

    full = list("今天天气很好，我们去公园。然后回家吃饭，再看电影吧朋友们大家好")
    rows = []
    for s in ("x", "y"):
        for i in range(14):
            tokens = full[: 8 + 2 * i] if s == "x" or i != 6 else ["改", *full[1:20]]
            rows.append((i, s, i, tokens, "".join(tokens), 2, i == 13))
    df = spark.createDataFrame(rows, "n long, session_id string, sequence int, tokens array<string>, text string, committed_prefix_chars int, final_result boolean")
    marked = U.mark_revisions(df).drop("new_sequence")
    batch = U.stable_prefix(marked).select("session_id", "sequence", "stable", "unstable")
    live = drain(jobs.stable_prefix_stream(stream(spark, marked, str(tmp_path / "in"), 3)), spark, "live_stable", tmp_path)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_session_updates(spark, tmp_path):
    rows = [
        (0, "s", 0, "partial", "fir", ["fir"], 0.5), (1, "s", 1, "partial", "fir", ["fir"], 0.5), (2, "s", 2, "segment", "first.", ["first."], 0.8),
        (3, "s", 3, "partial", "", [], 0.1), (4, "s", 4, "partial", "sek", ["sek"], 0.5), (5, "s", 5, "segment", "second.", ["second", "."], 0.6),
        (6, "s", 6, "final", "", [], 0.0), (7, "s", 7, "partial", "late", ["late"], 0.0),
    ]
    df = spark.createDataFrame(rows, "n long, session_id string, seq long, kind string, text string, tokens array<string>, confidence double")
    live = drain(jobs.session_updates(stream(spark, df, str(tmp_path / "in"), 3)), spark, "live_updates", tmp_path)
    got = [(r.text, r.committed_prefix_chars, r.revision, round(r.confidence, 3), r.final_result) for r in live.orderBy("sequence").collect()]
    assert got == [("fir", 0, False, 0.5, False), ("first.", 6, False, 0.8, False), ("first.sek", 6, False, 0.8, False), ("first.second.", 13, True, 0.7, False), ("first.second.", 13, False, 0.7, True)]
