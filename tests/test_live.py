"""Streams with state and time: chunks, idle alarms, live captures, failed writes, raw blocks; import closures; the endpoint's margins."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from cuesmith.operators import lexicon as L
from cuesmith.operators import segments as S
from cuesmith.sources import readers, schemas
from cuesmith.sources.sinks import append_dataset
from cuesmith.streaming import jobs
from tests.test_streaming import drain, stream


def test_chunks_over_batches(spark, tmp_path):
    rng, rows, whole = random.Random(2), [], {}
    for i in range(30):
        s = rng.choice("ab")
        block = [rng.randrange(-9, 9) for _ in range(rng.choice((0, 1, 3, 5, 16)))]
        rows.append((i, s, len(whole.setdefault(s, [])), block, False))
        whole[s] += block
    rows.append((30, "a", len(whole["a"]), [7], True))
    whole["a"].append(7)
    df = spark.createDataFrame(rows, "n long, stream_id string, pos long, samples array<smallint>, last boolean")
    live = drain(jobs.chunk_stream(stream(spark, df, str(tmp_path / "in"), 4), 7), spark, "live_chunks", tmp_path)
    cut = lambda x: [x[i : i + 7] for i in range(0, len(x), 7)]
    want = {"a": cut(whole["a"]), "b": [c for c in cut(whole["b"]) if len(c) == 7]}  # b isn't ended: its rest isn't sent
    assert sorted(map(tuple, live.collect())) == sorted((s, i, c) for s in want for i, c in enumerate(want[s]))
    batch = jobs.chunk_stream(df, 7).collect()
    assert sorted(map(tuple, batch)) == sorted((s, i, c) for s in whole for i, c in enumerate(cut(whole[s])))


def test_idle_alarm_without_a_later_row(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([("a",), ("a",), ("b",)], "stream_id string").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("stream_id string").parquet(str(tmp_path / "in"))
    q = jobs.idle_alarms(events, 1).writeStream.format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    until = time.time() + 120
    while time.time() < until and q.exception() is None and spark.table("alarms").count() < 2:
        time.sleep(1)
    q.stop()
    assert sorted((r.stream_id, r.events) for r in spark.table("alarms").collect()) == [("a", 2), ("b", 1)]
    assert jobs.idle_alarms(spark.createDataFrame([("a",)], "stream_id string"), 0).count() == 0


def test_live_captures(spark, tmp_path):
    rng = random.Random(4)
    at = lambda s: f"2025-01-01 00:{s // 60:02d}:{s % 60:02d}"
    frames = [(i, rng.choice("xy"), at(i), i) for i in range(600)]
    captures = [(i, "xy"[i % 2], i // 2, at(s), at(s + n) if n else None) for i, (s, n) in enumerate([(10, 20), (15, 60), (100, 5), (200, 30), (250, 40), (400, 0)])]
    f = spark.createDataFrame(frames, "n long, stream_id string, ts string, frame long").withColumn("ts", F.col("ts").cast("timestamp"))
    c = spark.createDataFrame(captures, "n long, stream_id string, capture_idx long, start_ts string, end_ts string").withColumns({x: F.col(x).cast("timestamp") for x in ("start_ts", "end_ts")})
    live = jobs.frames_in_capture_stream(stream(spark, f, str(tmp_path / "f"), 5), stream(spark, c, str(tmp_path / "c"), 3), 2_000, longest_s=300, late_s=60)
    got = drain(live.select("stream_id", "frame", "capture_idx"), spark, "live_frames", tmp_path)
    want = S.frames_in_capture(f.drop("n"), c.drop("n"), 2_000).select("stream_id", "frame", "capture_idx")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def commits(spark):
    rows = [(i, f"s{i}", 0, True, f"t{i}", "r", 1.0, 0.1, 0.5, "2025-01-01 00:00:00") for i in range(6)]
    return spark.createDataFrame(rows, "n long, session_id string, seg_idx long, success boolean, text string, raw_text string, duration double, inference_latency double, confidence double, event_time string").withColumn("event_time", F.col("event_time").cast("timestamp"))


def test_failed_writes_are_tried_again(spark, tmp_path):
    out, side, tries = str(tmp_path / "set"), str(tmp_path / "failed"), []

    def put(df, path, mode):
        tries.append(path)
        if path.endswith("batch=0") and tries.count(path) == 1:
            append_dataset(df.limit(1), path, mode)  # a part is there already
            raise OSError("disk")
        append_dataset(df, path, mode)

    q = jobs.sink_commits(stream(spark, commits(spark), str(tmp_path / "in"), 3), out, str(tmp_path / "ck"), side, put).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and jobs.retry_commits(spark, out, side) == 0
    assert sorted(r.text for r in spark.read.json(f"{out}/*/*").collect()) == [f"t{i}" for i in range(6)]

    def never(df, path, mode):
        raise OSError("disk")

    q = jobs.sink_commits(stream(spark, commits(spark), str(tmp_path / "in2"), 2), f"{out}2", str(tmp_path / "ck2"), f"{side}2", never).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and spark.read.parquet(f"{side}2").count() == 6
    assert jobs.retry_commits(spark, f"{out}2", f"{side}2", never) == 2 and jobs.retry_commits(spark, f"{out}2", f"{side}2") == 0
    assert spark.read.json(f"{out}2/*/*").count() == 6


def test_raw_blocks(spark, tmp_path):
    f32 = lambda *x: struct.pack(f"<{len(x)}f", *x)
    rows = [
        ("f", 0, "f32", 1, f32(0.0, 1.0, -1.0, 2.0, -7.0, 0.5, float("nan"), float("inf"))),
        ("s", 0, "f32", 2, f32(0.5, 0.25, -1.0, -0.5, 0.75)),
        ("u", 0, "u16", 1, struct.pack("<4H", 0, 32_768, 65_535, 32_767)),
        ("v", 0, "u16", 2, struct.pack("<3H", 32_768, 32_771, 1)),
        ("i", 0, "i16", 3, struct.pack("<7h", -1, -1, 0, 32_767, 32_767, 32_767, -5) + b"x"),
        ("n", 0, "i16", None, None),
    ]
    want = {"f": [0, 32767, -32767, 32767, -32767, 16383, 0, 32767], "s": [12287, -24575, 24575], "u": [-32768, 0, 32767, -1], "v": [1, -32767], "i": [0, 32767, -5], "n": []}
    df = spark.createDataFrame([(s, p, None, k, c, 16_000, d) for s, p, k, c, d in rows], schemas.BLOCKS)
    assert {r.stream_id: r.samples for r in readers.frames_of_blocks(df).collect()} == want
    df.write.parquet(str(tmp_path / "in"))
    live = drain(readers.frames_of_blocks(readers.read_blocks(spark, str(tmp_path / "in"))), spark, "live_blocks", tmp_path)
    assert {r.stream_id: r.samples for r in live.collect()} == want
    with pytest.raises(Exception, match="no sample format"):
        readers.frames_of_blocks(df.withColumn("format", F.lit("i24"))).collect()


def slow_visits(edges, root):
    order, seen = [], set()

    def visit(file):
        seen.add(file)
        for _, child in sorted({(p, d) for s, d, p in edges if s == file}):
            if child not in seen:
                visit(child)
        order.append(file)

    visit(root)
    return order


def test_import_closure(spark):
    rng = random.Random(6)
    diamond = [(f"{a}{i}", f"{b}{i + 1}", k) for i in range(12) for a in "lr" for k, b in enumerate("lr")] + [("top", "l0", 0), ("top", "r0", 1)]
    loose = [(f"f{rng.randrange(14)}", f"f{rng.randrange(14)}", rng.randrange(3)) for _ in range(30)]
    edges = [*diamond, *loose, *loose[:4]]
    roots = ["top", "f0", "f3", "lonely", "f0"]
    got = {}
    for r in L.resolve_imports(spark.createDataFrame(edges, "src string, dst string, pos int"), spark.createDataFrame([(r,) for r in roots], "root string")).orderBy("root", "visit_ord").collect():
        got.setdefault(r.root, []).append((r.visit_ord, r.file))
    assert {k: [f for _, f in v] for k, v in got.items()} == {r: slow_visits(edges, r) for r in roots}
    assert all([o for o, _ in v] == list(range(len(v))) for v in got.values())


def slow_endpoint(flags, p):
    """Statuses and counters of every frame, with whole histories."""
    cum, runs, out = [], [], []
    start = maybe = margin = signalled = end = -1
    real = delay = segments = 0
    late = False
    at = lambda f: cum[max(f, 0)]
    for f, flag in enumerate(flags):
        cum.append((cum[-1] if cum else 0) + (flag and not (start >= 0 and f - start > p.longest)))
        runs.append(0 if flag else (runs[-1] if runs else 0) + 1)
        window = max(min(p.pre_end or 0, p.speech_end - 1), 0)
        early = p.pre_end is not None and window > p.gap and f > window and at(f) == at(f - window)
        if window < p.gap and signalled > 0 and start > 0 and f - signalled > max(p.pre_end_again, p.gap - window):
            signalled = -1
        event = None
        if start < 0:
            first = None
            if at(f) - at(f - 20) >= 15:
                first = f
            elif maybe < 0 or f - maybe > p.gap:
                maybe = -1
            elif at(f) - at(f - 1) == 1 and at(f) - at(maybe) >= 15:
                first = maybe + 20
            if first is not None:
                delay = p.start_margin + 21 if first - 20 > p.start_margin else first + 1
                start, maybe, signalled, late, segments = max(end, first - delay) + 1, -1, -1, False, segments + 1
                event = ("start", start, first - min(20, first))
            elif segments == 0 and f > p.response_timeout:
                delay, signalled, late, event = 0, -1, False, ("timeout", f, f)
            elif segments and p.delayed_end is not None and not late and f + 1 - real > p.delayed_end:
                delay, late, event = 0, True, ("delayed_end", f, f)
            elif segments and f + 1 - real > p.speech_end:
                delay, signalled, late, event = 0, -1, False, ("timeout", f, f)
            else:
                if maybe < 0 and at(f) - at(f - 7) >= 7:
                    maybe = f - 7
                if segments and early and signalled < 0:
                    signalled, event = f, ("pre_end", f, f)
            status = "none"
        elif early and signalled < 0:
            signalled, event, status = f, ("pre_end", f, f), "pre_end"
        elif f > p.gap and at(f) == at(f - p.gap):
            real = f - p.gap - runs[f - p.gap]
            end, start, margin, event = real + p.end_margin, -1, -1, ("end", real + p.end_margin, real)
        elif f == len(flags) - 1:
            end, real = (margin, margin - p.end_margin) if margin > 0 else (f, f)
            delay, start, margin, event = int(margin < 0), -1, -1, ("end", end, real)
        elif margin < 0:
            still = f > p.end_margin and at(f) == at(f - p.end_margin)
            margin, delay, status = (f, 0, "none") if still else (-1, 1, "speech")
        else:
            still = f > 1 and at(f) == at(f - 1)
            delay, margin, status = (0, margin, "none") if still else (f + 1 - margin, -1, "speech")
        out.append((event, event[0] if event else status, cum[-1], runs[-1], delay, margin))
    return out


def test_endpoint_traces():
    def events(flags, **params):
        state = S.Endpoint(S.Params(**params))
        return [e for i, f in enumerate(flags) if (e := state.feed(f, i == len(flags) - 1)) and e[0] != "timeout"]

    lead, talk = [False] * 20, [True] * 40
    assert events(lead + talk + [False] * 50)[-1] == ("end", 109, 89, 59)
    assert events(lead + talk + [False] * 20)[-1] == ("end", 79, 79, 79)
    assert events(lead + talk + [False] * 40 + talk + [False] * 35)[-1] == ("end", 174, 169, 139)
    rng = random.Random(12)
    kinds = set()
    for _ in range(150):
        flags, on = [], False
        for _ in range(rng.randrange(1, 400)):
            on ^= rng.random() < rng.choice((0.03, 0.1))
            flags.append(on)
        p = S.Params(rng.randrange(30), rng.randrange(1, 40), rng.randrange(1, 50), rng.choice((20, 6000)), rng.choice((25, 60, 800)), rng.choice((10, 60, 6000)), 0, rng.choice((None, 5, 40)), rng.choice((10, 100)), rng.choice((None, 15)))
        state = S.Endpoint(p)
        for i, want in enumerate(slow_endpoint(flags, p)):
            found = state.feed(flags[i], i == len(flags) - 1)
            assert (found and (found[0], *found[2:]), state.status, state.cum[-1], state.runs[-1], state.delay, state.margin) == want
            kinds.add(want[1])
    assert kinds == {"none", "speech", "start", "end", "timeout", "pre_end", "delayed_end"}


def test_settings(spark):
    for wrong in ({"gap": -1}, {"threshold": 1.5}, {"threshold": float("nan")}, {"energy_threshold": float("inf")}, {"pre_end": -1}):
        with pytest.raises(ValueError):
            S.Params(**wrong).check()
    rows = [(0, 30, 0.5, 0.0, None), (1, -1, 0.5, 0.0, None), (2, 30, 1.5, 0.0, None), (3, 30, float("nan"), 0.0, None), (4, 30, 0.5, float("-inf"), 5), (5, None, 0.5, 0.0, 5), (6, 0, 1.0, -3.0, -5)]
    df = S.check_params(spark.createDataFrame(rows, "id int, gap int, threshold double, energy_threshold double, pre_end int"))
    assert [r.problem for r in df.orderBy("id").collect()] == [None, "gap is negative or missing", "threshold isn't within 0 and 1", "threshold isn't finite", "energy_threshold isn't finite", "gap is negative or missing", "pre_end is negative"]
