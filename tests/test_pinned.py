"""Cases pinned by hand for text, captions, numbers, updates and segments."""

from pyspark.sql import functions as F

from cuesmith.functions import numbers as N
from cuesmith.functions import text as X
from cuesmith.operators import captions as C
from cuesmith.operators import lexicon as L
from cuesmith.operators import scores
from cuesmith.operators import segments as S
from cuesmith.operators import updates as U


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def apply(spark, f, values):
    return [r.o for r in texts(spark, values).select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_marks(spark):
    got = apply(spark, X.english_marks, ["你好，世界！“Rust”（2026）。", "我喜欢‘CLI’和“Rust”", "plain"])
    assert got == ['你好, 世界!"Rust"(2026).', "我喜欢 'CLI' 和 \"Rust\"", "plain"]
    assert apply(spark, X.strip_period, ["你好。", "hello.  ", "你好！", "", "a..", None]) == ["你好", "hello", "你好！", "", "a.", None]


def test_clauses(spark):
    assert apply(spark, X.split_clauses, ["你好, 我是测试。下一句来了。", "", " . ,", "no mark"]) == [["你好,", "我是测试。", "下一句来了。"], [], [".", ","], ["no mark"]]

    def restate(clause, limit):
        out, now = [], ""
        for c in clause:
            now += c
            if len(now) >= limit and (c.isspace() or c in X.SOFT_MARKS or len(now) >= limit + 8):
                out.append(now.strip())
                now = ""
        return [x for x in [*out, now.strip()] if x]

    long = ["abcdefg hijk lmnopqrstuvwxyz0123456789 ab", "a" * 50, "one two three four five six seven", "abcdefgh,ijk"]
    assert apply(spark, lambda t: X.split_long(F.array(t), 3), long) == [restate(t, 8) for t in long]


def test_rewrites(spark):
    def rules(*pairs, names=("from_text", "to_text")):
        return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, names, strict=True)]) for p in pairs])

    hot = rules(("chatgpt", "ChatGPT"), ("openai", "OpenAI"), ("gpt", "GPT"), names=("key", "word"))
    assert apply(spark, lambda t: X.normalise_hotwords(t, hot), ["使用 g p t 写代码", "chat g p t", "open ai", "xxgpt"]) == ["使用 GPT 写代码", "ChatGPT", "OpenAI", "xxgpt"]
    assert apply(spark, lambda t: X.rewrite(t, rules(("g p t", "ChatGPT"))), ["use g p t now", "agptb g p tx"]) == ["use ChatGPT now", "agptb g p tx"]
    assert apply(spark, lambda t: X.rewrite(t, rules(("cat", "dog$1\\"))), ["copycat cat."]) == ["copycat dog$1\\."]


def test_lexicon(spark):
    words = lambda *w: spark.createDataFrame([(x, i) for i, x in enumerate(w)], "word string, ord long")
    found = L.all_hotwords(("builtin", words("GPT", "OpenAI")), ("user", words("g p t", "gpt", "中文", "C++", "1")))
    assert sorted(r.word for r in found.collect()) == ["C++", "GPT", "OpenAI", "g p t"]
    assert {r.key: r.word for r in L.hotword_rules(found).collect()} == {"gpt": "GPT", "openai": "OpenAI", "c++": "C++"}
    user = spark.createDataFrame([("g p t", "ChatGPT")], "from_text string, to_text string")
    builtin = spark.createDataFrame([("g p t", "GPT"), ("k 8 s", "K8s"), (" ", "x")], "from_text string, to_text string")
    assert sorted((r.from_text, r.to_text, r.origin) for r in L.merge_rules(user, builtin).collect()) == [("g p t", "ChatGPT", "user"), ("k 8 s", "K8s", "builtin")]
    texts_ = spark.createDataFrame([(1, "use g p t, and Open AI"), (2, "nothing")], "id int, text string")
    assert sorted((r.id, r.key) for r in L.candidate_rules(texts_, L.hotword_rules(found)).collect()) == [(1, "gpt"), (1, "openai")]
    edges = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("a", "c", 0), ("b", "c", 0), ("c", "r", 0)], "src string, dst string, pos int")
    order = L.resolve_imports(edges, spark.createDataFrame([("r",)], "root string")).orderBy("visit_ord")
    assert [r.file for r in order.collect()] == ["c", "a", "b", "r"]


def test_numbers(spark):
    assert apply(spark, N.zh_cardinal, ["一百二十三", "一万零三十", "一亿零三万零五", "二零二六", "一千万", "三万", "abc", ""]) == ["123", "10,030", "100,030,005", "2026", "1,000万", "3万", "abc", ""]
    assert apply(spark, N.zh_time, ["三点一刻", "零点零五分", "三点", "三点整", "十二点半", "三点零", "点半"]) == ["3:15", "0:05", "3点", "3点", "12:30", "三点零", "点半"]
    split = lambda f: lambda t: f(F.split(t, " "))
    assert apply(spark, split(N.en_cardinal), ["one hundred and twenty three", "two million five", "and", "one cat"]) == [123, 2_000_005, None, None]
    assert apply(spark, split(N.en_ordinal), ["twenty second", "third", "two hundredth", "cat"]) == [22, 3, 200, None]
    assert apply(spark, split(N.en_year), ["nineteen hundred", "two thousand five"]) == [1900, 2005]
    assert apply(spark, split(N.en_digits), ["one oh two", "ten"]) == ["102", None]
    assert apply(spark, split(N.en_fraction), ["three quarter", "one half", "cat half"]) == ["3/4", "1/2", None]


def test_cues(spark):
    assert apply(spark, lambda t: X.clock(t.cast("long")), ["3723045", "0"]) == ["01:02:03,045", "00:00:00,000"]
    schema = "session_id string, seg_idx int, text string, raw_text string, tokens array<string>, token_timestamps array<float>, start_sample long, end_sample long, audio_start_sample long, audio_end_sample long"
    rows = [
        ("a", 0, "你好，世界。", "你好，世界。", list("你好世界"), [0.1, 0.3, 1.1, 1.3], 16000, 48000, 16000, 48000),
        ("b", 0, "你好，世界。", "你好，世界。", list("你好"), [0.1], 16000, 32000, 0, 48000),
        ("c", 0, "  ", "", [], None, 0, 1, 0, 1),
    ]
    got = C.caption(spark.createDataFrame(rows, schema), 24).orderBy("session_id", "cue_idx").collect()
    assert [(r.session_id, r.start_ms, r.end_ms, r.text) for r in got] == [("a", 1100, 2100, "你好，"), ("a", 2100, 2500, "世界"), ("b", 1000, 1500, "你好，"), ("b", 1500, 2000, "世界")]


def test_segments(spark):
    rows = spark.createDataFrame([("a", 0, 1000, 3000, 4000)], "session_id string, seg_idx int, start_sample int, end_sample int, total_samples int")
    r = S.pad_segments(rows, 200, 300).first()
    assert (r.audio_start_sample, r.audio_end_sample) == (800, 3300)
    r = S.pad_segments(spark.createDataFrame([("a", 0, 100, 3000, 3200)], rows.schema), 500, 2000).first()
    assert (r.audio_start_sample, r.audio_end_sample) == (0, 3200)
    p = S.Params.from_ms(180, 180, 650, 15000)
    assert (p.start_margin, p.end_margin, p.gap, p.longest) == (18, 18, 65, 1500)

    def run(flags, params, **more):
        state = S.Endpoint(params)
        return [e for i, f in enumerate(flags) if (e := state.feed(f, last=i == more.get("flush"))) and e[0] != "timeout"]

    assert run([False] * 200 + [True] * 600 + [False] * 400, S.Params(gap=300, ring=256)) == [("start", 214, 164, 194), ("end", 843, 573, 543)]
    assert [e[:2] for e in run([True] * 20, S.Params(), flush=19)] == [("start", 15), ("end", 19)]
    flags = [False] * 30 + [True] * 40 + [False] * 50
    frames = spark.createDataFrame([(s, i, f) for s in "xyz" for i, f in enumerate(flags)], "stream_id string, frame long, evidence boolean")
    got = S.endpoint(frames, S.Params(gap=20)).where("kind <> 'timeout'").orderBy("stream_id", "frame").collect()
    want = run(flags, S.Params(gap=20), flush=len(flags) - 1)
    assert [(r.stream_id, r.kind, r.frame, r.bound, r.real_bound) for r in got] == [(s, *e) for s in "xyz" for e in want]


def test_updates(spark):
    rows = [("a", 1, ["a"], 0.64), ("a", 2, ["a", "b"], 1.28), ("a", 3, ["a", "b", "c"], 1.92), ("b", 1, ["a", "b", "c"], 0.96), ("c", 1, ["a"], 0.64), ("c", 2, ["a", "b", "c"], 2.0)]
    got = U.token_times(spark.createDataFrame(rows, "session_id string, seq int, tokens array<string>, audio_end_s double")).orderBy("session_id", "pos").collect()
    assert [round(r.ts, 2) for r in got] == [0, 0.64, 1.28, 0, 0.32, 0.64, 0, 0.64, 1.32]
    pieces = spark.createDataFrame([("a", i, t) for i, t in enumerate(["co", "@@d", "@@ex", "的", "a", "@@i"])] + [("b", 0, "@@edge")], "utt string, pos int, token string")
    assert [r.token for r in U.merge_pieces(pieces).orderBy("utt", "pos").collect()] == ["codex", "的", "ai", "edge"]
    segments = spark.createDataFrame([("s", 1, "second.", ["second", "."], [0.5, 1.0], 0.6, 2.0), ("s", 0, "first.", ["first."], None, 0.8, 0.0)], "session_id string, seg_idx int, text string, tokens array<string>, token_timestamps array<double>, confidence double, offset_s double")
    r = U.commit_sessions(segments).first()
    assert (r.text, round(r.confidence, 4), r.token_timestamps) == ("first.second.", 0.7, [0.0, 2.5, 3.0])
    assert apply(spark, U.last_mark, ["版本12.34完成后继续处理", "好，再来", "a.b, c", ""]) == ["", "好，", "a.b,", ""]


def test_stable_prefix(spark):
    def restate(history, committed):
        if len(history) < 5:
            return committed
        chars = lambda seqs: next((i for i, column in enumerate(zip(*seqs, strict=False)) if len(set(column)) > 1), min(map(len, seqs)))
        last = history[-5:]
        tokens = min(chars([t for t, _ in last]), max(len(last[-1][0]) - 8, 0))
        n = min(len("".join(last[-1][0][:tokens])), chars([x for _, x in last]))
        import re

        found = re.match(r"[\s\S]*(?:[，。！？；]|(?<![A-Za-z0-9])[,.!?;]|[,.!?;](?![A-Za-z0-9]))", last[-1][1][:n])
        found = found.group() if found else ""
        return found if len(found) >= len(committed) else committed

    full = list("今天天气很好，我们去公园。然后回家吃饭，再看电影吧朋友们大家好")
    rows, want, history = [], [], []
    for i in range(12):
        tokens = full[: 8 + 2 * i]
        rows.append(("s", i, tokens, "".join(tokens), 2, False, 0, False))
        history.append((tokens, "".join(tokens)))
        want.append(restate(history, "".join(tokens)[:2]))
    df = spark.createDataFrame(rows, "session_id string, sequence int, tokens array<string>, text string, committed_prefix_chars int, revision boolean, revision_count int, final_result boolean")
    assert [r.stable for r in U.stable_prefix(df).orderBy("sequence").collect()] == want and any("。" in w for w in want)


def test_scores(spark):
    rows = spark.createDataFrame([("u", i, s) for i, s in enumerate([0.5, 0.9, 0.9, 0.1])], "utt string, id int, score double")
    assert [(r.id, r["rank"]) for r in scores.top_k(rows, 2, ["utt"]).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    schema = "utt string, step int, token int, acoustic double, prev double, path array<int>"
    done = spark.createDataFrame([("u", 1, 9, -0.5, [9], True)], "utt string, step int, token int, normalized double, path array<int>, terminal boolean")
    got = scores.rerank(spark.createDataFrame([("u", 2, 1, -0.2, -0.4, [1]), ("u", 2, 9, -2.0, -0.4, [1, 9])], schema), done, 2, 9, 10)
    assert [(r.path, r.terminal) for r in got.orderBy("rank").collect()] == [([1], False), ([9], True)]
    assert scores.best_path(got, final=True).first().path == [9] and scores.best_path(got, final=False).first().path == [1]


def test_words(spark):
    words = lambda *t: spark.createDataFrame([("u", i, x) for i, x in enumerate(t)], "utt string, pos int, text string")
    said = lambda df: "".join(r.text for r in df.orderBy("pos").collect())
    assert said(U.english_spacing(words("G", "P", "T"))) == " GPT"
    assert said(U.english_spacing(words("hello", "world", "5", "好", "abc"))) == " Hello world 5好abc"
    assert said(U.coalesce_per_mille(words("3.5", " ‰", "好", "‰"))) == "3.5‰好‰"
    df = spark.createDataFrame([("s", "", "x", 0.5, None), ("t", "r", "y", 0.5, None)], "id string, raw_text string, text string, confidence double, error string")
    assert [(r.success, r.text, r.confidence, r.error) for r in U.flag_results(df).orderBy("id").collect()] == [(False, "", 0.0, "empty result"), (True, "y", 0.5, None)]
    assert apply(spark, U.midnight_zero, ["0:05", "10:05", "x0:1"]) == ["00:05", "10:05", "x00:1"]


def test_session_lines(spark):
    results = spark.createDataFrame([("a", 1, "one"), ("a", 2, " "), ("a", 3, "two"), ("a", 9, "late")], "stream_id string, ts int, text string")
    captures = spark.createDataFrame([("a", 0, 0, 5)], "stream_id string, capture_idx int, start_ts int, end_ts int")
    assert [r.lines for r in U.session_lines(results, captures).orderBy("ts").collect()] == [["one"], ["one", "two"]]
