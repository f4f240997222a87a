import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from modlake.core import global_rank
from modlake.operators import incidents as I
from modlake.operators import spans as S
from modlake.streaming import keyed


def windows(spark, scores, hop=2.0, key="s"):
    return spark.createDataFrame([(key, i * hop, s, s >= 0.6, ["acoustic"] if s >= 0.6 else []) for i, s in enumerate(scores)], "k string, t double, score double, esc boolean, reasons array<string>")


def rolled(df, gap):
    x = I.merge_incidents(df, "k", "t", "esc", gap).withColumn("text", F.lit(None).cast("double"))
    return sorted(I.incident_rollup(x, "k", "t", 10.0, "score", "text", "reasons").collect(), key=lambda r: r.start)


def test_incidents_known(spark):
    (a,) = rolled(windows(spark, [0.95] * 4), 6)
    assert (a.start, a.end, a.windows) == (0, 16, 4)
    assert len(rolled(windows(spark, [0.95, 0.01, 0.01, 0.01, 0.01, 0.95, 0.95]), 6)) == 2
    scores = [0.62, 0.7, 0.91, 0.66]
    (b,) = rolled(windows(spark, scores), 6)
    assert b.peak_score == max(scores) and b.reasons == ["acoustic"]


def loop_incidents(rows, gap):
    out, now, last = [], None, None
    for t, esc in rows:
        if now is not None and not esc and t - last >= gap:
            out.append(now)
            now = None
        if esc:
            now, last = (now or []) + [t], t
    return out + ([now] if now else [])


def test_incidents_against_a_loop(spark):
    random.seed(0)
    data, want = [], {}
    for k in range(60):
        ts = sorted({random.randint(0, 60) for _ in range(random.randint(1, 25))})
        rows = [(float(t), random.random() < 0.4) for t in ts]
        want[k] = loop_incidents(rows, 7)
        data += [(k, t, e) for t, e in rows]
    df = I.merge_incidents(spark.createDataFrame(data, "k int, t double, esc boolean"), "k", "t", "esc", 7)
    got = {}
    for r in df.filter("incident is not null").orderBy("k", "t").collect():
        got.setdefault(r.k, {}).setdefault(r.incident, []).append(r.t)
    assert all(list(got.get(k, {}).values()) == w for k, w in want.items())


def test_smoothing_and_escalation(spark):
    df = windows(spark, [0.0, 1.0])
    assert [round(r.smoothed, 6) for r in I.ema_risk(df.drop("reasons"), "k", ["t"], "score").orderBy("t").collect()] == [0, 0.3]
    lv = lambda xs: [(r.final_level, r.consecutive_warns) for r in I.warn_escalation(windows(spark, xs).withColumn("level", I.risk_level("score", 0.4, 0.8)), "k", ["t"], "level").orderBy("t").collect()]
    assert lv([0.5, 0.5, 0.5]) == [("warn", 1), ("warn", 2), ("block", 3)]
    assert lv([0.5, 0.5, 0.1, 0.5]) == [("warn", 1), ("warn", 2), ("safe", 0), ("warn", 1)]


def test_adaptive_windows(spark):
    grid = lambda risk: spark.createDataFrame([("s", i * 2.5, risk) for i in range(13)], "k string, t double, risk double")
    assert [r.t for r in I.adaptive_windows(grid(0.1), "k", "t", "risk", 0.4).orderBy("t").collect()] == [0, 5, 10, 15, 20, 25, 30]
    assert I.adaptive_windows(grid(0.5), "k", "t", "risk", 0.4).orderBy("t").collect()[1].t == 2.5


def test_spans(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 12), ("a", 20, 15), ("a", 30, 40), ("a", 35, 50), ("a", -5, 2), ("b", 1, 2)], "k string, start long, end long")
    assert sorted(map(tuple, S.merge_spans(df, "k").collect())) == [("a", 0, 12), ("a", 30, 50), ("b", 1, 2)]


def loop_spans(scores, thr, drop, silence, length):
    low, out, start, first = max(thr - drop, 0.01), [], None, None
    for p, s in scores:
        if s >= thr:
            first = None
            start = p if start is None else start
        elif start is not None and s < low:
            first = p if first is None else first
            if p - first >= silence:
                out.append((start, first))
                start = first = None
    return out + ([(start, length)] if start is not None else [])


def test_spans_from_scores_against_a_loop(spark):
    random.seed(5)
    data, want = [], {}
    for k in range(40):
        n = random.randint(1, 30)
        sc = [(i, random.choice([0.1, 0.3, 0.4, 0.6, 0.9])) for i in range(n)]
        data += [(k, p, s) for p, s in sc]
        merged = []
        for a, b in loop_spans(sc, 0.5, 0.15, 2, n):
            if b - a >= 2:
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
        want[k] = merged
    got = {}
    for r in S.spans_from_scores(spark.createDataFrame(data, "k int, p int, s double"), "k", "p", "s", None, 0.5, 0.15, 2, 2).orderBy("k", "start").collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    assert all(got.get(k, []) == w for k, w in want.items())


def loop_groups(spans, max_gap, cut, flush):
    """Pieces of each group, span by span, in whole units."""
    groups, now, before = [], [], None
    voiced = lambda: sum(z - a for a, z in now)
    for a, z in spans:
        if z <= a:
            continue
        if now and a - before > max_gap:
            groups.append(now)
            now = []
        at = a
        while at < z:
            take = min(z, at + cut - voiced())
            now.append((at, take))
            at = take
            if voiced() >= cut:
                groups.append(now)
                now = []
        if voiced() >= flush:
            groups.append(now)
            now = []
        before = z
    return groups + ([now] if now else [])


def test_group_spans_against_a_loop(spark):
    random.seed(8)
    data, want = [], {}
    for k in range(50):
        at, spans = 0, []
        for _ in range(random.randint(0, 12)):
            at += random.randint(0, 4)
            spans.append((at, at + random.randint(0, 9)))
            at = spans[-1][1]
        data += [(k, float(a), float(z)) for a, z in spans]
        want[k] = loop_groups(spans, 2, 5, 3)
    got = {}
    for r in S.group_spans(spark.createDataFrame(data, "k int, start double, end double"), "k", max_gap=2, cut=5, flush=3).orderBy("k", "group").collect():
        got.setdefault(r.k, []).append((r.start, r.end, r.voiced, r.spans))
    assert all(got.get(k, []) == [(g[0][0], g[-1][1], sum(z - a for a, z in g), len(g)) for g in w] for k, w in want.items())


def test_group_spans_leaves_out_what_is_no_span(spark):
    df = spark.createDataFrame([("a", 3.0, 3.0), ("a", None, 4.0), ("b", -1.0, 1.0)], "k string, start double, end double")
    assert [tuple(r) for r in S.group_spans(df, "k").collect()] == [("b", 0, 0.0, 1.0, 1.0, 1, False)]


def loop_language(ps):
    mode, streak, out = "unknown", 0, []
    for p in ps:
        if p >= 0.5:
            mode, streak = "own", 0
            out.append("accept")
        elif p > 0.15:
            streak = 0
            out.append("uncertain")
        else:
            streak += 1
            gone = streak >= (3 if mode == "own" else 2)
            mode = "other" if gone else mode
            out.append("suppress" if gone else "pending")
    return out


def test_language_policy(spark):
    random.seed(9)
    runs = {k: [random.choice([0.05, 0.1, 0.15, 0.31, 0.6, 0.9]) for _ in range(20)] for k in range(30)}
    runs[99] = [0.1, 0.1, 0.9, 0.1, 0.1, 0.1, 0.31]
    df = spark.createDataFrame([(k, i, p, 3.0) for k, ps in runs.items() for i, p in enumerate(ps)], "k int, i int, p double, v double")
    got = {}
    for r in I.language_policy(df, "k", ["i"], "p", "v").orderBy("k", "i").collect():
        got.setdefault(r.k, []).append(r.decision)
        assert r.selected == (r.decision != "suppress")
    assert got == {k: loop_language(ps) for k, ps in runs.items()}
    assert got[99] == ["pending", "suppress", "accept", "pending", "pending", "suppress", "uncertain"]
    short = spark.createDataFrame([("s", i, p, v) for i, (p, v) in enumerate([(0.1, 1.0), (0.1, 3.0), (None, 3.0), (0.1, None)])], "k string, i int, p double, v double")
    assert [r.decision for r in I.language_policy(short, "k", ["i"], "p", "v").orderBy("i").collect()] == ["uncertain", "pending", "uncertain", "uncertain"]


def test_engine_against_a_loop(spark):
    from modlake.streaming import engine

    random.seed(10)
    rows, want = [], {}
    for k in range(12):
        last, ema, open_, last_up, n = None, 0.0, False, None, 0
        for i in range(25):
            t, a, x, rms, speech = i * 2.0, random.random(), random.random(), random.choice([0.0, 1.0]), random.random() < 0.8
            said = random.choice(["", "no no no no no", "fine words here"])
            rows.append((k, t, a, x, said, rms, speech))
            heard = rms >= 0.01 and speech and (last is None or t - last >= 5)
            last = t if heard else last
            text = x if heard and said == "fine words here" else None
            ema = 0.6 * ema + 0.4 * max(a, text or 0.0)
            up = a >= 0.9 or (text is not None and text >= 0.7)
            if up:
                n += not open_
                open_, last_up = True, t
            elif open_ and t - last_up >= 6:
                open_ = False
            want[k, t] = (text, round(ema, 9), "alert" if up else "watch" if a >= 0.54 else "ok", n if up else None)
    df = spark.createDataFrame(rows, "k int, t double, acoustic double, text double, transcript string, rms double, speech boolean")
    x = engine.moderate(df, "k", ["t"], every=5.0, thresholds={"acoustic": 0.9, "text": 0.7})
    assert {(r.k, r.t): (r.text_used, round(r.risk, 9), r.level, r.incident) for r in x.collect()} == want
    assert engine.incidents(x, "k").count() == len({(k, v[3]) for (k, _), v in want.items() if v[3]})


def test_global_rank(spark):
    random.seed(6)
    xs = [(i, random.randint(0, 50)) for i in range(400)]
    got = global_rank(spark.createDataFrame(xs, "id int, v int"), "v", "id", sums={"upto": F.col("v")}).orderBy("rank").collect()
    want, total = sorted(xs, key=lambda x: (x[1], x[0])), 0
    for i, (r, w) in enumerate(zip(got, want, strict=True), 1):
        total += w[1]
        assert (r.rank, r.id, r.upto) == (i, w[0], total)


@pytest.mark.parametrize("cuts", [1, 3])
def test_batch_equals_stream(spark, tmp_path, cuts):
    random.seed(7)
    big = (1 << 53) + 1
    rows = [([big, big - 1, None][i % 3], float(i), random.random(), None if i % 4 else big + i) for i in range(60)]
    schema = "k long, t double, score double, big long"
    src = tmp_path / "in"
    for c in range(cuts):
        spark.createDataFrame(rows[c * 60 // cuts : (c + 1) * 60 // cuts], schema).coalesce(1).write.mode("append").parquet(str(src))
    batch = spark.createDataFrame(rows, schema)
    for i, (step, extra) in enumerate(((I.ema_step("score", 0.3), "smoothed double"), (I.duty_step("t", 7.0), "kept boolean"))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        out = keyed.stream_fold(stream, "k", ["t"], step, {}, extra)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / f"out{i}")).option("checkpointLocation", str(tmp_path / f"cp{i}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        from modlake.core import ordered_fold

        want = sorted(map(tuple, ordered_fold(batch, "k", ["t"], step, {}, extra).collect()), key=str)
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / f"out{i}")).collect()), key=str) == want


def test_stream_incidents(spark, tmp_path):
    rows = [("s", i * 2.0, s >= 0.6, s, ["acoustic"]) for i, s in enumerate([0.95, 0.01, 0.01, 0.01, 0.01, 0.95, 0.95, 0.0, 0.0, 0.0, 0.0])]
    schema = "k string, t double, escalate boolean, score double, reasons array<string>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = keyed.stream_incidents(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", 6.0)
    keyed.incident_sink(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted((r.start, r.end, r.windows) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert got == [(0, 10, 1), (10, 22, 2)]


def test_score_hook_fails_open(spark):
    def load():
        def model(f: pd.DataFrame) -> pd.DataFrame:
            if (f["x"] < 0).any():
                raise ValueError("negative")
            return pd.DataFrame({"p": f["x"] / 10})

        return model

    good = keyed.score_hook(spark.createDataFrame([(5,)], "x int"), load, "p double").first()
    bad = keyed.score_hook(spark.createDataFrame([(-1,)], "x int"), load, "p double").first()
    assert good.p == 0.5 and good.error is None and bad.p is None and "negative" in bad.error
