import json
import math
import random

import pytest
from pyspark.sql import functions as F

from modlake.functions import labels as L
from modlake.operators import collections as C
from modlake.operators import joins as J
from modlake.operators import mining as N
from modlake.operators import sampling as P
from modlake.operators import validation as V
from modlake.sources import manifests as R

CLIP = R.CLIP


def clip(i, source="s", labels=("scream",), conf="verified", split="train", start=0.0, dur=10.0, cid=None):
    return (cid or f"c{i}", "audio", source, start, dur, list(labels), conf, split, None, None, False)


def test_manifest_faults(spark, tmp_path):
    rows = [clip(0), clip(1, conf="guessed"), clip(2, split="holdout"), clip(3, labels=["not_a_class"]), clip(4, start=-1.0, dur=0.0), clip(5, cid="c0")]
    df = spark.createDataFrame(rows, CLIP).withColumn("n", F.monotonically_increasing_id())
    got = sorted(map(tuple, V.validate_manifest(df, ["scream"], "n").collect()))
    assert got == [("c0", "duplicate clip_id"), ("c1", "bad confidence: guessed"), ("c2", "bad split: holdout"), ("c3", "unknown label: not_a_class"), ("c4", "negative start"), ("c4", "non-positive duration")]
    R.write_clip_manifest(spark.createDataFrame(rows[:1], CLIP), str(tmp_path / "m"))
    assert R.load_clip_manifest(spark, str(tmp_path / "m"), ["scream"]).count() == 1
    with pytest.raises(ValueError, match="unknown label"):
        R.load_clip_manifest(spark, str(tmp_path / "m"), ["other"])


def test_bad_json_names_its_line(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"clip_id": "a", "extra": 1}\n\n{"clip_id": \n')
    with pytest.raises(ValueError, match=r"x\.jsonl:3"):
        R.read_clip_manifest(spark, str(p))


def test_segments_to_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_text('# one\n# two\n# three\nkiwi42, 30.000, 40.000, "/m/1,/m/2"\n-plum07, 0.000, 10.000, "/m/2"\nqqq, 5.000, 15.000, "/m/9"\nshort, 1.0\n')
    m = spark.createDataFrame([("scream", "/m/1"), ("bang", "/m/2")], "class string, mid string")
    df = R.build_manifest(spark, [str(tmp_path / "a.csv")], m, str(tmp_path / "out"), "web", "train")
    assert {r.clip_id: r.labels for r in df.collect()} == {"kiwi42_30": ["bang", "scream"], "-plum07_0": ["bang"]}
    assert R.read_clip_manifest(spark, str(tmp_path / "out")).count() == 2


def test_clip_key_like_g(spark):
    xs = [0.0, 30.0, 30.5, 0.25, 123.456, 1234.5678, 100000.0, 99.99]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(L.clip_key(F.lit("a"), "x")).collect()]
    assert got == [f"a_{x:g}" for x in xs]


def test_cap_against_a_loop(spark):
    random.seed(0)
    rows = [(i, random.sample("abcd", random.randint(1, 3))) for i in range(200)]
    for cap in (1, 5, 30):
        seen, want = dict.fromkeys("abcd", 0), []
        for i, ls in rows:
            if any(seen[c] < cap for c in ls):
                want.append(i)
                for c in ls:
                    seen[c] += 1
        got = sorted(r.i for r in C.cap_per_class(spark.createDataFrame(rows, "i int, labels array<string>"), cap, "i").collect())
        assert got == want


def test_splits(spark):
    rows = [(f"s{i // 5}", "wild" if i < 25 else "web") for i in range(500)]
    df = spark.createDataFrame(rows, "source_id string, source string")
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    a = C.assign_splits_greedy(df, ratios, 1, ["wild"])
    out = {r.source_id: r.split for r in a.collect()}
    assert len(out) == 100 and all(out[f"s{i}"] == "test" for i in range(5))
    n = {s: sum(v == s for v in out.values()) / 100 for s in ratios}
    assert all(abs(n[s] - r) <= 0.05 for s, r in ratios.items())
    assert out == {r.source_id: r.split for r in C.assign_splits_greedy(df.repartition(7), ratios, 1, ["wild"]).collect()}
    applied = C.apply_split(df, a)
    assert applied.count() == 500 and V.leaks(applied, "source_id").count() == 0
    with pytest.raises(Exception, match="no split for source"):
        C.apply_split(df, a.filter("source_id <> 's7'")).collect()
    with pytest.raises(ValueError):
        V.assert_disjoint(spark.createDataFrame([("a", "train"), ("a", "test")], "source_id string, split string"), "source_id")
    h = df.withColumn("split", C.assign_splits_hash("source_id", ratios))
    assert V.leaks(h, "source_id").count() == 0
    for bad in ({"train": 0.5, "val": 0.5}, {"train": 0.7, "val": 0.2, "test": 0.2}):
        with pytest.raises(ValueError, match="ratios"):
            C.assign_splits_greedy(df, bad)
        with pytest.raises(ValueError, match="ratios"):
            C.assign_splits_hash("source_id", bad)


def test_clip_keys(spark):
    xs = [0.0, 30.0, 12.5, 1 / 3, 0.00012345678, 0.00009999996, 5e-7, 123456.7, 999999.5, 1234567.0, -2.25, 1e21]
    got = [r.k for r in spark.createDataFrame(list(enumerate(xs)), "i int, s double").orderBy("i").select(L.clip_key(F.lit("v"), "s").alias("k")).collect()]
    assert got == [f"v_{x:g}" for x in xs]


def test_asr_manifest(spark):
    rows = [("a", "a.wav", "said", "heard", "general", "train", "s", None), ("b", "b.wav", None, "heard", "movie", "train", "s", None), ("c", "c.wav", "x", None, "no_speech", "train", "s", None), ("d", None, None, None, "song", "val", "t", None), ("d", "d.wav", "", None, "no_speech", "val", "t", None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], R.ASR + ", n int")
    got = {r.n: r for r in V.validate_asr_manifest(df, "n").collect()}
    assert (got[0].transcript, got[0].transcript_source) == ("said", "human") and (got[1].transcript, got[1].transcript_source) == ("heard", "teacher")
    assert got[2].error == "no_speech must be empty" and got[3].error == "missing keys" and got[4].error is None


def test_balanced_batches(spark):
    for n_harm, n_rest, size in ((10, 57, 8), (3, 40, 8), (0, 20, 6), (25, 25, 7)):
        rows = [(i, i < n_harm) for i in range(n_harm + n_rest)]
        df = spark.createDataFrame(rows, "id int, harm boolean")
        got = {}
        for r in P.balanced_batches(df, "id", "harm", size, seed=2).collect():
            got.setdefault(r.batch, []).append((r.id, r.harm))
        q = {True: size // 2, False: size - size // 2} if n_harm else {False: size}
        assert len(got) == max(1, max(math.ceil({True: n_harm, False: n_rest}[k] / v) for k, v in q.items()))
        for rows_of in got.values():
            for kind, quota in q.items():
                ids = [i for i, h in rows_of if h == kind]
                pool = {True: n_harm, False: n_rest}[kind]
                assert len(ids) == quota and (pool < quota or len(set(ids)) == quota)
        again = P.balanced_batches(df.repartition(3), "id", "harm", size, seed=2)
        assert sorted((r.batch, r.id) for r in again.collect()) == sorted((b, i) for b, x in got.items() for i, _ in x)


def test_weighted_samples(spark):
    df = spark.createDataFrame([(i, float(1 + i % 3)) for i in range(300)], "id int, weight double")
    n = P.weighted_sample(df, 3000, "id", seed=1).count()
    assert abs(n - 3000) < 300
    heavy = spark.createDataFrame([(1, 1e6), (2, 1.0), (3, None), (4, 0.0)], "id int, weight double")
    drawn = P.weighted_sample(heavy, 3_000_000, "id", seed=2).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("draw").alias("d")).collect()
    assert {r.id for r in drawn} <= {1, 2} and all(r.n == r.d for r in drawn) and abs(max(r.n for r in drawn) - 3_000_000) < 9_000
    exact = P.exact_weighted_sample(df, 500, "id", seed=1)
    assert exact.count() == 500 and exact.select("draw").distinct().count() == 500


def test_labels_and_weights(spark):
    df = spark.createDataFrame([(["a"],), (["b", "a"],)], "l array<string>")
    assert [r[0] for r in df.select(L.multi_hot("l", ["a", "b", "c"])).collect()] == [[1, 0, 0], [1, 1, 0]]
    with pytest.raises(Exception, match="unknown labels"):
        df.select(L.multi_hot("l", ["a"])).collect()
    a = {r["class"]: r.alpha for r in P.class_alpha(df.withColumnRenamed("l", "labels"), ["a", "b", "c"]).collect()}
    assert a == {"a": 0.25, "b": 0.75, "c": 0.5}
    with pytest.raises(ValueError, match="no rows"):
        P.domain_weights(spark.createDataFrame([("x",)], "domain string"), {"x": 1.0, "y": 1.0})


def test_candidates_and_review(spark):
    rows = [(f"c{i}", i, [p, 0.1, 0.99]) for i, p in enumerate([0.9, 0.5, 0.2, 0.65])]
    q = N.select_candidates(spark.createDataFrame(rows, "clip_id string, pos int, probs array<double>"), ["a", "b"], 10, "pos").orderBy("rank")
    assert [r.clip_id for r in q.collect()] == ["c0", "c3", "c1"]
    dec = spark.createDataFrame([("c0", "skip", None, 1), ("c3", "confirm_fp", "talk", 2), ("c9", "dance", None, 3)], R.DECISION)
    assert [r.clip_id for r in N.pending(q, dec).collect()] == ["c1", "c0"]
    assert tuple(N.progress(q, dec).first()) == (1, 3)
    classes = spark.createDataFrame([("talk", False), ("bang", True)], "class string, is_harm boolean")
    assert N.check_decisions(dec, q, classes).collect()[0].problem == "unknown clip"
    h = lambda *f: N.should_stop(spark.createDataFrame(list(enumerate(f, 1)), "iteration int, fpr double")).first().stop
    assert (h(0.2, 0.1), h(0.2, 0.199), h(0.5, 0.4, 0.3, 0.2, 0.1), h(0.2)) == (False, True, True, False)


def test_verdicts(spark):
    texts = ['Well: {"degree": 70, "category": " Threat", "reason": "x", "confident": "yes"} done', '{"degree": 900}', '{"degree": -5}', '{"degree": "55"}', '{"degree": 62.6, "reason": "", "confident": false}', "no json", '{"degree": true, "category": 3}', "", None]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(L.verdict_normalize("t", ["threat"]).alias("v")).collect()]
    assert [v.degree_percent for v in got] == [70, None, None, None, 63, None, 1, None, None] and [v.category for v in got] == ["threat"] + [None] * 8
    assert got[5].raw == "no json" and got[3].raw == texts[3] and got[0].raw is None and got[7].raw is None
    assert (got[0].reason, got[0].confident, got[4].reason, got[4].confident) == ("x", None, None, False)


def test_alignment_and_plan(spark):
    lines = spark.createDataFrame([("s", 0, "가 나"), ("s", 1, "다")], "k string, line int, text string")
    times = spark.createDataFrame([("s", i, float(i), i + 0.5, 2.6) for i in range(3)], "k string, i int, start double, end double, d double")
    assert sorted((r.line, r.start, r.end) for r in C.align_lines_to_times(lines, times, "k", "d").collect()) == [(0, 0.0, 1.75), (1, 1.75, 2.6)]
    with pytest.raises(ValueError):
        C.align_lines_to_times(lines, times.filter("i < 2"), "k", "d")
    fg, bg = spark.createDataFrame([(i,) for i in range(4)], "f int"), spark.createDataFrame([("x",), ("y",)], "b string")
    assert sorted(map(tuple, C.mix_plan(fg, bg, "f", "b").collect())) == [(0, "x", 0.0), (1, "y", 5.0), (2, "x", 10.0), (3, "y", 0.0)]


def test_label_similarity_keeps_all_links(spark):
    random.seed(4)
    rows = [(i, random.sample("abcdef", random.randint(0, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, labels array<string>")
    rep = {r.id: r.rep for r in J.label_classes(df, "id", "labels").collect()}
    pairs = {(r.a, r.b) for r in J.label_similarity(df, "id", "labels", 0.5).collect()}
    for i, x in rows:
        for j, y in rows:
            if i < j and x and y:
                like = len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5
                a, b = sorted((rep[i], rep[j]))
                assert like == (a == b or (a, b) in pairs)


def test_tables_reject_bad_configuration(spark):
    with pytest.raises(ValueError):
        R.taxonomy_table(spark, {"x": ["a"]}, ["a"])
    with pytest.raises(ValueError):
        R.policy_table(spark, "v", 0.8, 0.4, {})
    with pytest.raises(ValueError):
        R.threshold_table(spark, 1.5, 0, 0)
    assert json.loads(R.config_text({"a": 1})) == {"a": 1}


def test_segments_of_a_frequent_mid_are_not_gathered(spark):
    segments = spark.range(1000).selectExpr("id AS pos", "array('m', concat('r', id % 3)) AS mids")
    label_map = spark.createDataFrame([("a", "m"), ("b", "r1"), ("a", "r1"), ("c", "zz")], "class string, mid string")
    got = C.map_segments(segments, label_map, "pos")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert {r.pos: r.labels for r in got.collect()} == {i: ["a", "b"] if i % 3 == 1 else ["a"] for i in range(1000)}
