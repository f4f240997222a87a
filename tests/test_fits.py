"""Sweeps, Poisson weights and fits against loops; a whole run from segment lists to a report."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlake.operators import collections as C
from modlake.operators import metrics as M
from modlake.operators import signal as G
from modlake.operators import validation as V


def test_a_sweep_counts_each_row_once(spark):
    r = random.Random(1)
    cuts = [round(0.05 * k, 2) for k in range(40)] + [0.5, -1.0]
    rows = [(r.choice(["a", "b", None]), r.choice([0, 1, 1, None]), r.choice([None, float("nan"), 0.35, 0.5, r.random(), 5.0, -5.0])) for _ in range(400)] + [("c", 1, None), ("d", None, 0.3), ("e", 0, 0.2)]
    df = spark.createDataFrame(rows, "class string, y int, score double")
    got = {(x["class"], x.threshold): x for x in M.threshold_sweep(df, cuts, budget=0.3).collect()}
    kinds = {k for k, _, _ in rows}
    assert set(got) == {(k, t) for k in kinds for t in set(cuts)}
    for (k, t), x in got.items():
        own = [(y, s >= t or s != s) for q, y, s in rows if q == k and s is not None and y is not None]
        pos, neg = [h for y, h in own if y == 1], [h for y, h in own if y == 0]
        assert (x.tp, x.fp) == (sum(pos), sum(neg))
        assert x.recall == (pytest.approx(sum(pos) / len(pos)) if pos else None) and x.fpr == (pytest.approx(sum(neg) / len(neg)) if neg else None)
    for k in kinds:
        own = sorted((t, x) for (q, t), x in got.items() if q == k)
        within = [t for t, x in own if (x.fpr or 0.0) <= 0.3]
        assert [t for t, x in own if x.chosen] == [within[0] if within else min(own, key=lambda o: (abs(o[1].fpr - 0.3), o[0]))[0]]


def test_poisson_weights(spark):
    rows = [(n, i) for n in (1, 3, 30, 31, 400) for i in range(4000)]
    df = spark.createDataFrame(rows, "n long, i int")
    w = df.withColumn("w", M.poisson_weight(F.col("n"), F.when(F.col("n") <= M.EXACT, M.poisson_cdf(F.col("n"))), F.md5(F.concat_ws("|", "n", "i"))))
    for x in w.groupBy("n").agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.min("w").alias("low")).collect():
        assert abs(x.m - x.n) < 5 * (x.n / 4000) ** 0.5 and abs(x.v / x.n - 1) < 0.12 and x.low >= 0


def test_newton_finds_the_best_coefficients(spark):
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=500), rng.normal(size=500) * 3
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.8 * u - 0.5 * v + 0.3)))).astype(int)
    df = spark.createDataFrame([*zip(u.tolist(), v.tolist(), y.tolist(), strict=True), (None, 1.0, 1), (1.0, 1.0, None)], "weighted_max double, weighted_sum double, y int")
    m = M.fit_risk(df)
    p = 1 / (1 + np.exp(-(m["a"] * u + m["b"] * v + m["c"])))
    assert max(abs(((y - p) * x).sum()) for x in (u, v, np.ones(500))) < 1e-6 and abs(m["a"] - 0.8) < 0.5 and 0.7 < m["auroc"] < 1
    told = M.fit_risk(df.filter("weighted_max is not null").withColumn("y", (F.col("weighted_max") > 0).cast("int")))
    assert told["auroc"] > 0.99 and all(np.isfinite(told[c]) for c in "abc")
    assert M.fit_risk(df.limit(0)) == dict.fromkeys(("a", "b", "c", "auroc"))
    assert M.fit_risk(df.withColumn("weighted_sum", F.col("weighted_max") * 2))["auroc"] is not None  # no step is possible


def test_acceptance_and_confidence(spark):
    table = lambda rows: spark.createDataFrame(rows, "domain string, cer double, term_recall double, false_transcript_rate double")
    base = [("general", 0.10, 0.5, None), ("movie", 0.30, 0.5, None), ("song", 0.40, 0.5, None), ("no_speech", None, 0.5, 0.2)]
    new = [("general", 0.115, 0.6, None), ("movie", 0.29, 0.6, None), ("song", 0.39, 0.6, None), ("no_speech", None, 0.6, 0.2)]
    assert M.accept_asr(table(base), table(new)).first().accepted
    for i, worse in enumerate([("general", 0.13, 0.6, None), ("movie", 0.30, 0.6, None), ("song", 0.41, 0.6, None), ("no_speech", None, 0.6, 0.3)]):
        assert not M.accept_asr(table(base), table([*new[:i], worse, *new[i + 1 :]])).first().accepted
    assert not M.accept_asr(table(base), table([(d, c, 0.5, f) for d, c, _, f in new])).first().accepted
    x = spark.createDataFrame([(1, -0.5, 0.1, 1.0), (1, -1.5, 0.3, 2.0), (2, None, None, None)], "id int, avg_logprob double, no_speech_prob double, compression_ratio double")
    got = {r.id: (r.confidence, r.no_speech, r.compression) for r in M.segment_confidence(x, "id").collect()}
    assert got == {1: (-1.0, 0.3, 2.0), 2: (None, None, None)}


def test_clips_of_two_splits_fail_the_job(spark):
    good = spark.createDataFrame([("c1", "train"), ("c2", "test"), ("c1", "train")], "clip_id string, split string")
    assert V.assert_disjoint(good, "clip_id").count() == 3
    with pytest.raises(Exception, match="c1"):
        V.assert_disjoint(good.unionByName(spark.createDataFrame([("c1", "val")], "clip_id string, split string")), "clip_id").collect()


def test_from_segments_to_a_report(spark, tmp_path):
    """Segment list, manifest, features, normalisation, scores, report: one chain over files."""
    from modlake.sources import manifests as S

    lines = ["# ytid, start, end, labels", *[f'yt{i}, {i}.0, {i + 10}.0, "/m/{"loud" if i % 3 else "calm"}"' for i in range(24)]]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    segments = S.read_segments_csv(spark, str(tmp_path / "s.csv"))
    mapping = spark.createDataFrame([("/m/loud", "shout"), ("/m/calm", "speech")], "mid string, class string")
    clips = C.map_segments(segments, mapping, "ytid")
    assert clips.count() == 24
    t = np.arange(1600) / 16000
    waves = spark.createDataFrame([(f"yt{i}", ((0.9 if i % 3 else 0.05) * np.sin(2 * np.pi * 440 * t)).tolist()) for i in range(24)], "ytid string, x array<double>")
    features = G.log_mel(waves, "ytid", "x", mels=8)
    stats = G.fit_norm_stats(features, "feature").first()
    assert len(stats["mean"]) == 8 and all(s > 0 for s in stats["std"])
    level = features.select("ytid", F.array_max(F.transform("feature", lambda r: F.array_max(r))).alias("score"))
    scored = clips.join(level, "ytid").select(F.col("ytid").alias("id"), F.lit("shout").alias("class"), F.array_contains("labels", "shout").cast("int").alias("y"), F.col("score").cast("double"))
    report = M.harm_report(scored, spark.createDataFrame([("shout", "harm", True)], "class string, category string, is_harm boolean"), 0.1, {"ap": 0.9})
    macro = [r for r in report.collect() if r.scope == "macro" and r.name == "harm"][0]
    assert macro.ap == 1 and macro.auroc == 1 and macro.pass_ap


def test_runs_of_equal_sources_are_the_fold():
    r = random.Random(7)
    for case in range(300):
        sizes = {}
        for _ in range(r.randint(1, 6)):
            sizes[r.choice([1, 2, 3, 5, 7, 20, 100])] = r.randint(1, 40)
        ratios = r.choice([[0.7, 0.15, 0.15], [0.8, 0.1, 0.1], [1 / 3, 1 / 3, 1 - 2 / 3], [0.0, 0.0, 1.0], [0.5, 0.25, 0.25]])
        total, fixed = sum(n * m for n, m in sizes.items()), r.choice([0, 0, 3, 500])
        lack = [round(x * 1_000_000) * total for x in ratios]
        lack[2] -= 1_000_000 * fixed
        for size, alone, paired, one, two, cycle in C.greedy_runs(list(sizes.items()), ratios, total, fixed):
            for j in range(sizes[size]):
                want = lack.index(max(lack))
                got = one if j < alone else (two, one)[(j - alone) % 2] if j < paired else cycle[(j - paired) % 3]
                assert got == want, (case, size, j)
                lack[want] -= 1_000_000 * size


def test_many_sources_are_placed_without_one_array(spark):
    n = 200_000
    df = spark.range(n).select(F.concat(F.lit("s"), F.when(F.col("id") < 1000, F.col("id") % 10).otherwise(F.col("id"))).alias("source_id"), F.lit("x").alias("source"))
    got = {x.split: x.n for x in C.assign_splits_greedy(df, {"train": 0.7, "val": 0.15, "test": 0.15}).groupBy("split").agg(F.count("*").alias("n")).collect()}
    rows = {x.split: x.n for x in df.join(C.assign_splits_greedy(df, {"train": 0.7, "val": 0.15, "test": 0.15}), "source_id").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == n - 1000 + 10 and rows == {"train": 140_000, "val": 30_000, "test": 30_000}
