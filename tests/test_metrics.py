import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlake.operators import metrics as M

SCHEMA = "id long, class string, y int, score double"


def rows(spark, ys, scores, c="k"):
    return spark.createDataFrame([(i, c, y, s) for i, (y, s) in enumerate(zip(ys, scores, strict=True))], SCHEMA)


def one(df, col):
    return df.first()[col]


def draw(seed, n=30):
    r = random.Random(seed)
    return [r.randint(0, 1) for _ in range(n)], [r.choice([0.15, 0.3, 0.35, 0.6, 0.85]) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_average_precision_against_a_loop(spark, seed):
    ys, ss = draw(seed)
    hits, total = 0, 0.0
    for rank, i in enumerate(sorted(range(len(ys)), key=lambda i: (-ss[i], i)), 1):
        hits += ys[i]
        total += hits / rank if ys[i] else 0
    assert one(M.average_precision(rows(spark, ys, ss)), "ap") == pytest.approx(total / sum(ys))
    assert one(M.average_precision_one(rows(spark, ys, ss)), "ap") == pytest.approx(total / sum(ys))


def test_one_kind_only(spark):
    assert one(M.average_precision(rows(spark, [0, 0, 0], [0.2, 0.4, 0.4])), "ap") is None
    assert one(M.auroc(rows(spark, [1, 1, 1], [0.3, 0.7, 0.2])), "auroc") is None
    assert one(M.auroc(rows(spark, [1, 0, 1, 0, 0], [0.25] * 5)), "auroc") == 0.5


@pytest.mark.parametrize("seed", range(3))
def test_recall_and_confusion_against_a_loop(spark, seed):
    ys, ss = draw(seed)
    pos, neg = [s for s, y in zip(ss, ys, strict=True) if y], [s for s, y in zip(ss, ys, strict=True) if not y]
    for fpr in (0.01, 0.2, 0.6):
        want = max([0.0, *(sum(p >= t for p in pos) / len(pos) for t in ss if sum(q >= t for q in neg) <= fpr * len(neg))])
        assert one(M.recall_at_fpr(rows(spark, ys, ss), fpr), "recall") == pytest.approx(want)
    c = M.confusion_at_threshold(rows(spark, ys, ss), 0.35).first()
    assert (c.recall, c.fpr) == (pytest.approx(sum(p >= 0.35 for p in pos) / len(pos)), pytest.approx(sum(q >= 0.35 for q in neg) / len(neg)))


@pytest.mark.parametrize("budget", [0.0, 0.12, 0.4, 0.7])
def test_threshold_at_fpr_keeps_budget(spark, budget):
    r = random.Random(7)
    neg = [r.choice([0.05, 0.22, 0.61, 0.7]) for _ in range(90)]
    t = one(M.threshold_at_fpr(rows(spark, [0] * 90, neg), budget), "threshold")
    assert sum(x >= t for x in neg) <= budget * 90
    lower = [x for x in set(neg) if x < t]
    assert not lower or sum(x >= max(lower) for x in neg) > budget * 90


def test_threshold_at_recall(spark):
    assert one(M.threshold_at_recall(rows(spark, [1, 1, 1, 1, 0], [0.9, 0.8, 0.7, 0.2, 0.5]), 0.75), "threshold") == 0.7
    assert one(M.threshold_at_recall(rows(spark, [0], [0.5]), 0.9), "threshold") == 0


def test_random_against_loops(spark):
    random.seed(1)
    for _ in range(6):
        n = random.randint(2, 40)
        ys, ss = [random.randint(0, 1) for _ in range(n)], [random.choice([0.1, 0.2, 0.5, 0.7]) for _ in range(n)]
        df = rows(spark, ys, ss)
        pos, neg = [s for s, y in zip(ss, ys, strict=True) if y], [s for s, y in zip(ss, ys, strict=True) if not y]
        want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
        got = one(M.auroc(df), "auroc")
        assert got == (pytest.approx(want) if want is not None else None)
        if pos and neg:
            best = max([0.0, *(sum(p >= t for p in pos) / len(pos) for t in set(ss) if sum(q >= t for q in neg) <= 0.3 * len(neg))])
            assert one(M.recall_at_fpr(df, 0.3), "recall") == pytest.approx(best)


def test_partition_counts_do_not_matter(spark):
    random.seed(2)
    df = rows(spark, [random.randint(0, 1) for _ in range(500)], [random.random() for _ in range(500)])
    old, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append((one(M.average_precision_one(df), "ap"), one(M.auroc(df), "auroc")))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[1] == pytest.approx(got[0]) and got[2] == pytest.approx(got[0])


def test_harm_report(spark):
    classes = spark.createDataFrame([("a", "x", True), ("b", "x", True), ("c", "z", False)], "class string, category string, is_harm boolean")
    data = [(i, c, int(i // 2 == k), 0.9 if i // 2 == k else 0.1) for k, c in enumerate("abc") for i in range(6)]
    out = {(r.scope, r.name): r for r in M.harm_report(spark.createDataFrame(data, SCHEMA), classes, 0.01, {"ap": 0.7, "auroc": 0.9, "recall": 0.8}).collect()}
    assert out["macro", "harm"].ap == 1 and out["category", "x"].auroc == 1 and out["class", "a"].pass_ap and out["class", "a"].pass_recall


def test_asr_metrics(spark):
    df = spark.createDataFrame([(1, "general", "사람 살려", "사람 살려", ["살려"]), (2, "movie", "Help me", "help ME", []), (3, "no_speech", "", "noise", [])], "id int, domain string, text string, hypothesis string, harm_terms array<string>")
    r = {x.domain: x for x in M.asr_report(df).collect()}
    assert r["general"].cer == 0 and r["movie"].cer == 0 and r["no_speech"].cer is None and r["no_speech"].false_transcript_rate == 1 and r["general"].term_recall == 1


def test_error_rates_of_composed_text(spark):
    df = spark.createDataFrame([("a", "ㅋㅋ 한국 ", "\u1112\u1161\u11ab국"), ("a", "ab c", ""), ("b", "", "x"), ("b", None, None)], "k string, r string, h string")
    got = {x.k: (x.cer, x.n) for x in M.character_error_rate(df, "r", "h", ["k"]).collect()}
    assert got == {"a": (3 / 5, 2)}


def test_bootstrap_sees_a_better_model(spark):
    random.seed(3)
    data = [(i, y, (random.random() * 0.5 + 0.1 * y) / 1000, random.random() * 50 + 40 * y) for i in range(600) for y in [i % 2]]
    df = spark.createDataFrame(data, "id long, y int, score double, score_b double")
    r = M.bootstrap_compare(df, 200).first()
    assert r.significant and r.low > 0 and r.p_better == 1 and r.low <= r.delta <= r.high
    area = lambda k: sum((p[k] > q[k]) for p in data if p[1] for q in data if not q[1]) / 300**2
    assert r.auroc_a == pytest.approx(area(2)) and r.auroc_b == pytest.approx(area(3))
    assert M.bootstrap_compare(df.repartition(5), 200).first() == r


def test_bootstrap_interval_is_that_of_resampling_rows(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    a, b = rng.normal(y * 0.5, 1), rng.normal(y * 0.6, 1)
    r = M.bootstrap_compare(spark.createDataFrame(list(zip(range(400), y.tolist(), a.tolist(), b.tolist(), strict=True)), "id long, y int, score double, score_b double"), 500).first()

    def area(s, at):
        p, q = s[at][y[at] == 1], s[at][y[at] == 0]
        return ((p[:, None] > q).mean() + 0.5 * (p[:, None] == q).mean())

    ds = [area(b, at) - area(a, at) for at in (rng.integers(0, 400, 400) for _ in range(500))]
    low, high = np.percentile(ds, [2.5, 97.5])
    assert abs(r.low - low) < 0.015 and abs(r.high - high) < 0.015


def test_fit_risk(spark):
    random.seed(4)
    data = [(x, x * 2 + random.random(), int(x + random.random() * 0.2 > 0.6)) for x in (random.random() for _ in range(400))]
    m = M.fit_risk(spark.createDataFrame(data, "weighted_max double, weighted_sum double, y int"))
    assert m["auroc"] > 0.9


def test_bootstrap_draws_are_those_of_its_cells_and_a_replicate_is_one_row(spark):
    random.seed(8)
    grid = [(y, a, b, random.choice([1, 2, 7, 30, 31, 400])) for y in (0, 1) for a in range(0, 12, 2) for b in range(5) if random.random() < 0.7]
    cells = spark.createDataFrame(grid, "y int, a_bin int, b_bin int, n long")
    one_by_one = cells.crossJoin(spark.range(45)).withColumn("cdf", F.when(F.col("n") <= M.EXACT, M.poisson_cdf(F.col("n"))))
    drawn = one_by_one.select("id", "y", "a_bin", "b_bin", M.poisson_weight(F.col("n"), F.col("cdf"), F.md5(F.concat_ws("|", F.lit("3"), "id", "y", "a_bin", "b_bin"))).alias("w")).collect()

    def area(i, side):
        pos, neg = ([(r[side], r.w) for r in drawn if r.id == i and r.y == k] for k in (1, 0))
        return sum(w * x * ((p > q) + (p == q) / 2) for p, w in pos for q, x in neg) / (sum(w for _, w in pos) * sum(x for _, x in neg))

    got = M.drawn_areas(cells, 45, 3).collect()
    assert sorted(r.id for r in got) == list(range(45))
    for r in got:
        assert r.a == pytest.approx(area(r.id, "a_bin"), abs=1e-12) and r.b == pytest.approx(area(r.id, "b_bin"), abs=1e-12)
    assert all(r.a is None and r.b is None for r in M.drawn_areas(cells.filter("y = 1"), 21, 0).collect())
    assert M.drawn_areas(cells.limit(0), 21, 0).count() == 0
