"""Folds, recurrences and interval joins: types and nulls, and loops over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from modlake.core import decayed, ordered_fold
from modlake.operators import incidents as I
from modlake.operators import spans as S
from modlake.plans.base import r6

BIG = (1 << 53) + 1


def test_a_fold_keeps_null_keys_and_large_integers(spark):
    rows = [(None, BIG, 1, None), (None, None, 2, "b"), (BIG, BIG, 1, "c"), (BIG, 5, 2, None), (BIG - 1, BIG + 2, 1, "d")]
    df = spark.createDataFrame(rows, "k long, big long, i int, s string").withColumn("at", F.lit("2024-01-02 03:04:05.000007").cast("timestamp"))
    step = lambda state, row: ({"n": state.get("n", 0) + 1}, {"n": state.get("n", 0) + 1, "same": row["big"]})
    got = {tuple(r) for r in ordered_fold(df.coalesce(1), "k", ["i"], step, {}, "n long, same long").drop("at").collect()}
    assert got == {(None, BIG, 1, None, 1, BIG), (None, None, 2, "b", 2, None), (BIG, BIG, 1, "c", 1, BIG), (BIG, 5, 2, None, 2, 5), (BIG - 1, BIG + 2, 1, "d", 1, BIG + 2)}
    assert ordered_fold(df.limit(0), "k", ["i"], step, {}, "n long, same long").count() == 0


@pytest.mark.parametrize("kind", ["long", "string", "double", "struct<x:int>"])
def test_a_fold_restarts_where_the_key_changes(spark, kind):
    df = spark.createDataFrame([(k, i) for k in (None, 1, 2, 3) for i in range(50)], "k int, i int")
    key = F.when(F.col("k").isNotNull(), F.struct(F.col("k").alias("x"))) if "struct" in kind else F.col("k").cast(kind)
    step = lambda state, row: ({"n": state.get("n", 0) + 1}, {"n": state.get("n", 0) + 1})
    got = ordered_fold(df.withColumn("key", key), "key", ["i"], step, {}, "n int", ["i"]).collect()
    assert len(got) == 200 and all(r.n == r.i + 1 for r in got)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_every_rule_takes_null_keys(spark):
    """Null and large keys are streams like any other in all folded rules."""
    random.seed(4)
    rows = [(k, float(i) * 2, random.choice([None, random.random()]), random.random() * 4) for k in (None, BIG, BIG - 1, 7) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t double, p double, v double").repartition(3)

    def folded(step):
        out = []
        for r in by_key(rows).values():
            state = {}
            for k, t, p, v in r:
                state, new = step(state, {"k": k, "t": t, "p": p, "v": v, "b": p or 0.0, "g": v > 1})
                if new is not None:
                    out.append((k, t, new))
        return out

    def agree(got, names, step):
        want = sorted(((k, t, *[new[n] for n in names]) for k, t, new in folded(step)), key=str)
        rows = sorted(((r["k"], r["t"], *[r[n] for n in names]) for r in got.collect()), key=str)
        assert len(rows) == len(want)
        for a, b in zip(rows, want, strict=True):
            assert a[:2] == b[:2] and all(x == y or abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:], strict=True)), (a, b)

    agree(I.ema_risk(df, "k", ["t"], "p"), ["smoothed"], I.ema_step("p", 0.3))
    agree(I.ema_display(df, "k", ["t"], "p", "p"), ["display"], I.ema_step("b", 0.4, False, "display"))
    agree(I.duty_cycle(df.withColumn("g", F.col("v") > 1), "k", ["t"], "t", 5.0, "g"), [], I.duty_step("t", 5.0, "g"))
    agree(I.adaptive_windows(df, "k", "t", "p", 0.5), ["stride"], I.adaptive_step("t", "p", 0.5))
    agree(I.language_policy(df, "k", ["t"], "p", "v"), ["decision", "mode", "streak"], I.language_step("p", "v"))
    spans = df.select("k", F.col("t").alias("start"), (F.col("t") + F.col("v") / 2).alias("end"))
    got = {r.k: r.n for r in S.group_spans(spans, "k").groupBy("k").agg(F.sum("voiced").alias("n")).collect()}
    want = {k: sum(v / 2 for _, _, _, v in r) for k, r in by_key(rows).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("first_is_seed", [True, False])
def test_a_recurrence_over_ranges_is_the_loop(spark, first_is_seed):
    """One key has most rows, so it is cut over all ranges; some keys begin with nulls or have nothing else."""
    random.seed(1)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rows = [(k, i, None if i < lead or random.random() < 0.1 else random.choice([random.random(), 1e6 * random.random()]), "x") for k, n, lead in ((None, 40, 3), ("hot", 3000, 0), ("late", 600, 500), ("never", 30, 99), ("z", 1, 0)) for i in range(n)]
        rows[50] = (*rows[50][:2], float("nan"), "x")
        df = spark.createDataFrame(rows, "k string, i int, p double, other string")
        first = 1.0 if first_is_seed else 0.3
        got = {(r.k, r.i): r.y for r in decayed(df, "k", ["i"], F.col("p"), 0.7, 0.3, first, "y").collect()}
        assert len(got) == len(rows)
        step = I.ema_step("p", 0.3, first_is_seed)
        for k, r in by_key(rows).items():
            state = {}
            for _, i, p, _ in r:
                state, new = step(state, {"p": p})
                y = new["smoothed"]
                assert (got[k, i] is None) == (y is None) and (y is None or abs(got[k, i] - y) <= 1e-9 * max(1, abs(y))), (k, i)
        assert decayed(df.limit(0), "k", ["i"], F.col("p"), 0.7, 0.3, 1.0, "y").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_recurrence_is_the_loop_to_the_last_bit(spark):
    """Values of four digits, as the events have: a sixth digit often hangs on the last bit. One key is cut over all ranges."""
    random.seed(3)
    rows = [(k, i, random.randrange(10_000) / 10_000) for k, n in (("a", 30), ("hot", 4000), ("z", 30)) for i in range(n)]
    got = {(r.k, r.i): r.y for r in decayed(spark.createDataFrame(rows, "k string, i int, p double"), "k", ["i"], F.col("p"), 0.7, 0.3, 1.0, "y").collect()}
    for k, r in by_key(rows).items():
        y = None
        for _, i, p in r:
            y = p if y is None else 0.7 * y + 0.3 * p
            assert got[k, i] == y, (k, i)


def test_six_digits_are_those_of_the_sql(spark):
    import duckdb

    values = [(x + 0.5) / 1e6 for x in range(200_000, 260_000, 7)] + [0.0, -0.1234565, 1704067211.172425]
    sql = duckdb.connect().execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()
    got = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", r6("x").alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [r[0] for r in sql]


def test_spans_meet_windows_once(spark):
    random.seed(2)
    spans = [(random.choice(["a", "b"]), i, s := random.uniform(-50, 50), s + random.choice([0.1, 1, 3, 10, 80])) for i in range(80)]
    spans += [("a", 90, 1.0, 3.0), ("a", 91, 1.0, 3.0), ("a", 92, -1e9, 1e9), ("a", 93, 5.0, 5.0), ("a", 94, None, 3.0), ("a", 95, 8.0, 2.0), (None, 96, 0.0, 9.0)]
    windows = [(k, float(w), float(w) + size) for k in ("a", "b") for w, size in ((0, 2), (2, 2), (4, 2), (-40, 2), (10, 64), (0, 0.25), (-500, 1000))]
    s = spark.createDataFrame(spans, "k string, id int, start double, end double")
    w = spark.createDataFrame(windows, "k string, w_start double, w_end double")
    got = sorted((r.id, r.w_start, r.w_end) for r in S.spans_in_windows(s, w, "k", 2.0).collect())
    want = sorted((i, a, z) for k, i, x, y in spans for q, a, z in windows if k == q and x is not None and x < z and a < y)
    assert got == want and sum(i in (90, 91) for i, _, _ in got) == 2 * sum(i == 90 for i, _, _ in got)
    dealt = S.spans_in_windows(s.filter("id = 92"), w, "k", 1e-3)  # a span over 2 * 10^12 buckets
    assert dealt.count() == 7
    assert S.spans_in_windows(s.limit(0), w, "k", 2.0).count() == S.spans_in_windows(s, w.limit(0), "k", 2.0).count() == 0
