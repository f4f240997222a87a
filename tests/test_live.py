"""The engine as a stream: equal to the batch engine however rows arrive, through stops and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from modlake.streaming import engine, live

SCHEMA = "k long, id long, t double, acoustic double, text double, transcript string, rms double, speech boolean"
BIG = (1 << 53) + 1


def heard(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros((F.col("t") * 1000000).cast("long")))


def made(n, keys=(1, BIG, BIG - 1, None), seed=3):
    r = random.Random(seed)
    said = ["", None, "no no no no no", "fine words here", "other words here", "third words now"]
    return [(k, i, 1000.0 + 2.0 * i + 0.25 * j, r.choice([None, r.random()]), r.random(), r.choice(said), r.choice([0.0, None, 1.0, 1.0]), r.random() < 0.8) for j, k in enumerate(keys) for i in range(n)]


def stream_of(spark, at, parts, end=None, delay="20 seconds", **how):
    """Each part is written and read by a run of its own, which goes on from the checkpoint of the one before."""
    for part in [*parts, *([[end]] if end is not None else [])]:
        x = heard(spark, part if end is None or part != [end] else [(None, None, end, None, None, None, None, None)])
        x.withColumn("end", F.lit(part == [end])).coalesce(1).write.mode("append").parquet(f"{at}/in")
        src = spark.readStream.schema(x.withColumn("end", F.lit(False)).schema).parquet(f"{at}/in")
        out = live.moderate(src, "k", ["t", "id"], "ts", "t", delay, **how)
        live.run(spark, out, f"{at}/out", f"{at}/checkpoint", 200)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


HOW = dict(every=5.0, thresholds={"acoustic": 0.8, "text": 0.7}, gap=6.0)
COLUMNS = ["k", "id", "t", "text_used", "heard", "risk", "reasons", "escalate", "level", "incident"]


def rows_of(df, *cols):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("cuts", [1, 4])
def test_the_stream_is_the_batch(spark, tmp_path, cuts):
    """Rows come mixed within the delay, in one run or in several; null and large keys are streams of their own."""
    rows = made(40)
    batch = engine.moderate(heard(spark, rows), "k", ["t", "id"], **HOW)
    r = random.Random(cuts)
    late = sorted(rows, key=lambda x: x[2] + r.uniform(-8, 8))
    parts = [late[c * len(late) // cuts : (c + 1) * len(late) // cuts] for c in range(cuts)]
    out = stream_of(spark, tmp_path, parts, end=1e7, idle=1e6, **HOW)
    assert rows_of(live.windows(out), *COLUMNS) == rows_of(batch, *COLUMNS)
    same = ["k", "incident", "start", "end", "windows", "peak_acoustic", "peak_text", "peak_score", "transcripts", "duration"]
    got, want = live.incidents(out, "k"), engine.incidents(batch, "k")
    assert rows_of(got, *same) == rows_of(want, *same) and got.count() > 8
    assert rows_of(got.select("k", "incident", F.sort_array("reasons")), "k", "incident", "sort_array(reasons, true)") == rows_of(want.select("k", "incident", F.sort_array("reasons")), "k", "incident", "sort_array(reasons, true)")


def test_rows_wait_for_the_watermark_and_survive_a_stop(spark, tmp_path):
    rows = made(30, keys=(1,))
    first = stream_of(spark, tmp_path, [rows[:15]], **HOW)
    ready = live.windows(first).count()
    assert ready == sum(x[2] <= rows[14][2] - 20 for x in rows[:15]) and 0 < ready < 15
    late = [(1, 99, rows[0][2], 0.99, None, None, 1.0, True)]  # far behind the watermark: dropped, and can't open a closed incident
    out = stream_of(spark, tmp_path, [rows[15:], late], end=1e7, idle=1e6, **HOW)
    assert sorted(r.id for r in live.windows(out).collect()) == list(range(30))


def test_a_silent_stream_is_closed_and_forgotten(spark, tmp_path):
    loud = lambda i, t: (1, i, t, 0.9, None, None, 1.0, True)
    for cuts, parts in enumerate(([[loud(0, 10.0), loud(1, 12.0), loud(2, 200.0)]], [[loud(0, 10.0)], [loud(1, 12.0), loud(2, 200.0)]])):
        out = stream_of(spark, tmp_path / str(cuts), parts, end=1e5, idle=60.0, **HOW)
        got = sorted((r.start, r.end, r.windows, r.peak_score) for r in live.incidents(out, "k").collect())
        assert got == [(10.0, 22.0, 2, 0.9), (200.0, 210.0, 1, 0.9)]
        risk = {r.id: r.risk for r in live.windows(out).collect()}
        assert abs(risk[2] - 0.36) < 1e-9  # smoothing starts anew


def test_an_empty_stream_gives_nothing(spark, tmp_path):
    assert stream_of(spark, tmp_path, [[]], **HOW).count() == 0


class Counted:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.calls, self.values, self.value = 0, [], None

    def getListState(self, *a):
        return self

    def getValueState(self, *a):
        return Value(self)

    def registerTimer(self, ms):
        self.calls += 1

    def appendValue(self, v):
        self.calls, self.values = self.calls + 1, [*self.values, v]

    def get(self):
        self.calls += 1
        return iter(self.values)

    def clear(self):
        self.calls, self.values = self.calls + 1, []


class Value:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls += 1
        return self.store.value

    def update(self, v):
        self.store.calls, self.store.value = self.store.calls + 1, v


class Moment:
    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: 10**9


@pytest.mark.parametrize("streams", [1, 300])
def test_calls_of_the_state_store_do_not_grow_with_the_streams(spark, streams):
    T = live.T
    schema = T._parse_datatype_string("k long, t double, acoustic double, text double, transcript string, gates boolean, usable boolean, _us long")
    p, store = live.EngineProcessor(schema, "k", ["t"], "t", 4.0, 0.4, {"gate": 0.0, "acoustic": 0.5, "text": 0.5}, 6.0, 10.0, 1e6), Counted()
    p.init(store)
    rows = [(k, float(t), 0.9, None, "", True, False, t * 1000000) for t in range(3) for k in range(streams)]
    assert list(p.handleInputRows((0,), iter(rows), Moment())) == []
    out = list(p.handleExpiredTimer((0,), Moment(), Moment()))
    assert sorted(r.k for r in out) == sorted(r[0] for r in rows) and {r.incident for r in out} == {1}
    assert store.calls <= 7


def test_streams_that_share_a_state_stay_apart(spark, tmp_path):
    rows = made(20)
    batch = engine.moderate(heard(spark, rows), "k", ["t", "id"], **HOW)
    out = stream_of(spark, tmp_path, [rows], end=1e7, idle=1e6, groups=1, **HOW)
    assert rows_of(live.windows(out), *COLUMNS) == rows_of(batch, *COLUMNS)
