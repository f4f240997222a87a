"""The engine as a stream: one stateful processor from scored windows to moderated windows and closed incidents.

Rows wait in a list state until the watermark has passed them, then go through the rules in order: gates, the wait between
transcripts, smoothing, thresholds, incidents. So the result doesn't depend on how rows are cut into micro-batches or how they are
mixed within the watermark's delay. Streams share states in groups. Event-time timers stand at the first waiting row and at the end of the silence
after which a stream's incident is closed and its state forgotten. All state is in the checkpoint: a query that
was stopped goes on where it was.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from modlake.functions.labels import cascade_decision
from modlake.operators.incidents import display_level
from modlake.streaming.engine import text_step, with_gates
from modlake.streaming.keyed import ROCKSDB

#: What the processor adds to a window, and the record of a closed incident (null on windows).
WINDOW = "text_used double, heard boolean, risk double, incident long"
CLOSED = "incident long, start double, end double, windows long, peak_acoustic double, peak_text double, peak_score double, reasons array<string>, transcripts array<string>, duration double"
_KEPT = 5
#: Rows that stand in the state store as one value; groups of streams, each with one state.
AT_ONCE, GROUPS = 1_000, 1_024
#: A stream before its first row: when it was last heard, smoothed risk, last row's time, the same in microseconds, last escalation, incidents.
_NEW = (None, 0.0, None, None, None, 0)


def _higher(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else max(a, b)


def named(key):
    """A key as a dict takes it. NaN is one stream."""
    return bytes(key) if isinstance(key, bytearray) else "nan" if key != key else key


def _packed(rows: list[tuple]) -> tuple[bytes]:
    return (pickle.dumps(rows, pickle.HIGHEST_PROTOCOL),)


def known(x: float | None) -> float | None:
    return None if x is None or x != x else x


class EngineProcessor(StatefulProcessor):
    """State of a group of streams: waiting rows (list state, many rows a value), what each stream is at with its open incident (value
    state), timers in event time.

    A call of the state store costs as much as the rules of many rows, so streams share it: a group takes a few calls a micro-batch,
    whatever its streams and rows. One timer stands at the first waiting row, another at the first end of a silence.
    """

    def __init__(self, schema: T.StructType, key: str, order: list[str], t: str, every: float, rate: float, limits: dict[str, float], gap: float, window: float, idle: float | None):
        self.key, self.t = key, t
        self.limits, self.gap, self.window, self.idle = limits, gap, window, idle
        self.rule = text_step(t, every, rate)
        self.names = schema.fieldNames()
        self.us, self.at, self.places = self.names.index("_us"), self.names.index(key), [self.names.index(c) for c in order]
        self.out = Row(*self.names, *T._parse_datatype_string(WINDOW).fieldNames(), "closed")
        self.record = Row(*T._parse_datatype_string(CLOSED).fieldNames())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.now = handle.getValueState("now", "streams binary, wakes long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, rows = None, map(tuple, rows)
        while some := list(islice(rows, AT_ONCE)):
            self.waiting.appendValue(_packed(some))
            low = min(r[self.us] for r in some)
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto, us = timerValues.getCurrentWatermarkInMs() * 1000, self.us
        due, later = {}, []
        for (chunk,) in self.waiting.get():
            for r in pickle.loads(chunk):
                if r[us] <= upto:
                    due.setdefault(named(r[self.at]), []).append(r)
                else:
                    later.append(r)
        if due and later:
            self.waiting.put([_packed(later[at : at + AT_ONCE]) for at in range(0, len(later), AT_ONCE)])
        elif due:
            self.waiting.clear()
        if later:
            self.handle.registerTimer(-(-min(r[us] for r in later) // 1000))
        packed, stands = self.now.get() or (None, None)
        streams = pickle.loads(packed) if packed else {}  # name -> key, state, open incident
        for name, rows in due.items():
            rows.sort(key=lambda r: [(r[p] is not None, r[p]) for p in self.places])
            own, state, open_ = streams.get(name) or (rows[0][self.at], _NEW, None)
            streams[name] = (own, *(yield from self._released(own, rows, state, open_)))
        wakes = None if stands is not None and stands <= expiredTimerInfo.getExpiryTimeInMs() else stands
        ended = []
        if self.idle is not None:
            wait = {named(r[self.at]) for r in later}  # the timer of the waiting rows comes back to these
            ends = {name: x[1][3] + math.ceil(self.idle * 1e6) for name, x in streams.items() if name not in wait}
            ended = [name for name, end in ends.items() if end <= upto]
            for name in ended:  # silent for so long: what is open is closed, and nothing is kept
                own, state, open_ = streams.pop(name)
                if open_:
                    yield self._closed(own, state[5], open_)
                del ends[name]
            if ends and (wakes is None or min(ends.values()) <= 1000 * (wakes - 1)):
                wakes = -(-min(ends.values()) // 1000)
                self.handle.registerTimer(wakes)
        if streams and (due or ended or wakes != stands):
            self.now.update((pickle.dumps(streams, pickle.HIGHEST_PROTOCOL), wakes))
        elif not streams and packed:
            self.now.clear()

    def _closed(self, key, number: int, e: tuple) -> Row:
        start, last, windows, acoustic, text, peak, reasons, transcripts = e
        end = last + self.window
        record = self.record(number, start, end, windows, acoustic, text, peak, list(reasons), list(transcripts), end - start)
        return self.out(*[key if n == self.key else None for n in self.names], None, None, None, None, record)

    def _released(self, key, rows: list[tuple], state: tuple, open_: tuple | None) -> Iterator[Row]:
        """The rows' windows and the incidents that they close; returns the state and the open incident after them."""
        for row in rows:
            r = dict(zip(self.names, row, strict=True))
            heard_at, ema, seen, seen_us, up_at, n = state
            if self.idle is not None and seen_us is not None and r["_us"] - seen_us >= self.idle * 1e6:
                if open_:
                    yield self._closed(key, n, open_)
                heard_at, ema, seen, up_at, open_ = None, 0.0, None, None, None
            after, new = self.rule({"last": heard_at, "ema": ema}, r)
            acoustic, text, t = known(r["acoustic"]), new["text_used"], r[self.t]
            reasons = [w for w, x in (("acoustic", acoustic), ("text", text)) if x is not None and x >= self.limits[w]]
            quiet_long = up_at is not None and t > up_at and t - up_at >= self.gap
            number = None
            if reasons:
                if up_at is None or (seen is not None and seen > up_at and seen - up_at >= self.gap):
                    n, open_ = n + 1, None
                number = n
                open_ = self._grown(open_, r, acoustic, text, reasons)
            elif open_ and quiet_long:
                yield self._closed(key, n, open_)
                open_ = None
            state = (after["last"], after["ema"], t, r["_us"], t if reasons else up_at, n)
            yield self.out(*row, text, new["heard"], new["risk"], number, None)
        return state, open_

    def _grown(self, e: tuple | None, r: dict, acoustic: float | None, text: float | None, reasons: list[str]) -> tuple:
        start, _, windows, pa, pt, peak, why, said = e or (float(r[self.t]), None, 0, None, None, None, [], [])
        words = r["transcript"]
        if words:
            said = [*[s for s in said if s != words], words][-_KEPT:]
        return (start, float(r[self.t]), windows + 1, _higher(pa, acoustic), _higher(pt, text), _higher(peak, max(acoustic or 0.0, text or 0.0)), [*why, *[w for w in reasons if w not in why]], said)

    def close(self) -> None:
        pass


def moderate(df: DataFrame, key: str, order: list[str], ts: str = "ts", t: str = "t", delay: str = "10 minutes", rms_least: float = 0.01, every: float = 4.0, rate: float = 0.4, thresholds: dict[str, float] | None = None, gap: float = 6.0, window: float = 10.0, idle: float | None = None, groups: int = GROUPS) -> DataFrame:
    """``engine.moderate`` over a stream: its columns for each window, and rows with ``closed`` for each incident that has ended.

    ``t`` is in seconds, ``ts`` the same moment as a timestamp. Rows later than ``delay`` behind the latest are dropped by Spark. A stream
    silent for ``idle`` seconds has its incident closed and starts anew; without it, an incident waits for a quiet row. A row without a key
    belongs to the null stream; one without ``ts`` moves the watermark no further and is left out, and so is one whose ``end`` (if there is such
    a column) is true, which can serve to move the watermark on. Streams are dealt by a hash of their key to ``groups``, which share one state each: a task holds
the waiting rows and streams of one group at once, so more groups take less memory and more calls of the state store. The number has to
stay while a checkpoint is used. Needs the RocksDB state store (``run`` sets it).
    """
    limits = {"gate": 0.0, **(thresholds or {"acoustic": 0.5, "text": 0.5})}
    ended = F.coalesce("end", F.lit(False)) if "end" in df.columns else F.lit(False)
    # one predicate that holds the event time: any other is pushed below the watermark, which would then not see the row
    x = df.withWatermark(ts, delay).filter(F.when(~ended, F.col(ts)).isNotNull()).drop("end")
    x = with_gates(x, rms_least).withColumns({"_us": F.unix_micros(F.col(ts).cast("timestamp")), "_group": F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")})
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in x.schema.fields], *T._parse_datatype_string(f"{WINDOW}, closed struct<{CLOSED}>").fields])
    processor = EngineProcessor(x.schema, key, order, t, every, rate, limits, gap, window, idle)
    got = x.groupBy("_group").transformWithState(processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
    d = cascade_decision(F.lit(None), F.nanvl("acoustic", F.lit(None).cast("double")), F.col("text_used"), limits, gate_on=False)
    got = got.withColumn("d", d).withColumns({"reasons": F.col("d.reasons"), "escalate": F.col("d.escalate")})
    return got.withColumn("level", display_level(F.col("acoustic"), F.col("escalate"), limits["acoustic"])).drop("d", "gates", "usable", "_us", "_group")


def windows(out: DataFrame) -> DataFrame:
    """The moderated windows of ``moderate``."""
    return out.filter("closed is null").drop("closed")


def incidents(out: DataFrame, key: str) -> DataFrame:
    """The closed incidents of ``moderate``."""
    return out.filter("closed is not null").select(key, "closed.*")


def run(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, seconds: int = 3600) -> None:
    """All that is there now, through the stream to Parquet; a later call goes on from the checkpoint."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        if not q.awaitTermination(seconds):
            q.stop()
            raise TimeoutError(f"the stream has not ended in {seconds} seconds; it goes on from {checkpoint}")
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
