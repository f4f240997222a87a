"""Structured Streaming forms of the keyed rules: the batch step functions under transformWithState, and incidents.

Rows of one key are sorted by order inside each micro-batch; rows behind the watermark are dropped by Spark. Every
state is a small JSON document for each key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from modlake.core import Step, shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    """``step`` over each key's rows in order; extra columns follow the row's own, None drops the row."""

    def __init__(self, step: Step, init: dict, names: list[str], extra: list[str], order: list[str]):
        self.step, self.start, self.names, self.extra, self.order = step, init, names, extra, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = json.loads(self.value.get()[0]) if self.value.exists() else dict(self.start)
        out = Row(*self.names, *self.extra)
        for row in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]):
            state, new = self.step(state, row.asDict())
            if new is not None:
                yield out(*[row[n] for n in self.names], *[new[n] for n in self.extra])
        self.value.update((json.dumps(state),))

    def close(self) -> None:
        pass


def stream_fold(df: DataFrame, key: str, order: list[str], step: Step, init: dict, schema: str) -> DataFrame:
    """``ordered_fold`` for streams: same step, same columns and types. Needs the RocksDB state store.

    A micro-batch's rows of one key are sorted in memory, so bound a batch by maxFilesPerTrigger or maxBytesPerTrigger.
    """
    extra = T._parse_datatype_string(schema)
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema.fields], *extra.fields])
    p = FoldProcessor(step, init, df.columns, [f.name for f in extra.fields], order)
    return df.groupBy(key).transformWithState(p, outputStructType=out, outputMode="Append", timeMode="None")


class IncidentProcessor(StatefulProcessor):
    """Open incident of each stream; a quiet row long enough after the last escalation, or a timer, closes it."""

    def __init__(self, key: str, gap: float, window: float, idle_ms: int | None):
        self.key, self.gap, self.window, self.idle_ms = key, gap, window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("open", T.StructType([T.StructField("json", T.StringType())]))

    def _row(self, key, e: dict) -> Row:
        return Row(self.key, "start", "end", "windows", "peak_score", "reasons")(key[0], e["start"], e["last"] + self.window, e["n"], e["peak"], e["reasons"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        e = json.loads(self.value.get()[0]) if self.value.exists() else None
        for r in sorted(rows, key=lambda r: r["t"]):
            t, escalate = r["t"], r["escalate"]
            if e and not escalate and t > e["last"] and t - e["last"] >= self.gap:
                yield self._row(key, e)
                e = None
            if escalate:
                score = None if r["score"] is None or r["score"] != r["score"] else float(r["score"])
                e = e or {"start": float(t), "n": 0, "peak": None, "reasons": []}
                e |= {"last": float(t), "n": e["n"] + 1, "peak": max((x for x in (e["peak"], score) if x is not None), default=None), "reasons": [*e["reasons"], *[w for w in r["reasons"] or [] if w not in e["reasons"]]]}
        if e:
            self.value.update((json.dumps(e),))
            if self.idle_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        else:
            self.value.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.value.exists():
            e = json.loads(self.value.get()[0])
            self.value.clear()
            yield self._row(key, e)

    def close(self) -> None:
        pass


def stream_incidents(df: DataFrame, key: str, gap: float, window: float = 10.0, idle_ms: int | None = None) -> DataFrame:
    """key, start, end, windows, peak_score, reasons of closed incidents. Input: key, t, escalate, score, reasons.

    With ``idle_ms`` an incident without rows for so long is closed by a timer; late rows can't open it again.
    """
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, start double, end double, windows long, peak_score double, reasons array<string>"
    return df.select(key, "t", "escalate", "score", "reasons").groupBy(key).transformWithState(IncidentProcessor(key, gap, window, idle_ms), outputStructType=schema, outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")


def incident_sink(df: DataFrame, path: str, checkpoint: str | None = None, once: bool = True):
    """Write closed incidents as JSON, a folder for each micro-batch: a batch that runs again replaces its own."""
    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("request", F.struct(F.lit(n).alias("batch"), F.col("start"), F.col("end"))).write.mode("overwrite").json(f"{path}/batch={n}")

    w = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint or f"{shared_dir(df.sparkSession)}/incidents").outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def results_sink(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """One JSON object for each window."""
    w = df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def score_hook(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch: int | None = None) -> DataFrame:
    """``df`` with the columns that a model gives: ``load`` runs once for each task, its result on Arrow batches.

    ``batch`` is the most rows of one call (all of an Arrow batch if unset). A call that fails gives nulls and an ``error`` column instead of failing the job; policy decides what that means.
    Filter first, and score the filtered frame: cheap predicates don't move below Python.
    """
    extra = T._parse_datatype_string(f"{schema}, error string")
    names = [f.name for f in extra.fields if f.name != "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            parts, errors = [], []
            for at in range(0, len(frame), batch or max(len(frame), 1)):
                f = frame.iloc[at : at + (batch or len(frame))].reset_index(drop=True)
                try:
                    got, error = model(f)[names], None
                    columns = [got[n].to_numpy() for n in names]
                    if any(len(c) != len(f) for c in columns):
                        raise ValueError(f"the model gave {len(got)} rows for {len(f)}")
                except Exception as e:  # noqa: BLE001  the hook fails open
                    columns, error = [np.full(len(f), None, object) for _ in names], str(e)[:300]
                parts.append(columns)
                errors.append(np.full(len(f), error, object))
            if parts:  # one frame out for one in: joining them costs more than most models do on a few rows
                joined = {n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)}
                yield frame.reset_index(drop=True).assign(**joined, error=np.concatenate(errors))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *extra.fields]))
