"""Streams of scored windows in batch form: incidents, risk smoothing and escalation.

Rows carry a stream key and an order; a row's ``t`` is in seconds. Null scores mean that a branch did not run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlake.core import decayed, ordered_fold


def merge_incidents(df: DataFrame, key: str, t: str, escalate: str, gap: float, order: list[str] | None = None) -> DataFrame:
    """``df`` with incident: its number within the key for escalating rows, null for the others.

    An escalation begins an incident if none came before it, or if a quiet row stands at least ``gap`` after the last
    escalation. Native windows over one sort by key and order.
    """
    w = Window.partitionBy(key).orderBy(*(order or [t]))
    up = w.rowsBetween(Window.unboundedPreceding, -1)
    prev, last = F.lag(t).over(w), F.last(F.when(F.col(escalate), F.col(t)), ignorenulls=True).over(up)
    new = F.col(escalate) & (last.isNull() | ((prev > last) & (prev - last >= gap)))
    marked = df.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int"))
    number = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("incident", F.when(F.col(escalate), number)).drop("_new")


def incident_rollup(df: DataFrame, key: str, t: str, window: float, acoustic: str, text: str, reasons: str | None = None, transcript: str | None = None) -> DataFrame:
    """One row an incident: start, end, windows, peaks, reasons in first-seen order, the last 5 distinct transcripts."""
    top = F.greatest(F.coalesce(F.col(acoustic), F.lit(0.0)), F.coalesce(F.col(text), F.lit(0.0)))
    aggs = [
        F.min(t).alias("start"), (F.max(t) + window).alias("end"), F.count("*").alias("windows"), F.max(acoustic).alias("peak_acoustic"), F.max(text).alias("peak_text"),
        F.max(top).alias("peak_score"), F.max_by(t, F.struct(top, -F.col(t))).alias("best_t"),
    ]
    if reasons:
        aggs.append(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(t, reasons))), lambda x: x[reasons]))).alias("reasons"))
    if transcript:
        said = F.transform(F.array_sort(F.collect_list(F.when(F.length(transcript) > 0, F.struct(F.col(t).alias("t"), F.col(transcript).alias("x"))))), lambda x: x["x"])
        last_first = F.array_distinct(F.reverse(said))
        aggs.append(F.reverse(F.slice(last_first, 1, 5)).alias("transcripts"))
    return df.filter("incident is not null").groupBy(key, "incident").agg(*aggs).withColumn("duration", F.col("end") - F.col("start"))


def ema_step(score: str, rate: float, first_is_seed: bool = True, out: str = "smoothed"):
    """Exponential smoothing of a score; seeded with the first value (risk) or with 0 (display). Null keeps the state."""
    def step(state: dict, row: dict) -> tuple[dict, dict]:
        x, old = row[score], state.get("ema")
        if x is None or x != x:
            return state, {out: old}
        if old is None:
            old = x if first_is_seed else 0.0
        new = (1 - rate) * old + rate * x
        return {**state, "ema": new}, {out: new}

    return step


def ema_risk(df: DataFrame, key: str, order: list[str], score: str, rate: float = 0.3) -> DataFrame:
    """``df`` with smoothed: seeded with a stream's first score. A null score keeps the value. Long streams are spread over tasks."""
    return decayed(df, key, order, F.col(score), 1 - rate, rate, 1.0, "smoothed")


def ema_display(df: DataFrame, key: str, order: list[str], acoustic: str, text: str, rate: float = 0.4) -> DataFrame:
    """``df`` with display: the higher of two scores (null is 0), smoothed from 0 on. Long streams are spread over tasks."""
    base = F.greatest(F.coalesce(F.col(acoustic), F.lit(0.0)), F.coalesce(F.col(text), F.lit(0.0)))
    return decayed(df, key, order, base, 1 - rate, rate, rate, "display")


def risk_level(x: Column | str, warn: float, block: float) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x >= block, "block").when(x >= warn, "warn").otherwise("safe")


def display_level(acoustic: Column, escalate: Column, threshold: float) -> Column:
    return F.when(escalate, "alert").when(acoustic >= 0.6 * threshold, "watch").otherwise("ok")


def warn_escalation(df: DataFrame, key: str, order: list[str], level: str, runs: int = 3, calm: float = 5.0, alert: float = 2.5) -> DataFrame:
    """``df`` with consecutive_warns, final_level (block after ``runs`` warns in a row) and stride to the next window."""
    w = Window.partitionBy(key).orderBy(*order)
    g = df.withColumn("_g", F.sum(F.when(F.col(level) != "warn", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("consecutive_warns", F.sum(F.when(F.col(level) == "warn", 1).otherwise(0)).over(run).cast("int"))
    final = F.when((F.col(level) == "block") | (F.col("consecutive_warns") >= runs), "block").otherwise(F.col(level))
    return g.withColumn("final_level", final).withColumn("stride", F.when(F.col(level) == "safe", calm).otherwise(alert)).drop("_g")


def duty_step(t: str, every: float, gates: str | None = None):
    """Keep a row that passes its gates and is at least ``every`` seconds after the last one kept."""
    def step(state: dict, row: dict) -> tuple[dict, dict | None]:
        last = state.get("last")
        if (gates and not row[gates]) or (last is not None and row[t] - last < every):
            return state, None
        return {"last": row[t]}, {"kept": True}

    return step


def duty_cycle(df: DataFrame, key: str, order: list[str], t: str, every: float, gates: str | None = None) -> DataFrame:
    return ordered_fold(df, key, order, duty_step(t, every, gates), {}, "kept boolean", [t, *([gates] if gates else [])]).drop("kept")


def adaptive_step(t: str, risk: str, warn: float, calm: float = 5.0, alert: float = 2.5):
    """Of windows on a fine grid, those that a reader lands on who moves on by ``calm``, or by ``alert`` after a warn."""
    def step(state: dict, row: dict) -> tuple[dict, dict | None]:
        if row[t] + 1e-9 < state.get("next", row[t]):
            return state, None
        move = alert if row[risk] is not None and row[risk] >= warn else calm
        return {"next": row[t] + move}, {"stride": move}

    return step


def adaptive_windows(df: DataFrame, key: str, t: str, risk: str, warn: float, calm: float = 5.0, alert: float = 2.5) -> DataFrame:
    return ordered_fold(df, key, [t], adaptive_step(t, risk, warn, calm, alert), {}, "stride double", [t, risk])


def language_step(p: str, voiced: str, accept: float = 0.5, evidence: float = 0.15, enter: int = 2, switch: int = 3, least_voiced: float = 2.0):
    """Keep what is uncertain; suppress on sustained strong evidence of the other language only.

    A probability of ``accept`` or more is accepted and makes the stream "own". At most ``evidence`` over enough voiced
    seconds is a strong negative: the ``enter``-th in a row is suppressed (the ``switch``-th after "own"), and so are
    those that follow. Anything else, null too, is accepted as uncertain and ends the run.
    """
    def step(state: dict, row: dict) -> tuple[dict, dict]:
        mode, streak = state.get("mode", "unknown"), state.get("streak", 0)
        x, v = row[p], row[voiced]
        known = x is not None and x == x
        if known and x >= accept:
            mode, streak, decision = "own", 0, "accept"
        elif not (known and x <= evidence and v is not None and v >= least_voiced):
            streak, decision = 0, "uncertain"
        else:
            streak += 1
            decision = "suppress" if streak >= (switch if mode == "own" else enter) else "pending"
            mode = "other" if decision == "suppress" else mode
        return {"mode": mode, "streak": streak}, {"decision": decision, "selected": decision != "suppress", "mode": mode, "streak": streak}

    return step


def language_policy(df: DataFrame, key: str, order: list[str], p: str, voiced: str, **how) -> DataFrame:
    return ordered_fold(df, key, order, language_step(p, voiced, **how), {}, "decision string, selected boolean, mode string, streak int", [p, voiced])


def new_audio_slice(df: DataFrame, key: str, t: str, window: float = 10.0, least: float = 4.0) -> DataFrame:
    """``df`` (kept rows) with new_seconds: what the row before did not cover, within [least, window]."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))
    return df.withColumn("new_seconds", F.coalesce(F.greatest(F.lit(least), F.least(F.lit(window), gap)), F.lit(window)))


def sliding_windows(df: DataFrame, key: str, ts: str, width: str, slide: str, covered: Column, full_seconds: float, watermark: str | None = None) -> DataFrame:
    """Complete sliding windows: key, start, end, n, covered_seconds; incomplete ones are left out. Batch or stream.

    A window is complete if its covered seconds, to six digits, are ``full_seconds`` or more: the last bits of a sum go by the order of its rows.
    """
    src = df.withWatermark(ts, watermark) if watermark else df
    out = src.groupBy(key, F.window(ts, width, slide)).agg(F.count("*").alias("n"), F.sum(covered).alias("covered_seconds"))
    return out.filter(F.round(F.col("covered_seconds") * 1e6) / 1e6 >= full_seconds).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "covered_seconds")


def stream_stats(df: DataFrame, key: str, escalate: str, skip_reason: str | None = None, asr_seconds: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("windows"), F.count(F.when(F.col(escalate), 1)).alias("escalations"), F.coalesce(F.max("incident"), F.lit(0)).alias("incidents")]
    if asr_seconds:
        aggs += [F.count(asr_seconds).alias("asr_runs"), F.sum(asr_seconds).alias("asr_seconds")]
    if skip_reason:
        aggs.append(F.count(skip_reason).alias("skipped"))
    return df.groupBy(key).agg(*aggs)


def snapshot(df: DataFrame, key: str, t: str, n: int, *ties: str) -> DataFrame:
    """The latest ``n`` rows of each stream."""
    w = Window.partitionBy(key).orderBy(F.col(t).desc(), *[F.col(c).desc() for c in ties])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


retain_latest = snapshot


def route_summary(df: DataFrame, key: str, p_a: str, p_b: str, selected: str, voiced: str, rms: str) -> DataFrame:
    """Of the speech groups of each stream: best probability, selected and suppressed, and whether to fail open."""
    out = df.groupBy(key).agg(
        F.max(F.greatest(p_a, p_b)).alias("probability"), F.count(F.when(F.col(selected), 1)).alias("selected"), F.count(F.when(~F.col(selected), 1)).alias("suppressed"),
        F.coalesce(F.sum(voiced), F.lit(0.0)).alias("voiced"), F.max(rms).alias("rms"))
    return out.withColumn("fail_open", (F.col("voiced") <= 0) & (F.col("rms") >= 1e-4))


def gate_order(gates: list[tuple[str, Column]]) -> Column:
    """skip_reason: the name of the first gate that fails, cheap ones first; null if all pass. A null gate fails."""
    out = None
    for name, ok in gates:
        failed = ~F.coalesce(ok, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def silence_watchdog(df: DataFrame, key: str, order: list[str], rms: str, floor: float = 1e-4, runs: int = 3) -> DataFrame:
    """The rows where a run of ``runs`` silent windows is complete, once for each stream."""
    w = Window.partitionBy(key).orderBy(*order)
    quiet = F.coalesce(F.col(rms), F.lit(0.0)) < floor
    g = df.withColumn("_q", quiet).withColumn("_g", F.sum(F.when(~quiet, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = g.withColumn("_run", F.sum(F.col("_q").cast("int")).over(Window.partitionBy(key, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    hit = g.filter(F.col("_q") & (F.col("_run") == runs))
    return hit.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_q", "_g", "_run", "_n")
