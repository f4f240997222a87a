"""The stream engine end to end: scored windows through gates and thresholds to incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlake.core import ordered_fold
from modlake.functions.labels import cascade_decision
from modlake.operators.incidents import display_level, incident_rollup, merge_incidents
from modlake.operators.validation import degenerate_text


def text_step(t: str, every: float, rate: float):
    """Whether a window's text counts, and the smoothed risk.

    Text counts on a window that passed its gates, at least ``every`` seconds after the last one transcribed; one that
    was transcribed starts the next wait even if its transcript is then thrown away.
    """
    def step(state: dict, row: dict) -> tuple[dict, dict]:
        last, ema = state.get("last"), state.get("ema", 0.0)
        heard = bool(row["gates"]) and (last is None or row[t] - last >= every)
        known = lambda x: x is not None and x == x
        text = row["text"] if heard and row["usable"] and known(row["text"]) else None
        base = max(row["acoustic"] if known(row["acoustic"]) else 0.0, text or 0.0)
        ema = (1 - rate) * ema + rate * base
        return {"last": row[t] if heard else last, "ema": ema}, {"text_used": text, "heard": heard, "risk": ema}

    return step


def with_gates(df: DataFrame, rms_least: float) -> DataFrame:
    """``df`` with gates (loud enough, and speech) and usable (a transcript that isn't blank or a loop). Null fails a gate."""
    gates = F.coalesce((F.col("rms") >= rms_least) & F.col("speech"), F.lit(False))
    usable = (F.trim(F.coalesce("transcript", F.lit(""))) != "") & ~degenerate_text("transcript")
    return df.withColumns({"gates": gates, "usable": usable})


def moderate(df: DataFrame, key: str, order: list[str], t: str = "t", rms_least: float = 0.01, every: float = 4.0, rate: float = 0.4, thresholds: dict[str, float] | None = None, gap: float = 6.0) -> DataFrame:
    """``df`` (key, t, acoustic, text, transcript, rms, speech) with text_used, heard, risk, reasons, escalate, level and incident.

    Gates go from cheap to dear: level, speech, the wait between transcripts; then a looping transcript loses its score.
    ``incident`` numbers a stream's escalating windows; rows that don't escalate have null. Null scores count as not run.
    """
    limits = {"gate": 0.0, **(thresholds or {"acoustic": 0.5, "text": 0.5})}
    x = with_gates(df, rms_least)
    x = ordered_fold(x, key, order, text_step(t, every, rate), {}, "text_used double, heard boolean, risk double", [t, "gates", "usable", "text", "acoustic"])
    d = cascade_decision(F.lit(None), F.col("acoustic"), F.col("text_used"), limits, gate_on=False)
    x = x.withColumn("d", d).withColumn("reasons", F.col("d.reasons")).withColumn("escalate", F.col("d.escalate"))
    x = x.withColumn("level", display_level(F.col("acoustic"), F.col("escalate"), limits["acoustic"])).drop("d", "gates", "usable")
    return merge_incidents(x, key, t, "escalate", gap, order)


def incidents(windows: DataFrame, key: str, t: str = "t", window: float = 10.0) -> DataFrame:
    """The incidents of ``moderate``: one row each, with peaks, reasons and last transcripts."""
    return incident_rollup(windows, key, t, window, "acoustic", "text_used", "reasons", "transcript")
