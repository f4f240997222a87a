"""Interval algebra over rows (key, start, end), half-open, and spans from frame scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlake.core import ordered_fold


def merge_spans(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """key, start, end: the union. Touching spans merge, empty or reversed ones go, negatives are cut at 0."""
    s, e = F.greatest(F.col(start), F.lit(0)), F.greatest(F.col(end), F.lit(0))
    ok = df.select(key, s.alias("start"), e.alias("end")).filter("end > start")
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = ok.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = new.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def spans_from_scores(df: DataFrame, key: str, pos: str, score: str, length: DataFrame | None = None, threshold: float = 0.5, drop: float = 0.15, min_silence: float = 0.0, min_speech: float = 0.0, pad: float = 0.0, hop: float = 1.0) -> DataFrame:
    """key, start, end: spans by hysteresis over frames at ``pos``.

    A span begins at a score of at least the threshold and ends at the first low score (below threshold - drop, at
    least .01) of a stretch of ``min_silence`` without a new high. An open tail ends with the stream: ``length`` (key,
    length), else its last frame plus ``hop``. Short spans go, the rest is padded and merged.
    """
    low = max(threshold - drop, 0.01)
    w = Window.partitionBy(key).orderBy(pos)
    h = df.select(key, F.col(pos).alias("p"), F.col(score).alias("s"))
    tails = length.select(key, F.col("length")) if length is not None else h.groupBy(key).agg((F.max("p") + hop).alias("length"))
    w = Window.partitionBy(key).orderBy("p")
    h = h.withColumn("h", F.sum(F.when(F.col("s") >= threshold, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("h > 0")
    is_low = F.when(F.col("s") < low, F.col("p"))
    g = h.groupBy(key, "h").agg(F.min("p").alias("start"), F.min(is_low).alias("lo"), F.max(is_low).alias("hi"))
    g = g.withColumn("closed", F.coalesce(F.col("lo").isNotNull() & (F.col("hi") - F.col("lo") >= min_silence), F.lit(False)))
    o = Window.partitionBy(key).orderBy("h")
    g = g.withColumn("n", F.sum(F.when(F.coalesce(F.lag("closed").over(o), F.lit(True)), 1).otherwise(0)).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    spans = g.groupBy(key, "n").agg(F.min("start").alias("start"), F.max(F.when(F.col("closed"), F.col("lo"))).alias("lo"))
    spans = spans.join(tails, key).select(key, "start", F.coalesce("lo", "length").alias("end"), "length").filter(F.col("end") - F.col("start") >= min_speech)
    padded = spans.select(key, F.greatest(F.col("start") - pad, F.lit(0)).alias("start"), F.least(F.col("end") + pad, F.col("length")).alias("end"))
    return merge_spans(padded, key)


def group_step(start: str, end: str, max_gap: float, cut: float, flush: float):
    """The pieces of a span, each with the number of its group: spans are cut where a group is full, and a group ends
    when it is full, after a span that brings it to ``flush``, or before a gap of over ``max_gap``."""
    def step(state: dict, row: dict) -> tuple[dict, dict | None]:
        a, z = row[start], row[end]
        if a is None or z is None or z <= max(a, 0):
            return state, None
        a = max(a, 0)
        n, voiced, before = state.get("n", 0), state.get("voiced", 0.0), state.get("end")
        out = {"groups": [], "starts": [], "ends": []}
        if before is not None and a - before > max_gap and voiced:
            n, voiced = n + 1, 0.0
        while a < z:
            upto = min(z, a + cut - voiced)
            out["groups"].append(n), out["starts"].append(float(a)), out["ends"].append(float(upto))
            voiced += upto - a
            a = upto
            if voiced >= cut - 1e-9:
                n, voiced = n + 1, 0.0
        if voiced >= flush:
            n, voiced = n + 1, 0.0
        return {"n": n, "voiced": voiced, "end": z}, out

    return step


def group_spans(df: DataFrame, key: str, start: str = "start", end: str = "end", max_gap: float = 1.5, cut: float = 5.0, flush: float = 2.0) -> DataFrame:
    """key, group, start, end, voiced, spans (pieces), ready (voiced >= flush): spans packed in order. Empty and null spans go."""
    slim = df.select(key, start, end)
    pieces = ordered_fold(slim, key, [start, end], group_step(start, end, max_gap, cut, flush), {}, "groups array<int>, starts array<double>, ends array<double>", [start, end])
    x = pieces.select(key, F.explode(F.arrays_zip("groups", "starts", "ends")).alias("x")).select(key, F.col("x.groups").alias("group"), F.col("x.starts").alias("s"), F.col("x.ends").alias("e"))
    out = x.groupBy(key, "group").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.sum(F.col("e") - F.col("s")).alias("voiced"), F.count("*").alias("spans"))
    return out.withColumn("ready", F.col("voiced") >= flush - 1e-9)


def span_seconds(df: DataFrame, key: str, rate: float = 1.0) -> DataFrame:
    return df.groupBy(key).agg((F.sum(F.col("end") - F.col("start")) / rate).alias("seconds"))


def spans_in_windows(spans: DataFrame, windows: DataFrame, key: str, width: float) -> DataFrame:
    """Spans with each window (key, w_start, w_end) that they overlap, as often as rows repeat: an equi-join on dyadic buckets.

    A row's level is the smallest L at which a bucket of ``width`` times 2^L is as long as the row, so it touches a few buckets of that
    size, however long it is. A pair meets at the larger of its two levels, in the bucket where the later of the two starts: once.
    A row stands at its own level and at the larger ones that the other table has, at most some 60. Null ends meet nothing.
    """
    level = lambda a, z: F.greatest(F.ceil(F.log2(F.abs(F.col(z) - F.col(a)) / width)), F.lit(0)).cast("int")
    s, v = spans.withColumn("_l", level("start", "end")), windows.withColumn("_l", level("w_start", "w_end"))
    levels = [sorted(r[0] for r in x.select("_l").filter("_l is not null").distinct().collect()) for x in (s, v)]

    def dealt(x: DataFrame, a: str, z: str, others: list[int], own: str) -> DataFrame:
        up = F.filter(F.lit(others).cast("array<int>"), lambda n: n > F.col("_l")) if others else F.lit([]).cast("array<int>")
        x = x.withColumn("_at", F.explode(F.concat(F.array("_l"), up)))
        size = F.lit(width) * F.pow(F.lit(2.0), F.col("_at"))
        b = lambda c: F.floor(F.col(c) / size)
        return x.withColumn("_b", F.explode(F.sequence(b(a), b(z)))).withColumnRenamed("_l", own)

    size = F.lit(width) * F.pow(F.lit(2.0), F.col("_at"))
    first = F.floor(F.greatest("start", "w_start") / size)
    pairs = dealt(s, "start", "end", levels[1], "_ls").join(dealt(v, "w_start", "w_end", levels[0], "_lv"), [key, "_at", "_b"])
    hit = pairs.filter((F.col("start") < F.col("w_end")) & (F.col("w_start") < F.col("end")) & (F.col("_at") == F.greatest("_ls", "_lv")) & (F.col("_b") == first))
    return hit.drop("_b", "_at", "_ls", "_lv")


def voice_activity(frames: DataFrame, samples: str, floor_db: float = -50.0) -> DataFrame:
    """``frames`` with db and active: root mean square of each sample array against the floor."""
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.greatest(F.size(samples), F.lit(1))
    db = F.when(mean > 0, 10 * F.log10(mean)).otherwise(F.lit(float("-inf")))
    return frames.withColumn("db", db).withColumn("active", F.col("db") > floor_db)


def compact_audible(df: DataFrame, key: str, pos: str, active: str, hop: float, fill: float = 0.28, least: float = 0.16, pad: float = 0.12) -> tuple[DataFrame, DataFrame]:
    """Audible spans of active frames, and kept and removed seconds of each stream.

    Pauses up to ``fill``, leading and trailing ones too, are filled; then shorter runs than ``least`` go; the rest is padded and merged.
    """
    w = Window.partitionBy(key).orderBy("p")

    def runs(x: DataFrame) -> DataFrame:
        changed = F.when(F.lag("a").over(w) == F.col("a"), 0).otherwise(1)
        x = x.withColumn("c", changed)
        return x.withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("c")

    x = runs(df.select(key, F.col(pos).alias("p"), F.coalesce(F.col(active), F.lit(False)).alias("a")))
    length = F.count("*").over(Window.partitionBy(key, "run")) * F.lit(hop)
    x = x.withColumn("a", F.col("a") | (length <= fill + 1e-9)).drop("run")
    x = runs(x)
    keep = x.filter("a").groupBy(key, "run").agg(F.min("p").alias("start"), (F.max("p") + hop).alias("end")).filter(F.col("end") - F.col("start") >= least - 1e-9)
    ends = x.groupBy(key).agg((F.max("p") + hop).alias("length"))
    padded = keep.join(ends, key).select(key, F.greatest(F.lit(0.0), F.col("start") - pad).alias("start"), F.least(F.col("length"), F.col("end") + pad).alias("end"))
    spans = merge_spans(padded, key)
    kept = spans.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("kept_seconds"))
    report = ends.join(kept, key, "left").select(key, F.coalesce("kept_seconds", F.lit(0.0)).alias("kept_seconds"), (F.col("length") - F.coalesce("kept_seconds", F.lit(0.0))).alias("removed_seconds"))
    return spans, report
