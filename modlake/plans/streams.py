"""Queries over event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from modlake.core import shared_dir
from modlake.functions import labels as L
from modlake.operators import incidents as I
from modlake.operators import spans as S
from modlake.plans.base import WINDOWS, query, r6, windows
from modlake.streaming import engine as E
from modlake.streaming import live

GAP = 3600.0 * 6
_INCIDENTS = f"""{WINDOWS}, a AS (
  SELECT *, lag(t) OVER o AS prev, last_value(CASE WHEN esc THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
  FROM w WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CASE WHEN esc AND (last IS NULL OR (prev > last AND prev - last >= {GAP})) THEN 1 ELSE 0 END AS new FROM a),
c AS (SELECT *, CASE WHEN esc THEN sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS incident FROM b)"""


def _incidents(spark, d):
    return I.merge_incidents(windows(spark, d), "user_id", "t", "esc", GAP, ["ts", "event_id"])


@query(f"WITH {_INCIDENTS} SELECT user_id, incident::BIGINT AS incident, round(min(t), 6) AS start, round(max(t) + 10, 6) AS \"end\", count(*) AS windows, round(max(score), 6) AS peak_score FROM c WHERE incident IS NOT NULL GROUP BY 1, 2")
def merge_incidents(spark, d):
    """Incidents of each user's error events."""
    x = I.incident_rollup(_incidents(spark, d).withColumn("text", F.lit(None).cast("double")), "user_id", "t", 10.0, "score", "text")
    return x.select("user_id", F.col("incident").cast("long").alias("incident"), r6("start").alias("start"), r6("end").alias("end"), "windows", r6("peak_score").alias("peak_score"))


@query(f"""WITH {_INCIDENTS}, m AS (SELECT *, event_type || (event_id % 7)::VARCHAR AS said FROM c WHERE incident IS NOT NULL),
u AS (SELECT user_id, incident, said, max(t) AS mt FROM m GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY user_id, incident ORDER BY mt DESC) AS k FROM u)
SELECT m.user_id, m.incident::BIGINT AS incident, round(arg_max(t, struct_pack(s := score, t := -t)), 6) AS best_t, 'error' AS reasons, any_value(x.transcripts) AS transcripts, round(max(t) + 10 - min(t), 6) AS duration
FROM m JOIN (SELECT user_id, incident, string_agg(said, '/' ORDER BY mt) AS transcripts FROM v WHERE k <= 5 GROUP BY ALL) x ON x.user_id = m.user_id AND x.incident = m.incident GROUP BY 1, 2""")
def incident_rollup(spark, d):
    """Incidents with reasons, their best window and last transcripts."""
    x = _incidents(spark, d).withColumn("text", F.lit(None).cast("double")).withColumn("reasons", F.array("event_type")).withColumn("said", F.concat("event_type", F.col("event_id") % 7))
    out = I.incident_rollup(x, "user_id", "t", 10.0, "score", "text", "reasons", "said")
    return out.select("user_id", F.col("incident").cast("long").alias("incident"), r6("best_t").alias("best_t"), F.array_join("reasons", "/").alias("reasons"), F.array_join("transcripts", "/").alias("transcripts"), r6("duration").alias("duration"))


@query(f"WITH {_INCIDENTS} SELECT user_id, count(*) AS windows, count(*) FILTER (esc) AS escalations, coalesce(max(incident), 0)::BIGINT AS incidents FROM c GROUP BY 1")
def stream_stats(spark, d):
    return I.stream_stats(_incidents(spark, d), "user_id", "esc").withColumn("incidents", F.col("incidents").cast("long"))


@query(f"WITH {WINDOWS} SELECT user_id, event_id, round(score, 6) AS score FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) <= 12")
def snapshot(spark, d):
    return I.snapshot(windows(spark, d), "user_id", "t", 12, "event_id").select("user_id", "event_id", r6("score").alias("score"))


def _fold(columns: str, first: str, rest: str, out: str) -> str:
    """A recursive CTE over the rows of each user in order: ``first`` for the first row, ``rest`` from p (before) and n (now)."""
    return f"""WITH RECURSIVE {WINDOWS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM w),
f AS (SELECT n.user_id, n.event_id, n.rn, n.score, n.t, {first} FROM n WHERE rn = 1
  UNION ALL SELECT n.user_id, n.event_id, n.rn, n.score, n.t, {rest} FROM f p JOIN n ON n.user_id = p.user_id AND n.rn = p.rn + 1)
SELECT {out} FROM f"""


@query(_fold("ema", "n.score AS ema", "0.7 * p.ema + 0.3 * n.score", "user_id, event_id, round(ema, 6) AS smoothed"))
def ema_risk(spark, d):
    return I.ema_risk(windows(spark, d).drop("props"), "user_id", ["ts", "event_id"], "score").select("user_id", "event_id", r6("smoothed").alias("smoothed"))


@query(_fold("ema", "0.4 * n.score AS ema", "0.6 * p.ema + 0.4 * n.score", "user_id, event_id, round(ema, 6) AS display"))
def ema_display(spark, d):
    x = windows(spark, d).drop("props").withColumn("text", F.lit(None).cast("double"))
    return I.ema_display(x, "user_id", ["ts", "event_id"], "score", "text").select("user_id", "event_id", r6("display").alias("display"))


_LEVELS = f"{WINDOWS}, l AS (SELECT *, CASE WHEN score >= .9 THEN 'block' WHEN score >= .2 THEN 'warn' ELSE 'safe' END AS level FROM w), g AS (SELECT *, sum(CASE WHEN level <> 'warn' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM l), r AS (SELECT *, sum(CASE WHEN level = 'warn' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)"


@query(f"WITH {_LEVELS} SELECT user_id, event_id, level, run::BIGINT AS consecutive_warns, CASE WHEN level = 'block' OR run >= 3 THEN 'block' ELSE level END AS final_level, CASE WHEN level = 'safe' THEN 5.0 ELSE 2.5 END::DOUBLE AS stride FROM r")
def warn_escalation(spark, d):
    x = windows(spark, d).withColumn("level", I.risk_level("score", 0.2, 0.9))
    return I.warn_escalation(x, "user_id", ["ts", "event_id"], "level").select("user_id", "event_id", "level", F.col("consecutive_warns").cast("long").alias("consecutive_warns"), "final_level", "stride")


DUTY = 3600.0 * 4


@query(_fold("last, kept", "n.t AS last, true AS kept", f"CASE WHEN n.t - p.last >= {DUTY} THEN n.t ELSE p.last END, n.t - p.last >= {DUTY}", "user_id, event_id") + " WHERE kept")
def duty_cycle(spark, d):
    return I.duty_cycle(windows(spark, d).drop("props"), "user_id", ["ts", "event_id"], "t", DUTY).select("user_id", "event_id")


@query(_fold("last, kept, fresh", "n.t AS last, true AS kept, 50000.0::DOUBLE AS fresh", f"CASE WHEN n.t - p.last >= {DUTY} THEN n.t ELSE p.last END, n.t - p.last >= {DUTY}, greatest(4.0, least(50000.0, n.t - p.last))", "user_id, event_id, round(fresh, 6) AS new_seconds") + " WHERE kept")
def new_audio_slice(spark, d):
    kept = I.duty_cycle(windows(spark, d).drop("props"), "user_id", ["ts", "event_id"], "t", DUTY)
    return I.new_audio_slice(kept, "user_id", "t", 50000.0).select("user_id", "event_id", r6("new_seconds").alias("new_seconds"))


@query(_fold("nxt, kept, stride", "n.t + CASE WHEN n.score >= .2 THEN 5000 ELSE 20000 END AS nxt, true AS kept, CASE WHEN n.score >= .2 THEN 5000.0 ELSE 20000.0 END::DOUBLE AS stride", "CASE WHEN n.t + 1e-9 >= p.nxt THEN n.t + CASE WHEN n.score >= .2 THEN 5000 ELSE 20000 END ELSE p.nxt END, n.t + 1e-9 >= p.nxt, CASE WHEN n.score >= .2 THEN 5000.0 ELSE 20000.0 END", "user_id, event_id, stride") + " WHERE kept")
def adaptive_windows(spark, d):
    from modlake.core import ordered_fold

    x = windows(spark, d).drop("props")
    return ordered_fold(x, "user_id", ["ts", "event_id"], I.adaptive_step("t", "score", 0.2, 20000.0, 5000.0), {}, "stride double", ["t", "score"]).select("user_id", "event_id", "stride")


@query(_fold(
    "mode, streak, decision",
    "CASE WHEN n.score >= .5 THEN 'own' ELSE 'unknown' END AS mode, CASE WHEN n.score <= .15 THEN 1 ELSE 0 END AS streak, CASE WHEN n.score >= .5 THEN 'accept' WHEN n.score <= .15 THEN 'pending' ELSE 'uncertain' END AS decision",
    """CASE WHEN n.score >= .5 THEN 'own' WHEN n.score <= .15 AND p.streak + 1 >= CASE p.mode WHEN 'own' THEN 3 ELSE 2 END THEN 'other' ELSE p.mode END, CASE WHEN n.score <= .15 THEN p.streak + 1 ELSE 0 END,
  CASE WHEN n.score >= .5 THEN 'accept' WHEN n.score > .15 THEN 'uncertain' WHEN p.streak + 1 >= CASE p.mode WHEN 'own' THEN 3 ELSE 2 END THEN 'suppress' ELSE 'pending' END""",
    "user_id, event_id, decision, decision <> 'suppress' AS selected, mode, streak::BIGINT AS streak"))
def language_policy(spark, d):
    x = windows(spark, d).drop("props").withColumn("voiced", F.lit(3.0))
    return I.language_policy(x, "user_id", ["ts", "event_id"], "score", "voiced").select("user_id", "event_id", "decision", "selected", "mode", F.col("streak").cast("long").alias("streak"))


@query(f"""WITH {WINDOWS}, s AS (SELECT DISTINCT to_timestamp((floor(epoch(ts) / 21600) - k) * 21600)::TIMESTAMP AS start FROM w, range(4) r(k))
SELECT user_id, start, start + INTERVAL 24 HOUR AS "end", count(*) AS n, round(sum(value), 6) AS covered_seconds FROM w JOIN s ON ts >= start AND ts < start + INTERVAL 24 HOUR GROUP BY ALL HAVING round(sum(value), 6) >= 60""")
def sliding_windows(spark, d):
    """Windows of a day, each six hours, whose covered seconds to six digits are 60 or more."""
    x = I.sliding_windows(windows(spark, d), "user_id", "ts", "24 hours", "6 hours", F.col("value"), 60.0)
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", r6("covered_seconds").alias("covered_seconds"))


@query(f"""WITH {WINDOWS}, q AS (SELECT *, sum(CASE WHEN value >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM w),
r AS (SELECT *, sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT user_id, event_id FROM r WHERE value < 5 AND run = 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def silence_watchdog(spark, d):
    return I.silence_watchdog(windows(spark, d), "user_id", ["ts", "event_id"], "value", floor=5.0).select("user_id", "event_id")


@query(f"WITH {WINDOWS} SELECT coalesce(CASE WHEN NOT value >= 2 THEN 'rms' WHEN event_type = 'view' THEN 'speech' WHEN NOT score >= .05 THEN 'language' END, 'scored') AS skip_reason, count(*) AS n FROM w GROUP BY 1")
def gate_order(spark, d):
    reason = I.gate_order([("rms", F.col("value") >= 2), ("speech", F.col("event_type") != "view"), ("language", F.col("score") >= 0.05)])
    return windows(spark, d).groupBy(F.coalesce(reason, F.lit("scored")).alias("skip_reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {WINDOWS} SELECT event_id, score >= .1 AS passed, concat_ws('+', CASE WHEN score >= .1 AND score >= .6 THEN 'acoustic' END, CASE WHEN value % 1 >= .5 THEN 'text' END) AS reasons,
  CASE WHEN (score >= .1 AND score >= .6) OR value % 1 >= .5 THEN 'alert' WHEN score >= .6 * .6 THEN 'watch' ELSE 'ok' END AS display FROM w""")
def cascade_decision(spark, d):
    w = windows(spark, d)
    c = L.cascade_decision(F.col("score"), F.col("score"), F.col("value") % 1, {"gate": 0.1, "acoustic": 0.6, "text": 0.5})
    return w.select("event_id", "score", c.alias("c")).select("event_id", F.col("c.passed").alias("passed"), F.array_join("c.reasons", "+").alias("reasons"), I.display_level(F.col("score"), F.col("c.escalate"), 0.6).alias("display"))


@query("""WITH s AS (SELECT user_id, greatest(epoch_us(ts) / 1000000 - 1704067200, 0) AS s, greatest(epoch_us(ts) / 1000000 - 1704067200 + value * 600, 0) AS e FROM events),
a AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE e > s),
b AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM a)
SELECT user_id, round(min(s), 6) AS start, round(max(e), 6) AS "end" FROM b GROUP BY user_id, i""")
def merge_spans(spark, d):
    return S.merge_spans(_spans(spark, d), "user_id").select("user_id", r6("start").alias("start"), r6("end").alias("end"))


def _spans(spark, d):
    t = F.col("t") - 1704067200
    return windows(spark, d).select("user_id", t.alias("start"), (t + F.col("value") * 600).alias("end"))


@query("""WITH s AS (SELECT user_id, epoch_us(ts) / 1000000 - 1704067200 AS s, value * 600 AS v FROM events WHERE value > 0) SELECT user_id, round(sum(v) / 60, 4) AS seconds FROM s GROUP BY 1""")
def span_seconds(spark, d):
    return S.span_seconds(_spans(spark, d).filter("end > start"), "user_id", 60.0).select("user_id", F.round("seconds", 4).alias("seconds"))


_FRAMES = """h0 AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 512 AS p, value / 100 AS s FROM events),
h AS (SELECT *, sum(CASE WHEN s >= .3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS h FROM h0),
g AS (SELECT user_id, h, min(p) AS start, min(CASE WHEN s < .15 THEN p END) AS lo, max(CASE WHEN s < .15 THEN p END) AS hi FROM h WHERE h > 0 GROUP BY 1, 2),
c AS (SELECT *, coalesce(lo IS NOT NULL AND hi - lo >= 1024, false) AS closed FROM g),
n AS (SELECT *, sum(CASE WHEN coalesce(prev, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY h ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT *, lag(closed) OVER (PARTITION BY user_id ORDER BY h) AS prev FROM c)),
l AS (SELECT user_id, max(p) + 512 AS length FROM h0 GROUP BY 1),
x AS (SELECT user_id, min(start) AS s, max(CASE WHEN closed THEN lo END) AS lo FROM n GROUP BY user_id, n),
y AS (SELECT user_id, greatest(s - 256, 0) AS s, least(coalesce(lo, length) + 256, length) AS e FROM x JOIN l USING (user_id) WHERE coalesce(lo, length) - s >= 1024),
z AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y),
q AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM z)"""


@query(f"WITH {_FRAMES} SELECT user_id, min(s)::BIGINT AS start, max(e)::BIGINT AS \"end\" FROM q GROUP BY user_id, i")
def spans_from_scores(spark, d):
    p = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) * 512
    x = windows(spark, d).select("user_id", p.alias("p"), (F.col("value") / 100).alias("s"))
    out = S.spans_from_scores(x, "user_id", "p", "s", None, 0.3, 0.15, 1024, 1024, 256, 512)
    return out.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""WITH RECURSIVE s AS (SELECT user_id, greatest(epoch_us(ts) / 1000000 - 1704067200, 0) AS s, epoch_us(ts) / 1000000 - 1704067200 + value * 600 AS e FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e) AS rn FROM s WHERE e > s),
f AS (SELECT user_id, rn, s, e, 0::DOUBLE AS v, 0::BIGINT AS g, e - s AS total FROM n WHERE rn = 1
  UNION ALL SELECT user_id, rn, s, e, CASE WHEN open THEN rest ELSE 0 END, done + CASE WHEN open OR rest = 0 THEN 0 ELSE 1 END, CASE WHEN open THEN rest ELSE 0 END + e - s FROM (
    SELECT n.*, p.g + floor((p.total + 1e-9) / 9000)::BIGINT AS done, CASE WHEN p.total - floor((p.total + 1e-9) / 9000) * 9000 < 1e-6 THEN 0 ELSE p.total - floor((p.total + 1e-9) / 9000) * 9000 END AS rest,
      p.total - floor((p.total + 1e-9) / 9000) * 9000 < 4000 AND n.s - p.e <= 7200 AS open FROM f p JOIN n ON n.user_id = p.user_id AND n.rn = p.rn + 1)),
x AS (SELECT user_id, g + j AS g, greatest(s, s - v + j * 9000) AS a, least(e, s - v + (j + 1) * 9000) AS z FROM (SELECT *, unnest(range(0, greatest(1, ceil((total - 1e-6) / 9000)::BIGINT))) AS j FROM f))
SELECT user_id, g::INT AS "group", round(min(a), 4) AS start, round(max(z), 4) AS "end", round(sum(z - a), 4) AS voiced, count(*) AS spans, sum(z - a) >= 4000 - 1e-9 AS ready FROM x GROUP BY 1, 2""")
def group_spans(spark, d):
    """Every user's spans packed into groups: cut at 9,000 seconds, ended after a span from 4,000 on, or at a gap."""
    out = S.group_spans(_spans(spark, d), "user_id", max_gap=7200.0, cut=9000.0, flush=4000.0)
    return out.select("user_id", "group", *[F.round(c, 4).alias(c) for c in ("start", "end", "voiced")], "spans", "ready")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) / 1000000 - 1704067200 AS s, epoch_us(ts) / 1000000 - 1704067200 + value * 600 AS e FROM events),
b AS (SELECT user_id, floor(min(s) / 43200)::BIGINT AS lo, floor(max(s) / 43200)::BIGINT AS hi FROM s GROUP BY 1),
w AS (SELECT user_id, unnest(range(lo, hi + 1)) * 43200 AS ws FROM b)
SELECT user_id, ws::BIGINT AS w_start, count(*) AS spans FROM s JOIN w USING (user_id) WHERE e > s AND s < ws + 43200 AND ws < e GROUP BY 1, 2""")
def spans_in_windows(spark, d):
    """Spans in each half day from a user's first event to the last."""
    at = F.floor((F.col("t") - 1704067200) / 43200)
    w = windows(spark, d).groupBy("user_id").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).select("user_id", F.explode(F.sequence("lo", "hi")).alias("k"))
    w = w.select("user_id", (F.col("k") * 43200).alias("w_start"), ((F.col("k") + 1) * 43200).alias("w_end"))
    return S.spans_in_windows(_spans(spark, d).filter("end > start"), w, "user_id", 43200.0).groupBy("user_id", F.col("w_start").cast("long").alias("w_start")).agg(F.count("*").alias("spans"))


# windows of the engine: acoustic and text scores, a transcript that may loop, level and speech gate
_RAW = f"""{WINDOWS}, raw AS (SELECT *, value % 1 AS said, value >= 2 AND event_type <> 'view' AS gates, event_id % 5 <> 0 AND event_id % 7 <> 0 AS usable FROM w), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM raw)"""
_USED = lambda p: f"CASE WHEN n.gates AND {p} THEN CASE WHEN n.usable THEN n.said END END"
_WAIT = "(p.last IS NULL OR n.t - p.last >= 14400)"
_ENGINE = f"""WITH RECURSIVE {_RAW}, f AS (SELECT n.user_id, n.event_id, n.rn, n.t, n.score, CASE WHEN n.gates THEN n.t END AS last, {_USED('true')} AS used, .4 * greatest(n.score, coalesce({_USED('true')}, 0)) AS risk FROM n WHERE rn = 1
  UNION ALL SELECT n.user_id, n.event_id, n.rn, n.t, n.score, CASE WHEN n.gates AND {_WAIT} THEN n.t ELSE p.last END, {_USED(_WAIT)}, .6 * p.risk + .4 * greatest(n.score, coalesce({_USED(_WAIT)}, 0)) FROM f p JOIN n ON n.user_id = p.user_id AND n.rn = p.rn + 1),
w2 AS (SELECT *, score >= .6 OR coalesce(used >= .7, false) AS esc FROM f),
a AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY rn) AS prev, last_value(CASE WHEN esc THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w2),
c AS (SELECT *, CASE WHEN esc THEN sum(CASE WHEN esc AND (before IS NULL OR (prev > before AND prev - before >= {GAP})) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) END AS incident FROM a)"""


def _heard(spark, d):
    w, i = windows(spark, d).drop("props"), F.col("event_id")
    said = F.when(i % 5 == 0, "").when(i % 7 == 0, "go go go go go go").otherwise(F.concat(F.lit("we heard event "), i))
    return w.select("user_id", "event_id", "ts", "t", F.col("score").alias("acoustic"), (F.col("value") % 1).alias("text"), said.alias("transcript"), F.col("value").alias("rms"), (F.col("event_type") != "view").alias("speech"))


def _engine(spark, d):
    return E.moderate(_heard(spark, d), "user_id", ["ts", "event_id"], "t", 2.0, 14400.0, 0.4, {"acoustic": 0.6, "text": 0.7}, GAP)


_MODERATED = _ENGINE + """ SELECT user_id, event_id, round(used, 6) AS text_used, round(risk, 6) AS risk, concat_ws('+', CASE WHEN score >= .6 THEN 'acoustic' END, CASE WHEN used >= .7 THEN 'text' END) AS reasons,
  CASE WHEN esc THEN 'alert' WHEN score >= .36 THEN 'watch' ELSE 'ok' END AS level, incident::BIGINT AS incident FROM c"""
_ENDED = _ENGINE + " SELECT user_id, incident::BIGINT AS incident, round(min(t), 6) AS start, round(max(t) + 10, 6) AS \"end\", count(*) AS windows, round(max(score), 6) AS peak_acoustic, round(max(used), 6) AS peak_text FROM c WHERE incident IS NOT NULL GROUP BY 1, 2"


def _moderated(x):
    return x.select("user_id", "event_id", r6("text_used").alias("text_used"), r6("risk").alias("risk"), F.array_join("reasons", "+").alias("reasons"), "level", F.col("incident").cast("long").alias("incident"))


def _ended(x):
    return x.select("user_id", F.col("incident").cast("long").alias("incident"), *[r6(c).alias(c) for c in ("start", "end")], "windows", r6("peak_acoustic").alias("peak_acoustic"), r6("peak_text").alias("peak_text"))


@query(_MODERATED)
def moderate_stream(spark, d):
    """Every window through gates, thresholds, smoothing and incident numbers."""
    return _moderated(_engine(spark, d))


@query(_ENDED)
def moderate_incidents(spark, d):
    """The incidents that come out of the same engine."""
    return _ended(E.incidents(_engine(spark, d), "user_id"))


#: A silence that no stream of the tables has; a row past it ends them all.
SILENCE = 86400.0 * 3650


def _live(spark, d):
    """The same windows as a stream: three parts that arrive one after the other, and a last row that moves the watermark past all of them.

    Each run stops when it has read what is there, and the next one goes on from its checkpoint.
    """
    x = _heard(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("end", F.lit(False))
    at = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    landing = f"{at}/landing"
    low, high = x.agg(F.min("ts"), F.max("ts")).first()
    parts = [x.filter(F.least(F.floor((F.col("t") - F.lit(low.timestamp())) / max((high - low).total_seconds() / 3, 1.0)), F.lit(2)) == k) for k in range(3)] if high else []
    last = x.limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in x.schema.fields])
    if high:
        after = spark.range(1).select(F.timestamp_seconds(F.lit(high.timestamp() + SILENCE + 86400.0)).alias("ts"), F.lit(True).alias("end"))
        last = after.select(*[F.col(f.name) if f.name in ("ts", "end") else F.lit(None).cast(f.dataType).alias(f.name) for f in x.schema.fields])
    for part in (*parts, last):
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(x.schema).parquet(landing)
        out = live.moderate(stream, "user_id", ["ts", "event_id"], "ts", "t", "1 hour", 2.0, 14400.0, 0.4, {"acoustic": 0.6, "text": 0.7}, GAP, idle=SILENCE)
        live.run(spark, out, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query(_MODERATED)
def moderate_live(spark, d):
    """The windows of moderate_stream by the stateful stream, stopped and started again."""
    return _moderated(live.windows(_live(spark, d)))


@query(_ENDED)
def incidents_live(spark, d):
    """The incidents of moderate_incidents as the stream closes them."""
    return _ended(live.incidents(_live(spark, d), "user_id"))
