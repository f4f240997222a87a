"""Queries of sources and sinks: the given tables written in a format to the shared folder and read back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from modlake.core import shared_dir
from modlake.functions import labels as L
from modlake.operators import collections as C
from modlake.operators import joins as J
from modlake.operators import signal as G
from modlake.operators import validation as V
from modlake.plans.base import query, r6, table, windows
from modlake.sources import formats
from modlake.sources import manifests as R
from modlake.streaming import keyed


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLIP = """SELECT 'c' || doc_id AS clip_id, source AS source_id, (doc_id % 7)::DOUBLE AS start_sec, lang AS label, doc_id % 3 = 0 AS flagged FROM documents"""


@query(_CLIP)
def clip_manifest(spark, d):
    """Documents as a clip manifest of JSON lines: written, read and validated."""
    i, none = F.col("doc_id"), F.lit(None)
    rows = table(spark, d, "documents").select(
        F.concat(F.lit("c"), i).alias("clip_id"), F.lit("pool").alias("source"), F.col("source").alias("source_id"), (i % 7).cast("double").alias("start_sec"), F.lit(10.0).alias("duration"), F.array("lang").alias("labels"),
        F.lit("weak").alias("label_confidence"), F.lit("train").alias("split"), none.cast("string").alias("annotator"), none.cast("double").alias("snr_est"), F.when(i % 3 == 0, True).alias("flagged"))
    R.write_clip_manifest(rows, at := _place(spark, "clips"))
    return R.load_clip_manifest(spark, at, ["en", "de", "fr", "es"]).select("clip_id", "source_id", "start_sec", F.get("labels", F.lit(0)).alias("label"), "flagged")


@query("""WITH g AS (SELECT l_orderkey AS k, list_distinct(list(l_returnflag || l_linestatus)) AS m FROM lineitem GROUP BY 1) SELECT 'o' || k || '_30' AS clip_id, CASE WHEN list_contains(m, 'NO') THEN CASE WHEN list_contains(m, 'RF') THEN 'fight,open' ELSE 'open' END ELSE 'fight' END AS labels, 10.0::DOUBLE AS duration
FROM g WHERE list_contains(m, 'NO') OR list_contains(m, 'RF')""")
def segments_csv(spark, d):
    """Orders as segment lines of a CSV with comments and quoted labels, read and made a manifest."""
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_set(F.concat("l_returnflag", "l_linestatus")), ",").alias("m"))
    lines = m.select(F.concat(F.lit("o"), F.col("l_orderkey"), F.lit(', 30.000, 40.000, "'), F.col("m"), F.lit('"')).alias("value"))
    spark.createDataFrame([("# segments",), ("# id, start, end, labels",)], "value string").unionByName(lines).write.text(at := _place(spark, "segments"))
    to = spark.createDataFrame([("open", "NO"), ("fight", "RF")], "class string, mid string")
    out = R.build_manifest(spark, [at], to, _place(spark, "manifest"), "segments", "train")
    return out.select("clip_id", F.array_join("labels", ",").alias("labels"), "duration")


@query("SELECT l_orderkey AS order_id, l_linenumber * 1.0::DOUBLE AS start, l_linenumber + l_quantity::DOUBLE AS \"end\", l_returnflag || ',' || l_linestatus AS mids FROM lineitem WHERE l_linenumber >= 3 AND l_quantity > 10")
def segments_source(spark, d):
    """Lines of orders as segment lists, read by format name; the first bound is pushed to the source, the second is Spark's."""
    i = table(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("double")
    text = F.concat_ws(", ", "l_orderkey", n, n + F.col("l_quantity").cast("double"), F.concat(F.lit('"'), "l_returnflag", F.lit(", "), "l_linestatus", F.lit('"')))
    i.select(text.alias("value")).write.text(at := _place(spark, "segment-lists"))
    formats.register(spark)
    rows = spark.read.format("segments").load(at).filter("start >= 3 and end - start > 10")
    return rows.select(F.col("ytid").cast("long").alias("order_id"), "start", "end", F.array_join("mids", ",").alias("mids"))


@query("SELECT DISTINCT l_returnflag || l_linestatus AS mid, 'sound ' || l_returnflag || l_linestatus AS name FROM lineitem")
def ontology(spark, d):
    """Line states as an ontology document, read back."""
    x = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("id")).distinct().withColumn("name", F.concat(F.lit("sound "), F.col("id")))
    whole = x.agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value"))  # a document of a row for each state
    whole.write.text(at := _place(spark, "ontology"))
    return R.read_ontology(spark, at)


@query("SELECT 'a' || doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'heard ' || lang WHEN doc_id % 5 = 0 THEN '' ELSE 'said ' || lang END AS transcript, CASE WHEN doc_id % 4 = 0 THEN 'teacher' WHEN doc_id % 5 <> 0 THEN 'human' END AS transcript_source FROM documents")
def asr_manifest(spark, d):
    """Documents as a speech manifest of JSON lines, read with its checks."""
    i = F.col("doc_id")
    none = F.lit(None).cast("string")
    domain = F.when((i % 4 != 0) & (i % 5 == 0), "no_speech").otherwise("movie")
    rows = table(spark, d, "documents").select(
        F.concat(F.lit("a"), i).alias("id"), F.lit("x.wav").alias("audio"), F.when((i % 4 != 0) & (i % 5 != 0), F.concat(F.lit("said "), "lang")).otherwise(none).alias("text"),
        F.when(i % 4 == 0, F.concat(F.lit("heard "), "lang")).alias("teacher_text"), domain.alias("domain"), F.lit("train").alias("split"), F.col("source").alias("source_id"), F.array("lang").alias("harm_terms"))
    R.write_json_lines(rows, at := _place(spark, "asr"))
    return R.read_asr_manifest(spark, at).select("id", "transcript", "transcript_source")


@query("SELECT doc_id::VARCHAR AS clip_id, doc_id::INT AS rank, CASE WHEN doc_id % 2 = 0 THEN 'uncertain' ELSE 'false_positive' END AS kind, round((n_chars % 1000) / 1000.0, 6)::DOUBLE AS prob FROM documents")
def review_queue(spark, d):
    """Documents as a review queue of JSON lines, read back in rank order."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.cast("int").alias("rank"), i.cast("string").alias("clip_id"), F.when(i % 2 == 0, "uncertain").otherwise("false_positive").alias("kind"), F.lit("a").alias("predicted"), ((F.col("n_chars") % 1000) / 1000.0).alias("prob"), F.lit(0.5).alias("priority"), F.lit("a").alias("pseudo_label"))
    R.write_review_queue(rows, at := _place(spark, "queue"))
    return R.read_review_queue(spark, at).select("clip_id", "rank", "kind", r6("prob").alias("prob"))


@query("SELECT user_id::VARCHAR AS clip_id, arg_max(event_type, event_id) AS action, max(event_id)::BIGINT AS seq FROM events GROUP BY 1")
def decision_log(spark, d):
    """Events as decisions of JSON lines, of which the last one of each clip counts."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("clip_id"), F.col("event_type").alias("action"), F.lit("x").alias("label"), F.col("event_id").alias("seq"))
    R.save_decisions(rows, at := _place(spark, "decisions"))
    return R.load_decisions(spark, at).select("clip_id", "action", "seq")


def _stream(spark, rows):
    rows.write.parquet(at := _place(spark, "stream"))
    return spark.readStream.schema(rows.schema).parquet(at)


@query("SELECT event_id, round(least(value / 100, 1.0), 6) AS score FROM events")
def stream_results_sink(spark, d):
    """Every window through a stream into JSON results, read back."""
    rows = windows(spark, d).select("event_id", "score")
    at = _place(spark, "results")
    keyed.results_sink(_stream(spark, rows), at, _place(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(rows.schema).json(at).select("event_id", r6("score").alias("score"))


@query("""WITH w AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1000000 AS t, event_type = 'error' AS esc, least(value / 100, 1.0) AS score FROM events),
a AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS prev, last_value(CASE WHEN esc THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM w),
b AS (SELECT *, CASE WHEN esc THEN sum(CASE WHEN esc AND (last IS NULL OR (prev > last AND prev - last >= 21600)) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) END AS k, last_value(CASE WHEN esc THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS upto FROM a),
q AS (SELECT user_id, max(CASE WHEN NOT esc AND upto IS NOT NULL AND t - upto >= 21600 THEN upto END) AS closed FROM b GROUP BY 1)
SELECT b.user_id, round(min(t), 6) AS start, round(max(t) + 10, 6) AS "end", count(*) AS windows FROM b JOIN q ON q.user_id = b.user_id WHERE k IS NOT NULL GROUP BY b.user_id, k HAVING max(t) <= any_value(q.closed)""")
def incident_sink(spark, d):
    """The closed incidents of the event stream by keyed state, as the sink wrote them; open ones at its end aren't written."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):  # keyed state needs it; the setting is of the session
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = windows(spark, d).select("user_id", "t", F.col("esc").alias("escalate"), "score", F.array(F.lit("acoustic")).alias("reasons"))
    out = keyed.stream_incidents(_stream(spark, rows), "user_id", 21600.0)
    at = _place(spark, "incidents")
    keyed.incident_sink(out, at, _place(spark, "checkpoint")).awaitTermination()
    got = spark.read.schema("user_id long, start double, end double, windows long").json(f"{at}/batch=*")
    return got.select("user_id", r6("start").alias("start"), r6("end").alias("end"), "windows")


@query("SELECT event_id AS clip_id, octet_length(encode(props)) AS audio_bytes, (value::INT) AS degree FROM events")
def verdict_log(spark, d):
    """Requests joined with verdicts, bytes counted."""
    e = table(spark, d, "events")
    req = e.select(F.col("event_id").alias("clip_id"), F.encode("props", "UTF-8").alias("audio"))
    return R.verdict_log(req, e.select(F.col("event_id").alias("clip_id"), F.bround("value", 0).cast("int").alias("degree"))).select("clip_id", F.col("audio_bytes").cast("long").alias("audio_bytes"), "degree")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'a' WHEN 'de' THEN 'b' ELSE 'confusable' END AS category, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END::INT AS idx FROM documents")
def taxonomy(spark, d):
    """Categories of classes by the taxonomy table."""
    t = R.taxonomy_table(spark, {"a": ["en"], "b": ["de"]}, ["fr", "es"])
    x = L.category_of(table(spark, d, "documents").select("doc_id", F.col("lang").alias("class")), t)
    return J.lookup(x, t.select("class", "idx"), "class").select("doc_id", "category", "idx")


@query("SELECT event_id, CASE WHEN value / 100 >= .8 THEN 'block' WHEN value / 100 >= .2 THEN 'warn' ELSE 'safe' END AS level, value / 100 >= .6 AS acoustic FROM events")
def policy_and_threshold(spark, d):
    """Levels by the policy table and hits by the threshold table."""
    p = R.policy_table(spark, "v1", 0.2, 0.8, {"a": 1.0}).withColumn("on", F.lit(1))
    t = R.threshold_table(spark, 0.1, 0.6, 0.5).withColumn("on", F.lit(1))
    x = J.lookup(J.lookup(table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("s"), F.lit(1).alias("on")), p, "on"), t, "on")
    return x.select("event_id", F.when(F.col("s") >= F.col("block"), "block").when(F.col("s") >= F.col("warn"), "warn").otherwise("safe").alias("level"), (F.col("s") >= F.col("acoustic")).alias("acoustic"))


@query("SELECT doc_id, (round(least(1.0, CASE WHEN contains(lower(text), 'the') THEN .3 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN .9 ELSE 0 END) * .5, 4))::DOUBLE AS risk FROM documents")
def lexicon_table(spark, d):
    """A lexicon through its table form."""
    from modlake.functions import text as X

    lex = X.lexicon_from_table(R.lexicon_table(spark, {"a": (0.5, {"the": 0.3, "license": 0.9})}))
    return table(spark, d, "documents").select("doc_id", X.lexicon_score("text", lex)["risk"].alias("risk"))


@query("SELECT vec_id, 64 AS n, true AS same FROM embeddings")
def audio_files(spark, d):
    """Every vector as a 16-bit WAV, stored as bytes in the shared folder and read back within a step of 16 bits."""
    import io
    import wave

    import numpy as np

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    at = _place(spark, "audio")

    def wavs(frames):
        for f in frames:
            out = []
            for x in f["embedding"]:
                b = io.BytesIO()
                with wave.open(b, "wb") as w:
                    w.setparams((1, 2, 16000, 0, "NONE", ""))
                    w.writeframes(np.round(np.clip(np.asarray(x, float) / 8, -1, 1) * 32767).astype("<i2").tobytes())
                out.append(b.getvalue())
            yield pd.DataFrame({"path": f["vec_id"].astype(str), "modificationTime": pd.NaT, "content": out})

    schema = "path string, modificationTime timestamp, content binary"
    e.mapInPandas(wavs, schema).write.parquet(at)
    samples = R.audio_samples(spark.read.schema(schema).parquet(at)).select(F.col("path").cast("long").alias("vec_id"), "samples")
    diff = F.array_max(F.zip_with("samples", "embedding", lambda a, b: F.abs(a - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), b / 8)))))
    return samples.join(e, "vec_id").select("vec_id", F.size("samples").alias("n"), (diff < 1e-4).alias("same"))


@query("SELECT DISTINCT doc_id, lang, n_chars FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))")
def modified_before(spark, d):
    """Train rows whose files are old enough; other splits stay."""
    x = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("val").alias("split"))
    files = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("2024-02-01")).otherwise("2024-01-01").cast("timestamp").alias("modificationTime"))
    return V.modified_before(x, files, "2024-01-15", "doc_id").select("doc_id", "lang", "n_chars")


@query("SELECT DISTINCT event_type AS class FROM events WHERE event_type NOT IN ('error', 'click')")
def validate_weights(spark, d):
    """Event types with a weight that are no harm classes."""
    classes = spark.createDataFrame([("error", True), ("click", True), ("view", False)], "class string, is_harm boolean")
    return V.unknown_weights(table(spark, d, "events").select(F.col("event_type").alias("class")).distinct(), classes)


@query("SELECT conv_id, turn, md5(CASE WHEN turn = 0 THEN '' ELSE text END) AS said FROM (SELECT conv_id, turn, CASE WHEN turn = 0 THEN ' AudioText' ELSE text END AS text FROM conversations)")
def artifact_transcripts(spark, d):
    """Turns with the known garbage of a recogniser emptied."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, " AudioText").otherwise(F.col("text")).alias("text"))
    return t.select("conv_id", "turn", F.md5(V.artifact_transcript("text", ["audiotext"])).alias("said"))


@query("SELECT doc_id, 0 AS n FROM documents")
def clear_labels(spark, d):
    """Labels taken away."""
    return C.clear_labels(table(spark, d, "documents").select("doc_id", F.array("lang").alias("labels"))).select("doc_id", F.size("labels").alias("n"))


@query("SELECT doc_id, lang || '?' AS heard FROM documents")
def hypotheses_to_references(spark, d):
    """Each document with its hypothesis; one without would fail the job."""
    t = table(spark, d, "documents")
    return J.require(t.select("doc_id"), t.select("doc_id", F.concat("lang", F.lit("?")).alias("heard")), "doc_id")


@query("""WITH c AS (SELECT conv_id, turn, 1 + turn % 3 AS n FROM conversations), s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER (PARTITION BY conv_id) AS total FROM c)
SELECT conv_id, turn AS line, greatest(0, b - .25)::DOUBLE AS start, least(total, b + n + .25)::DOUBLE AS "end" FROM s""")
def align_lines_to_times(spark, d):
    """A line of one to three syllables for each turn, aligned to timings of a second each."""
    lines = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line"), F.repeat(F.lit("가"), (1 + F.col("turn") % 3).cast("int")).alias("text"))
    total = lines.groupBy("conv_id").agg(F.sum(F.length("text")).alias("total"))
    times = total.select("conv_id", F.col("total").cast("double").alias("duration"), F.explode(F.sequence(F.lit(0), (F.col("total") - 1).cast("int"))).alias("i")).select("conv_id", F.col("i").cast("long").alias("i"), F.col("i").cast("double").alias("start"), (F.col("i") + 1.0).alias("end"), "duration")
    return C.align_lines_to_times(lines, times, "conv_id", "duration").select("conv_id", "line", "start", "end")


@query("SELECT vec_id, 128 AS bins, 1 + 2048 // 320 AS frames, true AS finite, true AS score_in_range FROM embeddings")
def log_mel_and_speech_score(spark, d):
    """Shapes and ranges of features of every vector said 32 times; values are held against direct formulas in the tests."""
    x = table(spark, d, "embeddings").select("vec_id", F.flatten(F.array_repeat(F.col("embedding"), 32)).alias("x"))
    mel = G.log_mel(x, "vec_id", "x")
    ok = F.forall("feature", lambda r: F.forall(r, lambda v: ~F.isnan(v) & (F.abs(v) < 1e6)))
    score = G.speech_score(x, "vec_id", "x").select("vec_id", F.col("score").between(0, 1).alias("score_in_range"))
    return mel.select("vec_id", F.size("feature").alias("bins"), F.size(F.get("feature", F.lit(0))).cast("long").alias("frames"), ok.alias("finite")).join(score, "vec_id")


_MELS, _SIZE, _HOP = 3, 16, 8
_LOG_MEL = f"""WITH b AS (SELECT list_transform(range({_MELS + 2}), lambda i: 700 * (pow(10, (2595 * log10(1 + 50 / 700.0) + (2595 * log10(1 + 8000 / 700.0) - 2595 * log10(1 + 50 / 700.0)) * i / {_MELS + 1}) / 2595) - 1)) AS p),
x AS (SELECT vec_id, list_concat(list_reverse(embedding[2:{_SIZE // 2 + 1}]), embedding, list_reverse(embedding[len(embedding) - {_SIZE // 2}:len(embedding) - 1])) AS e, len(embedding) AS n FROM embeddings),
f AS (SELECT vec_id, t, list_transform(range({_SIZE}), lambda k: e[t * {_HOP} + k + 1]::DOUBLE * (.5 - .5 * cos(2 * pi() * k / {_SIZE}))) AS w FROM x, range(0, 1 + n // {_HOP}) r(t)),
s AS (SELECT vec_id, t, list_transform(range({_SIZE // 2 + 1}), lambda q: pow(list_sum(list_transform(range({_SIZE}), lambda k: w[k + 1] * cos(2 * pi() * q * k / {_SIZE}))), 2) + pow(list_sum(list_transform(range({_SIZE}), lambda k: w[k + 1] * sin(2 * pi() * q * k / {_SIZE}))), 2)) AS power FROM f)
SELECT vec_id, m::INT AS mel, t::INT AS frame, round(ln(list_sum(list_transform(range({_SIZE // 2 + 1}), lambda q: power[q + 1] * greatest(0, least((q * {16000 // _SIZE} - p[m + 1]) / (p[m + 2] - p[m + 1]), (p[m + 3] - q * {16000 // _SIZE}) / (p[m + 3] - p[m + 2]))))) + 1e-6)::FLOAT::DOUBLE, 4) AS value FROM s, b, range({_MELS}) r(m)"""


@query(_LOG_MEL)
def log_mel(spark, d):
    """Log-mel values of every vector as a signal of 64 samples: 3 bands over 9 mirrored frames of 16."""
    mel = G.log_mel(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 16000, _SIZE, _HOP, _MELS)
    rows = mel.select("vec_id", F.posexplode("feature").alias("mel", "row")).select("vec_id", "mel", F.posexplode("row").alias("frame", "v"))
    return rows.select("vec_id", "mel", "frame", F.round(F.col("v").cast("double"), 4).alias("value"))


_SPEECH = """WITH w AS (SELECT vec_id, list_transform(range(64), lambda k: (cos(2 * pi() * 5 * k / 64) + .02 * embedding[k + 1]::DOUBLE) * (.5 - .5 * cos(2 * pi() * k / 63))) AS w FROM embeddings),
b AS (SELECT vec_id, list_transform(range(33), lambda q: sqrt(pow(list_sum(list_transform(range(64), lambda k: w[k + 1] * cos(2 * pi() * q * k / 64))), 2) + pow(list_sum(list_transform(range(64), lambda k: w[k + 1] * sin(2 * pi() * q * k / 64))), 2))) AS b FROM w),
s AS (SELECT vec_id, t, q, (t + 1) / 27.0::DOUBLE * b[q + 1] + 1e-10 AS s FROM b, range(27) r(t), range(33) u(q)),
f AS (SELECT vec_id, t, sum(s) AS level, sum(CASE WHEN q BETWEEN 2 AND 13 THEN s END) AS band, exp(avg(ln(s))) AS geo FROM s GROUP BY 1, 2),
g AS (SELECT vec_id, sum(band) / sum(level) AS band, avg(geo) / (sum(level) / (27 * 33)) AS flat, stddev_pop(level) / (avg(level) + 1e-12) AS m FROM f GROUP BY 1)
SELECT vec_id, round(cbrt(greatest(0, least(1, (band - .25) / .35)) * (1 - least(1, 3 * flat)) * least(1, m / .6)), 5) AS score FROM g"""


@query(_SPEECH)
def speech_score(spark, d):
    """A tone with some of each vector on it, swelling over 27 frames."""
    e = table(spark, d, "embeddings")
    wave = F.transform(F.sequence(F.lit(0), F.lit(27 * 64 - 1)), lambda k: (F.cos(2 * F.pi() * 5 * (k % 64) / 64) + 0.02 * F.get("embedding", k % 64).cast("double")) * (F.floor(k / 64) + 1) / 27)
    return G.speech_score(e.select("vec_id", wave.alias("x")), "vec_id", "x", 16000, 64, 64).select("vec_id", F.round("score", 5).alias("score"))


@query("SELECT vec_id, e::INT AS epoch, 8 AS bins FROM embeddings, range(3) r(e)")
def per_epoch_variants(spark, d):
    """Three epochs of augmented 8 x 8 features of every vector."""
    from modlake.operators import sampling as P

    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    x = table(spark, d, "embeddings").select("vec_id", grid.alias("f"))
    zeros, ones = F.array_repeat(F.lit(0.0), 8), F.array_repeat(F.lit(1.0), 8)
    out = P.per_epoch_variants(x, "vec_id", "f", zeros, ones, 5, 3)
    return out.select("vec_id", "epoch", F.size("f").alias("bins"))


@query("SELECT event_id, round(least(value / 100, 1.0) / 2, 6) AS p, true AS small_batch FROM events")
def score_hook(spark, d):
    """A model over every window, in calls of at most 32 rows."""
    def load():
        def model(f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"p": f["score"] / 2, "n": len(f)})

        return model

    out = keyed.score_hook(windows(spark, d).select("event_id", "score"), load, "p double, n long", batch=32)
    return out.select("event_id", r6("p").alias("p"), (F.col("n") <= 32).alias("small_batch"))
