"""Queries of the smaller operators: projections, signals, text risk, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlake.functions import labels as L
from modlake.functions import terms as M
from modlake.functions import text as X
from modlake.operators import collections as C
from modlake.operators import incidents as I
from modlake.operators import joins as J
from modlake.operators import mining as N
from modlake.operators import sampling as P
from modlake.operators import signal as G
from modlake.operators import spans as S
from modlake.operators import validation as V
from modlake.plans.base import WINDOWS, query, r6, table, windows


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0")
def training_rows(spark, d):
    i = F.col("doc_id")
    return V.training_rows(table(spark, d, "documents").withColumn("split", F.when(i % 3 == 0, "val").otherwise("train")).withColumn("flagged", i % 7 == 0)).select("doc_id")


@query("SELECT conv_id, turn, md5(lower(regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g'))) AS clean FROM conversations")
def normalize_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.normalize_text(F.col("text"))).alias("clean"))


@query("SELECT source, string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) AS prompt FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS b FROM documents) WHERE a <= 4 OR b <= 2 GROUP BY 1")
def vocabulary_prompt(spark, d):
    """The first four and the last two of each source's documents: only these are gathered, by ranks from both ends."""
    from pyspark.sql import Window

    x = table(spark, d, "documents").select("source", "doc_id")
    w = Window.partitionBy("source")
    head = x.withColumn("n", F.row_number().over(w.orderBy("doc_id"))).filter("n <= 6").drop("n")
    tail = x.withColumn("n", F.row_number().over(w.orderBy(F.desc("doc_id")))).filter("n <= 6").drop("n")
    terms = head.union(tail).distinct().groupBy("source").agg(F.transform(F.array_sort(F.collect_list("doc_id")), lambda v: v.cast("string")).alias("terms"))
    return terms.select("source", X.vocabulary_prompt(F.col("terms"), 6).alias("prompt"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 7 = 0 THEN '' END ELSE 'said' END AS text, CASE WHEN doc_id % 2 = 0 AND doc_id % 7 <> 0 AND l.doc_id2 IS NOT NULL THEN 'heard' END AS teacher_text
FROM documents LEFT JOIN (SELECT doc_id AS doc_id2 FROM labels) l ON l.doc_id2 = doc_id""")
def fill_teacher_text(spark, d):
    i = F.col("doc_id")
    x = table(spark, d, "documents").select("doc_id", F.when(i % 2 == 1, "said").alias("text"), F.lit(None).cast("string").alias("teacher_text"), F.when(i % 7 == 0, "no_speech").otherwise("movie").alias("domain"))
    return C.fill_teacher_text(x, table(spark, d, "labels").select("doc_id", F.lit("heard").alias("text")), "doc_id").select("doc_id", "text", "teacher_text")


def _queue(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("clip_id"), F.col("doc_id").alias("rank"))


def _decisions(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "labels").select(i.cast("string").alias("clip_id"), F.when(i % 3 == 0, "skip").when(i % 5 == 0, "dance").otherwise("confirm_fp").alias("action"), F.when(i % 3 != 0, F.when(i % 4 == 0, "bang").otherwise("talk")).alias("label"), i.alias("seq"))


@query("SELECT d.doc_id::VARCHAR AS clip_id, row_number() OVER (ORDER BY l.doc_id IS NOT NULL, d.doc_id) AS place FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR d.doc_id % 3 = 0")
def pending(spark, d):
    """The queue of what is left to review, with its order as a number."""
    from modlake.core import global_rank

    x = N.pending_rows(_queue(spark, d), _decisions(spark, d))
    return global_rank(x, "skipped", "rank", name="place").select("clip_id", "place")


@query("SELECT (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE doc_id % 3 <> 0) AS decided, (SELECT count(*) FROM documents) AS total")
def progress(spark, d):
    return N.progress(_queue(spark, d), _decisions(spark, d))


@query("SELECT doc_id::VARCHAR AS clip_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown action' ELSE 'label of the wrong kind' END AS problem FROM labels WHERE doc_id % 3 <> 0 AND (doc_id % 5 = 0 OR doc_id % 4 = 0)")
def check_decisions(spark, d):
    classes = spark.createDataFrame([("bang", True), ("talk", False)], "class string, is_harm boolean")
    return N.check_decisions(_decisions(spark, d), _queue(spark, d), classes)


@query("WITH h AS (SELECT floor(epoch(ts) / 604800) AS w, avg((event_type = 'error')::INT) AS fpr FROM events GROUP BY 1), d AS (SELECT w, lag(fpr) OVER (ORDER BY w) - fpr AS drop FROM h) SELECT coalesce(arg_max(drop, w) < .005, false) OR (SELECT count(*) FROM h) >= 5 AS stop FROM d WHERE drop IS NOT NULL")
def should_stop(spark, d):
    week = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 604800)
    h = table(spark, d, "events").groupBy(week.alias("iteration")).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("fpr"))
    return N.should_stop(h, most=5)


@query("SELECT doc_id, round(1 - (n_chars % 100) / 100.0::DOUBLE, 4) AS risk, CASE WHEN round(1 - (n_chars % 100) / 100.0::DOUBLE, 4) >= .5 THEN CASE WHEN doc_id % 2 = 0 THEN 'abuse' ELSE 'threat' END END AS category FROM documents")
def softmax_risk(spark, d):
    rest = 1 - (F.col("n_chars") % 100) / 100.0
    even = F.when(F.col("doc_id") % 2 == 0, 0.7).otherwise(0.3)
    probs = F.create_map(F.lit("safe"), (F.col("n_chars") % 100) / 100.0, F.lit("abuse"), rest * even, F.lit("threat"), rest * (1 - even))
    return table(spark, d, "documents").select("doc_id", X.softmax_risk(probs).alias("v")).select("doc_id", "v.risk", "v.category")


@query("WITH s AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS a, ((doc_id * 7919) % 1009) / 1009.0::DOUBLE AS b FROM documents) SELECT doc_id, round(greatest(a, b), 6) AS risk, CASE WHEN greatest(a, b) >= .5 THEN CASE WHEN a >= b THEN 'abuse' ELSE 'threat' END END AS category FROM s")
def ensemble_toxicity(spark, d):
    a, b = (F.col("n_chars") % 1000) / 1000.0, ((F.col("doc_id") * 7919) % 1009) / 1009.0
    models = F.array(F.create_map(F.lit("neutral"), F.lit(0.99), F.lit("toxic"), a), F.create_map(F.lit("threat"), b))
    return table(spark, d, "documents").select("doc_id", X.ensemble_toxicity(models, ["neutral"], {"toxic": "abuse"}).alias("v")).select("doc_id", r6("v.risk").alias("risk"), "v.category")


@query("""WITH s AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS l, ((doc_id * 7919) % 1009) / 1009.0::DOUBLE AS s, CASE WHEN doc_id % 3 = 0 THEN 'threat' ELSE 'abuse' END AS top, CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 5 = 1 THEN 0 END AS f FROM documents),
r AS (SELECT doc_id, greatest(CASE WHEN s < .3 AND top <> 'threat' THEN 0 ELSE l END, s) AS base, CASE WHEN f IS NULL OR s < .2 THEN 0 WHEN f <= 0 THEN .75 ELSE .6 END AS fuzzy FROM s) SELECT doc_id, round(greatest(base, fuzzy), 6) AS risk FROM r""")
def combine_text_risk(spark, d):
    i = F.col("doc_id")
    v = X.combine_text_risk((F.col("n_chars") % 1000) / 1000.0, F.when(i % 3 == 0, "threat").otherwise("abuse"), ((i * 7919) % 1009) / 1009.0, F.when(i % 5 == 0, 1).when(i % 5 == 1, 0))
    return table(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", r6("v.risk").alias("risk"))


@query("""WITH u AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS s, contains(lower(text), 'idiot') AS i, contains(lower(text), 'moron') AS m, contains(lower(text), 'lichen') AS l FROM documents)
SELECT doc_id, round(greatest(s, CASE WHEN i THEN .9 WHEN m THEN .45 ELSE 0 END), 6) AS score FROM u""")
def hybrid_text_score(spark, d):
    """Best unit of each text by a classifier's scores (the whole text's here) and the lexicon; a unit holds one of the words whenever the text does."""
    t = table(spark, d, "documents")
    scores = t.groupBy(X.full_text(F.col("text")).alias("unit"), "doc_id").agg(F.max((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    out = X.hybrid_text_score(t, "doc_id", "text", {"abuse": (0.9, {"idiot": 1.0, "moron": 0.5})}, scores)
    return out.select("doc_id", r6(F.when(F.col("lexicon_max") >= 0.9, F.greatest(F.col("score"), F.lit(0.9))).otherwise(F.col("score"))).alias("score"))


_PAIRS = """c AS (SELECT DISTINCT (length(text) % 5)::VARCHAR AS category, text FROM benchmark), s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('0|' || text), text) <= {most}),
e AS (SELECT category, text, min(k) AS k FROM (SELECT category, text, 0 AS k FROM c UNION ALL SELECT a.category, a.text || '{joiner}' || b.text, 1 FROM s a JOIN s b ON a.category = b.category AND a.text <> b.text) GROUP BY 1, 2)
SELECT category, md5(text) AS text FROM e QUALIFY row_number() OVER (PARTITION BY category ORDER BY k, md5('0|' || text), text) <= {target}"""


def _clauses(spark, d):
    return table(spark, d, "benchmark").select((F.length("text") % 5).cast("string").alias("category"), F.lit("en").alias("lang"), F.lit("plain").alias("kind"), "text")


@query("WITH " + _PAIRS.format(most=24, joiner=" and ", target=500))
def generate_corpus(spark, d):
    """Clauses and their pairs within a category, up to 500 a category."""
    j = spark.createDataFrame([("en", "and")], "lang string, connector string")
    return X.generate_corpus(_clauses(spark, d), j, 500).select("category", F.md5("text").alias("text"))


@query("WITH " + _PAIRS.format(most=19, joiner="; ", target=300))
def generate_testset(spark, d):
    """Clauses and joined pairs of each cell, up to 300 a cell."""
    return X.generate_testset(_clauses(spark, d), 300, "; ").select("category", F.md5("text").alias("text"))


@query("""WITH t AS (SELECT DISTINCT event_type AS term, (length(event_type) % 2)::VARCHAR AS label FROM events WHERE event_type <> 'error'), m AS (SELECT * FROM (VALUES ('0', 'say {}'), ('1', 'a {} now'), ('1', '{}!')) v(label, template)),
l AS (SELECT label, replace(template, '{}', term) AS text FROM t JOIN m USING (label)) SELECT label, text FROM l UNION SELECT label, text || ' ' || tail FROM l, (VALUES ('please'), ('today')) v(tail)""")
def generate_templates(spark, d):
    """Event types in templates of their class, with tails; one type is held out."""
    terms = table(spark, d, "events").select(F.col("event_type").alias("term"), (F.length("event_type") % 2).cast("string").alias("label")).distinct()
    templates = spark.createDataFrame([("0", "say {}"), ("1", "a {} now"), ("1", "{}!")], "label string, template string")
    return X.generate_templates(terms, templates, spark.createDataFrame([("please",), ("today",)], "tail string"), spark.createDataFrame([("error",)], "term string"))


@query("SELECT vec_id, i AS frame, round(a * b, 6) AS product FROM (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS a, embedding[64 - i]::DOUBLE AS b FROM embeddings, range(0, 64) r(i))")
def positional_alignment(spark, d):
    e = table(spark, d, "embeddings")
    x = J.positional(e, e.select("vec_id", F.reverse("embedding").alias("back")), "vec_id", "embedding", "back")
    return x.select("vec_id", F.col("i").cast("long").alias("frame"), r6(F.col("a_item").cast("double") * F.col("b_item").cast("double")).alias("product"))


@query("WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS j FROM benchmark) SELECT doc_id, item_id, [0.0, 5.0, 10.0][k % 3 + 1]::DOUBLE AS snr FROM f JOIN b ON j = k % (SELECT count(*) FROM benchmark)")
def mix_plan(spark, d):
    return C.mix_plan(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


@query("WITH x AS (SELECT vec_id, embedding[i]::DOUBLE AS a, embedding[i]::DOUBLE * .5 AS b FROM embeddings, range(1, 65) r(i)) SELECT vec_id, round(20 * log10(sqrt(avg(b * b)) / sqrt(avg(a * a))), 4) AS rms_change_db, round(sqrt(avg((a - b) * (a - b))), 6) AS removed_rms, round(avg((abs(b) >= .999)::INT), 6) AS clipped FROM x GROUP BY 1")
def signal_delta(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    x = G.signal_delta(e.withColumn("b", F.transform("a", lambda v: v * 0.5)), "vec_id", "a", "b")
    return x.select("vec_id", F.round("rms_change_db", 4).alias("rms_change_db"), r6("removed_rms").alias("removed_rms"), r6("clipped").alias("clipped"))


@query("SELECT vec_id, 100 AS n, round(list_sum(list_slice(embedding::DOUBLE[], 1, 40)) + list_sum(list_slice(embedding::DOUBLE[], 41, 64)), 5) AS total FROM embeddings")
def join_segments(spark, d):
    pieces = F.array(F.slice("embedding", 1, 40), F.slice("embedding", 41, 24))
    fixed = table(spark, d, "embeddings").withColumn("embedding", G.join_segments(pieces, 8))
    return fixed.select("vec_id", F.size(V.fix_length("embedding", 100)).alias("n"), F.round(F.aggregate(V.fix_length("embedding", 100), F.lit(0.0), lambda a, v: a + v.cast("double")), 5).alias("total"))


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, count(*) AS samples, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, round(avg((x <> 0)::INT), 6) AS nonzero, 'ok' AS verdict FROM x GROUP BY 1")
def level_probe(spark, d):
    e = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return V.level_probe(e, "label", "x").select("label", "samples", r6("peak").alias("peak"), r6("rms").alias("rms"), r6("nonzero").alias("nonzero"), "verdict")


@query("SELECT vec_id, 10 * log10(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / 64) > -18.2 AS active FROM embeddings")
def voice_activity(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return S.voice_activity(e, "x", -18.2).select("vec_id", "active")


@query(f"""WITH {WINDOWS}, x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value > 15 AS a FROM w),
c1 AS (SELECT *, CASE WHEN lag(a) OVER o = a THEN 0 ELSE 1 END AS c FROM x WINDOW o AS (PARTITION BY user_id ORDER BY i)), r1 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c1),
y AS (SELECT user_id, i, a OR count(*) OVER (PARTITION BY user_id, run) * .04 <= .28 + 1e-9 AS a FROM r1),
c2 AS (SELECT *, CASE WHEN lag(a) OVER o = a THEN 0 ELSE 1 END AS c FROM y WINDOW o AS (PARTITION BY user_id ORDER BY i)), r2 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c2),
k AS (SELECT user_id, min(i) * .04 AS s, (max(i) + 1) * .04 AS e FROM r2 WHERE a GROUP BY user_id, run HAVING count(*) * .04 >= .16 - 1e-9), l AS (SELECT user_id, count(*) * .04 AS length FROM x GROUP BY 1),
p AS (SELECT user_id, greatest(0, s - .12) AS s, least(length, e + .12) AS e FROM k JOIN l USING (user_id)), q AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
m AS (SELECT user_id, sum(e - greatest(s, coalesce(reach, s))) AS kept FROM (SELECT * FROM q WHERE reach IS NULL OR e > reach) GROUP BY 1)
SELECT user_id, round(coalesce(kept, 0), 4)::DOUBLE AS kept_seconds, round(length - coalesce(kept, 0), 4)::DOUBLE AS removed_seconds FROM l LEFT JOIN m USING (user_id)""")
def compact_audible(spark, d):
    """Audible stretches of each user's events by position."""
    from pyspark.sql import Window

    p = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) * 0.04
    x = windows(spark, d).select("user_id", p.alias("p"), (F.col("value") > 15).alias("a"))
    return S.compact_audible(x, "user_id", "p", "a", 0.04)[1].select("user_id", *[(F.round(c, 4) + 0).alias(c) for c in ("kept_seconds", "removed_seconds")])


def _u(seed_and_epoch: str, row: str, op: str) -> str:
    return f"(('0x' || substring(md5('{seed_and_epoch}|' || {row} || '|{op}'), 1, 13))::BIGINT / 4503599627370496)"


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, {_u('1|0', 'vec_id', 'gain')} AS g, {_u('1|0', 'vec_id', 'gain?')} AS g0, {_u('1|0', 'vec_id', 'shift')} AS s, {_u('1|0', 'vec_id', 'crop')} AS c FROM embeddings)
SELECT vec_id, round(CASE WHEN g0 < .5 THEN list_sum(x) * 10 ** ((-6 + 12 * g) / 20) ELSE list_sum(x) END, 4) AS gain, round(x[((64 - floor(s * 64)::INT) % 64) + 1], 6) AS roll, round(list_sum(list_slice(x, floor(c * 49)::INT + 1, floor(c * 49)::INT + 16)), 4) AS crop FROM e""")
def augmentations(spark, d):
    """Gain, roll and crop of every vector for one epoch, as sums and a first item."""
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")), 4)
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    e = e.select("vec_id", "x", P.augment_gain("x", "vec_id", 1, 0).cast("array<double>").alias("g"), P.augment_shift("x", "vec_id", 1, 0).alias("s"), P.random_crop("x", 16, "vec_id", 1, 0).alias("c"))
    return e.select("vec_id", total("g").alias("gain"), r6(F.get("s", F.lit(0))).alias("roll"), total("c").alias("crop"))


@query(f"""WITH b AS (SELECT vec_id, [{_u('1|0', 'vec_id', 'mask-b')}, {_u('1|0', 'vec_id', 'mask-f')}, {_u('1|0', 'vec_id', 'mask-b0')}, {_u('1|0', 'vec_id', 'mask-f0')}] AS u FROM embeddings),
w AS (SELECT vec_id, u, floor(u[1] * 5) AS wb, floor(u[2] * 5) AS wf FROM b), z AS (SELECT vec_id, floor(u[3] * (8 - wb + 1)) AS b0, wb, floor(u[4] * (8 - wf + 1)) AS f0, wf FROM w)
SELECT vec_id, (64 - (8 - wb) * (8 - wf))::BIGINT AS masked, CASE WHEN wb > 0 THEN b0 END::BIGINT AS band FROM z""")
def augment_mask(spark, d):
    """Masked cells of every vector laid out as 8 x 8, and where its masked band begins."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array_repeat(F.lit(1.0).cast("float"), 8)).alias("x"))
    m = e.select("vec_id", P.augment_mask("x", "vec_id", 1, 0, 4, 4).alias("m"))
    gone = F.transform("m", lambda r: F.forall(r, lambda v: v == 0))
    return m.select("vec_id", F.size(F.filter(F.flatten("m"), lambda v: v == 0)).cast("long").alias("masked"), F.nullif(F.array_position(gone, True) - 1, F.lit(-1)).alias("band"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_reverse(embedding)::DOUBLE[] AS v FROM embeddings), p AS (SELECT vec_id, x, v, list_dot_product(x, x) AS px, list_dot_product(v, v) AS pv FROM e)
SELECT vec_id, round(CASE WHEN px > 0 THEN list_sum(x) + list_sum(v) * sqrt(px / (pv * 10)) ELSE list_sum(x) END, 3) AS total FROM p""")
def augment_noise(spark, d):
    """Every vector with its mirror image as noise at 10 dB."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    y = P.augment_noise(F.col("x"), F.reverse("x"), F.lit(10.0))
    return e.select("vec_id", F.round(F.aggregate(y, F.lit(0.0), lambda a, v: a + v.cast("double")), 3).alias("total"))


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label, row_number() OVER (ORDER BY md5('3|0|' || vec_id), vec_id) AS r, count(*) OVER () AS n FROM embeddings),
b AS (SELECT a.vec_id, a.x AS x, o.x AS o, a.label AS k, o.label AS m, sin(pi() / 2 * {_u('3|0', 'a.vec_id', 'mixup')}) ** 2 AS lam FROM e a JOIN e o ON o.r = a.r % a.n + 1)
SELECT vec_id, round(lam, 6) AS lam, round(lam * list_sum(x) + (1 - lam) * list_sum(o), 4) AS total, CASE WHEN k = m THEN 1 ELSE 2 END::DOUBLE AS labels FROM b""")
def mixup(spark, d):
    """Every vector mixed with the next one in a seeded order."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (k == F.col("label")).cast("double")).alias("y"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return P.mixup(e, "vec_id", "x", "y", 3).select("vec_id", r6("lam").alias("lam"), F.round(total("x"), 4).alias("total"), total("y").alias("labels"))


@query(f"WITH {WINDOWS} SELECT user_id, round(max(greatest(score, value % 1)), 6) AS probability, count(*) FILTER (esc) AS selected, count(*) FILTER (NOT esc) AS suppressed, sum(value) <= 0 AND max(value) >= 1e-4 AS fail_open FROM w GROUP BY 1")
def route_summary(spark, d):
    x = windows(spark, d).withColumn("p", F.col("value") % 1)
    return I.route_summary(x, "user_id", "score", "p", "esc", "value", "value").select("user_id", r6("probability").alias("probability"), "selected", "suppressed", "fail_open")


@query("WITH s AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS a, ((doc_id * 7919) % 1009) / 1009.0::DOUBLE AS b FROM documents) SELECT doc_id, round(greatest(a, b), 6) AS risk, CASE WHEN greatest(a, b) >= .8 THEN 'block' WHEN greatest(a, b) >= .4 THEN 'warn' ELSE 'safe' END AS level FROM s")
def overall_verdict(spark, d):
    v = L.overall_verdict((F.col("n_chars") % 1000) / 1000.0, ((F.col("doc_id") * 7919) % 1009) / 1009.0, 0.4, 0.8)
    return table(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", r6("v.risk").alias("risk"), "v.level")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN round(value / 100, 6) ELSE round(value / 50, 6) END AS acoustic, CASE WHEN event_id % 2 = 0 THEN 'a / b' ELSE event_type END AS transcript FROM events")
def judge_request(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, F.struct((v / 100).alias("peak_acoustic"), F.lit(0.1).alias("peak_text"), F.array(F.lit("a"), F.lit("b")).alias("transcripts"))).alias("event"),
        F.struct((v / 50).alias("acoustic"), F.lit(0.2).alias("text"), F.col("event_type").alias("transcript")).alias("window"))
    return e.select("event_id", L.judge_request("event", "window").alias("r")).select("event_id", r6("r.acoustic").alias("acoustic"), "r.transcript")


@query("SELECT doc_id, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IN (SELECT DISTINCT lang FROM documents WHERE doc_id % 2 = 0)")
def shared_splits(spark, d):
    """Documents of the languages that two splits share, with their number."""
    x = table(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    shared = J.shared_ids(x, "lang", "split", "a", "b")
    return J.lookup(x.join(shared, "lang", "left_semi"), x.groupBy("lang").agg(F.count("*").alias("n")), "lang").select("doc_id", "n")


@query("SELECT lang AS label, least(count(*), CASE WHEN lang = 'en' THEN 100 ELSE count(*) END) AS n FROM documents GROUP BY 1")
def cap_label(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))
    return X.cap_label(x, "label", "en", 100, "doc_id").groupBy("label").agg(F.count("*").alias("n"))


def _near(term: str) -> str:
    n = len(term)
    hit = " OR ".join(f"(i + {k} - 1 <= length(f) AND levenshtein(substr(f, i, {k}), '{term}') <= 1)" for k in (n - 1, n, n + 1))
    return f"CASE WHEN NOT contains(f, '{term}') AND len(list_filter(range(1, length(f) + 1), lambda i: f[i] = '{term[0]}' AND ({hit}))) > 0 THEN '{term}' END"


@query(f"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS f FROM conversations), h AS (SELECT conv_id, turn, concat_ws(',', {_near('thorea')}, {_near('lichen')}, {_near('andthe')}) AS terms FROM c)
SELECT * FROM h WHERE terms <> ''""")
def fuzzy_terms(spark, d):
    """Curated nouns within one unit of spans of each conversation's turns."""
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", X.fuzzy_terms(F.col("text"), ["thorea", "lichen", "andthe"]).alias("f")).filter("size(f) > 0").select("conv_id", "turn", F.array_join(F.transform("f", lambda x: x["term"]), ",").alias("terms"))


#: Each letter as a Hangul syllable, so that the turns are Korean script: fixed values, neighbours differ in one of the three units.
_SYLLABLES = "가각간나낙난다닥단라락란마막만바박반사삭산아악안자작"
_KOREAN = [w.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", _SYLLABLES)) for w in ("thorea", "lichen", "andthe", "tion")]


def _units_sql(c: str) -> str:
    """The three units of each syllable, one printable ASCII character each, so that edits of bytes are edits of units."""
    return f"list_reduce(list_transform(string_split({c}, ''), lambda s: chr((33 + (unicode(s) - 44032) // 588)::INT) || chr((53 + (unicode(s) - 44032) // 28 % 21)::INT) || chr((75 + (unicode(s) - 44032) % 28)::INT)), lambda x, y: x || y)"


def _near_korean(term: str) -> str:
    n = len(term)
    d = lambda k: f"levenshtein({_units_sql(f'substr(f, i::INT, {k})')}, {_units_sql(repr(term))})"
    hit = " OR ".join(f"(i + {k} - 1 <= length(f) AND {d(k)} <= 1)" for k in (n - 1, n, n + 1))
    return f"CASE WHEN NOT contains(f, '{term}') AND len(list_filter(range(1, length(f) + 1), lambda i: (unicode(f[i]) - 44032) // 588 = {(ord(term[0]) - 44032) // 588} AND ({hit}))) > 0 THEN '{term}' END"


@query(f"""WITH c AS (SELECT conv_id, turn, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{_SYLLABLES}'), '[^가-힣]', '', 'g') AS f FROM conversations), h AS (SELECT conv_id, turn, concat_ws(',', {", ".join(map(_near_korean, _KOREAN))}) AS terms FROM c)
SELECT * FROM h WHERE terms <> ''""")
def fuzzy_korean_terms(spark, d):
    """Curated nouns in Hangul within one unit of spans of each turn, by the index of halves."""
    said = F.regexp_replace(F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", _SYLLABLES), "[^가-힣]", "")
    x = M.fuzzy_containing(table(spark, d, "conversations").select("conv_id", "turn", said.alias("said")), "said", _KOREAN)
    return x.filter("size(fuzzy) > 0").select("conv_id", "turn", F.array_join(F.transform("fuzzy", lambda f: f["term"]), ",").alias("terms"))


def _many_sql() -> str:
    return "SELECT d.doc_id, count(*) AS n, string_agg(CASE WHEN r <= 3 THEN term END, ',' ORDER BY term) AS first_terms FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY term) AS r FROM (SELECT doc_id, lower(text) AS t FROM documents) JOIN (SELECT chr((97 + k // 676 % 26)::INT) || chr((97 + k // 26 % 26)::INT) || chr((97 + k % 26)::INT) || chr((97 + k * 7 % 26)::INT) AS term FROM range(2000) x(k)) ON contains(t, term)) d GROUP BY 1"


@query(_many_sql())
def lexicon_many(spark, d):
    """Which of 2,000 terms each document holds, in one pass."""
    at = lambda n: chr(97 + n % 26)
    terms = [at(k // 676) + at(k // 26) + at(k) + at(k * 7) for k in range(2000)]
    x = M.containing(table(spark, d, "documents").select("doc_id", "text"), "text", terms).filter("size(terms) > 0")
    first = F.slice(F.array_sort("terms"), 1, 3)
    return x.select("doc_id", F.size("terms").cast("long").alias("n"), F.array_join(first, ",").alias("first_terms"))


@query("SELECT lang, round(sum(n_chars / 1000.0) / sum(n_chars / 500.0), 6) AS rtf FROM documents GROUP BY 1")
def real_time_factor(spark, d):
    from modlake.operators import metrics

    x = table(spark, d, "documents").select("lang", (F.col("n_chars") / 1000.0).alias("elapsed"), (F.col("n_chars") / 500.0).alias("audio_seconds"))
    return metrics.real_time_factor(x, ["lang"]).select("lang", r6("rtf").alias("rtf"))
