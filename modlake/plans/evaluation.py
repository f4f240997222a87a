"""Queries of metrics, thresholds and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlake.operators import metrics as M
from modlake.plans.base import SCORED, query, r6, scored, table

_AP = "r AS (SELECT *, row_number() OVER w AS rank, sum(y) OVER (PARTITION BY class ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS tp FROM s WINDOW w AS (PARTITION BY class ORDER BY score DESC, id))"
_G = "g AS (SELECT class, score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1, 2)"
_RUN = f"{_G}, q AS (SELECT class, score, neg, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY class) AS p, sum(neg) OVER (PARTITION BY class) AS n FROM g WINDOW d AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {SCORED}, {_AP} SELECT class, round(sum(CASE WHEN y = 1 THEN tp / rank END) / nullif(sum(y), 0), 6) AS ap FROM r GROUP BY 1")
def average_precision(spark, d):
    return M.average_precision(scored(spark, d)).select("class", r6("ap").alias("ap"))


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER w AS rank, sum(y) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS tp FROM s WINDOW w AS (ORDER BY score DESC, id)) SELECT round(sum(CASE WHEN y = 1 THEN tp / rank END) / nullif(sum(y), 0), 6) AS ap FROM r")
def average_precision_one(spark, d):
    """One class over all rows, by global ranks."""
    return M.average_precision_one(scored(spark, d)).select(r6("ap").alias("ap"))


@query(f"WITH {SCORED}, {_G}, b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT class, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auroc FROM b GROUP BY 1")
def auroc(spark, d):
    return M.auroc(scored(spark, d)).select("class", r6("auroc").alias("auroc"))


@query(f"WITH {SCORED}, {_RUN} SELECT class, round(CASE WHEN max(p) > 0 AND max(n) > 0 THEN coalesce(max(CASE WHEN fp <= .05 * n THEN tp / nullif(p, 0) END), 0) END, 6) AS recall FROM q GROUP BY 1")
def recall_at_fpr(spark, d):
    return M.recall_at_fpr(scored(spark, d), 0.05).select("class", r6("recall").alias("recall"))


@query(f"""WITH {SCORED}, n AS (SELECT class, score, row_number() OVER (PARTITION BY class ORDER BY score DESC) - 1 AS k, count(*) OVER (PARTITION BY class) AS n FROM s WHERE y = 0),
t AS (SELECT class, score AS threshold FROM n WHERE k = greatest(0, floor(.1 * n) - 1)) SELECT class, round(any_value(threshold), 6) AS threshold, round(avg((score > threshold)::INT), 6) AS recall FROM s JOIN t USING (class) WHERE y = 1 GROUP BY 1""")
def recall_at_kth_negative(spark, d):
    return M.recall_at_kth_negative(scored(spark, d), 0.1).select("class", r6("threshold").alias("threshold"), r6("recall").alias("recall"))


@query(f"WITH {SCORED}, c AS (SELECT class, count(*) FILTER (score >= .5 AND y = 1) AS tp, count(*) FILTER (score >= .5 AND y = 0) AS fp, count(*) FILTER (score < .5 AND y = 1) AS fn FROM s GROUP BY 1) SELECT class, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def prf_at_threshold(spark, d):
    x = M.prf_at_threshold(scored(spark, d), 0.5)
    return x.select("class", "tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {SCORED} SELECT class, round(avg((score >= .5)::INT) FILTER (y = 1), 6) AS recall, round(avg((score >= .5)::INT) FILTER (y = 0), 6) AS fpr, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM s GROUP BY 1")
def confusion_at_threshold(spark, d):
    return M.confusion_at_threshold(scored(spark, d), 0.5).select("class", r6("recall").alias("recall"), r6("fpr").alias("fpr"), "n_pos", "n_neg")


@query(f"WITH {SCORED} SELECT class, source, round(avg((score_b >= .5)::INT) FILTER (y = 1), 6) AS recall, round(avg((score_b >= .5)::INT) FILTER (y = 0), 6) AS fpr, count(*) AS n FROM s GROUP BY 1, 2")
def group_recall(spark, d):
    return M.group_recall(scored(spark, d), ["class", "source"], 0.5, score="score_b").select("class", "source", r6("recall").alias("recall"), r6("fpr").alias("fpr"), "n")


_T = [0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 0.95]


@query(f"""WITH {SCORED}, t AS (SELECT class, unnest({_T}) AS threshold, y, score FROM s), a AS (SELECT class, threshold::DOUBLE AS threshold, avg((score >= threshold)::INT) FILTER (y = 1) AS recall, avg((score >= threshold)::INT) FILTER (y = 0) AS fpr, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp FROM t GROUP BY 1, 2)
SELECT class, threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr, tp, fp, row_number() OVER (PARTITION BY class ORDER BY CASE WHEN coalesce(fpr, 0) <= .02 THEN 0 ELSE 1 END, CASE WHEN coalesce(fpr, 0) <= .02 THEN threshold ELSE abs(fpr - .02) END, threshold) = 1 AS chosen FROM a""")
def threshold_sweep(spark, d):
    return M.threshold_sweep(scored(spark, d), _T).select("class", "threshold", r6("recall").alias("recall"), r6("fpr").alias("fpr"), "tp", "fp", "chosen")


@query(f"WITH {SCORED}, {_RUN} SELECT class, round(CASE WHEN max(n) = 0 THEN .5 ELSE coalesce(min(CASE WHEN fp <= .15 * n THEN score END), max(CASE WHEN neg > 0 THEN score END) + 1e-9) END, 6) AS threshold FROM q GROUP BY 1")
def threshold_at_fpr(spark, d):
    return M.threshold_at_fpr(scored(spark, d), 0.15).select("class", r6("threshold").alias("threshold"))


@query(f"WITH {SCORED}, {_RUN} SELECT class, round(coalesce(max(CASE WHEN p > 0 AND tp >= .9 * p - 1e-9 THEN score END), 0), 6) AS threshold FROM q GROUP BY 1")
def threshold_at_recall(spark, d):
    return M.threshold_at_recall(scored(spark, d), 0.9).select("class", r6("threshold").alias("threshold"))


def _report_sql() -> str:
    one = lambda src: f"""SELECT a.class AS name, ap, auroc, recall FROM (
      SELECT class, sum(CASE WHEN y = 1 THEN tp / rank END) / nullif(sum(y), 0) AS ap FROM (SELECT *, row_number() OVER w AS rank, sum(y) OVER (PARTITION BY class ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS tp FROM {src} WINDOW w AS (PARTITION BY class ORDER BY score DESC, id)) GROUP BY 1) a
      JOIN (SELECT class, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc, CASE WHEN max(p) > 0 AND max(n) > 0 THEN coalesce(max(CASE WHEN fp <= .1 * n THEN tp / nullif(p, 0) END), 0) END AS recall FROM (
        SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY class) AS p, sum(neg) OVER (PARTITION BY class) AS n
        FROM (SELECT class, score, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY 1, 2) WINDOW d AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1) b USING (class)"""  # noqa: E731
    return f"""WITH {SCORED}, k AS (SELECT * FROM (VALUES ('en', 'a', true), ('de', 'a', true), ('fr', 'b', true), ('es', 'c', false)) v(class, category, is_harm)),
    x AS (SELECT s.id, k.category AS class, max(s.y) AS y, max(s.score) AS score FROM s JOIN k USING (class) GROUP BY ALL), c AS ({one('s')}), p AS ({one('x')}), h AS (SELECT c.* FROM c JOIN k ON k.class = c.name WHERE is_harm),
    t AS (SELECT coalesce(min(ap) >= .3, false) AS pass_ap, coalesce(min(auroc) >= .99, false) AS pass_auroc FROM h)
    SELECT * FROM (SELECT 'class' AS scope, name, round(ap, 4) AS ap, round(auroc, 4) AS auroc, round(recall, 4) AS recall FROM c UNION ALL SELECT 'category', name, round(ap, 4), round(auroc, 4), round(recall, 4) FROM p
    UNION ALL SELECT 'macro', 'all', round(avg(ap), 4), round(avg(auroc), 4), round(avg(recall), 4) FROM c UNION ALL SELECT 'macro', 'harm', round(avg(ap), 4), round(avg(auroc), 4), round(avg(recall), 4) FROM h), t"""


@query(_report_sql())
def harm_report(spark, d):
    """By class and by category, with the macro rows and whether targets are met."""
    k = spark.createDataFrame([("en", "a", True), ("de", "a", True), ("fr", "b", True), ("es", "c", False)], "class string, category string, is_harm boolean")
    x = M.harm_report(scored(spark, d).select("id", "class", "y", "score"), k, 0.1, {"ap": 0.3, "auroc": 0.99})
    return x.select("scope", "name", *[F.round(c, 4).alias(c) for c in ("ap", "auroc", "recall")], "pass_ap", "pass_auroc")


@query(f"WITH {SCORED}, {_AP}, m AS (SELECT class, sum(CASE WHEN y = 1 THEN tp / rank END) / nullif(sum(y), 0) AS ap FROM r GROUP BY 1) SELECT round(avg(ap), 6) AS macro_ap, count(ap) AS defined FROM m")
def macro_ap(spark, d):
    x = M.macro(M.average_precision(scored(spark, d)), "ap")
    return x.select(r6("macro_ap").alias("macro_ap"), "defined")


@query(f"WITH {SCORED}, c AS (SELECT y, unnest(['gate', 'trigger', 'both']) AS stage, unnest([score >= .2, score_b >= .6, score >= .2 AND score_b >= .6]) AS hit FROM s) SELECT stage, round(avg(hit::INT) FILTER (y = 1), 6) AS recall, round(avg(hit::INT) FILTER (y = 0), 6) AS fpr, round(avg(hit::INT), 6) AS woken FROM c GROUP BY 1")
def cascade_report(spark, d):
    x = scored(spark, d).select("y", (F.col("score") >= 0.2).alias("g"), (F.col("score_b") >= 0.6).alias("t"))
    return M.cascade_report(x, "y", "g", "t").select("stage", *[r6(c).alias(c) for c in ("recall", "fpr", "woken")])


def _bootstrap_sql(replicates: int, bins: int) -> str:
    area = lambda src, k: f"(SELECT sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {k} AS score, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY 1)))"
    binned = lambda k: f"SELECT {k}, floor({bins} * (sum(count(*)) OVER (ORDER BY {k}) - count(*)) / (SELECT count(*) FROM r))::INT AS {k}_bin FROM r GROUP BY {k}"
    side = lambda k: f"""(SELECT i, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS area FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY i ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT i, {k}_bin AS bin, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM w GROUP BY 1, 2)) GROUP BY i)"""  # noqa: E731
    u = lambda at: f"('0x' || substring(h, {at}, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    return f"""WITH {SCORED}, r AS (SELECT y, score AS a, score_b AS b FROM s), ab AS ({binned("a")}), bb AS ({binned("b")}),
    c AS (SELECT y, a_bin, b_bin, count(*)::DOUBLE AS n FROM r JOIN ab USING (a) JOIN bb USING (b) GROUP BY ALL),
    f AS (SELECT *, CASE WHEN n <= 30 THEN list_transform(range(0, ceil(n + 9 * sqrt(n) + 21)::BIGINT), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-n + i * ln(n) - lgamma(i + 1))))) END AS cdf FROM c),
    d AS (SELECT *, md5(concat_ws('|', '0', i, y, a_bin, b_bin)) AS h FROM f, range({replicates}) t(i)), v AS (SELECT *, {u(1)} AS u, sqrt(-2 * ln(1 - {u(1)})) * cos(2 * pi() * {u(14)}) AS z FROM d),
    w AS (SELECT i, y, a_bin, b_bin, CASE WHEN n <= 30 THEN len(list_filter(cdf, lambda x: x <= u)) ELSE greatest(floor(n + sqrt(n) * z + (z * z - 1) / 6 + .5), 0) END AS w FROM v),
    e AS (SELECT b.area - a.area AS d FROM {side("a")} a JOIN {side("b")} b USING (i) WHERE a.area IS NOT NULL AND b.area IS NOT NULL),
    o AS (SELECT {area("r", "a")} AS auroc_a, {area("r", "b")} AS auroc_b, quantile_cont(d, .025) AS low, quantile_cont(d, .975) AS high, avg((d > 0)::INT) AS p_better FROM e)
    SELECT round(auroc_a, 4) AS auroc_a, round(auroc_b, 4) AS auroc_b, round(auroc_b - auroc_a, 4) AS delta, round(low, 4) AS low, round(high, 4) AS high, round(p_better, 4) AS p_better, low > 0 OR high < 0 AS significant FROM o"""


@query(_bootstrap_sql(2000, 100))
def bootstrap_compare(spark, d):
    """Two score columns by paired resampling, 2,000 times, with weights that SQL draws too."""
    x = M.bootstrap_compare(scored(spark, d).select("id", "y", "score", "score_b"))
    return x.select(*[F.round(c, 4).alias(c) for c in ("auroc_a", "auroc_b", "delta", "low", "high", "p_better")], "significant")


@query(f"WITH {SCORED}, {_G}, b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g), a AS (SELECT class, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM b GROUP BY 1) SELECT round(avg(auroc), 6) AS macro_auroc, count(auroc) AS defined FROM a")
def macro_auroc(spark, d):
    x = M.macro(M.auroc(scored(spark, d)), "auroc")
    return x.select(r6("macro_auroc").alias("macro_auroc"), "defined")


def _newton_sql(steps: int) -> str:
    """Newton's steps for two features and a constant, each a common table over the one before; Cramer's rule solves."""
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    h = "uu uv u uv vv v u v o".split()
    put = lambda at: [x if k % 3 != at else ("gu", "gv", "g")[k // 3] for k, x in enumerate(h)]
    out = [f"WITH {SCORED}, x AS MATERIALIZED (SELECT y::DOUBLE AS y, quality + score * .5 AS u, score_b - quality * score AS v FROM s), w0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c)"]
    for k in range(steps):
        out.append(f"p{k} AS (SELECT x.*, 1 / (1 + exp(-(a * u + b * v + c))) AS p FROM x, w{k})")
        sums = "sum((y - p) * u) AS gu, sum((y - p) * v) AS gv, sum(y - p) AS g, sum(p * (1 - p) * u * u) AS uu, sum(p * (1 - p) * u * v) AS uv, sum(p * (1 - p) * u) AS u, sum(p * (1 - p) * v * v) AS vv, sum(p * (1 - p) * v) AS v, sum(p * (1 - p)) AS o"
        moved = ", ".join(f"w.{c} + {det(put(i))} / {det(h)} AS {c}" for i, c in enumerate("abc"))
        out.append(f"g{k} AS MATERIALIZED (SELECT {sums} FROM p{k}), w{k + 1} AS MATERIALIZED (SELECT {moved} FROM g{k}, w{k} w)")
    last = f"z AS (SELECT y, a * u + b * v + c AS score FROM x, w{steps}), q AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM z GROUP BY 1))"
    return ", ".join([*out, last]) + f" SELECT round(a, 5) AS a, round(b, 5) AS b, round(c, 5) AS c, round((SELECT sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) FROM q), 5) AS auroc FROM w{steps}"


@query(_newton_sql(10))
def fit_risk(spark, d):
    """A logistic fit of the label on two features that don't hold it."""
    x = scored(spark, d).select("y", (F.col("quality") + F.col("score") * 0.5).alias("weighted_max"), (F.col("score_b") - F.col("quality") * F.col("score")).alias("weighted_sum"))
    m = M.fit_risk(x)
    return x.limit(0).agg(*[F.round(F.lit(m[c]), 5).alias(c) for c in ("a", "b", "c", "auroc")])


def _asr(spark, d):
    ref = F.regexp_replace("text", "[^A-Za-z0-9 ]", "")
    hyp = F.when(F.col("conv_id") % 5 == 0, F.lit("")).otherwise(F.regexp_replace(ref, "th", "d"))
    dom = F.when(F.col("conv_id") % 11 == 0, "no_speech").otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", dom.alias("domain"), F.when(dom == "no_speech", "").otherwise(ref).alias("text"), hyp.alias("hypothesis"), F.array(F.lit("tion"), F.lit("the")).alias("harm_terms"))


_ASR = """a AS (SELECT conv_id, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') AS ref, CASE WHEN conv_id % 11 = 0 THEN 'no_speech' ELSE role END AS domain FROM conversations),
b AS (SELECT domain, CASE WHEN domain = 'no_speech' THEN '' ELSE lower(replace(ref, ' ', '')) END AS r, lower(replace(CASE WHEN conv_id % 5 = 0 THEN '' ELSE replace(ref, 'th', 'd') END, ' ', '')) AS h FROM a)"""


@query(f"WITH {_ASR} SELECT domain, round(sum(levenshtein(r, h)) / nullif(sum(length(r)), 0), 6) AS cer, count(*) AS n FROM b WHERE r <> '' GROUP BY 1")
def character_error_rate(spark, d):
    return M.character_error_rate(_asr(spark, d), "text", "hypothesis", ["domain"]).select("domain", r6("cer").alias("cer"), "n")


@query(f"""WITH {_ASR}, c AS (SELECT *, contains(h, 'tion')::INT + contains(h, 'the')::INT AS hit FROM b), t AS (SELECT sum(hit) / (2 * count(*)) AS term_recall FROM c)
SELECT domain, count(*) AS n, round(sum(CASE WHEN r <> '' THEN levenshtein(r, h) END) / nullif(sum(length(r)), 0), 6) AS cer, round(CASE WHEN domain <> 'no_speech' THEN avg((h = '')::INT) END, 6) AS empty_rate, round(CASE WHEN domain = 'no_speech' THEN avg((h <> '')::INT) END, 6) AS false_transcript_rate, round(any_value(term_recall), 6) AS term_recall FROM c, t GROUP BY 1""")
def asr_report(spark, d):
    return M.asr_report(_asr(spark, d)).select("domain", "n", *[r6(c).alias(c) for c in ("cer", "empty_rate", "false_transcript_rate", "term_recall")])


@query(f"WITH {SCORED}, {_AP} SELECT '{{\"class\":\"' || class || '\",\"positives\":' || sum(y)::BIGINT || ',\"odds\":' || CASE WHEN class = 'en' THEN 'null' ELSE '0.5' END || '}}' AS report FROM r GROUP BY class")
def report_json(spark, d):
    return M.report_json(scored(spark, d).groupBy("class").agg(F.sum("y").alias("positives")).withColumn("odds", F.when(F.col("class") == "en", F.lit(float("nan"))).otherwise(0.5)))


@query("""WITH d AS (SELECT doc_id, generate_series AS k, ((doc_id + generate_series) % 10) / 10.0 AS p FROM documents, generate_series(0, 2))
SELECT doc_id, round(avg(-p), 6) AS confidence, round(max(p), 6) AS no_speech, round(max(1 + p * 2), 6) AS compression FROM d GROUP BY 1""")
def segment_confidence(spark, d):
    """Three segments of every document as a recogniser reports them."""
    p = (F.col("doc_id") + F.col("k")) % 10 / 10.0
    x = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    x = M.segment_confidence(x.select("doc_id", (-p).alias("avg_logprob"), p.alias("no_speech_prob"), (1 + p * 2).alias("compression_ratio")), "doc_id")
    return x.select("doc_id", *[r6(c).alias(c) for c in ("confidence", "no_speech", "compression")])


@query("""WITH r AS (SELECT CASE lang WHEN 'en' THEN 'general' WHEN 'de' THEN 'movie' WHEN 'fr' THEN 'song' ELSE 'no_speech' END AS domain, avg(doc_id % 100) / 100 AS b, avg(doc_id % 97) / 100 AS n FROM documents GROUP BY 1),
k AS (SELECT CASE domain WHEN 'general' THEN n <= b + .02 WHEN 'no_speech' THEN n <= b ELSE n < b END AND .6 > .5 AS ok FROM r) SELECT bool_and(ok) AS accepted FROM k""")
def accept_asr(spark, d):
    """Whether a second recogniser, of made error rates, may replace the first."""
    domain = F.when(F.col("lang") == "en", "general").when(F.col("lang") == "de", "movie").when(F.col("lang") == "fr", "song").otherwise("no_speech")
    rate = lambda n, recall: table(spark, d, "documents").groupBy(domain.alias("domain")).agg((F.avg(F.col("doc_id") % n) / 100).alias("cer")).select("domain", "cer", F.col("cer").alias("false_transcript_rate"), F.lit(recall).alias("term_recall"))
    return M.accept_asr(rate(100, 0.5), rate(97, 0.6))
