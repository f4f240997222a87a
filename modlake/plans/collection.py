"""Queries of collections, validation, sampling, text and mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlake.core import hashed_uniform
from modlake.functions import labels as L
from modlake.functions import text as X
from modlake.operators import collections as C
from modlake.operators import joins as J
from modlake.operators import mining as N
from modlake.operators import sampling as P
from modlake.operators import signal as G
from modlake.operators import validation as V
from modlake.plans.base import query, r6, table

_MAP = [("alarm", "AF"), ("alarm", "NF"), ("fight", "RF"), ("fight", "NO"), ("noise", "NF"), ("noise", "NO"), ("ghost", "ZZ")]
_MAPQ = "m(class, mid) AS (VALUES " + ", ".join(f"('{c}', '{m}')" for c, m in _MAP) + ")"
_SEGQ = "g AS (SELECT l_orderkey AS pos, list_distinct(list(l_returnflag || l_linestatus)) AS mids FROM lineitem GROUP BY 1)"
_LABQ = f"{_MAPQ}, {_SEGQ}, e AS (SELECT DISTINCT pos, class FROM (SELECT pos, unnest(mids) AS mid FROM g) JOIN m USING (mid))"


def _map(spark):
    return spark.createDataFrame(_MAP, "class string, mid string")


def _segments(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("mids"))


@query(f"WITH {_LABQ} SELECT pos, string_agg(class, ',' ORDER BY class) AS labels FROM e GROUP BY 1")
def map_segments(spark, d):
    return C.map_segments(_segments(spark, d), _map(spark), "pos").select("pos", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {_LABQ}, n AS (SELECT pos, class, row_number() OVER (PARTITION BY class ORDER BY pos) AS n FROM e) SELECT DISTINCT pos FROM n WHERE n <= 500")
def cap_per_class(spark, d):
    return C.cap_per_class(C.map_segments(_segments(spark, d), _map(spark), "pos"), 500, "pos").select("pos")


@query(f"WITH {_MAPQ}, k AS (SELECT DISTINCT l_returnflag || l_linestatus AS mid FROM lineitem) SELECT m.mid, string_agg(DISTINCT class, ',' ORDER BY class) AS classes FROM m JOIN k USING (mid) GROUP BY 1")
def invert_label_map(spark, d):
    k = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("mid")).distinct()
    return C.invert_label_map(_map(spark).join(k, "mid", "left_semi")).select("mid", F.array_join("classes", ",").alias("classes"))


def _onto(spark, d):
    return table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("mid")).distinct().withColumn("name", F.concat(F.lit("sound "), F.col("mid")))


_ONTO = "o AS (SELECT DISTINCT l_returnflag || l_linestatus AS mid, 'sound ' || l_returnflag || l_linestatus AS name FROM lineitem)"


@query(f"WITH {_MAPQ}, {_ONTO} SELECT class, mid, coalesce(name, '<MISSING>') AS name FROM m LEFT JOIN o USING (mid)")
def describe_label_map(spark, d):
    return C.describe_label_map(_map(spark), _onto(spark, d))


@query(f"WITH {_MAPQ}, {_ONTO} SELECT class, mid FROM m WHERE mid NOT IN (SELECT mid FROM o)")
def validate_label_map(spark, d):
    return V.unknown_mids(_map(spark), _onto(spark, d))


_CLIPS = """c AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'c' || (doc_id - 7) ELSE 'c' || doc_id END AS clip_id, CASE WHEN doc_id % 41 = 0 THEN 'guessed' ELSE 'weak' END AS label_confidence, CASE WHEN doc_id % 43 = 0 THEN 'holdout' ELSE 'train' END AS split,
  CASE WHEN doc_id % 37 = 0 THEN -1.0 ELSE 1.0 END AS start_sec, CASE WHEN doc_id % 31 = 0 THEN 0.0 ELSE 10.0 END AS duration, [lang] AS labels FROM documents)"""


def _clips(spark, d):
    i = F.col("doc_id")
    clip = F.concat(F.lit("c"), F.when(i % 50 == 7, i - 7).otherwise(i))
    return table(spark, d, "documents").select(
        i, clip.alias("clip_id"), F.when(i % 41 == 0, "guessed").otherwise("weak").alias("label_confidence"), F.when(i % 43 == 0, "holdout").otherwise("train").alias("split"),
        F.when(i % 37 == 0, -1.0).otherwise(1.0).alias("start_sec"), F.when(i % 31 == 0, 0.0).otherwise(10.0).alias("duration"), F.array("lang").alias("labels"), "source", "lang")


@query(f"""WITH {_CLIPS}, n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY doc_id) AS n FROM c)
SELECT clip_id, 'bad confidence: ' || label_confidence AS problem FROM n WHERE label_confidence = 'guessed' UNION ALL SELECT clip_id, 'bad split: ' || split FROM n WHERE split = 'holdout'
UNION ALL SELECT clip_id, 'negative start' FROM n WHERE start_sec < 0 UNION ALL SELECT clip_id, 'non-positive duration' FROM n WHERE duration <= 0 UNION ALL SELECT clip_id, 'duplicate clip_id' FROM n WHERE n > 1
UNION ALL SELECT clip_id, 'unknown label: ' || labels[1] FROM n WHERE labels[1] = 'es'""")
def validate_manifest(spark, d):
    return V.validate_manifest(_clips(spark, d), ["en", "de", "fr"], "doc_id")


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 29 = 3 THEN doc_id - 3 ELSE doc_id END AS id, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE 'x.wav' END AS audio, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'said' END AS text, CASE WHEN doc_id % 5 = 0 THEN 'heard' END AS teacher,
  CASE WHEN doc_id % 19 = 0 THEN 'opera' WHEN doc_id % 7 = 0 THEN 'no_speech' ELSE 'movie' END AS domain, source FROM documents),
b AS (SELECT *, coalesce(sum(CASE WHEN audio IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT doc_id, CASE WHEN audio IS NULL THEN 'missing keys' WHEN before > 0 THEN 'duplicate id' WHEN domain = 'opera' THEN 'bad domain' WHEN domain <> 'no_speech' AND text IS NULL AND teacher IS NULL THEN 'text or teacher_text required'
  WHEN domain = 'no_speech' AND coalesce(text, teacher, '') <> '' THEN 'no_speech must be empty' END AS error, CASE WHEN text IS NOT NULL THEN 'human' WHEN teacher IS NOT NULL THEN 'teacher' END AS transcript_source FROM b""")
def validate_asr_manifest(spark, d):
    i = F.col("doc_id")
    x = table(spark, d, "documents").select(
        i, F.when(i % 29 == 3, i - 3).otherwise(i).alias("id"), F.when(i % 23 != 0, "x.wav").alias("audio"), F.when(i % 3 != 0, "said").alias("text"), F.when(i % 5 == 0, "heard").alias("teacher_text"),
        F.when(i % 19 == 0, "opera").when(i % 7 == 0, "no_speech").otherwise("movie").alias("domain"), F.lit("train").alias("split"), F.col("source").alias("source_id"))
    return V.validate_asr_manifest(x, "doc_id").select("doc_id", "error", "transcript_source")


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def assert_source_disjoint(spark, d):
    """Sources that stand in more than one language, taken as splits."""
    return V.leaks(table(spark, d, "documents"), "source", "lang").select("source", F.array_join("splits", ",").alias("splits"))


@query("SELECT count(*) AS n, sum(quality)::BIGINT AS quality FROM labels")
def assert_clip_disjoint(spark, d):
    """All labelled clips, each in one split only: the check raises if one stands in two."""
    x = table(spark, d, "labels").withColumn("split", F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test"))
    return V.assert_disjoint(x, "doc_id").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_artifacts(spark, d):
    return V.missing_artifacts(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def has_artifact(spark, d):
    return V.has_artifact(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query(f"WITH {_CLIPS} SELECT doc_id FROM c WHERE NOT (split = 'train' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def exclude_listed(spark, d):
    return V.exclude_listed(_clips(spark, d), table(spark, d, "labels").filter("toxic = 1"), "doc_id").select("doc_id")


@query(f"WITH {_CLIPS} SELECT clip_id, min(doc_id) AS doc_id, string_agg(l, ',' ORDER BY first) AS labels FROM (SELECT clip_id, min(doc_id) AS doc_id, l, min(doc_id) AS first FROM (SELECT clip_id, doc_id, unnest(labels) AS l FROM c) GROUP BY clip_id, l) GROUP BY 1")
def dedup_union_labels(spark, d):
    return C.dedup_union_labels(_clips(spark, d), "doc_id").select("clip_id", "doc_id", F.array_join("labels", ",").alias("labels"))


@query("SELECT source AS source_id, count(*) AS n, bool_or(lang = 'es') AS forced FROM documents GROUP BY 1")
def source_group_counts(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("lang").alias("source"))
    return C.source_group_counts(x, ["es"])


_SOURCES = "x AS (SELECT 'v' || (doc_id % 97) AS source_id, source FROM documents)"


def _sources(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("v"), F.col("doc_id") % 97).alias("source_id"), "source")


@query(f"""WITH RECURSIVE {_SOURCES}, g AS (SELECT source_id, count(*) AS n, bool_or(source = 'src3') AS forced FROM x GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5('7|' || source_id), source_id) AS rn FROM g WHERE NOT forced),
t AS (SELECT coalesce(sum(n) FILTER (NOT forced), 0) AS total, coalesce(sum(n) FILTER (forced), 0) AS fixed FROM g),
f AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS source_id, NULL::VARCHAR AS split, .7 * total AS a, .15 * total AS b, .15 * total - fixed AS c FROM t
  UNION ALL SELECT o.rn, o.source_id, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END, a - CASE WHEN a >= b AND a >= c THEN o.n ELSE 0 END, b - CASE WHEN b > a AND b >= c THEN o.n ELSE 0 END, c - CASE WHEN c > a AND c > b THEN o.n ELSE 0 END FROM f JOIN o ON o.rn = f.rn + 1)
SELECT source_id, split FROM f WHERE rn > 0 UNION ALL SELECT source_id, 'test' FROM g WHERE forced""")
def assign_splits_greedy(spark, d):
    """Sources to splits by the largest deficit."""
    return C.assign_splits_greedy(_sources(spark, d), {"train": 0.7, "val": 0.15, "test": 0.15}, 7, ["src3"])


@query("""WITH h AS (SELECT doc_id, floor(('0x' || substring(md5('7|' || doc_id), 1, 13))::BIGINT / 4503599627370496 * 1000000) AS h FROM documents) SELECT doc_id, CASE WHEN h < 700000 THEN 'train' WHEN h < 850000 THEN 'val' ELSE 'test' END AS split FROM h""")
def assign_splits_hash(spark, d):
    """Every document as a source of its own to a split by its hash."""
    return table(spark, d, "documents").select("doc_id").withColumn("split", C.assign_splits_hash("doc_id", {"train": 0.7, "val": 0.15, "test": 0.15}, 7))


@query("""WITH h AS (SELECT source, floor(('0x' || substring(md5('7|' || source), 1, 13))::BIGINT / 4503599627370496 * 1000000) AS h FROM documents) SELECT source, CASE WHEN h < 700000 THEN 'train' WHEN h < 850000 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM h GROUP BY ALL""")
def apply_split(spark, d):
    """Rows with the split of their source, counted."""
    x = table(spark, d, "documents").select("doc_id", "source")
    to = x.select("source").distinct().withColumn("split", C.assign_splits_hash("source", {"train": 0.7, "val": 0.15, "test": 0.15}, 7))
    return C.apply_split(x, to, "source").groupBy("source", "split").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS split FROM documents WHERE doc_id % 2 = 0 OR n_chars > 100")
def split_union(spark, d):
    """Two parts, one with a column more, of which rows of all splits are taken together."""
    t = table(spark, d, "documents")
    parts = [t.filter("doc_id % 2 = 0").select("doc_id", F.lit("a").alias("split")), t.filter("doc_id % 2 = 1 and n_chars > 100").select("doc_id", F.lit("b").alias("split"), "lang")]
    return C.split_union(parts).select("doc_id", "split")


@query("""WITH v AS (SELECT source, min(lang) AS class FROM documents GROUP BY 1 UNION ALL SELECT 'd' || doc_id, lang FROM documents),
k AS (SELECT *, count(*) OVER (PARTITION BY class) AS n, row_number() OVER (PARTITION BY class ORDER BY md5('3|' || source), source) AS k FROM v)
SELECT source, class, CASE WHEN k <= greatest(1, floor(.7 * n)) THEN 'train' WHEN k <= greatest(1, floor(.7 * n)) + greatest(1, floor(.15 * n)) THEN 'val' ELSE 'test' END AS split FROM k""")
def split_per_class(spark, d):
    t = table(spark, d, "documents")
    x = t.select("source", F.array("lang").alias("labels")).unionByName(t.select(F.concat(F.lit("d"), F.col("doc_id")).alias("source"), F.array("lang").alias("labels")))
    return C.split_per_class(x, "source", order=F.md5(F.concat(F.lit("3|"), F.col("source"))))


@query("""WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('5|' || doc_id), doc_id) AS k FROM documents WHERE n_chars >= 40)
SELECT doc_id, source, CASE WHEN k <= 3 THEN 'general' ELSE 'movie' END AS domain FROM k WHERE k <= 5""")
def sample_per_group(spark, d):
    return C.sample_per_group(table(spark, d, "documents"), "source", "doc_id", {"general": 3, "movie": 2}, keep=F.col("n_chars") >= 40, strict=False, order=F.md5(F.concat(F.lit("5|"), F.col("doc_id")))).select("doc_id", "source", "domain")


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1")
def count_matrix(spark, d):
    return C.count_matrix(table(spark, d, "documents"), "source", "lang", ["en", "de", "fr", "es"])


@query("SELECT source, lang, arg_min(doc_id, lpad(doc_id::VARCHAR, 12, '0')) AS doc_id FROM documents GROUP BY 1, 2")
def first_per_group(spark, d):
    x = table(spark, d, "documents").select("source", "lang", "doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"))
    return C.first_per_group(x, ["source", "lang"], "name").select("source", "lang", "doc_id")


@query("SELECT d.doc_id, quality, toxic FROM documents d JOIN labels USING (doc_id)")
def teacher_targets(spark, d):
    return C.teacher_targets(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("""WITH k AS (SELECT md5(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS k, doc_id FROM documents), b AS (SELECT md5(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS k FROM benchmark)
SELECT min(doc_id) AS doc_id FROM k WHERE k NOT IN (SELECT k FROM b) GROUP BY k""")
def decontaminate(spark, d):
    return X.decontaminate(table(spark, d, "documents"), "text", table(spark, d, "benchmark"), "text", "doc_id").select("doc_id")


@query("""SELECT doc_id, (lang = 'en')::INT || ',' || (lang = 'de')::INT || ',' || (lang = 'fr')::INT || ',' || (lang = 'es')::INT AS hot, lang IN ('en', 'de') AS harm FROM documents""")
def multi_hot(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.array("lang").alias("l"))
    hot = L.multi_hot("l", ["en", "de", "fr", "es"])
    return x.select("doc_id", F.array_join(F.transform(hot, lambda v: v.cast("int").cast("string")), ",").alias("hot"), L.is_harm("l", ["en", "de"]).alias("harm"))


@query("SELECT event_id, 'u' || user_id || '_' || replace(printf('%.6g', value), '.000000', '') AS clip_key, 'u_' || replace(printf('%.6g', value / 1000000), '.000000', '') AS small FROM events")
def clip_key(spark, d):
    """Keys of every event, and of values so small that some need an exponent."""
    return table(spark, d, "events").select("event_id", L.clip_key(F.concat(F.lit("u"), F.col("user_id")), "value").alias("clip_key"), L.clip_key(F.lit("u"), F.col("value") / 1000000).alias("small"))


_PROBS = "p AS (SELECT doc_id, [(n_chars % 1000) / 1000.0::DOUBLE, ((doc_id * 7919) % 1009) / 1009.0::DOUBLE, ((doc_id * 31) % 97) / 97.0::DOUBLE] AS p FROM documents)"


def _probs(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", i.cast("string").alias("clip_id"), F.array((F.col("n_chars") % 1000) / 1000.0, ((i * 7919) % 1009) / 1009.0, ((i * 31) % 97) / 97.0).alias("probs"))


@query(f"WITH {_PROBS} SELECT doc_id, round(greatest(p[1], .5 * p[2], .25 * p[3]), 6) AS top, round(p[1] + .5 * p[2] + .25 * p[3], 6) AS total, round(1 / (1 + exp(-(2 * greatest(p[1], .5 * p[2], .25 * p[3]) + p[1] + .5 * p[2] + .25 * p[3] - 2))), 6) AS risk FROM p")
def risk_score(spark, d):
    params = spark.createDataFrame([(2.0, 1.0, -2.0, True, "v1")], "a double, b double, c double, fitted boolean, policy_version string")
    x = _probs(spark, d).withColumn("w", L.weight_vector(["a", "b", "c"], F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(0.5), F.lit("c"), F.lit(0.25))))
    top, total = L.risk_features("probs", "w")
    return L.risk_score(x, params, "probs", "w", "v1").select("doc_id", r6(top).alias("top"), r6(total).alias("total"), r6("risk").alias("risk"))


@query(f"WITH {_PROBS}, e AS (SELECT doc_id, i, p[i] AS v, row_number() OVER (PARTITION BY doc_id ORDER BY p[i] DESC, i) AS k FROM p, range(1, 4) r(i)) SELECT doc_id, string_agg(['a', 'b', 'c'][i], ',' ORDER BY k) AS top, round(max(v), 6) AS prob FROM e WHERE k <= 2 GROUP BY 1")
def top_events(spark, d):
    t = L.top_events("probs", ["a", "b", "c"], 2)
    return _probs(spark, d).select("doc_id", F.array_join(F.transform(t, lambda x: x["class"]), ",").alias("top"), r6(L.binary_any("probs", 3)).alias("prob"))


@query(f"""WITH {_PROBS}, m AS (SELECT doc_id, greatest(p[1], p[2]) AS prob, CASE WHEN p[1] >= p[2] THEN 'a' ELSE 'b' END AS predicted FROM p), k AS (SELECT *, CASE WHEN prob >= .6 THEN 'false_positive' ELSE 'uncertain' END AS kind, CASE WHEN prob >= .6 THEN prob ELSE 1 - 2 * abs(prob - .5) END AS priority FROM m WHERE prob >= .4),
o AS (SELECT *, row_number() OVER (ORDER BY kind, priority DESC, doc_id) AS rank FROM k) SELECT rank, doc_id::VARCHAR AS clip_id, kind, predicted, round(prob, 6) AS prob, round(priority, 6) AS priority FROM o WHERE rank <= 400""")
def select_candidates(spark, d):
    x = N.select_candidates(_probs(spark, d), ["a", "b"], 400, "doc_id")
    return x.select(F.col("rank").cast("long").alias("rank"), "clip_id", "kind", "predicted", r6("prob").alias("prob"), r6("priority").alias("priority"))


@query(f"WITH {_PROBS} SELECT CASE WHEN p[1] >= p[2] THEN 'a' ELSE 'b' END AS predicted, count(*) AS n FROM p WHERE greatest(p[1], p[2]) >= .6 GROUP BY 1")
def fp_distribution(spark, d):
    return N.fp_distribution(N.score_candidates(_probs(spark, d), ["a", "b"], "doc_id"))


@query("""SELECT doc_id::VARCHAR AS clip_id, source AS source_id, CASE WHEN doc_id % 4 = 0 THEN 'bang' ELSE 'talk' END AS label FROM documents WHERE doc_id % 2 = 0""")
def promote_reviewed(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    cands = docs.select(i.cast("string").alias("clip_id"), F.lit("pool").alias("source"), F.col("source").alias("source_id"), F.lit(0.0).alias("start_sec"), F.lit(10.0).alias("duration"))
    dec = docs.select(i.cast("string").alias("clip_id"), F.when(i % 2 == 1, "skip").when(i % 4 == 0, "confirm_positive").otherwise("confirm_fp").alias("action"), F.when(i % 4 == 0, "bang").otherwise("talk").alias("label"), i.alias("seq"))
    classes = spark.createDataFrame([("bang", True), ("talk", False)], "class string, is_harm boolean")
    return N.export_reviewed(dec, cands, classes).select("clip_id", "source_id", F.get("labels", F.lit(0)).alias("label"))


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 AND (props->>'$.k')::DOUBLE * 1.5 <= 100 THEN round_even((props->>'$.k')::DOUBLE * 1.5, 0)::INT END AS degree_percent, CASE WHEN event_type IN ('error', 'click') THEN event_type END AS category,
event_id % 3 = 0 OR (props->>'$.k')::DOUBLE * 1.5 > 100 AS kept_raw FROM events""")
def verdict_normalize(spark, d):
    """Chatty answers around an object; each third quotes its degree, which doesn't count."""
    e = table(spark, d, "events")
    n = (F.get_json_object("props", "$.k").cast("double") * 1.5).cast("string")
    n = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n)
    raw = F.concat(F.lit("Sure! Here: {\"degree\": "), n, F.lit(", \"category\": \""), F.upper("event_type"), F.lit("\", \"reason\": \"r\"} Hope it helps."))
    v = L.verdict_normalize(raw, ["error", "click"])
    return e.select("event_id", v.alias("v")).select("event_id", "v.degree_percent", "v.category", F.col("v.raw").isNotNull().alias("kept_raw"))


_LEX = {"abuse": (0.9, {"stupid": 0.6, "idiot": 0.7, "moron": 0.8}), "disgust": (0.5, {"trash": 0.5, "disgusting": 0.9, "scum": 0.4})}


def _lex_sql() -> str:
    cats = [f"round(least(1.0, {' + '.join(f'''(CASE WHEN contains(lower(text), '{t}') THEN {w} ELSE 0 END)''' for t, w in ts.items())}) * {cw}, 4)" for cw, ts in _LEX.values()]
    return f"SELECT doc_id, ({cats[0]})::DOUBLE AS abuse, ({cats[1]})::DOUBLE AS disgust, greatest({cats[0]}, {cats[1]})::DOUBLE AS risk, CASE WHEN greatest({cats[0]}, {cats[1]}) > 0 THEN CASE WHEN {cats[0]} >= {cats[1]} THEN 'abuse' ELSE 'disgust' END END AS top FROM documents"


@query(_lex_sql())
def lexicon_score(spark, d):
    x = table(spark, d, "documents").select("doc_id", X.lexicon_score("text", _LEX).alias("s"))
    return x.select("doc_id", F.col("s.by_category")["abuse"].alias("abuse"), F.col("s.by_category")["disgust"].alias("disgust"), F.col("s.risk").alias("risk"), F.col("s.top").alias("top"))


_WS = r"[ \t\n\x0B\f\r]"


@query(f"""WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '[ \t]+', ' ', 'g') AS t FROM documents),
s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(t, '([.!?。！？]){_WS}+', '\\1' || chr(10), 'g'), '\\n+')) AS s FROM f), s2 AS (SELECT doc_id, regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g') AS s FROM s),
c AS (SELECT doc_id, unnest(string_split_regex(s, '{_WS}*([,;:…]+|[-–—]{_WS}+){_WS}*')) AS c FROM s2 WHERE s <> ''), c2 AS (SELECT doc_id, regexp_replace(c, '^{_WS}+|{_WS}+$', '', 'g') AS c FROM c),
w AS (SELECT doc_id, string_split_regex(c, '{_WS}+') AS w FROM c2 WHERE c <> ''), v AS (SELECT doc_id, w, unnest(range(1, len(w) - 6, 4)) AS i FROM w WHERE len(w) > 8),
u AS (SELECT doc_id, t AS u FROM f UNION ALL SELECT doc_id, s FROM s2 UNION ALL SELECT doc_id, c FROM c2 UNION ALL SELECT doc_id, array_to_string(list_slice(w, i, i + 7), ' ') FROM v)
SELECT doc_id, count(*) AS units, md5(string_agg(u, '|' ORDER BY u)) AS content FROM (SELECT DISTINCT doc_id, u FROM u WHERE u <> '') GROUP BY 1""")
def text_units(spark, d):
    """The distinct views of each text: sentences, clauses, windows."""
    t = table(spark, d, "documents").filter(F.col("text").rlike(r"(?U)\S"))  # a filter by the units would compute them once more
    u = t.select("doc_id", F.sort_array(X.text_units(F.col("text"))).alias("u"))
    return u.select("doc_id", F.size("u").cast("long").alias("units"), F.md5(F.array_join("u", "|")).alias("content"))


def _loops() -> str:
    runs = []
    for size, times in ((1, 5), (2, 3), (3, 3), (4, 3)):
        same = " AND ".join(f"list_slice(w, i, i + {size - 1}) = list_slice(w, i + {k * size}, i + {k * size + size - 1})" for k in range(1, times))
        runs.append(f"len(list_filter(range(1, len(w) - {size * times} + 2), lambda i: {same})) > 0")
    return " OR ".join(runs)


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[가-힣a-zA-Z0-9]+') AS w FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -item_id - 1, repeat(substr(text, 1, 12) || ' ', 3) FROM benchmark)),
n AS (SELECT doc_id, max(c) AS top, count(*) AS kinds FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM t) GROUP BY 1, 2) GROUP BY 1)
SELECT t.doc_id, len(w) >= 4 AND (2 * top > len(w) OR kinds < .35 * len(w) OR {_loops()}) AS looping FROM t JOIN n USING (doc_id)""")
def degenerate_text(spark, d):
    """Whether each document loops, and each benchmark passage's beginning said three times (ids below 0)."""
    x = table(spark, d, "documents").select("doc_id", "text")
    y = table(spark, d, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), F.repeat(F.concat(F.substring("text", 1, 12), F.lit(" ")), F.lit(3)).alias("text"))
    return x.unionByName(y).filter(F.col("text").rlike("[가-힣a-zA-Z0-9]")).select("doc_id", V.degenerate_text("text").alias("looping"))


@query("SELECT CASE WHEN regexp_matches(text, 'trash|scum') THEN 'threat' WHEN regexp_matches(text, 'stupid|idiot') THEN 'abuse' ELSE 'safe' END AS label, count(*) AS n FROM documents GROUP BY 1")
def weak_label(spark, d):
    return table(spark, d, "documents").groupBy(X.weak_label(F.col("text"), "trash|scum", "stupid|idiot", F.lit(True)).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' ELSE 'en' END AS lang, count(*) AS n FROM conversations GROUP BY 1")
def detect_lang(spark, d):
    return table(spark, d, "conversations").groupBy(X.detect_lang(F.col("text")).alias("lang")).agg(F.count("*").alias("n"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
s AS (SELECT conv_id, turn, CASE WHEN before IS NULL THEN text ELSE lower(array_to_string(list_slice(string_split_regex(trim(before), '\s+'), -3, -1), ' ')) || ', ' || text END AS text FROM c),
p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM s),
t AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS now, list_filter(string_split_regex(coalesce(prev, ''), '\s+'), lambda x: x <> '') AS old FROM p),
m AS (SELECT *, list_transform(now, lambda x: lower(regexp_replace(x, '[^가-힣a-zA-Z0-9]', '', 'g'))) AS a, list_transform(old, lambda x: lower(regexp_replace(x, '[^가-힣a-zA-Z0-9]', '', 'g'))) AS b FROM t),
k AS (SELECT *, coalesce(list_max(list_filter(range(1, least(20, len(a), len(b)) + 1), lambda n: list_slice(a, 1, n) = list_slice(b, len(b) - n + 1, len(b)) AND NOT list_contains(list_slice(a, 1, n), ''))), 0) AS n FROM m)
SELECT conv_id, turn, n AS removed, md5(CASE WHEN n > 0 THEN array_to_string(list_slice(now, n + 1, len(now)), ' ') ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END) AS fresh FROM k""")
def remove_leading_overlap(spark, d):
    """Turns that begin with the last words of the turn before, in lower case and with a comma, without these."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    words = F.split(F.trim(before), r"\s+")
    x = c.withColumn("text", F.when(before.isNull(), F.col("text")).otherwise(F.concat(F.lower(F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3)), " ")), F.lit(", "), F.col("text"))))
    out = X.remove_leading_overlap(x, "conv_id", "turn", "text")
    count = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda v: v != ""))
    return out.select("conv_id", "turn", (count("text") - count("fresh")).cast("long").alias("removed"), F.md5("fresh").alias("fresh"))


_PROTO = "p AS (SELECT label, embedding AS e FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3)"


@query(f"""WITH {_PROTO}, c AS (SELECT v.vec_id, p.label, max(list_cosine_similarity(v.embedding::DOUBLE[], p.e::DOUBLE[])) AS s FROM embeddings v, p GROUP BY 1, 2),
m AS (SELECT vec_id, max(s) FILTER (label <> 0) - max(s) FILTER (label = 0) AS margin, arg_max(label, s) FILTER (label <> 0) AS top FROM c GROUP BY 1)
SELECT vec_id, round(margin, 6) AS margin, round(1 / (1 + exp(-40 * (margin - .02))), 6) AS risk, CASE WHEN margin > .02 THEN top::VARCHAR END AS category FROM m""")
def prototype_score(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "embeddings")
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    p = e.withColumn("n", n).filter("n <= 3").select(F.col("label").cast("string").alias("category"), "embedding")
    return X.prototype_score(e, "vec_id", "embedding", p, safe="0").select("vec_id", r6("margin").alias("margin"), r6("risk").alias("risk"), "category")


@query("""WITH b AS (SELECT i, avg(embedding[i]::DOUBLE) AS m, sqrt(greatest(avg(embedding[i]::DOUBLE * embedding[i]::DOUBLE) - avg(embedding[i]::DOUBLE) ** 2, 0)) AS s FROM embeddings, range(1, 65) r(i) GROUP BY 1)
SELECT i - 1 AS bin, round(m, 6) AS mean, round(s, 6) AS std FROM b""")
def fit_norm_stats(spark, d):
    e = table(spark, d, "embeddings").select(F.transform("embedding", lambda v: F.array(v)).alias("f"))
    x = G.fit_norm_stats(e, "f").select(F.posexplode(F.arrays_zip("mean", "std")).alias("bin", "z"))
    return x.select(F.col("bin").cast("long").alias("bin"), r6("z.mean").alias("mean"), r6("z.std").alias("std"))


@query("""WITH b AS (SELECT i, avg(embedding[i]::DOUBLE) AS m, sqrt(greatest(avg(embedding[i]::DOUBLE * embedding[i]::DOUBLE) - avg(embedding[i]::DOUBLE) ** 2, 0)) AS s FROM embeddings, range(1, 65) r(i) GROUP BY 1)
SELECT vec_id, round(sum((embedding[i]::DOUBLE - m) / (s + 1e-6)), 4) AS total FROM embeddings, b GROUP BY 1""")
def apply_norm(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.array(v.cast("double"))).alias("f"))
    x = e.crossJoin(F.broadcast(G.fit_norm_stats(e, "f"))).select("vec_id", L.apply_norm("f", F.col("mean"), F.col("std")).alias("z"))
    return x.select("vec_id", F.round(F.aggregate(F.flatten("z"), F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("SELECT vec_id, round(10 * log10(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / 64), 4) AS db FROM embeddings WHERE 10 * log10(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / 64) >= -18.1")
def rms_gate(spark, d):
    return V.rms_gate(table(spark, d, "embeddings"), "embedding", -18.1).select("vec_id", F.round(V.rms_db("embedding"), 4).alias("db"))


@query("SELECT vec_id, i AS frame, round(list_sum(list_slice(embedding::DOUBLE[], i * 8 + 1, i * 8 + 16)), 5) AS total FROM embeddings, range(0, 7) r(i)")
def frame_signal(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode(G.frame_signal("embedding", 16, 8)).alias("frame", "f"))
    return x.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(F.aggregate("f", F.lit(0.0), lambda a, v: a + v.cast("double")), 5).alias("total"))


@query("SELECT lang AS class, count(*) AS n, round(sum(count(*)) OVER () / (4 * count(*)), 6) AS weight FROM documents GROUP BY 1")
def class_weights(spark, d):
    return P.class_weights(table(spark, d, "documents"), ["en", "de", "fr", "es"], "lang").select("class", "n", r6("weight").alias("weight"))


@query("WITH n AS (SELECT lang AS class, count(*) AS n, 1 / sqrt(count(*)) AS i FROM documents GROUP BY 1) SELECT class, n, round(.25 + .5 * (i - min(i) OVER ()) / (max(i) OVER () - min(i) OVER ()), 6) AS alpha FROM n")
def class_alpha(spark, d):
    x = table(spark, d, "documents").select(F.array("lang").alias("labels"))
    return P.class_alpha(x, ["en", "de", "fr", "es"]).select("class", "n", r6("alpha").alias("alpha"))


@query("SELECT doc_id, round(CASE lang WHEN 'en' THEN .4 WHEN 'de' THEN .3 WHEN 'fr' THEN .2 ELSE .1 END / count(*) OVER (PARTITION BY lang), 9) AS weight FROM documents")
def domain_weights(spark, d):
    return P.domain_weights(table(spark, d, "documents"), {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}, "lang").select("doc_id", F.round("weight", 9).alias("weight"))


def _pool(kind: int, quota: int, batches: str) -> str:
    return f"""k{kind} AS (SELECT doc_id, harm, pass, size, per, row_number() OVER (ORDER BY pass, md5('3|0|{kind}|' || pass || '|' || doc_id), doc_id) - 1 - pass * size AS pos FROM
  (SELECT doc_id, harm, count(*) OVER () AS size, floor(count(*) OVER () / {quota})::BIGINT AS per, {batches} AS batches FROM x WHERE harm = ({kind} = 1)),
  LATERAL (SELECT unnest(range(0, ceil(CASE WHEN per > 0 THEN batches / greatest(per, 1) ELSE batches * {quota} / size END)::BIGINT)) AS pass)),
r{kind} AS (SELECT doc_id, harm, floor(CASE WHEN per > 0 THEN pass * per + floor(pos / {quota}) ELSE (pass * size + pos) / {quota} END)::BIGINT AS batch, (CASE WHEN per > 0 THEN pos ELSE pass * size + pos END % {quota} + {0 if kind else 16})::BIGINT AS slot, {batches} AS batches
  FROM k{kind} WHERE per = 0 OR pos < per * {quota})"""


_BATCHES = "(SELECT greatest(1, max(ceil(n / 16)))::BIGINT FROM (SELECT count(*) AS n FROM x GROUP BY harm))"


@query(f"WITH x AS (SELECT doc_id, toxic = 1 AS harm FROM labels), {_pool(1, 16, _BATCHES)}, {_pool(0, 16, _BATCHES)} SELECT batch, slot, doc_id, harm FROM r1 WHERE batch < batches UNION ALL SELECT batch, slot, doc_id, harm FROM r0 WHERE batch < batches")
def balanced_batches(spark, d):
    """Batches of 32 with half toxic documents."""
    x = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("harm"))
    return P.balanced_batches(x, "doc_id", "harm", 32, seed=3)


@query("""WITH x AS (SELECT doc_id, 2000.0::DOUBLE * n_chars / (SELECT sum(n_chars) FROM documents) AS lam, ('0x' || substring(md5('5|' || doc_id), 1, 13))::BIGINT / 4503599627370496 AS u FROM documents WHERE n_chars > 0),
k AS (SELECT doc_id, len(list_filter(range(0, 400), lambda j: u >= list_sum(list_transform(range(0, j + 1), lambda i: exp(i * ln(lam) - lam - lgamma(i + 1)))))) AS k FROM x) SELECT doc_id, unnest(range(1, k + 1))::INT AS draw FROM k""")
def weighted_sample(spark, d):
    """Draws with replacement by length."""
    x = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("weight"))
    return P.weighted_sample(x, 2000, "doc_id", seed=5).select("doc_id", "draw")


@query("SELECT doc_id, round(('0x' || substring(md5('9|' || doc_id), 1, 13))::BIGINT / 4503599627370496, 9) AS u FROM documents")
def hashed_uniforms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(hashed_uniform(9, "doc_id"), 9).alias("u"))


@query("""WITH s AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_returnflag || l_linestatus || (l_linenumber % 2)))) AS s FROM lineitem GROUP BY 1), c AS (SELECT s, min(k) AS rep FROM s GROUP BY 1)
SELECT a.rep AS a, b.rep AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM c a JOIN c b ON a.rep < b.rep WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= .5""")
def label_similarity(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber") % 2)).alias("labels"))
    return J.label_similarity(x, "l_orderkey", "labels", 0.5).select("a", "b", r6("jaccard").alias("jaccard"))


@query("SELECT doc_id, n FROM (SELECT doc_id, contains(lower(text), 'tion')::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'heit')::INT AS n FROM documents) WHERE n > 0")
def lexicon_containment(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.size(J.containment(t, "text", ["tion", "license", "heit"])).alias("n")).filter("n > 0")


@query("SELECT event_type AS status, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN event_id END)::BIGINT AS failed FROM events GROUP BY 1")
def fetch_report(spark, d):
    """Counts by status, with the sum of the failed ids."""
    counts, failed = C.fetch_report(table(spark, d, "events").withColumnRenamed("event_type", "status"), "event_id", failed="error")
    ids = failed.agg(F.sum("event_id").alias("failed")).withColumn("status", F.lit("error"))
    return counts.join(ids, "status", "left")


@query("WITH t AS (SELECT lang AS class, max(doc_id) AS k, arg_max(doc_id, struct_pack(a := n_chars % 100, b := -doc_id)) AS doc_id FROM documents GROUP BY 1) SELECT class, doc_id FROM t")
def worst_window(spark, d):
    x = table(spark, d, "documents").select(F.col("lang").alias("class"), "doc_id", F.lit("warn").alias("level"), (F.col("n_chars") % 100).cast("double").alias("score"))
    return L.worst_window(x, "class", "level", "score", "doc_id").select("class", "doc_id")
