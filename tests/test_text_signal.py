import io
import math
import random
import re
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlake.functions import text as X
from modlake.operators import sampling as P
from modlake.operators import signal as G
from modlake.operators import spans as S
from modlake.operators import validation as V
from modlake.plans import registry
from modlake.sources import manifests as R


def texts(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "id int, text string")


def column(df, c):
    return [r.v for r in df.orderBy("id").select(c.alias("v")).collect()]


def test_degenerate_text(spark):
    xs = ["예 " * 34, "go home now go home now go home now", "no no no stop it please", "a a a", "", None, "one two three four five six"]
    assert column(texts(spark, xs), V.degenerate_text("text")) == [True, True, False, False, False, False, False]


def loop_degenerate(t):
    w = re.findall("[가-힣a-zA-Z0-9]+", t)
    n = len(w)
    if n < 4:
        return False
    rep = lambda s, k: any(all(w[i : i + s] == w[i + j * s : i + j * s + s] for j in range(k)) for i in range(n - s * k + 1))
    return max(map(w.count, w)) * 2 > n or len(set(w)) < 0.35 * n or rep(1, 5) or any(rep(s, 3) for s in (2, 3, 4))


def test_degenerate_against_a_loop(spark):
    random.seed(1)
    xs = [" ".join(random.choice("abcdABé") for _ in range(random.randint(1, 25))) for _ in range(300)]
    xs += [" ".join(random.choice("abcdefghijkl") for _ in range(8)) + " x y z w" * random.randint(1, 3) for _ in range(50)]
    assert column(texts(spark, xs), V.degenerate_text("text")) == [loop_degenerate(x) for x in xs]


def test_fuzzy_terms(spark):
    got = column(texts(spark, ["대학살이다", "대학쌀이다", "학교에 간다", None]), X.fuzzy_terms(F.col("text"), ["대학살"]))
    assert got[0] == [] and [x.term for x in got[1]] == ["대학살"] and got[1][0].distance == 1 and got[2] == [] and got[3] == []
    assert column(texts(spark, ["가a각"]), F.length(X.jamo(F.col("text")))) == [7]


def test_lexicon(spark):
    lex = {"threat": (1.0, {"kill": 0.7, "die": 0.5}), "abuse": (0.5, {"fool": 1.0})}
    r = column(texts(spark, ["I will KILL you, die", "fool", "", None]), X.lexicon_score("text", lex))
    assert (r[0].risk, r[0].top, r[0].matched["threat"]) == (1.0, "threat", ["kill", "die"]) and (r[1].risk, r[1].top) == (0.5, "abuse") and r[2].risk == 0 and r[2].top is None


def loop_units(text):
    """Views of a text, in order, without repeats."""
    found = {}
    whole = re.sub("[ \t]+", " ", text.strip())
    pieces = [whole]
    for sentence in re.split(r"\n+|(?<=[.!?。！？])\s+", whole):
        if not (sentence := sentence.strip()):
            continue
        pieces.append(sentence)
        for clause in map(str.strip, re.split(r"\s*(?:[,;:…]+|[-–—]\s+)\s*", sentence)):
            words = clause.split()
            pieces += [clause] + [" ".join(words[k : k + 8]) for k in range(0, len(words) - 7, 4) if len(words) > 8]
    return [found.setdefault(p, p) for p in pieces if p and p not in found]


@pytest.mark.parametrize("name", ["text_units", "hybrid_text_score"])
def test_units_are_computed_once(spark, data, name):
    plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1


def test_units_of_texts_with_odd_space(spark):
    pieces = ["a", "b c", " \n ", "\n", "\u00a0\n", ". ", "! \n\u3000", ", ", "\u2003;", " - ", "\t", "  ", "one two three four five six seven eight nine\u00a0ten"]
    r = random.Random(5)
    xs = ["".join(r.choice(pieces) for _ in range(r.randint(1, 12))) for _ in range(400)]
    assert column(texts(spark, xs), X.text_units(F.col("text"))) == [loop_units(x) for x in xs]


def test_text_units(spark):
    words = [f"w{i}" for i in range(17)]
    (u,) = column(texts(spark, [" ".join(words)]), X.text_units(F.col("text")))
    assert u == [" ".join(words), *[" ".join(words[i : i + 8]) for i in (0, 4, 8)]]
    (v,) = column(texts(spark, ["Stop it.  Now, or - else!\nGo"]), X.text_units(F.col("text")))
    assert v == ["Stop it. Now, or - else!\nGo", "Stop it.", "Now, or - else!", "Now", "or", "else!", "Go"]
    random.seed(11)
    xs = ["".join(random.choice(["a", "bc ", "d. ", "e,", " ;", "- ", "\n", "\t ", "f g h i j k l m n ", "…"]) for _ in range(random.randint(0, 25))) for _ in range(300)]
    assert column(texts(spark, xs), X.text_units(F.col("text"))) == [loop_units(x) for x in xs]
    assert column(texts(spark, [None, " \n"]), X.text_units(F.col("text"))) == [[], []]


def test_hybrid_score(spark):
    df = texts(spark, ["fine words. you fool", "nothing", None])
    scores = spark.createDataFrame([("fine words.", 0.2), ("nothing", 0.7)], "unit string, score double")
    r = {x.id: x for x in X.hybrid_text_score(df, "id", "text", {"abuse": (0.9, {"fool": 1.0})}, scores).collect()}
    assert (r[0].score, r[0].classifier_max, r[0].lexicon_max, r[0].unit) == (0.9, 0.2, 0.9, "fine words.") and (r[1].score, r[1].unit) == (0.7, "nothing") and (r[2].score, r[2].unit) == (0, "")


def test_overlap_against_a_loop(spark):
    random.seed(2)
    rows = [("k", i, " ".join(random.choice(["a", "B", "b,", "A", "-"]) for _ in range(random.randint(0, 6)))) for i in range(150)]
    got = {r.i: r.fresh for r in X.remove_leading_overlap(spark.createDataFrame(rows, "k string, i int, t string"), "k", "i", "t").collect()}
    plain = lambda w: re.sub("[^a-z0-9]", "", w.lower())
    prev, hits = [], 0
    for _, i, t in rows:
        w = t.split()
        fits = [k for k in range(1, min(20, len(w), len(prev)) + 1) if all(plain(x) and plain(x) == plain(y) for x, y in zip(w[:k], prev[-k:], strict=True))]
        assert got[i] == (" ".join(w[max(fits) :]) if fits else t.strip())
        prev, hits = w or prev, hits + bool(fits)
    assert hits > 20
    two = spark.createDataFrame([("k", 1, "Caf\u00e9 한국"), ("k", 2, "CAFE\u0301! \u1112\u1161\u11ab국 now"), ("k", 3, None)], "k string, i int, t string")
    assert [r.fresh for r in X.remove_leading_overlap(two, "k", "i", "t").orderBy("i").collect()] == ["Caf\u00e9 한국", "now", ""]


def test_combination(spark):
    df = spark.createDataFrame([(0.8, "abuse", 0.1, None), (0.8, "threat", 0.1, None), (0.1, "abuse", 0.5, None), (0.0, None, 0.25, 1), (0.0, None, 0.1, 0)], "lex double, top string, sem double, d int")
    got = [r.v.risk for r in df.select(X.combine_text_risk(F.col("lex"), F.col("top"), F.col("sem"), F.col("d")).alias("v")).collect()]
    assert got == [0.1, 0.8, 0.5, 0.6, 0.1]
    e = spark.createDataFrame([([{"neutral": 0.9, "toxic": 0.7}, {"threat": 0.8}],)], "m array<map<string,double>>").select(X.ensemble_toxicity(F.col("m"), ["neutral"], {"toxic": "abuse"}).alias("v")).first().v
    assert (e.risk, e.category) == (0.8, "threat")
    s = spark.createDataFrame([({"safe": 0.3, "abuse": 0.5, "threat": 0.2},)], "p map<string,double>").select(X.softmax_risk(F.col("p")).alias("v")).first().v
    assert (s.risk, s.category) == (0.7, "abuse")


def test_prototypes(spark):
    p = spark.createDataFrame([("safe", [1.0, 0.0]), ("threat", [0.0, 1.0])], "category string, embedding array<double>")
    df = spark.createDataFrame([(1, [0.0, 2.0], "x"), (2, [3.0, 0.0], "x"), (3, [0.0, 1.0], " ")], "id int, e array<double>, text string")
    r = {x.id: x for x in X.prototype_score(df, "id", "e", p, text="text").collect()}
    assert r[1].category == "threat" and r[1].risk > 0.99 and r[2].category is None and r[3].risk == 0


def test_corpora(spark):
    clauses = spark.createDataFrame([("t", "en", "one"), ("t", "en", "two"), ("t", "ko", "삼")], "category string, lang string, text string")
    c = X.generate_corpus(clauses, spark.createDataFrame([("en", "and")], "lang string, connector string"), 4)
    got = {r.text for r in c.collect()}
    assert {"one", "two", "삼"} < got and got - {"one", "two", "삼"} <= {"one and two", "two and one"} and c.count() == 4
    t = X.generate_templates(spark.createDataFrame([("x", "a"), ("y", "a")], "term string, label string"), spark.createDataFrame([("a", "say {}")], "label string, template string"), spark.createDataFrame([("now",)], "tail string"), spark.createDataFrame([("y",)], "term string"))
    assert sorted(r.text for r in t.collect()) == ["say x", "say x now"]
    d = X.decontaminate(texts(spark, ["a b", "ab", "c", None]), "text", spark.createDataFrame([("c ",)], "t string"), "t", "id")
    assert sorted(r.id for r in d.collect()) == [0, 3]
    assert [r.text for r in X.compose(texts(spark, ["é", "x"]), "text").orderBy("id").collect()] == ["é", "x"]


def wav(x, rate=16000, width=2):
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes() if width == 2 else bytes(len(x)))
    return b.getvalue()


def test_audio(spark, tmp_path):
    t = np.arange(16000) / 16000
    (tmp_path / "sine.wav").write_bytes(wav(np.sin(2 * np.pi * 440 * t)))
    (tmp_path / "silence.wav").write_bytes(wav(np.zeros(16000)))
    (tmp_path / "odd.wav").write_bytes(wav(np.zeros(100), width=1))
    df = R.audio_files(spark, str(tmp_path)).withColumn("id", F.element_at(F.split("path", "/"), -1)).cache()
    db = {r.id: r.v for r in df.filter("error is null").select("id", V.rms_db("samples").alias("v")).collect()}
    assert db["sine.wav"] == pytest.approx(-3.01, abs=0.02) and db["silence.wav"] == -math.inf
    assert df.filter("error is not null").first().id == "odd.wav"
    assert [r.id for r in V.rms_gate(df.filter("error is null"), "samples").collect()] == ["sine.wav"]
    mel = {r.id: r.feature for r in G.log_mel(df, "id", "samples").collect()}
    assert len(mel["sine.wav"]) == 128 and {len(x) for x in mel["sine.wav"]} == {1 + 16000 // 320} and mel["odd.wav"] is None
    peak = int(np.argmax(np.array(mel["sine.wav"]).mean(1)))
    assert np.array(mel["sine.wav"]).mean(1)[peak] > np.array(mel["silence.wav"]).mean()
    assert {r.id: r.verdict for r in V.level_probe(df.filter("error is null"), "id", "samples").collect()} == {"sine.wav": "ok", "silence.wav": "silent"}


def test_augmentation(spark):
    df = spark.createDataFrame([(i, [float(i + j) for j in range(10)]) for i in range(20)], "id int, x array<float>")
    a = df.select("id", P.augment_shift("x", "id", 1, 0).alias("y"), "x", P.random_crop("x", 4, "id", 1, 0).alias("c")).collect()
    assert all(sorted(r.y) == r.x and len(r.c) == 4 and r.c == list(np.arange(r.c[0], r.c[0] + 4)) for r in a) and len({tuple(np.subtract(r.y, r.id)) for r in a}) > 3
    n = df.select("x", P.augment_noise(F.col("x"), F.array(F.lit(1.0), F.lit(-1.0)), F.lit(10.0)).alias("y")).collect()
    for r in n[1:]:
        noise = np.subtract(r.y, r.x)
        assert 10 * np.log10(np.mean(np.square(r.x)) / np.mean(np.square(noise))) == pytest.approx(10, abs=0.01)
    m = P.mixup(df.withColumn("y", F.array(F.col("id").cast("double"))), "id", "x", "y").collect()
    assert len(m) == 20 and all(0 <= r.lam <= 1 and r.y[0] >= r.id for r in m)
    assert [r.f for r in df.select(V.fix_length("x", 12).alias("f")).limit(1).collect()][0][-2:] == [0, 0]


def test_log_mel_by_definition(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.1, 2000).astype(np.float32)
    (r,) = G.log_mel(spark.createDataFrame([(1, x.tolist())], "id int, x array<float>"), "id", "x", mels=16).collect()
    padded = np.concatenate([x[512:0:-1], x, x[-2:-514:-1]]).astype(float)
    hz, mel = (lambda m: 700 * (10 ** (m / 2595) - 1)), (lambda f: 2595 * np.log10(1 + f / 700))
    edges = [hz(m) for m in np.linspace(mel(50), mel(8000), 18)]
    for frame in (0, 3, 6):
        part = padded[frame * 320 : frame * 320 + 1024]
        power = [abs(sum(part[n] * (0.5 - 0.5 * math.cos(2 * math.pi * n / 1024)) * np.exp(-2j * math.pi * k * n / 1024) for n in range(1024))) ** 2 for k in range(0, 60)]
        for b in (0, 2):
            lo, mid, hi = edges[b : b + 3]
            want = sum(p * max(0.0, min((k * 15.625 - lo) / (mid - lo), (hi - k * 15.625) / (hi - mid))) for k, p in enumerate(power))
            assert r.feature[b][frame] == pytest.approx(math.log(want + 1e-6), abs=1e-3)
    assert len(r.feature[0]) == 1 + 2000 // 320


def test_speech_score(spark):
    rng = np.random.default_rng(2)
    t = np.arange(16000) / 16000
    voice = np.sin(2 * np.pi * 700 * t) * (1 + np.sign(np.sin(2 * np.pi * 4 * t))) / 2 * 0.5
    rows = [(1, voice), (2, rng.normal(0, 0.3, 16000)), (3, np.zeros(16000)), (4, voice[:1000]), (5, 1e-4 * voice)]
    df = spark.createDataFrame([(i, x.astype(float).tolist()) for i, x in rows] + [(6, None)], "id int, x array<double>")
    s = {r.id: r.score for r in G.speech_score(df, "id", "x").collect()}
    assert s[1] > 0.9 and s[1] > s[2] and s[3] == s[4] == s[5] == 0 and s[6] is None
    frames = [voice[k : k + 512] * np.hanning(512) for k in range(0, 16000 - 511, 256)]
    spec = np.array([np.abs(np.fft.rfft(f)) + 1e-10 for f in frames])
    f = np.arange(257) * 31.25
    band = spec[:, (f >= 300) & (f <= 3400)].sum() / spec.sum()
    flat = np.exp(np.log(spec).mean(1)).mean() / spec.mean(1).mean()
    want = (min(1, max(0, (band - 0.25) / 0.35)) * (1 - min(1, 3 * flat)) * min(1, spec.sum(1).std() / spec.sum(1).mean() / 0.6)) ** (1 / 3)
    assert s[1] == pytest.approx(want, rel=1e-6)


def test_norm_stats_and_delta(spark):
    rng = np.random.default_rng(0)
    xs = [rng.normal(3, 2, (4, 6)) for _ in range(10)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "id int, f array<array<double>>")
    s = G.fit_norm_stats(df, "f").first()
    whole = np.concatenate(xs, 1)
    assert np.allclose(s.mean, whole.mean(1)) and np.allclose(s.std, whole.std(1))
    d = G.signal_delta(spark.createDataFrame([("k", [0.5, -0.5], [0.25, -0.25])], "k string, a array<double>, b array<double>"), "k", "a", "b").first()
    assert d.rms_change_db == pytest.approx(-6.0206, abs=1e-3) and d.correlation == pytest.approx(1) and d.clipped == 0


def test_compact_audible(spark):
    on = [0, 1, 1, 1, 1, 1, 0, 0, 1, 1, 1, 1, 1] + [0] * 20 + [1, 1] + [0] * 10
    df = spark.createDataFrame([("k", i * 0.04, bool(a)) for i, a in enumerate(on)], "k string, p double, a boolean")
    spans, report = S.compact_audible(df, "k", "p", "a", 0.04)
    (r,) = spans.collect()
    assert r.start == 0 and r.end == pytest.approx(13 * 0.04 + 0.12)
    rep = report.first()
    assert rep.kept_seconds + rep.removed_seconds == pytest.approx(len(on) * 0.04)


class _Batches:
    """A table of one Arrow batch, to see in what pieces a function sends on its rows."""

    def __init__(self, batch, schema):
        self.batch, self.schema = batch, schema

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        return [x.num_rows for x in f(iter([self.batch]))]

    def mapInPandas(self, f, _):
        return [len(x) for x in f(iter([self.batch.to_pandas()]))]


def test_features_of_many_clips_are_sent_on_in_pieces():
    import pyarrow as pa
    from pyspark.sql import types as T

    clips = [[0.1] * 2048, None, [], *[[0.0, 0.5] * 1024] * 397]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(clips, pa.list_(pa.float32()))], ["id", "x"])
    df = _Batches(batch, T.StructType([T.StructField("id", T.LongType())]))
    sizes = G.log_mel(df, "id", "x")
    assert sum(sizes) == 400 and max(sizes) <= 64


def test_a_hook_of_small_calls_sends_on_whole_frames():
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql import types as T

    from modlake.streaming import keyed

    calls = []

    def load():
        return lambda f: calls.append(list(f.index)) or pd.DataFrame({"p": f["x"] * 2})

    df = _Batches(pa.RecordBatch.from_arrays([pa.array(range(100))], ["x"]), T.StructType([T.StructField("x", T.LongType())]))
    assert keyed.score_hook(df, load, "p long", batch=32) == [100]
    assert calls == [list(range(n)) for n in (32, 32, 32, 4)]


def test_the_pattern_of_one_edit_misses_no_span():
    import random
    import re

    r = random.Random(0)
    for _ in range(3000):
        term, span = ("".join(r.choices("ab.", k=k)) for k in (r.randint(3, 4), r.randint(2, 5)))
        near = span in {term[:i] + c + term[j:] for i in range(len(term) + 1) for j in (i, i + 1) for c in ("", "a", "b", ".")}
        if near and span[0] == term[0]:
            assert re.match(X.within_one([term]), span + "z"), (term, span)
