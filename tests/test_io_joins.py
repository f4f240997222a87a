import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlake.core import running_sums
from modlake.operators import incidents as I
from modlake.operators import joins as J
from modlake.operators import sampling as P
from modlake.operators import validation as V
from modlake.sources import manifests as R
from modlake.streaming import keyed


def test_review_files(spark, tmp_path):
    q = spark.createDataFrame([(2, "b", "uncertain", "x", 0.5, 1.0, None), (1, "a", "false_positive", "x", 0.9, 0.9, "y")], R.CANDIDATE)
    R.write_review_queue(q, str(tmp_path / "q"))
    assert [r.clip_id for r in R.read_review_queue(spark, str(tmp_path / "q")).collect()] == ["a", "b"]
    R.save_decisions(spark.createDataFrame([("a", "skip", None, 1), ("a", "confirm_fp", "talk", 2)], R.DECISION), str(tmp_path / "d"))
    (d,) = R.load_decisions(spark, str(tmp_path / "d")).collect()
    assert (d.action, d.label) == ("confirm_fp", "talk")


def test_asr_file(spark, tmp_path):
    rows = [("a", "a.wav", "said", None, "general", "train", "s", ["x"])]
    R.write_json_lines(spark.createDataFrame(rows, R.ASR), str(tmp_path / "m"))
    assert R.read_asr_manifest(spark, str(tmp_path / "m")).first().transcript == "said"
    with pytest.raises(ValueError, match="no audio file"):
        R.read_asr_manifest(spark, str(tmp_path / "m"), spark.createDataFrame([("z.wav",)], "path string"))


def test_ontology(spark, tmp_path):
    (tmp_path / "o.json").write_text('[{"id": "/m/1", "name": "Scream", "child_ids": []}, {"id": "/m/2", "name": "Bang"}]')
    assert {r.mid: r.name for r in R.read_ontology(spark, str(tmp_path / "o.json")).collect()} == {"/m/1": "Scream", "/m/2": "Bang"}


def test_verdict_log(spark):
    req = spark.createDataFrame([("a", bytearray(b"12345"))], "clip_id string, audio binary")
    r = R.verdict_log(req, spark.createDataFrame([("a", 70)], "clip_id string, degree int")).first()
    assert r.audio_bytes == 5 and r.degree == 70 and "audio" not in r.asDict()
    b = spark.createDataFrame([(bytearray(b"\x00\xff"),)], "a binary")
    assert b.select(R.audio_from_text(R.audio_to_text(F.col("a"))).alias("b")).first().b == b"\x00\xff"


def test_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert [r.v for r in J.lookup(a, b, "k").orderBy("k").collect()] == ["x", None]
    assert [r.v for r in J.lookup(a, b, "k", most=0).orderBy("k").collect()] == ["x", None]
    assert J.require(a.filter("k = 1"), b, "k").count() == 1
    with pytest.raises(Exception, match="no k 2"):
        J.require(a, b, "k").collect()


def test_modified_before(spark):
    df = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "clip_id string, split string")
    files = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-06-01 00:00:00"), ("c", "2024-06-01 00:00:00")], "clip_id string, m string").select("clip_id", F.col("m").cast("timestamp").alias("modificationTime"))
    assert sorted(r.clip_id for r in V.modified_before(df, files, "2024-03-01").collect()) == ["a", "c"]


def test_variants_repeat_and_differ(spark):
    df = spark.createDataFrame([(i, np.arange(12.0).reshape(3, 4).tolist()) for i in range(6)], "id int, x array<array<float>>")
    mean, std = F.array(*[F.lit(0.0)] * 3), F.array(*[F.lit(1.0)] * 3)
    one = {(r.epoch, r.id): r.x for r in P.per_epoch_variants(df, "id", "x", mean, std, 1, 3).collect()}
    two = {(r.epoch, r.id): r.x for r in P.per_epoch_variants(df.repartition(3), "id", "x", mean, std, 1, 3).collect()}
    assert one == two and len({str(x) for x in one.values()}) > 5 and all(np.shape(x) == (3, 4) for x in one.values())
    plain = P.per_epoch_variants(df, "id", "x", mean, std, 1, 1, training=False).first().x
    assert np.allclose(plain, np.arange(12.0).reshape(3, 4), rtol=1e-5)


def test_running_sums_of_a_hot_key(spark):
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"k{i % 2}", i, i % 7) for i in range(300)]
    got = {r.i: (r.n, r.s) for r in running_sums(spark.createDataFrame(rows, "k string, i int, v int"), "k", "i", n=F.lit(1), s=F.col("v")).collect()}
    seen = {}
    for k, i, v in rows:
        n, s = seen.get(k, (0, 0))
        seen[k] = (n + 1, s + v)
        assert got[i] == seen[k]


def test_streaming_windows_and_results(spark, tmp_path):
    rows = [("s", f"2024-01-01 00:00:{i:02d}", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, s string, sec double").select("k", F.col("s").cast("timestamp").alias("ts"), "sec")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted((str(r.start), r.n) for r in I.sliding_windows(df, "k", "ts", "10 seconds", "2 seconds", F.col("sec"), 10.0).collect())
    assert len(want) == 16 and {n for _, n in want} == {10}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    keyed.results_sink(stream.select("k", "sec"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 40
    out = I.sliding_windows(stream, "k", "ts", "10 seconds", "2 seconds", F.col("sec"), 10.0, "5 seconds")
    out.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    got = sorted((str(r.start), r.n) for r in spark.table("w").collect())
    assert got and set(got) <= set(want)  # those that the watermark has passed


def test_a_full_window_does_not_hang_on_the_order_of_its_rows(spark):
    """These seconds are 60; their sum as doubles is 60 from one end and 59.99999999999999 from the other."""
    seconds = [6.71, 21.34, 16.11, 15.18, 0.66]
    for order in (seconds, seconds[::-1]):
        df = spark.createDataFrame([("s", x) for x in order], "k string, sec double").coalesce(1).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
        assert I.sliding_windows(df, "k", "ts", "10 seconds", "10 seconds", F.col("sec"), 60.0).count() == 1


def test_label_similarity_against_all_pairs(spark):
    r = random.Random(4)
    rows = [(i, r.sample("abcdefgh", r.randint(0, 6))) for i in range(150)]
    firsts = {}
    for i, x in rows:
        if x:
            firsts.setdefault(frozenset(x), i)
    for threshold in (0.3, 0.5, 1.0):
        want = {}
        for x, i in firsts.items():
            for z, j in firsts.items():
                if i < j and len(x & z) / len(x | z) >= threshold:
                    want[i, j] = len(x & z) / len(x | z)
        got = {(p.a, p.b): p.jaccard for p in J.label_similarity(spark.createDataFrame(rows, "id int, labels array<string>"), "id", "labels", threshold).collect()}
        assert got == pytest.approx(want)
