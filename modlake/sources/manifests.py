"""Readers and writers: manifests, segment CSVs, ontologies, queues, decisions, audio files, configuration tables."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlake.core import saved
from modlake.operators.collections import build_manifest as segments_to_manifest
from modlake.operators.validation import load_checked, validate_asr_manifest, validate_manifest

CLIP = "clip_id string, source string, source_id string, start_sec double, duration double, labels array<string>, label_confidence string, split string, annotator string, snr_est double, flagged boolean"
ASR = "id string, audio string, text string, teacher_text string, domain string, split string, source_id string, harm_terms array<string>"
CANDIDATE = "rank int, clip_id string, kind string, predicted string, prob double, priority double, pseudo_label string"
DECISION = "clip_id string, action string, label string, seq bigint"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by schema: unknown keys vanish, blank lines are skipped, broken ones fail with file and line number."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    parsed = lines.filter(F.trim("value") != "").select("value", "_file", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = parsed.filter("r._corrupt is not null").select("_file", "value").limit(1).collect()
    if bad:
        whole = (r.value for r in spark.read.text(bad[0]._file).toLocalIterator())
        at = next((i for i, x in enumerate(whole, 1) if x == bad[0].value), 0)
        raise ValueError(f"{bad[0]._file}:{at}: not JSON of this shape: {bad[0].value[:80]}")
    return parsed.select(*[f"r.{f.name}" for f in T._parse_datatype_string(schema).fields])


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def read_clip_manifest(spark: SparkSession, path: str) -> DataFrame:
    df = read_json_lines(spark, path, CLIP)
    return df.withColumn("flagged", F.coalesce("flagged", F.lit(False)))


write_clip_manifest = write_review_queue = save_decisions = write_json_lines


def load_clip_manifest(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """Read and validate; ValueError with the first 10 problems."""
    df = read_clip_manifest(spark, path)
    return load_checked(df, validate_manifest(df, classes))


def read_segments_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ytid, start, end, mids, pos: comment lines and rows with fewer than 4 fields are left out."""
    raw = spark.read.schema("ytid string, start double, end double, labels string").option("comment", "#").option("quote", '"').option("ignoreLeadingWhiteSpace", True).csv(path)
    rows = raw.filter("labels is not null").withColumn("mids", F.transform(F.split("labels", ","), lambda m: F.trim(m)))
    return rows.select("ytid", "start", "end", "mids", F.monotonically_increasing_id().alias("pos"))


def build_manifest(spark: SparkSession, csvs: list[str], label_map: DataFrame, out: str, source: str, split: str, cap: int | None = None) -> DataFrame:
    """CSVs to a clip manifest of JSON lines."""
    df = saved(segments_to_manifest(saved(read_segments_csv(spark, csvs), "segments"), label_map, source, split, cap=cap), "manifest")
    write_json_lines(df, out)
    return df


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, name string").option("multiLine", True).json(path).select(F.col("id").alias("mid"), "name")


def read_asr_manifest(spark: SparkSession, path: str, require_audio: DataFrame | None = None) -> DataFrame:
    """Valid rows with transcript and its source; ValueError with the first 10 problems."""
    df = validate_asr_manifest(read_json_lines(spark, path, ASR), "id")
    if require_audio is not None:
        df = df.join(require_audio.select(F.col("path").alias("audio"), F.lit(True).alias("_a")), "audio", "left").withColumn("error", F.coalesce("error", F.when(F.col("_a").isNull(), F.lit("no audio file")))).drop("_a")
    return load_checked(df, df.filter("error is not null").select("id", "error")).drop("error")


def read_review_queue(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, CANDIDATE).orderBy("rank")


def load_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The last decision of each clip."""
    df = read_json_lines(spark, path, DECISION)
    return df.groupBy("clip_id").agg(F.max_by(F.struct("action", "label", "seq"), "seq").alias("d")).select("clip_id", "d.*")


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples of a 16-bit PCM WAV; ValueError for any other."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            if w.getsampwidth() != 2 or w.getcomptype() != "NONE":
                raise ValueError("only 16-bit PCM")
            raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
            return w.getframerate(), raw.reshape(-1, w.getnchannels()).mean(1)
    except (wave.Error, EOFError) as e:
        raise ValueError(str(e)) from e


def samples_at(content: bytes, rate: int) -> tuple[list[float] | None, str | None]:
    """Mono samples of a WAV at ``rate``, or what is wrong with it."""
    try:
        own, x = decode_wav(content)
    except ValueError as e:
        return None, str(e)
    if own != rate and len(x):
        x = np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x).astype(np.float32)
    return x.tolist(), None


def audio_files(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """path, modificationTime, rate, samples, error: the WAV files of a folder as mono samples at ``rate``."""
    return audio_samples(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path), rate)


def audio_samples(files: DataFrame, rate: int = 16000) -> DataFrame:
    """The same from rows of path, modificationTime and content; other rates are interpolated, what isn't 16-bit PCM has an error."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            read = [samples_at(content, rate) for content in f["content"]]
            yield pd.DataFrame({"path": f["path"], "modificationTime": f["modificationTime"], "rate": rate, "samples": [x for x, _ in read], "error": [e for _, e in read]})

    return files.select("path", "modificationTime", "content").mapInPandas(run, "path string, modificationTime timestamp, rate int, samples array<float>, error string")


def verdict_log(requests: DataFrame, verdicts: DataFrame, key: str = "clip_id", audio: str = "audio") -> DataFrame:
    """Requests with their verdicts; audio bytes are replaced by their number."""
    return requests.join(verdicts, key).withColumn("audio_bytes", F.octet_length(audio)).drop(audio)


def audio_to_text(audio: Column) -> Column:
    return F.base64(audio)


def audio_from_text(text: Column) -> Column:
    return F.unbase64(text)


def taxonomy_table(spark: SparkSession, harm: dict[str, list[str]], confusable: list[str]) -> DataFrame:
    """idx, class, category, is_harm from category -> harm classes and the confusable ones; a name twice is an error."""
    rows = [(c, k, True) for k, cs in harm.items() for c in cs] + [(c, "confusable", False) for c in confusable]
    names = [r[0] for r in rows]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"classes named twice: {twice}")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx int, class string, category string, is_harm boolean")


def policy_table(spark: SparkSession, version: str, warn: float, block: float, weights: dict[str, float]) -> DataFrame:
    if not 0 <= warn < block <= 1:
        raise ValueError("levels must rise: 0 <= warn < block <= 1")
    return spark.createDataFrame([(version, warn, block, weights)], "version string, warn double, block double, weights map<string,double>")


def threshold_table(spark: SparkSession, gate: float, acoustic: float, text: float) -> DataFrame:
    if not all(0 <= x <= 1 for x in (gate, acoustic, text)):
        raise ValueError("thresholds lie in [0, 1]")
    return spark.createDataFrame([(gate, acoustic, text)], "gate double, acoustic double, text double")


def lexicon_table(spark: SparkSession, lexicon: dict[str, tuple[float, dict[str, float]]]) -> DataFrame:
    return spark.createDataFrame([(c, t, float(w), float(cw)) for c, (cw, ts) in lexicon.items() for t, w in ts.items()], "category string, term string, w double, cat_weight double")


def config_text(values: dict) -> str:
    """A configuration as strict JSON: no NaN."""
    return json.dumps(values, allow_nan=False, ensure_ascii=False, sort_keys=True)
