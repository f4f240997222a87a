"""Signals: frames, speech score, log-mel features, normalisation statistics, differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Clips whose features are sent on in one batch, so that a task holds these and not those of a whole batch of samples.
AT_ONCE = 64


def frame_signal(samples: str, size: int, hop: int) -> Column:
    """Overlapping frames; only full ones."""
    n = F.size(samples)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1, F.lit(hop)), lambda i: F.slice(samples, i, F.lit(size)))).otherwise(F.array().cast("array<array<float>>"))


def _power(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Power spectra (frames, bins) under a periodic Hann window; frame k is centred on sample k * hop, ends are mirrored."""
    x = np.pad(x, size // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return np.abs(np.fft.rfft(frames * np.hanning(size + 1)[:-1], axis=1)) ** 2


def mel_bank(rate: int, size: int, mels: int, low: float, high: float) -> np.ndarray:
    """Triangles on the mel scale over FFT bins: (mels, bins)."""
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    points = 700 * (10 ** (np.linspace(mel(low), mel(high), mels + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(size, 1 / rate)
    up = (freq - points[:-2, None]) / np.diff(points)[:-1, None]
    down = (points[2:, None] - freq) / np.diff(points)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(df: DataFrame, row_id: str, samples: str, rate: int = 16000, size: int = 1024, hop: int = 320, mels: int = 128, low: float = 50.0, high: float = 8000.0) -> DataFrame:
    """row_id, feature (mels x (1 + samples // hop) frames): log(mel power + 1e-6). One row a clip; null or empty samples give null."""
    schema = df.select(row_id).schema.add("feature", T.ArrayType(T.ArrayType(T.FloatType())))
    kind = pa.list_(pa.list_(pa.float32()))

    def features(x: np.ndarray, bank: np.ndarray) -> pa.Array:
        mel = np.log(bank @ _power(x, size, hop).T + 1e-6).astype(np.float32)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(mel) + 1, dtype=np.int32) * mel.shape[1]), pa.array(mel.ravel()))
        return pa.ListArray.from_arrays(pa.array([0, len(mel)], pa.int32()), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = mel_bank(rate, size, mels, low, high)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                out = [features(_samples(x), bank) if x.is_valid and len(x) else pa.nulls(1, kind) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.concat_arrays(out).cast(kind)], [row_id, "feature"])

    return df.select(row_id, samples).mapInArrow(run, schema)


def _samples(x: pa.ListScalar) -> np.ndarray:
    """The samples of one clip as doubles, null as NaN."""
    return x.values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def speech_likelihood(x: np.ndarray, rate: int = 16000, size: int = 512, hop: int = 256) -> float:
    """Cube root of voice-band share x spectral peakiness x modulation of the level, each scaled to 0..1.

    0 for under a tenth of a second, under 8 full frames, or a root mean square under .001.
    """
    frames = 1 + (len(x) - size) // hop
    if len(x) < rate // 10 or frames < 8 or np.sqrt(np.mean(x * x)) < 1e-3:
        return 0.0
    spec = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size), axis=1)) + 1e-10
    freq = np.fft.rfftfreq(size, 1 / rate)
    band = spec[:, (freq >= 300) & (freq <= 3400)].sum() / spec.sum()
    flat = np.exp(np.log(spec).mean(axis=1)).mean() / spec.mean()
    level = spec.sum(axis=1)
    parts = (np.clip((band - 0.25) / 0.35, 0, 1), 1 - min(1, 3 * flat), min(1, level.std() / (level.mean() + 1e-12) / 0.6))
    return float(np.cbrt(np.prod(parts)))


def speech_score(df: DataFrame, row_id: str, samples: str, rate: int = 16000, size: int = 512, hop: int = 256) -> DataFrame:
    """row_id, score: ``speech_likelihood`` of each sample array, a diagnostic. Null samples give null."""
    schema = df.select(row_id).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                score = [speech_likelihood(_samples(x), rate, size, hop) if x.is_valid else None for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], [row_id, "score"])

    return df.select(row_id, samples).mapInArrow(run, schema)


def fit_norm_stats(df: DataFrame, feature: str) -> DataFrame:
    """mean, std: one row of two arrays by bin, over all frames of all rows (bins x frames arrays)."""
    sums = F.transform(feature, lambda f: F.struct(F.size(f).alias("n"), F.aggregate(f, F.lit(0.0), lambda a, v: a + v).alias("s"), F.aggregate(f, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")).alias("q")))
    each = df.select(F.posexplode(sums).alias("bin", "x")).groupBy("bin").agg(F.sum("x.n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q"))
    mean = F.col("s") / F.col("n")
    each = each.filter("n > 0").select("bin", mean.alias("m"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("d"))
    all_bins = each.agg(F.array_sort(F.collect_list(F.struct("bin", "m", "d"))).alias("x"))  # a row for each bin
    return all_bins.select(F.transform("x", lambda b: b["m"]).alias("mean"), F.transform("x", lambda b: b["d"]).alias("std"))


def signal_delta(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, rms_change_db, removed_rms, correlation, clipped: between two sample arrays of equal length."""
    x = df.select(key, F.explode(F.arrays_zip(F.col(before).alias("a"), F.col(after).alias("b"))).alias("z")).select(key, F.col("z.a").cast("double").alias("a"), F.col("z.b").cast("double").alias("b"))
    rms = lambda c: F.sqrt(F.avg(c * c))
    ra, rb = rms(F.col("a")), rms(F.col("b"))
    return x.groupBy(key).agg(F.when((ra > 0) & (rb > 0), 20 * F.log10(rb / ra)).alias("rms_change_db"), rms(F.col("a") - F.col("b")).alias("removed_rms"), F.corr("a", "b").alias("correlation"), F.avg((F.abs("b") >= 0.999).cast("double")).alias("clipped"))


def join_segments(pieces: Column, gap: int) -> Column:
    """Arrays one after the other with ``gap`` zeros between."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), gap)
    return F.flatten(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(zeros, p))))
