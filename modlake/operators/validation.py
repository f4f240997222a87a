"""Validation and quality gates: error rows in long form, predicates, disjointness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE = ("verified", "pseudo", "weak")
SPLITS = ("train", "val", "test")
ASR_DOMAINS = ("general", "movie", "song", "no_speech")


def validate_manifest(df: DataFrame, classes: list[str], order: str | None = None) -> DataFrame:
    """clip_id, problem: one row for each problem. The second and later copies of an id are duplicates, in ``order``; null and blank ids have no copies."""
    known = F.array(*map(F.lit, classes)) if classes else F.array().cast("array<string>")
    unknown = F.array_except(F.coalesce("labels", F.array().cast("array<string>")), known)
    blank = F.coalesce(F.trim("clip_id"), F.lit("")) == ""
    x = df.withColumn("_apart", F.when(blank, F.monotonically_increasing_id()))  # rows without an id are no copies of each other
    x = x.withColumn("_copy", F.row_number().over(Window.partitionBy("clip_id", "_apart").orderBy(F.col(order) if order else F.lit(0))))
    checks = F.array_compact(F.array(
        F.when(blank, F.lit("empty clip_id")),
        F.when(~F.coalesce(F.col("label_confidence").isin(*CONFIDENCE), F.lit(False)), F.concat(F.lit("bad confidence: "), F.coalesce("label_confidence", F.lit("null")))),
        F.when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), F.concat(F.lit("bad split: "), F.coalesce("split", F.lit("null")))),
        F.when(F.coalesce(F.col("start_sec") < 0, F.lit(True)), F.lit("negative start")),
        F.when(F.coalesce(F.col("duration") <= 0, F.lit(True)), F.lit("non-positive duration")),
        F.when(F.col("_copy") > 1, F.lit("duplicate clip_id")),
    ))
    return x.select("clip_id", F.explode(F.concat(checks, F.transform(unknown, lambda c: F.concat(F.lit("unknown label: "), c)))).alias("problem"))


def load_checked(df: DataFrame, errors: DataFrame, most: int = 10) -> DataFrame:
    """``df``, or ValueError with the first problems."""
    found = errors.limit(most).collect()
    if found:
        raise ValueError("; ".join(f"{r[0]}: {r[1]}" for r in found))
    return df


def resolve_transcript(text: str = "text", teacher: str = "teacher_text") -> tuple[Column, Column]:
    """The human text, else the teacher's, and which of them it is."""
    human = F.nullif(F.trim(text), F.lit(""))
    other = F.nullif(F.trim(teacher), F.lit(""))
    return F.coalesce(human, other, F.lit("")), F.when(human.isNotNull(), "human").when(other.isNotNull(), "teacher")


def validate_asr_manifest(df: DataFrame, order: str) -> DataFrame:
    """``df`` with error (the first rule that fails, else null), transcript, transcript_source. Rows with missing keys don't claim their id."""
    missing = F.col("id").isNull() | F.col("audio").isNull() | F.col("domain").isNull() | F.col("split").isNull() | F.col("source_id").isNull()
    claim = F.sum(F.when(~missing, 1).otherwise(0)).over(Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    words, source = resolve_transcript()
    silent = F.col("domain") == "no_speech"
    x = df.withColumn("_before", F.coalesce(claim, F.lit(0))).withColumn("transcript", words).withColumn("transcript_source", source)
    error = F.coalesce(
        F.when(missing, "missing keys"), F.when(F.col("_before") > 0, "duplicate id"), F.when(~F.col("domain").isin(*ASR_DOMAINS), "bad domain"), F.when(~F.col("split").isin(*SPLITS), "bad split"),
        F.when(~silent & F.col("text").isNull() & F.col("teacher_text").isNull(), "text or teacher_text required"),
        F.when(silent & (F.col("transcript") != ""), "no_speech must be empty"), F.when(~silent & (F.col("transcript") == ""), "empty transcript"),
    )
    return x.withColumn("error", error).drop("_before")


def training_rows(df: DataFrame) -> DataFrame:
    return df.filter((F.col("split") == "train") & ~F.coalesce(F.col("flagged"), F.lit(False)))


def leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split, with these."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def assert_disjoint(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    return load_checked(df, leaks(df, key, split).select(F.col(key).cast("string"), F.array_join("splits", ",")))


def has_artifact(df: DataFrame, artifacts: DataFrame, key: str = "clip_id") -> DataFrame:
    return df.join(artifacts.select(key), key, "left_semi")


def missing_artifacts(df: DataFrame, artifacts: DataFrame, key: str = "clip_id") -> DataFrame:
    return df.join(artifacts.select(key), key, "left_anti").select(key)


def exclude_listed(df: DataFrame, listed: DataFrame, key: str = "clip_id") -> DataFrame:
    """``df`` without the train rows that are listed; other splits stay."""
    out = listed.select(F.col(key).alias("_x")).distinct()
    return df.join(out, (F.col(key) == F.col("_x")) & (F.col("split") == "train"), "left_anti")


def modified_before(df: DataFrame, files: DataFrame, before: str, key: str = "clip_id") -> DataFrame:
    """Train rows whose file (key, modificationTime) is older than ``before``; other splits stay."""
    late = files.filter(F.col("modificationTime") >= F.lit(before).cast("timestamp")).select(key)
    return exclude_listed(df, late, key)


def rms_db(samples: str | Column) -> Column:
    """Level of a sample array in dBFS; silence and no samples are minus infinity."""
    x = F.col(samples) if isinstance(samples, str) else samples
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.greatest(F.size(x), F.lit(1))
    return F.when(mean > 0, 10 * F.log10(mean)).otherwise(F.lit(float("-inf")))


def rms_gate(df: DataFrame, samples: str, floor_db: float = -45.0) -> DataFrame:
    return df.filter(rms_db(samples) >= floor_db)


def fix_length(samples: str, n: int) -> Column:
    return F.slice(F.concat(F.col(samples), F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def unknown_mids(label_map: DataFrame, ontology: DataFrame) -> DataFrame:
    """Rows (class, mid) of the map whose mid the ontology lacks; repeated rows stay."""
    return label_map.join(ontology.select("mid"), "mid", "left_anti").select("class", "mid")


def unknown_weights(weights: DataFrame, classes: DataFrame) -> DataFrame:
    """Weight keys that are no harm classes."""
    return weights.join(classes.filter("is_harm").select("class"), "class", "left_anti").select("class")


def degenerate_text(text: str | Column) -> Column:
    """Whether a transcript loops: at least 4 tokens, and one token over half of them, few distinct ones, or a phrase over and over."""
    x = F.col(text) if isinstance(text, str) else text
    tokens = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"[가-힣a-zA-Z0-9]+"), F.lit(0))

    def loops(w: Column) -> Column:
        n = F.size(w)
        kinds = F.array_distinct(w)
        middle = F.get(F.array_sort(w), F.floor(n / 2).cast("int"))  # a token over half of all is the middle one in order
        top = F.transform(F.array(middle), lambda m: F.size(F.filter(w, lambda v: v == m)))[0]

        def repeated(size: int, times: int) -> Column:
            """A phrase stands so often in a row if as many places in a row equal the ones ``size`` further on."""
            same = F.array_join(F.transform(w, lambda v, i: F.when(v == F.get(w, i + size), "1").otherwise("0")), "")
            return F.contains(same, F.lit("1" * (size * (times - 1))))

        runs = repeated(1, 5) | repeated(2, 3) | repeated(3, 3) | repeated(4, 3)
        return F.when(n < 4, F.lit(False)).otherwise((top * 2 > n) | (F.size(kinds) < 0.35 * n) | runs)

    return F.transform(F.array(tokens), loops)[0]


def artifact_transcript(text: str, known: list[str]) -> Column:
    """The text, empty if it is one of the known garbage strings."""
    return F.when(F.lower(F.trim(text)).isin(*[k.lower() for k in known]), F.lit("")).otherwise(F.col(text))


def level_probe(df: DataFrame, key: str, samples: str) -> DataFrame:
    """key, samples, peak, rms, nonzero, verdict of each source."""
    x = df.select(key, F.explode_outer(samples).alias("x"))
    out = x.groupBy(key).agg(F.count("x").alias("samples"), F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.avg((F.col("x") != 0).cast("double")).alias("nonzero"))
    return out.withColumn("verdict", F.when(F.col("samples") == 0, "none").when(F.col("peak") <= 0, "silent").when((F.col("rms") < 1e-4) | (F.col("nonzero") < 0.01), "suspect").otherwise("ok"))
