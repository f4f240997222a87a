"""Label and score expressions. Classes and weights are ordered lists or maps given by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlake.operators.joins import lookup


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def multi_hot(labels: Column | str, classes: list[str]) -> Column:
    """0/1 vector in the order of ``classes``; an unknown label fails the job."""
    x = F.coalesce(_col(labels), F.array().cast("array<string>"))
    unknown = F.array_except(x, strings(classes))
    hot = F.transform(strings(classes), lambda c: F.array_contains(x, c).cast("float"))
    return F.when(F.size(unknown) == 0, hot).otherwise(F.raise_error(F.concat(F.lit("unknown labels: "), F.array_join(unknown, ","))).cast("array<float>"))


def is_harm(labels: Column | str, harm: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(_col(labels), strings(harm)), F.lit(False))


def category_of(df: DataFrame, classes: DataFrame, col: str = "class") -> DataFrame:
    """``df`` with category; ``classes`` is the taxonomy, one row a class."""
    return lookup(df, classes.select(F.col("class").alias(col), "category"), col)


def clip_key(ytid: Column | str, start: Column | str) -> Column:
    """``id_start`` with the start as %g prints it: six significant digits, no trailing zeros, an exponent below 1e-4 and from 1e6 on."""
    s = _col(start).cast("double")
    exact = F.format_string("%.5e", s)  # rounds to six digits first, as the choice of the form needs
    power = F.substring_index(exact, "e", -1).cast("int")
    shorn = lambda c: F.when(F.contains(c, F.lit(".")), F.regexp_replace(F.regexp_replace(c, r"0+$", ""), r"\.$", "")).otherwise(c)
    fixed = F.coalesce(*[F.when(power == p, F.format_string(f"%.{5 - p}f", s)) for p in range(-4, 6)])
    wide = F.concat(shorn(F.substring_index(exact, "e", 1)), F.lit("e"), F.regexp_extract(exact, r"e(.*)$", 1))
    return F.concat_ws("_", _col(ytid), F.when(s == 0, F.lit("0")).when(power.between(-4, 5), shorn(fixed)).otherwise(wide))


def weight_vector(classes: list[str], weights: Column) -> Column:
    """Weights of a map in the order of ``classes``, 0 where unset."""
    return F.transform(strings(classes), lambda c: F.coalesce(F.try_element_at(weights, c), F.lit(0.0)))


def risk_features(probs: Column | str, weights: Column | str) -> tuple[Column, Column]:
    """Weighted maximum and weighted sum of class scores."""
    x = F.zip_with(_col(probs), _col(weights), lambda p, w: p * w)
    return F.array_max(x), F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-709.0), F.least(F.lit(709.0), z))))


def risk_score(df: DataFrame, parameters: DataFrame, probs: str, weights: str, version: str) -> DataFrame:
    """``df`` with risk = sigmoid(a max + b sum + c). ``parameters``: one row a, b, c, fitted, policy_version; unfitted ones, or those of another policy, fail the job."""
    top, total = risk_features(probs, weights)
    x = df.crossJoin(F.broadcast(parameters.limit(1)))
    ok = F.col("fitted") & (F.col("policy_version") == version)
    return x.withColumn("risk", F.when(ok, sigmoid(F.col("a") * top + F.col("b") * total + F.col("c"))).otherwise(F.raise_error(F.lit("risk parameters are not fitted for this policy")).cast("double"))).drop(*parameters.columns)


def top_events(probs: Column | str, classes: list[str], k: int) -> Column:
    """The k best (class, prob); equal scores in the order of the classes."""
    ranked = F.array_sort(F.transform(_col(probs), lambda p, i: F.named_struct(F.lit("n"), -p, F.lit("i"), i, F.lit("class"), F.get(strings(classes), i), F.lit("prob"), p)))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.named_struct(F.lit("class"), x["class"], F.lit("prob"), x["prob"]))


def binary_any(vector: Column | str, n_harm: int) -> Column:
    """Maximum over the first ``n_harm`` classes: an any-harm target, or score."""
    return F.array_max(F.slice(_col(vector), 1, n_harm))


def cascade_decision(gate: Column, acoustic: Column, text: Column, thresholds: dict[str, float], gate_on: bool = True) -> Column:
    """struct(passed, acoustic, reasons, escalate). Thresholds are inclusive; a gate that is on needs a score."""
    passed = F.when(gate.isNull(), F.raise_error(F.lit("gate is on and has no score")).cast("boolean")).otherwise(gate >= thresholds["gate"]) if gate_on else F.lit(True)
    heard = F.when(passed, acoustic)
    reasons = F.array_compact(F.array(F.when(heard >= thresholds["acoustic"], F.lit("acoustic")), F.when(text >= thresholds["text"], F.lit("text"))))
    return F.struct(passed.alias("passed"), heard.alias("acoustic"), reasons.alias("reasons"), (F.size(reasons) > 0).alias("escalate"))


def verdict_normalize(raw: Column | str, categories: list[str]) -> Column:
    """struct(degree_percent, category, reason, confident, raw) from a model's free text around a JSON object.

    The object's ``degree`` counts if it is a number (or true or false, as 1 or 0) from 0 to 100, rounded half to even;
    a quoted one doesn't. ``raw`` is kept where there is none. Null text gives nulls.
    """
    text = _col(raw)
    v = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = F.when(kind("$.degree") == "BOOLEAN", F.try_variant_get(v, "$.degree", "boolean").cast("double")).when(kind("$.degree") != "STRING", F.try_variant_get(v, "$.degree", "double"))
    degree = F.when((number >= 0) & (number <= 100), F.bround(number, 0).cast("int"))
    category = F.lower(F.trim(F.try_variant_get(v, "$.category", "string")))
    reason = F.nullif(F.try_variant_get(v, "$.reason", "string"), F.lit(""))
    confident = F.when(kind("$.confident") == "BOOLEAN", F.try_variant_get(v, "$.confident", "boolean"))
    return F.struct(degree.alias("degree_percent"), F.when(category.isin(*categories), category).alias("category"), F.substring(reason, 1, 300).alias("reason"), confident.alias("confident"), F.when(degree.isNull(), F.nullif(F.substring(text, 1, 600), F.lit(""))).alias("raw"))


def judge_request(event: str, window: str) -> Column:
    """struct(acoustic, text, transcript) from an event's peaks, or else a window's scores."""
    e, w = F.col(event), F.col(window)
    from_event = F.struct(e["peak_acoustic"].alias("acoustic"), e["peak_text"].alias("text"), F.substring(F.array_join(e["transcripts"], " / "), 1, 500).alias("transcript"))
    from_window = F.struct(w["acoustic"].alias("acoustic"), w["text"].alias("text"), F.substring(w["transcript"], 1, 500).alias("transcript"))
    return F.when(e.isNotNull(), from_event).otherwise(from_window)


LEVELS = {"safe": 0, "warn": 1, "block": 2}


def level_order(level: Column | str) -> Column:
    return F.coalesce(*[F.when(_col(level) == k, F.lit(v)) for k, v in LEVELS.items()])


def worst_window(df: DataFrame, key: str, level: str, score: str, t: str) -> DataFrame:
    """Of each clip the window of the highest level, then score, then the earliest."""
    best = F.max_by(F.struct(*[F.col(c) for c in df.columns if c != key]), F.struct(level_order(level), F.col(score), -F.col(t)))
    return df.groupBy(key).agg(best.alias("w")).select(key, "w.*")


def overall_verdict(audio: Column, text: Column, warn: float, block: float) -> Column:
    risk = F.greatest(audio, text)
    return F.struct(risk.alias("risk"), F.when(risk >= block, "block").when(risk >= warn, "warn").otherwise("safe").alias("level"))


def apply_norm(feature: Column | str, mean: Column, std: Column) -> Column:
    """(x - mean) / (std + 1e-6) by bin, for a bins x frames array."""
    stats = F.arrays_zip(mean.alias("m"), std.alias("s"))
    return F.zip_with(_col(feature), stats, lambda frames, s: F.transform(frames, lambda x: (x - s["m"]) / (s["s"] + 1e-6)))
