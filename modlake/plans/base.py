"""Shared inputs of the registered queries: the given tables in the shapes that the operators take, in Spark and in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, dir) -> DataFrame under its name, with its DuckDB SQL."""
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six digits as the SQL rounds them: of the product with 10^6. Spark's own rounding goes by the decimal digits, and takes another side of some ties."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.round(c * 1e6) / 1e6


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored windows: user_id, event_id, t (seconds), esc, score, rms."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), (F.col("event_type") == "error").alias("esc"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), "event_type", "value", "props")


WINDOWS = "w AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1000000 AS t, event_type = 'error' AS esc, least(value / 100, 1.0) AS score, event_type, value, props FROM events)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with two made scores: id, class (language), y (toxic), score (with ties), score_b."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    x = table(spark, sf_dir, "labels").join(d, "doc_id")
    return x.select(F.col("doc_id").alias("id"), F.col("lang").alias("class"), F.col("toxic").alias("y"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"), (((F.col("doc_id") * 7919) % 1009) / 1009.0).alias("score_b"), "source", "quality")


SCORED = "s AS (SELECT doc_id AS id, lang AS class, toxic AS y, (n_chars % 1000) / 1000.0::DOUBLE AS score, ((doc_id * 7919) % 1009) / 1009.0::DOUBLE AS score_b, source, quality FROM labels JOIN documents USING (doc_id))"
