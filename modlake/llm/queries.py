"""The numbered operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlake.llm import bpe, forest, hardneg, licenses, media, mixing, oracles, pages, pii, ranking, rules, simhash, spelling, suffix
from modlake.llm.common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored in and read back from a baseline JPEG."""
    return media.read_media(media.store_media(table(spark, sf_dir, "documents")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in a mix of all sources to their targets."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base rule and the learned decision list."""
    return rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise-ranked quality of every document."""
    return ranking.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeats of 400 bytes."""
    return suffix.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids and back."""
    return bpe.encode(table(spark, sf_dir, "documents"), and_back=True)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by similar sets of 4-word shingles."""
    return forest.near_copies(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors among all embeddings."""
    return hardneg.mine(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_media_columns, op2_mixing, op3_quality_rules, op4_quality_classifier, op5_html_extraction, op6_simhash_dedup, op7_pii, op8_suffix_dedup, op9_byte_bpe, op10_license_scan,
    op11_minhash_dedup, op12_spelling_variants, op13_hard_negatives,
)
QUERIES = {f.__name__: f for f in _ALL}
#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {"op11_minhash_dedup": oracles.OP11, "op12_spelling_variants": oracles.OP12, "op13_hard_negatives": oracles.OP13}
