"""Documents to training data: five stages, each over all that the one before kept.

1. quality classifier: rejected documents go
2. SimHash near-duplicates: one document of each group stays. Groups are by 5-word Jaccard similarity of 0.8 or more, confirmed
   on whole sets: fingerprints within 4 bits, by the BK-trees of op6, are checked first; as they miss most such pairs, the LSH
   forest of op11 adds the rest
3. personal data: replaced in the texts
4. mixing: documents are repeated, or left out, by their source's target
5. byte-level BPE: texts become token ids

Documents may have nulls in any column, repeated rows and further columns of any name; these stay with their rows up to
stage 4. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modlake.llm import bpe, forest, mixing, pii, ranking
from modlake.llm.common import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts to be good. A null text is an empty one; rows of one id (null is one) go together."""
    return ranking.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group. Null, empty and wordless texts are one group; rows that repeat the id kept
    stay; a row without an id stays only if its whole group has none."""
    return forest.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [EMAIL] and the like in place of personal data, and n_chars of the new text. A null text stays null."""
    return pii.sanitise(docs, n_col="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the part of a document counts as one copy from a half on. A null source is a
    source; rows that repeat an id and source are taken as often as the one that is taken most."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; a null text has no ids."""
    return bpe.encode(docs, and_back=True)


STAGES = [("quality classifier", quality), ("SimHash near-duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixture), ("byte-level BPE", tokens)]
#: SQL can't express a fitted classifier, disclosure or merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
