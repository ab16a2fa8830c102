"""From raw documents to token ids: five stages, each one of the operators in inkstone.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and is
written as Parquet before the next one reads it. All but the last return the columns of docs;
extra columns are carried along, whatever their names.

Defined cases: an empty table passes through every stage empty. A null or empty text fails the
quality rules (it has no words) and goes in the first stage; given to a later stage directly it
stays as it is, is a copy of every other text without words, and has no token ids. Nulls in other
columns stay. Texts of any length are handled whole. Repeated rows, and documents whose texts are
alike, are one group: the least doc_id stays (null ids give way; of equal ids one row stays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstone.llm import bpe, decontaminate, pii, quality, simhash
from inkstone.llm.common import documents
from inkstone.session import finished, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy of the rule ledger keeps."""
    return quality.filtered(docs, quality.STRICT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that consist of them for more than half go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, distinct for distinct entities.

    The key is the session's spark.inkstone.pii.key; the example key only where that is unset."""
    key = spark.conf.get("spark.inkstone.pii.key", None)
    return pii.distinct_surrogates(docs, key.encode() if key else pii.EXAMPLE_KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document."""
    return bpe.encoded(docs, bpe.public_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL cannot express the fingerprint components, the surrogates or the encoder: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = documents(ship(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
