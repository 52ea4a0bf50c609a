"""The corpus pipeline: raw documents to a mix for training.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes each
stage's rows to the shared folder as Parquet and reads them for the next; then
the rows before are deleted. A stage is one of the operators, so its cases (null and empty texts, repeated
rows, empty tables) are those of the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideledger.llm import decontaminate, mixing, pii, quality_rules, simhash
from tideledger.llm.shared import delete_folder, new_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated classifier."""
    labels = table(spark, sf_dir, "labels")
    return quality_rules.passing(docs, quality_rules.trained(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms generalised; n_chars follows the text."""
    return pii.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken beside their columns."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("source_mix", mix),
]

#: No SQL can train the classifier or hash the shingles; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs
