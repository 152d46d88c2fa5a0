"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, the next one's docs. A stage that needs
other tables (labels, benchmark items) reads them from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, mixing, neardup, quality, secrets
from tallyforge.llm.common import Workspace, table

#: Test passages of at least so many words are cut out of documents that stay below the contamination rule.
MAX_SPAN = 50


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line model reject go."""
    return quality.keep_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8)."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; whole test passages in the others are cut out."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_span=MAX_SPAN)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text."""
    return secrets.redact(docs, secrets.train(secrets.samples(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with their size and the number of copies and words taken."""
    return mixing.select_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mix_sources),
]

#: Stages that learn, link or cut cannot be said in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = space.save(docs)
    return docs
