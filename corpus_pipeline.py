"""The corpus pipeline: five stages over documents.

1. toxicity: documents that the classifier chain finds toxic go.
2. ngram_jaccard_join: of each group of linked documents the one with the smallest doc_id stays.
3. benchmark_decontamination: documents that hold a benchmark item go.
4. secret_scans: secrets in texts are replaced; all documents stay.
5. best_fit_packing: all texts are packed; one row for each piece.

Each stage works on all rows that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, jaccard_join, packing, secrets, toxicity
from lodestar.llm.common import materialize, table
from lodestar.session import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.filter_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, "byte_bpe_50k.json")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]
#: Tokenizers, fitted models and similarity joins can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the output of each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
