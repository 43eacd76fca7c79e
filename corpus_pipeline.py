"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyvote.llm import decontaminate, neardup, packing, pieces, pii, quality
from manyvote.llm.queries import tokenizer_path
from manyvote.llm.rows import crc_fold, table
from manyvote.workspace import Workspace


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 3) != 1)
    return quality.keep_good(docs, quality.learn(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return neardup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a test item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a mark of its kind; ``n_chars`` is that of the new text."""
    return pii.mask_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their place in sequences of 2048."""
    cut = pieces.token_pieces(docs, tokenizer_path("word_bpe_49k.json"), kept=50_000)
    return packing.pack(cut.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: No SQL twin: classifier, signatures, tokenizer and packing have none. The tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    workspace = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = workspace.save(docs, name.replace(" ", "-"))
    return docs
