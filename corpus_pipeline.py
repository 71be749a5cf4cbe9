"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import line_dedup, minhash, mixing, packing, quality
from evidentia.llm._shared import keep, scratch, table
from evidentia.session import ship


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, predicts as 1."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.accepted(docs, quality.train(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document or line has, equal at any length or within one word; documents that lose lines and keep none but blank ones go."""
    ship(spark)
    return _counted(docs, line_dedup.without_emptied(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that is linked at a similarity of 0.8: that with the smallest id.

    Decided by row, so an id with several texts loses only the text that is a copy. Rows without words stay, and rows without an id if no
    row with an id has their set.
    """
    ship(spark)
    return minhash.without_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    ship(spark)
    return mixing.copies(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2,048 tokens."""
    ship(spark)
    return packing.pack(docs)


def _counted(before: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, after a change of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality", reject_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Training by gradient descent, randomised rounding and tokenizers have no form in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote on its way goes once its output is written
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
