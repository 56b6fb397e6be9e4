"""A corpus from raw documents: toxic texts go, near copies go, documents that hold test items
go, personal data is masked, and sources are mixed to target weights.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All
but the last return the columns of documents; their rules for nulls, empty texts and repeated
rows are those of the operators. Toxicity and personal data are beyond SQL, so there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieloom.llm import decontamination, mixing, near_dedup, pii, toxicity
from tieloom.llm.tables import small
from tieloom.staging import staged

TOXIC = 0.7

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold. A null id cannot be scored and stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    scored, _ = toxicity.score_texts(docs, labels, remainder == 1)
    rejected = staged(scored.where(F.col("score") >= TOXIC).select(F.col("doc_id").alias("__id")).distinct(), "rejected")
    return docs.join(small(rejected), docs["doc_id"] == F.col("__id"), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document of the smallest id."""
    found = near_dedup.near_duplicates(docs)
    copies = staged(found.where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct(), "copies")
    return docs.join(small(copies), docs["doc_id"] == F.col("__id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts and sets their new length."""
    return pii.redact(docs, length_column="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: ``doc_id, size, source_size, target, taken``. Documents beyond their source's
    budget have nothing taken."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
