"""The corpus pipeline: from all documents to a mix of clean ones.

Each stage works on what its predecessor kept and takes (spark, docs, sf_dir). ``run``
writes each result as Parquet below the shared folder and reads it again.

Defined results: a NULL text has no words, no secrets and no toxic score to speak of, and equals other texts
without words, of which one document stays; repeated rows are one class of near-duplicates, of which one row
stays; of a class's documents the one of the least id stays (NULL comes first), of one id the text of the least address;
empty documents, labels or benchmarks give an empty or an unfiltered result; further columns go through all stages but the last
as they are, whatever their names; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platefield.llm import decontaminate, mixing, near_dedup, secrets, toxicity
from platefield.llm.common import table
from platefield.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field learned from the labels doesn't predict to be toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where one was."""
    return secrets.mask_secrets(docs, chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its source's target and the words the mix takes of it."""
    rows = mixing.words_taken(*mixing.mix(docs))
    return rows.select(F.col("doc").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: SQL has no words for the first three stages; tests hold them against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
