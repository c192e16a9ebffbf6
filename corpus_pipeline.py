"""The corpus pipeline: documents that are not toxic, not near copies, free of benchmark passages and personal data, as token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import stored
from siltstone.llm.decontaminate import remove_contaminated
from siltstone.llm.minhash import near_duplicates
from siltstone.llm.pii import sanitise
from siltstone.llm.toxicity import remove_toxic
from siltstone.llm.wfst import encode
from siltstone.shipping import ship

#: A row with this remainder of crc32(doc_id as text) by 3 is held out of the fit of the toxicity models.
HELD_OUT = 1


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models reject go."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != HELD_OUT)
    return remove_toxic(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Rows without an id stay; rows that repeat one id are one document and stay as they are.
    """
    ship(spark)
    name = f"gone_{uuid.uuid4().hex}"  # no column of docs is called so
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    ship(spark)
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised in the texts."""
    ship(spark)
    return sanitise(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Each document as token ids, with a check that they decode to its text."""
    ship(spark)
    return encode(docs, path or public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: Fitted models and tokenisers are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
