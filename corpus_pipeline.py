"""Corpus pipeline over ``documents``: each stage applies one operator of ``streamlearn.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of their input; the last returns one row per piece
of a document with its place in a packed sequence.

A null text is an empty text to every stage; rows with a null ``doc_id`` are kept
by the near-duplicate stage, which cannot tell them apart; extra columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from streamlearn import checkpoint_dir
from streamlearn.llm import decontaminate, packing, pii, quality, simhash
from streamlearn.llm.common import read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier (fitted on the labelled documents) rejects."""
    model = quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return quality.keep_accepted(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each component of near copies."""
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a benchmark item occurs."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    return pii.mask(docs, pii.fit(pii.training_table(spark)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("pii", pii_stage), ("packing", packing_stage)]

#: The classifier, the hash fingerprints and the tokenizer have no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage returns is written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
