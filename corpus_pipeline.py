"""Documents to packed sequences: language ID, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of documents. ``run`` writes
each stage's result into the shared folder and reads it again, so that a lost
executor costs the stage at hand at most; what a stage wrote for itself goes when
its result is written.

Nulls, empty and very long texts, and repeated ids pass through each stage as its
operator's docstring says: a null or empty text has no language and goes in the
first stage, a row that repeats an id and a text stays once. Extra columns of the
input are left out, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.io import table
from quillspark.llm import decontaminate, langid, neardup, packing, secrets
from quillspark.llm.shared import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can express neither the trained models nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null text, or no letters); ``lang`` becomes the predicted one."""
    named = langid.predict_rows(docs.select(*COLUMNS), langid.train(docs))
    return named.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that with the least id. A document without words is in no group."""
    return neardup.keep_one(docs.select(*COLUMNS))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a whole window of a benchmark item, or the windows of two items."""
    return decontaminate.leave_out(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; keeps all documents."""
    cleaned = secrets.redact(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with Workspace.passing():
            docs = space.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            space.drop(f"stage{k - 1}")
    return docs
