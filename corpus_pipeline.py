"""Cleaning a corpus in stages: quality rules, near-duplicates, benchmark passages,
secrets, encoding. Counted as part of the subpackage casebook.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept;
all but the last return the columns of documents. Edge cases are those of the
operators: null and empty texts fail the quality rules and go; rows with a null or repeated
id are judged each by its text; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import bpe, decontam, neardup, quality, secrets
from casebook.llm.common import new_folder, prepare, read

#: No SQL: signatures, decoded keys and BPE are not expressed in it; tests/llm has a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail no rule of the policy."""
    prepare(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    prepare(spark)
    return neardup.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced in the texts; n_chars follows the text."""
    prepare(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids."""
    prepare(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
