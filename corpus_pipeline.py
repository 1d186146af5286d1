"""A corpus pipeline of five stages over the documents table.

Each stage works on all that its predecessor kept, and is written and read again. All
but the last return the columns of documents; the last returns the packed pieces.

Defined results: documents without any letter (or text) go in the first stage; of each
group of near duplicates the document with the smallest id stays (one row, if rows
repeat; a null id only if the group has no other), documents without words all stay;
contaminated documents go; live-looking secrets are replaced in the text; every document
that is left is packed whole. Extra columns of documents are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.llm import decontaminate, language, ngram_join, packing, secrets
from govlens.llm.common import fold, ready, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; without any labelled one, no language is told and all of them stay."""
    ready(spark)
    docs = docs.select(COLUMNS)
    found = language.identify(docs, language.learn(docs.where(fold("doc_id", 4) != 2)))
    return found.where("lettered").select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ready(spark)
    return ngram_join.representatives(docs.select(COLUMNS))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not carry a benchmark's passages."""
    found = decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.where(~decontaminate.contaminated(c["n_words"], c["n_hit"])).select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced."""
    return secrets.redact(docs.select(COLUMNS)).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences."""
    ready(spark)
    return packing.report(docs)


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard_join", one_of_each),
    ("decontamination", uncontaminated),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

# Sub-word tokens and phrase counts are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
