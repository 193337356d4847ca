"""Cleaning of a document corpus in five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last returns the token digests of what is left.

Nulls, empty texts and repeats: a null text counts as empty; empty texts are never toxic, are one group to near_dedup, hold no
benchmark item and no personal data, and have no tokens. Rows with a null or shared doc_id are rows like any other. Texts are
taken whole, however long. Of equally similar rows the smallest doc_id stays. An empty table gives no rows. Columns beyond
those of documents go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweft.llm import leaks, pieces, pii, simhash, toxicity
from tagweft.llm.queries import model_path, table
from tagweft.llm.text import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are similar (0.8 or more, exactly), the one with the smallest
    doc_id stays. Candidates are the links of SimHash fingerprints, and by prefixes those that lie beyond their radius. Rows
    go one by one, also those that share a doc_id or have none."""
    return simhash.without_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return leaks.without_hits(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of what they decode to."""
    return pieces.digests(docs, model_path())


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", mask_pii), ("pieces", tokenize)]
#: SQL can express none of the learned stages; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
