"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes what a stage returns and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontamination, jaccard, mixing, quality_ranking, secrets
from lectern.llm.common import materialise, set_aside, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (predicted 0)."""
    ranker = quality_ranking.train(docs, table(spark, sf_dir, "labels"))
    docs, back = set_aside(docs, "score", "predicted")
    scored = quality_ranking.with_score(docs, ranker, *docs.columns)
    return back(scored.where("predicted = 1").select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates, that with the smallest id."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    docs, back = set_aside(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), *docs.columns)
    return back(found.where("not contaminated").select(*docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with a mark in place of each secret; n_chars follows the text."""
    return secrets.redact(docs, secrets.train(secrets.labelled_samples(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with how many of their words the mix takes."""
    return mixing.mix(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("mixing to target weights", mixture),
]
#: The learned scores have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
