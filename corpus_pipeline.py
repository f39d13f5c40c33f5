"""From raw documents to a training mixture: five stages, each a full pass over what is left.

Every stage takes (spark, docs, sf_dir) and returns a frame; all return the columns of `documents`.
`run` writes each result as Parquet below the shared folder and reads it again for the next stage, so a
lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import decontam, jaccard, mixing, secrets, toxicity
from gridledger.llm.common import stored, table
from gridledger.llm.queries import MIXTURE


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.reject(docs, toxicity.train(docs, labels.filter(~toxicity.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the least id."""
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or paraphrased, go."""
    return decontam.clean(docs, decontam.models(docs, table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside texts are replaced by a mark; all documents stay."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have the target shares."""
    return mixing.mix(docs, MIXTURE)


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("mixture", draw_mixture),
]

#: The stages train models and fit weights, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
