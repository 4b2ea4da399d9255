"""From raw documents to a training mix: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from pageloom.llm.common import table, written

#: A document that scores this or more is rejected as toxic.
REJECT = 0.7
#: Sources weigh as their number of documents to this power.
POWER = 0.5


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.learned(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept(docs, toxicity_model(spark, docs, sf_dir), REJECT)


def not_copied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def not_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.tempered(docs, POWER), seed=5)


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", not_copied),
    ("near_dedup", not_near),
    ("decontamination", not_leaked),
    ("mixing", mix),
]

#: A learned score and similarity classes are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the shared folder, which the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
