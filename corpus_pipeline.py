"""The corpus pipeline: filter, filter, de-duplicate, redact, pack.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``. ``run``
writes every stage's result to the shared folder, so that a later failure or a lost executor repeats no finished stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import packing, pii, quality_rules, similar, toxicity
from concord.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep; the ratio's corpus is ``docs``."""
    return quality_rules.kept(docs, quality_rules.weights(quality_rules.counted(docs, table(spark, sf_dir, "labels"))))


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8."""
    return similar.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of the sources' proportions."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("toxicity", detoxify), ("near_duplicates", deduplicate), ("pii", redact), ("packing", pack)]
#: Learned models and tokenisation have no SQL form; tests hold the survivors and the packed pieces of a whole run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
