"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.common import labelled_sample, stored, table
from quarrylane.llm.decontaminate import decontaminated
from quarrylane.llm.jaccard import one_of_each_group
from quarrylane.llm.mixing import mix_sources
from quarrylane.llm.substring_dedup import without_repeats
from quarrylane.llm.toxicity import MOST_LABELLED, toxicity_scores


#: Texts that Spark hands to Python at once; its own default of 10,000 doesn't ask how long they are.
TEXTS_AT_ONCE = 1_000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(stage):
    """A stage under which Spark's default number of rows of an Arrow batch is lowered for the session; another
    number that the user has set stays."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_SETTING, "10000") == "10000":
            spark.conf.set(_SETTING, str(TEXTS_AT_ONCE))
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weakly supervised classifier scores 0.5 or more."""
    known = labelled_sample(table(spark, sf_dir, "labels"), "toxic", 5, 0, MOST_LABELLED)
    return toxicity_scores(docs, known).where("score < 0.5").select(*docs.columns)


@bounded_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of texts linked by a Jaccard of 0.8 over 5-word shingles."""
    return one_of_each_group(docs, 5, 4, 5).select(*docs.columns)


@bounded_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that occur earlier; n_chars is that of what is left."""
    left = without_repeats(docs)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@bounded_batches
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@bounded_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("mix_sources", mix),
]

#: The stages train a classifier, group near-duplicates and tile strings: no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
