"""A training corpus from raw documents: five stages, each on all that the one before kept.

toxicity drops the documents it rejects; the n-gram Jaccard join keeps one
document of each group of near copies; decontamination drops documents in which a
benchmark item leaks; secret scans mask the secrets; mixing decides how often each
document is taken and returns the taken ones, with their masked texts and all other
columns of documents, and size, source_size, target, repeats and taken.

Edge cases: those of the operators; a stage that keeps nothing hands an empty table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.decontamination import drop_leaking
from lodestone.llm.mixing import take_mix
from lodestone.llm.near_join import keep_one_of_each
from lodestone.llm.secrets import ALPHABETS, mask_secrets
from lodestone.llm.toxicity import drop_toxic
from lodestone.scratch import Cuts, released

#: The last stage fits targets to the sizes kept and picks by a hash: tested against a brute-force version instead.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs, alphabets=ALPHABETS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written and read again by the next.

    A stage's intermediate tables are deleted once its result is written, and that
    result once the next one is; only what the last stage reads from stays.
    """
    docs, cuts = spark.read.parquet(f"{sf_dir}/documents.parquet"), Cuts(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with released():
            docs = cuts.cut(stage(spark, docs, sf_dir))
        if k:
            cuts.drop(k - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
