"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontamination import find_leaks
from lodestone.llm.licenses import scan_licenses
from lodestone.llm.lm_scoring import score_texts
from lodestone.llm.mixing import mix_sources
from lodestone.llm.near_join import near_join
from lodestone.llm.oracles import ORACLES
from lodestone.llm.periodic_runs import find_runs, run_digest, with_periodic_tail
from lodestone.llm.pii import find_pii, pii_digest
from lodestone.llm.quality import quality_rules
from lodestone.llm.secrets import ALPHABETS, scan_secrets
from lodestone.llm.spelling import spelling_variants
from lodestone.llm.token_counts import token_counts
from lodestone.llm.toxicity import toxicity
from lodestone.llm.url_filters import filter_urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(_read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(_read(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_read(spark, sf_dir, "documents"), alphabets=ALPHABETS)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(find_runs(with_periodic_tail(_read(spark, sf_dir, "documents"))))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(_read(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"), slip=97)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_url_filters": op5_url_filters,
    "op6_secret_scans": op6_secret_scans,
    "op7_license_scans": op7_license_scans,
    "op8_toxicity": op8_toxicity,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pii": op12_pii,
    "op13_spelling_variants": op13_spelling_variants,
}

__all__ = ["ORACLES", "QUERIES"]
