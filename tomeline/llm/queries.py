"""The queries that apply this subpackage's operators to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .decontaminate import contamination
from .fill_middle import fill_in_middle
from .html_text import extract_text
from .licenses import licenses
from .mixing import mix
from .near_dups import near_duplicates
from .neighbours import nearest
from .quality import quality
from .secrets import secrets
from .substring_dups import remove_repeats
from .toxicity import toxicity
from .url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op2_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), length=13)


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(_table(spark, sf_dir, "documents")).drop("output")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every vector whose id is divisible by 100, among all."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash_near_dups": op2_minhash_near_dups,
    "op3_secret_scans": op3_secret_scans,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scans": op5_license_scans,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_url_filter": op8_url_filter,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_source_mixing": op10_source_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_nearest_neighbours": op12_nearest_neighbours,
}

ORACLES = {
    "op1_quality_rules": oracles.QUALITY,
    "op2_minhash_near_dups": oracles.NEAR_DUPS,
    "op4_substring_dedup": oracles.REPEATS,
    "op8_url_filter": oracles.URLS,
    "op10_source_mixing": oracles.MIXING,
    "op11_fill_in_middle": oracles.FILL_MIDDLE,
}
