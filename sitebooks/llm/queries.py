"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import round_trip
from .decontamination import contamination
from .language_id import languages
from .language_model import scores
from .licenses import license_report, notices
from .line_dedup import deduplicated_lines
from .nearest import nearest
from .ngram_join import ngram_components
from .periodic import periodic_runs, run_report
from .quality import quality_scores
from .shared import shared_folder
from .spelling import LEAST_COUNT, corpus_words, spelling_forms
from .sql import url_sql
from .token_counts import token_counts
from .url_filter import Rule, page_outcomes, url_verdicts

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string",
}

# fixed values: the url rules of the contract
URL_RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, unless it is installed there."""
    root = str(Path(__file__).resolve().parents[2])
    found = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in found.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, found]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(table(spark, folder, "documents"))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def counted_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, folder, "documents"), path, shared_folder(spark))


def quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scores(table(spark, folder, "documents"))


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"))


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_report(table(spark, folder, "documents"), notices(spark))


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = deduplicated_lines(table(spark, folder, "documents").select("doc_id", "text"), increments=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The labels are the outcomes of the pages with their ids: the tables hold no others."""
    return url_verdicts(table(spark, folder, "pages"), page_outcomes(table(spark, folder, "labels")), URL_RULES)


def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = corpus_words(table(spark, folder, "documents")).where(F.col("n") >= LEAST_COUNT)
    return spelling_forms(words)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: in one document of ten a block repeats from some word on; not for an unknown id."""
    n = len(words)
    crc = zlib.crc32(str(doc_id).encode())
    if doc_id is None or n == 0 or crc % 10:
        return words
    g = crc // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    block = words[start : start + period]
    return words[:start] + (block * -(-(n - start) // period))[: n - start]


def periodic(spark: SparkSession, folder: str) -> DataFrame:
    return run_report(periodic_runs(table(spark, folder, "documents"), rewrite=repeated_tail))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination,
    "op2_ngram_jaccard": ngram_jaccard,
    "op3_nearest": nearest_vectors,
    "op4_quality": quality,
    "op5_token_counts": counted_tokens,
    "op6_lm_scores": lm_scores,
    "op7_byte_bpe": bpe_round_trip,
    "op8_language_id": language_id,
    "op9_license_scan": license_scan,
    "op10_line_dedup": line_dedup,
    "op11_url_filter": url_filter,
    "op12_spelling": spelling_variants,
    "op13_periodic": periodic,
}
SQL: dict[str, str] = {"op11_url_filter": url_sql(URL_RULES)}
