"""The operators over their whole tables: one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SOURCE_WEIGHTS = {"src0": 8}  # every other source: 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_qda import quality_classifier

    return quality_classifier(documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir), SOURCE_WEIGHTS)


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(documents(spark, sf_dir), order=2)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digest, without_repeats

    return digest(without_repeats(documents(spark, sf_dir)))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similarity_classes

    return similarity_classes(documents(spark, sf_dir))


def op6_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .revisit import captures_of_pages, resolve_revisits

    found = resolve_revisits(captures_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.withColumn("headers", merged)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(documents(spark, sf_dir), _labels(spark, sf_dir).where("quality = 1"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licence_scan

    return licence_scan(documents(spark, sf_dir))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import digest, line_bitmaps, without_shared_lines

    docs = documents(spark, sf_dir)
    return digest(without_shared_lines(docs, line_bitmaps(docs)))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import by_component, whiten

    return by_component(whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, digest, repaired

    return digest(repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), present="present", lone_system=False))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_pfair_mixing, op3_katz_backoff, op4_suffix_dedup, op5_jaccard_join, op6_revisit_resolution, op7_exact_top_k, op8_minimum_bin_slack, op9_quality_rules, op10_license_scan, op11_line_dedup, op12_embedding_whitening, op13_conversation_repair)}
