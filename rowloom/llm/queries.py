"""The registered query of each operator: its contract's columns over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, language, licenses, mixing, pii, quality, sharding, simhash, substring, urls
from rowloom.llm.oracles import ORACLES  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    df, names = quality.judge(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    return df.select("doc_id", *[F.col(names[k]).alias(k) for k in [*quality.STATS, "base_failed", "rule", "kept"]])


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(_read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.identify(docs, language.samples(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_read(spark, sf_dir, "documents"))
    base = F.concat(*[pii.listed(k, F.col(f"base.{k}")) for k in pii.KINDS])
    return out.select(
        "doc_id",
        *[F.size(f"base.{k}").cast("bigint").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, pii.listed(None, F.col("more"))), ",").alias("spans"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_quality_rules,
        op3_simhash_groups,
        op4_license_scan,
        op5_byte_shards,
        op6_url_filter,
        op7_mix_sources,
        op8_language_id,
        op9_repeated_passages,
        op10_personal_data,
    )
}
