"""One query per operator on the given tables, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, filter_audit, hard_negatives, language_id, line_rules, neardup, packing, quality, scoring,
    sharding, toxicity, url_filters, warc,
)
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


YEAR_MINUTES = 365 * 24 * 60


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def toxic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(_table(spark, sf_dir, "documents"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"), packing.tokenizer_file())


def shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_table(spark, sf_dir, "documents"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched 37 minutes apart and from the start again every year; the lists are
    histories of their own hosts: every host, parent domain and first path part is listed, taken off and
    listed again within that year, at times that follow from its MD5."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    pages = _table(spark, sf_dir, "pages")
    fetched = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * F.lit(37) % F.lit(YEAR_MINUTES) * F.lit(60))
    captures = pages.select("page_id", "url", fetched.alias("fetched_at"))
    host = url_filters.host_of(F.col("url"))
    part = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]+)", 1)
    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    keys = pages.where(host.contains(".")).select(
        F.explode(
            F.array(
                F.struct(F.lit("domains").alias("list"), domain.alias("key"), F.lit("block").alias("action")),
                F.struct(F.lit("trusted").alias("list"), host.alias("key"), F.lit("allow").alias("action")),
                F.struct(
                    F.lit("paths").alias("list"),
                    F.when(part != "", F.concat(host, F.lit("/"), part)).alias("key"),
                    F.lit("block").alias("action"),
                ),
            )
        ).alias("e")
    ).select("e.*").distinct()
    number = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 4), 16, 10).cast("int")
    listed = keys.where("key is not null").withColumn("n", number)
    steps = F.array(
        F.struct((F.col("n") % 6000).alias("hour"), F.col("action").alias("action")),
        F.struct((F.col("n") % 6000 + 700 + F.col("n") % 500).alias("hour"), F.lit("remove").alias("action")),
        F.struct((F.col("n") % 6000 + 1500 + F.col("n") % 900).alias("hour"), F.col("action").alias("action")),
    )
    entries = listed.select("list", "key", F.explode(steps).alias("s")).select(
        "list", "key", "s.action", F.timestamp_add("HOUR", F.col("s.hour"), start).alias("at")
    )
    return url_filters.verdicts(captures, entries).select(
        "page_id", F.unix_timestamp("fetched_at").alias("fetched_s"), "verdict", "list", "key"
    )


def hard_negative_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector is an anchor; every 7th has the label after its own."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
    return found.drop("positive_no")


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def language_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


QUERIES = {
    "op1_toxicity": toxic_score,
    "op5_quality": quality_score,
    "op2_warc": warc_round_trip,
    "op3_minimax_sharding": shard_bytes,
    "op4_decontaminate": decontaminate,
    "op6_url_filters": url_verdicts,
    "op7_quality_rules": quality_rules,
    "op8_language_scores": language_scores,
    "op9_best_fit_packing": best_fit_packing,
    "op10_near_duplicates": near_duplicates,
    "op11_hard_negatives": hard_negative_triples,
    "op12_filter_interactions": filter_interactions,
    "op13_language_id": language_predictions,
}
