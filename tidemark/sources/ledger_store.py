"""The stored ledger: partitioned sink and a reader for both contract versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import LEDGER

BUCKETS = 256


def write_ledger(ledger: DataFrame, path: str, fmt: str = "parquet", buckets: int = BUCKETS) -> None:
    """Write nested records below ``bucket=`` folders named by a hash of the source.

    Rows are spread by (bucket, event) before writing: a large source becomes many files, and only
    the buckets present are replaced.
    """
    placed = ledger.withColumn("bucket", F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int"))
    (
        placed.repartition("bucket", F.pmod(F.xxhash64("source_id", "event_no"), F.lit(64)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .format(fmt)
        .save(path)
    )


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Parquet table with their place: ``file`` and ``row_index`` in it.

    Writers name files in the order of their partitions, so a table that was written in order is in
    order by (file, place).
    """
    return spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index")
    )


def read_ledger(spark: SparkSession, *paths: str, fmt: str = "parquet") -> DataFrame:
    """Union of stored ledgers. Version 1.0 records have no chunk list; it becomes the single
    primary chunk."""
    result = None
    for path in paths:
        reader = spark.read.schema(LEDGER + ", bucket int") if fmt == "json" else spark.read
        part = reader.format(fmt).load(path)
        if "part" not in part.columns:
            part = part.withColumn("part", F.lit(0).cast("long"))
        stored = part.schema["provenance"].dataType.fieldNames()
        chunks = F.col("provenance.chunk_ids") if "chunk_ids" in stored else F.lit(None).cast("array<string>")
        part = part.withColumn(
            "provenance",
            F.struct(
                F.col("provenance.source_id").alias("source_id"),
                F.col("provenance.chunk_id").alias("chunk_id"),
                F.coalesce(chunks, F.array("provenance.chunk_id")).alias("chunk_ids"),
                F.col("provenance.run_id").alias("run_id"),
            ),
        )
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result.drop("bucket")
