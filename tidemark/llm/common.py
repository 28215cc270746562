"""Written intermediate tables, batch sizes and small column helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_root, configure

# Python workers get batches of at most so many rows and bytes: one batch of very long texts must fit.
BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20

# Copies made of the small side of a join whose other side may hold a third of its rows on one key.
SALTS = 16

_tables: dict[str, list[str]] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint folder, deleted by :func:`release`."""
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and go on from the written rows.

    Lineage is cut by a table that every executor can read, so a lost executor costs its running
    tasks only. The table stays until :func:`release`.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the written tables of this application; results that still read them must be stored first."""
    context = spark.sparkContext
    for path in _tables.pop(context.applicationId, []):
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``: the folds of the training rules. Null: null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


def held_out(key: str, modulus: int, fold: int) -> Column:
    """True for rows of one fold; rows without a key belong to no fold and are never learned from."""
    return F.coalesce(remainder(key, modulus) == F.lit(fold), F.lit(True))


def salted(df: DataFrame, count: int = SALTS, name: str = "salt") -> DataFrame:
    """One copy of every row for each salt: the small side of a join on a key that may be hot."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def salt_of(*columns: str, count: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")
