"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest group that may be ordered inside one task, and largest group that may be folded as one
# array. Both can be lowered per session, which the tests use to drive the distributed branches.
HOT_ROWS_KEY = "tidemark.hotRows"
FOLD_ROWS_KEY = "tidemark.foldRows"
BLOCK_ROWS_KEY = "tidemark.blockRows"
DEFAULTS = {HOT_ROWS_KEY: 5_000_000, FOLD_ROWS_KEY: 10_000, BLOCK_ROWS_KEY: 4_096}

_SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more shuffle: a hot source must not become
    # one task only because the next operator groups by the same key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings that the operators rely on."""
    for key, value in _SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


# Sorted keys and numbers shrink to a dozen bytes a row when they are shuffled. Partitions joined up to the
# usual 64 MB would then hold millions of rows, and a task's sorts and groupings gigabytes.
JOINED_PARTITION = "4m"
# Stored numbers are as small: a split of the usual 128 MB holds more than ten million rows.
READ_PARTITION = "16m"


def bound_tasks(spark: SparkSession) -> SparkSession:
    """Let shuffle partitions be joined, and files be read, by a few megabytes only, so that tasks stay small in large tables."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", JOINED_PARTITION)
    spark.conf.set("spark.sql.files.maxPartitionBytes", READ_PARTITION)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in _SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def limit(spark: SparkSession, key: str) -> int:
    """Read one of the size limits from the session."""
    return int(spark.conf.get(key, str(DEFAULTS[key])))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's own, or a scratch folder in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as compressed columns below the shared checkpoint folder and continue from them.

    For tables that are read several times, each time by a few of their columns. They stay in that folder.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
