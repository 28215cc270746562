"""Sidecar observations: nested JSON documents to typed rows and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rules import between, broken, one_of, required
from tidemark.schemas import MODALITIES, SIDECAR, SPEECH_MODALITIES

_REQUIRED = (
    "observation_id", "adapter", "start_ms", "end_ms", "claim_type", "text", "confidence", "modality",
)


def parse_sidecars(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split exploded sidecars (``SIDECAR`` layout) into observations and rejects.

    Rejects keep every broken rule. Repeated ids are counted before they are joined back, so one id
    with many copies does not gather in one task.
    """
    rows = documents.select("source_id", F.inline("observations"))
    rules = [(f"missing:{c}", required(c)) for c in _REQUIRED]
    rules += [
        ("bad_interval", (F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms"))),
        ("bad_confidence", between("confidence", 0, 1)),
        ("unknown_modality", one_of("modality", MODALITIES)),
        ("speech_without_speech_evidence",
         F.col("speech_text").isNull() | F.col("modality").isin(list(SPEECH_MODALITIES))),
    ]
    keys = ["source_id", "observation_id"]
    copies = rows.filter("observation_id is not null").groupBy(*keys).count().filter("count > 1")
    judged = rows.join(copies.withColumnRenamed("count", "_copies"), keys, "left")
    rules.append(("repeated_id", F.col("_copies").isNull()))
    judged = judged.withColumn("violations", broken(rules)).drop("_copies")
    good = judged.filter(F.size("violations") == 0).drop("violations")
    good = good.withColumns(
        {"speech_source": F.lit(None).cast("string"), "evidence_ref_override": F.lit(None).cast("string")}
    )
    bad = judged.filter(F.size("violations") > 0).select(*keys, "violations")
    return good, bad


def read_observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read sidecar files (one JSON document each): observations, rejected rows, corrupt files."""
    schema = SIDECAR + ", _corrupt string"
    files = (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
        .withColumn("path", F.input_file_name())
    )
    corrupt = files.filter(F.col("_corrupt").isNotNull() | F.col("observations").isNull()).select(
        "path", F.lit("malformed_document").alias("reason")
    )
    good, bad = parse_sidecars(files.filter("_corrupt is null"))
    return good, bad, corrupt
