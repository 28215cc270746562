"""Artifact inventories: size, hash and class of files, compared with a recorded map."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.paths import below

READ_BYTES = 8 * 1024 * 1024  # a file of any size is hashed in reads of so many bytes


def classify(path: Column, classes: Sequence[tuple[str, str]], default: str) -> Column:
    """Class of the first prefix that the path starts with."""
    result = F.lit(default)
    for prefix, name in reversed(list(classes)):
        result = F.when(F.startswith(path, F.lit(prefix)), F.lit(name)).otherwise(result)
    return result


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the SHA-256 of each file, read piece by piece from where it is stored."""
    for batch in batches:
        digests = []
        for uri in batch.column(0).to_pylist():
            local = uri.startswith("file:/") and not uri.startswith("file://")
            files, path = fs.FileSystem.from_uri("file://" + uri[len("file:") :] if local else uri)
            digest = hashlib.sha256()
            with files.open_input_stream(path, compression=None) as stream:
                while piece := stream.read(READ_BYTES):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["uri", "path", "size_bytes", "sha256"])


def describe(contents: DataFrame, classes: Sequence[tuple[str, str]] = (), default: str = "artifact") -> DataFrame:
    """Inventory of a table of artifacts ``path, content``: size in bytes, SHA-256 and class."""
    content = F.col("content").cast("binary")
    return contents.select(
        "path", F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(content, 256).alias("sha256")
    ).withColumn("class", classify(F.col("path"), classes, default))


def inventory_files(
    spark: SparkSession, path: str, classes: Sequence[tuple[str, str]] = (), default: str = "artifact"
) -> DataFrame:
    """One row per file below ``path``: relative path, size, SHA-256 and class.

    Spark lists the files; their contents are read in pieces, so a file of any size has its hash.
    """
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = stored.select(
        F.col("path").alias("uri"), below(F.col("path"), path).alias("path"), F.col("length").alias("size_bytes")
    )
    hashed = listed.mapInArrow(_hashed, "uri string, path string, size_bytes long, sha256 string")
    return hashed.drop("uri").withColumn("class", classify(F.col("path"), classes, default))


def verify_artifacts(inventory: DataFrame, manifest: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Files missing, changed or unlisted against a manifest, and required names it omits."""
    held = inventory.select("path", F.col("sha256").alias("_actual"), F.lit(True).alias("_held"))
    listed = manifest.select("path", F.col("sha256").alias("_recorded"), F.lit(True).alias("_listed"))
    both = held.join(listed, "path", "full")
    state = (
        F.when(F.col("_held").isNull(), "missing")
        .when(F.col("_listed").isNull(), "unlisted")
        .when(~F.col("_actual").eqNullSafe(F.col("_recorded")), "hash_mismatch")
    )
    found = both.select("path", state.alias("problem")).filter("problem is not null")
    if not required:
        return found
    names = manifest.sparkSession.range(1).select(F.explode(F.lit(list(required))).alias("path"))
    omitted = names.join(manifest.select("path"), "path", "left_anti").select(
        "path", F.lit("required_but_absent").alias("problem")
    )
    return found.unionByName(omitted)
