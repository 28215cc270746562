"""Stored files by their path below a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def below(path: Column, root: str) -> Column:
    """Path of a file relative to the folder it was listed from; the folder is taken literally.

    Spark lists local files as ``file:/…`` or ``file:///…`` whatever the folder was called.
    """
    folder = root.split(":", 1)[1].lstrip("/") if root.startswith("file:") else root.lstrip("/")
    at = F.locate(folder.rstrip("/") + "/", path)
    return F.when(at > 0, F.substring(path, at + len(folder.rstrip("/")) + 1, F.length(path))).otherwise(path)


def mapped_files(stored: DataFrame, root: str, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored files with their row of ``names`` (by ``file_name``, the path below ``root``), and the
    rest: files without a row (``unmapped_file``) and rows without a file (``missing_file``).

    ``names`` without a path separator in any way still meet only files directly below the root, so
    equal base names in two folders are never confused.
    """
    listed = stored.withColumn("file_name", below(F.col("path"), root))
    found = listed.join(names, "file_name")
    reason = lambda text: F.lit(text).alias("reason")
    unmapped = listed.select("file_name").join(names.select("file_name"), "file_name", "left_anti")
    missing = names.join(listed.select("file_name"), "file_name", "left_anti")
    return found, missing.select(*names.columns, reason("missing_file")).unionByName(
        unmapped.select("file_name", reason("unmapped_file")), allowMissingColumns=True
    )
