"""Files of any size as numbered lines, read by byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.sequence import attach, is_hot, running
from tidemark.session import materialise

WHOLE_BYTES = 32 << 20  # files up to so many bytes are one value each; larger ones are read as lines


def read_lines(spark: SparkSession, path: str, above_bytes: int = -1) -> DataFrame:
    """Lines of the files below ``path`` that are larger than ``above_bytes``: ``path, line_no, line``.

    Files are cut into byte ranges wherever Spark likes. A line belongs to the range that it begins
    in; the lines of a range follow each other, so only the number of lines per range is summed up to
    number all lines of a file, and no line is sorted. A byte-order mark at the start of a file is dropped.
    """
    at = "_metadata.file_block_start"
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    rows = rows.where(F.col("_metadata.file_size") > above_bytes).select(
        F.col("_metadata.file_path").alias("path"), F.col(at).alias("_from"), F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("_at"),
    )
    ranges = rows.groupBy("path", "_from").agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_lines"))
    earlier = W.partitionBy("path").orderBy("_from").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0))).drop("_lines")
    return attach(rows, ranges, ["path", "_from"]).select(
        "path", (F.col("_before") + F.col("_at") - F.col("_least") + 1).alias("line_no"), "line"
    )


def quoted_records(lines: DataFrame, keys: list[str], opens: str, stays: str) -> DataFrame:
    """Number the records that lines belong to (``record_no``), where quotes may hold line breaks.

    ``opens`` says whether a line that begins outside a quote ends inside one, ``stays`` the same of a line
    that begins inside. A line thus is a map of two states: it sets the state, keeps it or swaps it. The
    state before a line is what the last setting line left, swapped as often as lines since then swap.
    """
    marked = lines.withColumns(
        {
            "_sets": F.when(F.col(opens) == F.col(stays), F.col(opens).cast("int")),
            "_swaps": (F.col(opens) & ~F.col(stays)).cast("long"),
        }
    )
    hot = is_hot(marked, keys)
    order = ["line_no"]
    counted = running(marked, keys, order, "_swaps", "_swapped", hot=hot)
    setting = F.when(
        F.col("_sets").isNotNull(), F.struct("line_no", F.col("_swapped").alias("swapped"), F.col("_sets").alias("state"))
    )
    last = running(counted.withColumn("_setting", setting), keys, order, "_setting", "_last", F.max, hot)
    # The state behind a line; a file begins outside.
    behind = F.pmod(
        F.coalesce(F.col("_last.state"), F.lit(0)) + F.col("_swapped") - F.coalesce(F.col("_last.swapped"), F.lit(0)), F.lit(2)
    )
    ended = materialise(last.withColumn("_ends", F.when(behind == 0, 1).otherwise(0)))
    numbered = running(ended, keys, order, "_ends", "_ended", hot=hot)
    return numbered.withColumn("record_no", F.col("_ended") - F.col("_ends") + 1).drop(
        "_sets", "_swaps", "_swapped", "_setting", "_last", "_ends", "_ended"
    )
