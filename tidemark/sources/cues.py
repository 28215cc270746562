"""Caption files: WebVTT and SRT text to cue rows, one narrow pass per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.functions.text import normalise_text
from tidemark.functions.timecode import clock_to_ms, is_timing
from tidemark.operators.sequence import attach, is_hot, number_rows, running
from tidemark.session import materialise
from tidemark.sources.lines import WHOLE_BYTES, read_lines
from tidemark.sources.paths import below, mapped_files

_MARK = "\ufeff"  # byte-order mark, ignored around a timing line


def _lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def _unmarked(line: Column) -> Column:
    return F.regexp_replace(line, f"^{_MARK}+|{_MARK}+$", "")


def _blocks(text: Column) -> Column:
    """Runs of lines between empty lines."""
    inner = F.regexp_replace(text, "^\n+|\n+$", "")
    return F.filter(F.split(inner, "\n\n+"), lambda b: b != "")


def _read_block(block: Column) -> Column:
    """First timing line of a block, the text below it, and whether a line above it is broken.

    A line with an arrow that is neither a timing nor directly above one spoils the file.
    """
    def read(lines: Column, at: Column) -> Column:
        above = F.slice(lines, 1, F.when(at > 0, F.greatest(at - 2, F.lit(0))).otherwise(F.size(lines)))
        body = F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))
        timing = _unmarked(F.get(lines, at - 1))
        return F.struct(
            (at > 0).alias("is_cue"),
            F.exists(above, lambda line: F.contains(line, F.lit("-->"))).alias("broken"),
            F.when(at > 0, clock_to_ms(timing, 1)).alias("start_ms"),
            F.when(at > 0, clock_to_ms(timing, 5)).alias("end_ms"),
            F.when(at > 0, F.array_join(body, "\n")).alias("text"),
        )

    def find(lines: Column) -> Column:
        marks = F.transform(lines, lambda line: is_timing(_unmarked(line)))
        return let(F.array_position(marks, F.lit(True)).cast("int"), lambda at: read(lines, at))

    return let(F.split(block, "\n"), find)


def parse_cues(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues and rejected files of a table ``source_id, track_id, duration_ms, content``.

    A file with a broken timing, or with an interval outside ``0 <= start < end <= duration``, is
    rejected whole. Cue ids count the cues of one file from 1.
    """
    def verdict(blocks: Column) -> Column:
        cues = F.filter(blocks, lambda c: c["is_cue"])
        unclear = F.exists(blocks, lambda c: c["broken"] | (c["is_cue"] & (c["start_ms"].isNull() | c["end_ms"].isNull())))
        return let(
            cues,
            lambda kept: F.struct(
                F.when(unclear, "broken_timing")
                .when(
                    F.exists(kept, lambda c: (c["end_ms"] <= c["start_ms"]) | (c["end_ms"] > F.col("duration_ms"))),
                    "interval_outside_source",
                ).alias("reason"),
                kept.alias("cues"),
            ),
        )

    parsed = let(F.transform(_blocks(_lines(F.col("content"))), _read_block), verdict)
    # Unpacking a one-element list keeps the optimiser from parsing again for every later use.
    read = files.select("source_id", "track_id", F.explode(F.array(parsed)).alias("_p")).select(
        "source_id", "track_id", F.col("_p.reason").alias("reason"), F.col("_p.cues").alias("_cues")
    )
    rejects = read.filter("reason is not null").select("source_id", "track_id", "reason")
    cues = read.filter("reason is null").select(
        "source_id", "track_id", F.posexplode("_cues").alias("_pos", "_cue")
    )
    return _named(cues.withColumn("_no", F.col("_pos") + 1)), rejects


def _named(cues: DataFrame) -> DataFrame:
    """Cue rows from ``_cue``, the ``_no``-th of its file."""
    cue_id = F.format_string("CUE_%06d", F.col("_no"))
    cues = cues.select(
        "source_id", "track_id", cue_id.alias("cue_id"),
        F.col("_cue.start_ms").alias("start_ms"), F.col("_cue.end_ms").alias("end_ms"),
        F.col("_cue.text").alias("text"),
        F.concat_ws(":", F.lit("SUB"), "track_id", cue_id).alias("evidence_ref"),
    )
    return cues.withColumn("normalized_text", normalise_text(F.col("text")))


def parse_cue_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of files of any size, from ``source_id, track_id, duration_ms, line_no, line``.

    Only the lines of one block, between empty lines, ever meet in one value.
    """
    keys = ["source_id", "track_id", "duration_ms"]
    hot = is_hot(lines, keys)
    empty = lines.withColumn("_empty", (F.col("line") == "").cast("int"))
    placed = running(empty, keys, ["line_no"], "_empty", "_block", hot=hot).where("_empty = 0")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    blocks = placed.groupBy(*keys, "_block").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("_text")
    )
    # Unpacking a one-element list keeps the optimiser from parsing again for every later use.
    read = materialise(blocks.select(*keys, "_block", F.explode(F.array(_read_block(F.col("_text")))).alias("_cue")))
    clock = F.col("_cue.start_ms").isNull() | F.col("_cue.end_ms").isNull()
    outside = (F.col("_cue.end_ms") <= F.col("_cue.start_ms")) | (F.col("_cue.end_ms") > F.col("duration_ms"))
    is_cue = F.col("_cue.is_cue")
    files = read.groupBy(*keys).agg(
        F.max(F.col("_cue.broken") | (is_cue & clock)).alias("_unclear"),
        F.max(is_cue & F.coalesce(outside, F.lit(False))).alias("_outside"),
    )
    reason = F.when(F.col("_unclear"), "broken_timing").when(F.col("_outside"), "interval_outside_source")
    judged = files.withColumn("reason", reason)
    good = attach(read.where(is_cue), judged.where("reason is null").select(*keys), keys, "left_semi")
    cues = number_rows(good, keys, ["_block"], "_no", hot)
    return _named(cues), judged.where("reason is not null").select("source_id", "track_id", "reason")


def read_cues(
    spark: SparkSession, path: str, files: DataFrame, whole_bytes: int = WHOLE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Read caption files below ``path``.

    ``files`` maps ``file_name``, the path below ``path``, to ``source_id, track_id, duration_ms``.
    Rejects also name stored files without a row and rows without a stored file. Files above
    ``whole_bytes`` are read by byte ranges, line by line.
    """
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named, unmatched = mapped_files(stored, path, files)
    keys = ["source_id", "track_id", "duration_ms"]
    text = named.filter(F.col("length") <= whole_bytes).withColumn("content", F.decode("content", "UTF-8"))
    cues, rejects = parse_cues(text.select(*keys, "content"))
    large = named.filter(F.col("length") > whole_bytes).select("file_name", *keys)
    if not large.isEmpty():
        lines = read_lines(spark, path, whole_bytes).withColumn("file_name", below(F.col("path"), path))
        more, spoiled = parse_cue_lines(lines.join(large, "file_name").select(*keys, "line_no", "line"))
        cues, rejects = cues.unionByName(more), rejects.unionByName(spoiled)
    return cues, rejects.unionByName(
        unmatched.select("source_id", "track_id", "file_name", "reason"), allowMissingColumns=True
    )
