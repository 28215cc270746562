"""Caption and timeline exports as ordered line blocks.

A document is never gathered into one value: its blocks are numbered rows, and the writer range-
partitions them by (source, block number), so that a long source becomes several ordered files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timecode import timecode
from tidemark.operators.ledger import event_id
from tidemark.operators.sequence import number_rows


def _header(sources: DataFrame, lines: str) -> DataFrame:
    return sources.select("source_id", F.lit(0).cast("long").alias("block_no"), F.lit(lines).alias("block"))


def export_captions(speech: DataFrame, fmt: str) -> DataFrame:
    """Caption blocks of the quoted speech in ledger order; block 0 is the WebVTT header.

    Joining a source's blocks with line breaks gives its document.
    """
    if fmt not in ("vtt", "srt"):
        raise ValueError("caption format must be 'vtt' or 'srt'")
    sign = "," if fmt == "srt" else "."
    rows = number_rows(speech, ["source_id"], ["claim_no"], "block_no")
    line = F.concat(timecode(F.col("start_ms"), sign), F.lit(" --> "), timecode(F.col("end_ms"), sign))
    body = [line, F.concat_ws(": ", "speaker_id", "text"), F.lit("")]
    if fmt == "srt":
        body.insert(0, F.col("block_no").cast("string"))
    blocks = rows.select("source_id", "block_no", F.concat_ws("\n", *body).alias("block"))
    if fmt == "srt":
        return blocks
    return _header(speech.select("source_id").distinct(), "WEBVTT\n").unionByName(blocks)


def export_cues_vtt(cues: DataFrame) -> DataFrame:
    """Normalised caption track: every cue with a note that names its evidence."""
    rows = number_rows(cues, ["source_id"], ["track_id", "cue_id"], "block_no")
    note = F.concat_ws(" ", F.lit("NOTE"), "track_id", "cue_id", "evidence_ref")
    line = F.concat(timecode(F.col("start_ms")), F.lit(" --> "), timecode(F.col("end_ms")))
    blocks = rows.select("source_id", "block_no", F.concat_ws("\n", note, line, "text", F.lit("")).alias("block"))
    return _header(cues.select("source_id").distinct(), "WEBVTT\n").unionByName(blocks)


def export_timeline(claims: DataFrame) -> DataFrame:
    """One bullet line per claim with its reference, in ledger order."""
    span = F.concat_ws("-", timecode(F.col("start_ms")), timecode(F.col("end_ms")))
    line = F.concat(
        F.lit("- **"), span, F.lit("** "), F.col("text"), F.lit(" _["), F.col("evidence_ref"), F.lit("]_")
    )
    return claims.select("source_id", F.col("claim_no").alias("line_no"), line.alias("line"))


def scene_summary(claims: DataFrame, events: DataFrame) -> DataFrame:
    """One bullet line per claim under its scene, with event and reference."""
    placed = claims.join(events.select("source_id", "event_no", "scene_id"), ["source_id", "event_no"])
    line = F.concat(
        F.lit("- "), F.col("text"), F.lit(" _["), event_id(F.col("event_no")), F.lit("; "),
        F.col("evidence_ref"), F.lit("]_"),
    )
    return placed.select("source_id", "scene_id", F.col("claim_no").alias("line_no"), line.alias("line"))


def write_documents(blocks: DataFrame, path: str, order: str = "block_no", value: str = "block") -> None:
    """Write blocks as text below ``source_id=`` folders, in order over the files of a source."""
    (
        blocks.repartitionByRange("source_id", order)
        .sortWithinPartitions("source_id", order)
        .select("source_id", F.col(value).alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_id")
        .text(path)
    )
