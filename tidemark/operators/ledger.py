"""The event ledger: claims grouped by equal intervals, numbered, versioned and nested."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.observations import (
    DEFAULT_SPEECH_SOURCE,
    UNKNOWN_SPEAKER,
    adapter_rank,
    evidence_ref,
    filled,
)
from tidemark.operators.sequence import is_hot, number_rows
from tidemark.operators.timeline import chunk_id, overlapping_chunks

SCHEMA_VERSION = "1.1.0"
PART_ROWS = 10_000  # claims per nested ledger row
_INTERVAL = ["source_id", "start_ms", "end_ms"]


def number_claims(observations: DataFrame, adapters: Sequence[str], hot: bool | None = None) -> DataFrame:
    """Flat claim table: every observation with its event number and running claim number.

    Events are the distinct intervals of a source in (start, end) order; claims run on over
    (start, end, observation id, adapter order). ``hot`` states whether some source is too large for one task.
    """
    rows = observations.withColumn("evidence_ref", evidence_ref()).withColumn(
        "_rank", adapter_rank(adapters)
    )
    order = ["start_ms", "end_ms", "observation_id", "_rank"]
    if hot is None:
        hot = is_hot(rows, ["source_id"])
    if not hot:
        # Both numbers come from one sort of each source.
        window = W.partitionBy("source_id")
        return rows.withColumns(
            {
                "event_no": F.dense_rank().over(window.orderBy("start_ms", "end_ms")).cast("long"),
                "claim_no": F.row_number().over(window.orderBy(*order)).cast("long"),
            }
        ).drop("_rank")
    claims = number_rows(rows, ["source_id"], order, "claim_no", hot=True)
    events = number_rows(
        claims.select(*_INTERVAL).distinct(), ["source_id"], ["start_ms", "end_ms"], "event_no"
    )
    return claims.join(events, _INTERVAL).drop("_rank")


def event_id(number: Column) -> Column:
    return F.format_string("EVT_%06d", number)


def claim_id(number: Column) -> Column:
    return F.format_string("CLM_%06d", number)


def scene_of(start: Column, duration: Column) -> Column:
    """The documented scene rule: before or after the middle of the source."""
    return F.when(start * 2 < duration, F.lit("SCN_0001")).otherwise(F.lit("SCN_0002"))


def build_events(claims: DataFrame, sources: DataFrame, size_ms: int, overlap_ms: int) -> DataFrame:
    """One row per event: interval, scene, chunks and counts. Aggregates only, no lists of claims."""
    events = claims.groupBy("source_id", "event_no", "start_ms", "end_ms").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count("speech_text").alias("speech_rows"),
        F.min("claim_no").alias("first_claim_no"),
    )
    timed = events.join(sources.select("source_id", "duration_ms"), "source_id")
    chunks = overlapping_chunks(
        F.col("start_ms"), F.col("end_ms"), F.col("duration_ms"), size_ms, overlap_ms
    )
    return timed.select(
        "source_id", "event_no", event_id(F.col("event_no")).alias("event_id"), "start_ms", "end_ms",
        scene_of(F.col("start_ms"), F.col("duration_ms")).alias("scene_id"),
        F.transform(chunks, chunk_id).alias("chunk_ids"), "claims", "speech_rows", "first_claim_no",
    ).withColumn("chunk_id", F.get("chunk_ids", F.lit(0)))


def nest_ledger(
    claims: DataFrame, events: DataFrame, status: str, run_id: str, part_rows: int = PART_ROWS
) -> DataFrame:
    """Nested ledger records of one pass (``provisional`` or ``final``).

    A record holds at most ``part_rows`` claims; an interval shared by more of them continues in
    further ``part`` rows of the same event, so no event has to fit one task.
    """
    revision = {"provisional": 1, "final": 2}[status]
    keys = ["source_id", "event_no", "part"]
    placed = claims.join(events.select("source_id", "event_no", "first_claim_no"), ["source_id", "event_no"])
    placed = placed.withColumn(
        "part", F.floor((F.col("claim_no") - F.col("first_claim_no")) / part_rows).cast("long")
    )
    spoken = F.col("speech_text").isNotNull()
    claim = F.struct(
        claim_id(F.col("claim_no")).alias("claim_id"), F.col("claim_type").alias("type"), "text",
        "confidence", F.array("evidence_ref").alias("evidence_refs"),
    )
    speech = F.struct(
        filled("speaker_id", UNKNOWN_SPEAKER).alias("speaker_id"), F.col("speech_text").alias("text"),
        filled("speech_source", DEFAULT_SPEECH_SOURCE).alias("source"), "evidence_ref", "confidence",
    )
    packed = placed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("claim_no", claim.alias("claim")))).alias("_claims"),
        F.array_sort(
            F.collect_list(F.when(spoken, F.struct("claim_no", speech.alias("speech"))))
        ).alias("_speech"),
        F.array_sort(F.collect_set("speaker_id")).alias("entities"),
    )
    return packed.join(events, ["source_id", "event_no"]).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "source_id", "event_no", "event_id", "part",
        F.lit(revision).alias("revision"), "start_ms", "end_ms", F.lit("atomic").alias("level"),
        "scene_id", F.col("_claims.claim").alias("claims"), F.col("_speech.speech").alias("speech"),
        "entities", F.array().cast("array<string>").alias("uncertainty"),
        F.lit(status).alias("status"),
        F.struct(
            F.col("source_id"), F.col("chunk_id"), F.col("chunk_ids"), F.lit(run_id).alias("run_id")
        ).alias("provenance"),
    )


def make_revisions(events: DataFrame) -> DataFrame:
    """Provisional (1) and final (2) rows of every event, in one narrow pass."""
    passes = F.array(
        F.struct(F.lit(1).alias("revision"), F.lit("provisional").alias("status")),
        F.struct(F.lit(2).alias("revision"), F.lit("final").alias("status")),
    )
    return events.select("*", F.inline(passes))


def latest_revision(revisions: DataFrame) -> DataFrame:
    """Highest revision of each event, combined before the shuffle."""
    keys = ["source_id", "event_id"]
    rest = [c for c in revisions.columns if c not in keys]
    newest = revisions.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col("revision")).alias("_row")
    )
    return newest.select(*keys, "_row.*").select(*revisions.columns)


def summarise(events: DataFrame) -> DataFrame:
    """Event and claim counts per scene, per source and in total."""
    return (
        events.rollup("source_id", "scene_id")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("events"),
            F.sum("claims").alias("claims"),
        )
        .select("level", "source_id", "scene_id", "events", "claims")
    )
