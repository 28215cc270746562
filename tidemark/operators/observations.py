"""The common observation row: mapping typed tables to it, evidence, speech and entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import number_rows

COLUMNS = (
    "source_id", "observation_id", "adapter", "start_ms", "end_ms", "claim_type", "text",
    "confidence", "modality", "speaker_id", "speech_text", "speech_source", "evidence_ref_override",
)
UNKNOWN_SPEAKER = "SPEAKER_UNKNOWN"
DEFAULT_SPEECH_SOURCE = "sidecar_asr"


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def cue_observations(cues: DataFrame) -> DataFrame:
    """Subtitle claims; cues without text say nothing."""
    return cues.filter("text <> ''").select(
        "source_id",
        F.concat_ws("_", "track_id", "cue_id").alias("observation_id"),
        _text("subtitle").alias("adapter"),
        "start_ms",
        "end_ms",
        _text("subtitle_text").alias("claim_type"),
        F.concat(F.lit("Subtitle text: "), F.col("text")).alias("text"),
        F.lit(1.0).alias("confidence"),
        _text("SUB").alias("modality"),
        _text(UNKNOWN_SPEAKER).alias("speaker_id"),
        F.col("text").alias("speech_text"),
        _text("subtitle").alias("speech_source"),
        F.col("evidence_ref").alias("evidence_ref_override"),
    )


def ocr_observations(regions: DataFrame, sources: DataFrame) -> DataFrame:
    """On-screen text claims: one millisecond long, clipped to the source, confidence on 0–1."""
    joined = regions.join(sources.select("source_id", "duration_ms"), "source_id")
    return joined.select(
        "source_id",
        "observation_id",
        _text("ocr_frame").alias("adapter"),
        F.col("timestamp_ms").alias("start_ms"),
        F.least(F.col("timestamp_ms") + 1, F.col("duration_ms")).alias("end_ms"),
        _text("on_screen_text").alias("claim_type"),
        F.concat(F.lit("On-screen text: "), F.col("text")).alias("text"),
        (F.col("ocr_confidence") / 100).alias("confidence"),
        _text("OCR").alias("modality"),
        _text(None).alias("speaker_id"),
        _text(None).alias("speech_text"),
        _text(None).alias("speech_source"),
        F.col("evidence_ref").alias("evidence_ref_override"),
    )


def to_observations(parts: Sequence[DataFrame], sources: DataFrame, adapters: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Union of observation tables, limited to the configured adapters.

    Returns the accepted rows and those that end after their source.
    """
    merged = parts[0].select(*COLUMNS)
    for part in parts[1:]:
        merged = merged.unionByName(part.select(*COLUMNS))
    merged = merged.filter(F.col("adapter").isin(list(adapters)))
    timed = merged.join(sources.select("source_id", "duration_ms"), "source_id", "left")
    fits = F.coalesce(F.col("end_ms") <= F.col("duration_ms"), F.lit(False))
    rejects = timed.filter(~fits).select(
        "source_id", "observation_id", F.lit("exceeds_source_duration").alias("reason")
    )
    return timed.filter(fits).select(*COLUMNS), rejects


def adapter_rank(adapters: Sequence[str]) -> Column:
    """Position in the configured adapter order; it settles ties between equal ids."""
    return F.array_position(F.lit(list(adapters)), F.col("adapter")).cast("long")


def evidence_ref() -> Column:
    """Reference text of an observation."""
    by_time = F.format_string(
        "%s:%s:ms:%d-%d", F.col("modality"), F.col("source_id"), F.col("start_ms"), F.col("end_ms")
    )
    by_id = F.concat_ws(":", "modality", "observation_id")
    return F.coalesce(
        F.col("evidence_ref_override"),
        F.when(F.col("modality").isin("VID", "AUD"), by_time).otherwise(by_id),
    )


def build_evidence(observations: DataFrame, adapters: Sequence[str], extra: DataFrame | None = None) -> DataFrame:
    """One row per (source, reference); the last observation in ledger order wins.

    Rows of ``extra`` (frames, cues) replace equal references. Copies of a reference are combined
    before the shuffle, so a reference shared by many observations stays cheap.
    """
    place = F.struct("start_ms", "end_ms", "observation_id", adapter_rank(adapters).alias("rank"))
    kept = F.struct("observation_id", "modality", "start_ms", "end_ms")
    rows = observations.select(
        "source_id", evidence_ref().alias("evidence_ref"), F.lit(0).alias("layer"),
        place.alias("place"), kept.alias("kept"),
    )
    if extra is not None:
        nowhere = F.struct("start_ms", "end_ms", "observation_id", F.lit(0).cast("long").alias("rank"))
        rows = rows.unionByName(
            extra.select(
                "source_id", "evidence_ref", F.lit(1).alias("layer"), nowhere.alias("place"), kept.alias("kept")
            )
        )
    return (
        rows.groupBy("source_id", "evidence_ref")
        .agg(F.max_by("kept", F.struct("layer", "place")).alias("kept"))
        .select("source_id", "evidence_ref", "kept.*")
    )


def keyframe_evidence(keyframes: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence rows of frames: one millisecond, clipped to the source."""
    return keyframes.join(sources.select("source_id", "duration_ms"), "source_id").select(
        "source_id", "evidence_ref", F.col("keyframe_id").alias("observation_id"),
        F.lit("VID").alias("modality"), F.col("timestamp_ms").alias("start_ms"),
        F.least(F.col("timestamp_ms") + 1, F.col("duration_ms")).alias("end_ms"),
    )


def cue_evidence(cues: DataFrame) -> DataFrame:
    """Evidence rows of cues, with or without text."""
    return cues.select(
        "source_id", "evidence_ref", F.concat_ws("_", "track_id", "cue_id").alias("observation_id"),
        F.lit("SUB").alias("modality"), "start_ms", "end_ms",
    )


def filled(column: str, default: str) -> Column:
    """The column, or the default where it is null or empty."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def speech_rows(claims: DataFrame) -> DataFrame:
    """Quoted speech of claims that carry speech text, with the default speaker and source.

    ``claims`` is the flat claim table of a ledger (see ``ledger.number_claims``).
    """
    return claims.filter("speech_text is not null").select(
        "source_id", "event_no", "claim_no", "start_ms", "end_ms",
        filled("speaker_id", UNKNOWN_SPEAKER).alias("speaker_id"),
        F.col("speech_text").alias("text"),
        filled("speech_source", DEFAULT_SPEECH_SOURCE).alias("source"),
        "evidence_ref", "confidence",
    )


def entity_evidence(claims: DataFrame) -> DataFrame:
    """One row per (speaker, reference) in ledger order: the registry in its scalable form."""
    spoken = claims.filter("speaker_id is not null").select(
        "source_id", F.col("speaker_id").alias("entity_id"), "claim_no", "evidence_ref"
    )
    return number_rows(spoken, ["source_id", "entity_id"], ["claim_no"], "position")


def entity_registry(claims: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Speakers with their ordered references, in consecutive parts of bounded size."""
    placed = entity_evidence(claims)
    part = F.floor((F.col("position") - 1) / part_rows).cast("long").alias("part")
    packed = placed.groupBy("source_id", "entity_id", part).agg(
        F.array_sort(F.collect_list(F.struct("position", "evidence_ref"))).alias("_refs")
    )
    return packed.select(
        "source_id", "entity_id", "part", F.col("_refs.evidence_ref").alias("evidence_refs")
    )
