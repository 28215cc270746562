"""Shot structure from frame signatures: differences, cuts, gradual runs, boundaries, shots.

Frames of a source carry consecutive ``frame_index`` values from 0, so a neighbour is arithmetic:
frames are laid into blocks of consecutive indexes, each block with a margin of copied frames, and
no task ever sees a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.timecode import half_even
from tidemark.operators.chains import greedy_chain
from tidemark.operators.sequence import is_hot, number_rows, running_sum, shift
from tidemark.session import BLOCK_ROWS_KEY, FOLD_ROWS_KEY, limit


def difference(left: Column, right: Column, scale: float = 255.0) -> Column:
    """Mean absolute difference of two signatures, as a share of ``scale``."""
    total = F.aggregate(
        F.zip_with(left, right, lambda a, b: F.abs(a - b).cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return total / (F.size(left) * F.lit(scale))


def _lagged(frames: DataFrame, values: dict[str, tuple[str, int]]) -> DataFrame:
    """Frame neighbours by offset, within blocks of consecutive frame indexes."""
    size = limit(frames.sparkSession, BLOCK_ROWS_KEY)
    offsets = [offset for _, offset in values.values()]
    behind, ahead = max([0, *[-o for o in offsets]]), max([0, *offsets])
    index = F.col("frame_index")
    home = F.floor(index / size).cast("long")
    # A frame is also seen by the block of any frame that looks back or ahead to it.
    seen_in = F.sequence(
        F.floor((index - ahead) / size).cast("long"), F.floor((index + behind) / size).cast("long")
    )
    spread = frames.withColumn("_home", home).withColumn("_block", F.explode(seen_in))
    window = W.partitionBy("source_id", "_block").orderBy("frame_index")
    for name, (column, offset) in values.items():
        value = F.lag(column, -offset) if offset < 0 else F.lead(column, offset)
        spread = spread.withColumn(name, value.over(window))
    return spread.filter("_home = _block").drop("_home", "_block")


def frame_difference(frames: DataFrame, scale: float = 255.0) -> DataFrame:
    """Score of each frame against the one before it; the first frame scores 0."""
    pairs = _lagged(frames.select("source_id", "frame_index", "signature"), {"_before": ("signature", -1)})
    score = F.coalesce(difference(F.col("_before"), F.col("signature"), scale), F.lit(0.0))
    return pairs.select("source_id", "frame_index", score.alias("score"))


def _flash_ends(frames: DataFrame, hard: float, gradual: float, window: int, scale: float) -> DataFrame:
    """Scored frames; candidates also carry the first later frame that looks like the one before.

    All frames in reach are compared inside their block, so no pair of frames is ever shuffled.
    """
    picks = {"_before": ("signature", -1)}
    picks |= {f"_later{k}": ("signature", k) for k in range(1, window + 1)}
    near = _lagged(frames.select("source_id", "frame_index", "signature"), picks)
    score = F.coalesce(difference(F.col("_before"), F.col("signature"), scale), F.lit(0.0))
    near = near.withColumn("score", score)
    candidate = (F.col("frame_index") > 0) & (F.col("score") >= hard)
    similar = F.coalesce(
        *[
            F.when(
                difference(F.col("_before"), F.col(f"_later{k}"), scale) < gradual,
                F.col("frame_index") + k,
            )
            for k in range(1, window + 1)
        ]
    )
    return near.select(
        "source_id", "frame_index", "score", candidate.alias("candidate"),
        F.when(candidate, similar).cast("long").alias("flash_end"),
    )


def flash_window(flash_ms: int, fps: float) -> int:
    return max(1, math.ceil(flash_ms * fps / 1000))


def classify_frames(
    frames: DataFrame, hard: float, gradual: float, flash_ms: int, fps: float, scale: float = 255.0
) -> DataFrame:
    """Each frame with its score, whether a flash hides it, and whether it is a hard cut.

    A hidden frame can neither cut nor hide others, which makes the decision depend on the frames
    before it: the flashes that hide others are a chain, each the first one behind the reach of the
    one before.
    """
    window = flash_window(flash_ms, fps)
    scored = _flash_ends(frames, hard, gradual, window, scale)
    # Frames are counted instead of candidates: an upper bound that needs no signature.
    hot = None if is_hot(frames, ["source_id"], FOLD_ROWS_KEY) else False
    flashes = scored.filter("candidate and flash_end is not null").select(
        "source_id", "frame_index", "flash_end", (F.col("flash_end") + 1).alias("until")
    )
    begun = greedy_chain(flashes, ["source_id"], "frame_index", "until", window + 1, hot)
    # A flash hides its first frame and at most ``window`` more; the ranges never overlap.
    hides = begun.join(flashes, ["source_id", "frame_index"]).select(
        "source_id", F.explode(F.sequence("frame_index", "flash_end")).alias("frame_index"),
        F.lit(True).alias("hidden"),
    )
    hidden = F.coalesce("hidden", F.lit(False))
    return scored.join(hides, ["source_id", "frame_index"], "left").select(
        "source_id", "frame_index", "score", hidden.alias("hidden"),
        (F.col("candidate") & F.col("flash_end").isNull() & ~hidden).alias("is_cut"),
    )


def hard_cuts(classified: DataFrame, fps: float) -> DataFrame:
    """Hard cuts as boundary candidates."""
    return classified.filter("is_cut").select(
        "source_id",
        half_even(F.col("frame_index") * 1000 / fps).alias("boundary_ms"),
        F.lit("hard_cut").alias("boundary_type"),
        F.least(F.lit(1.0), F.col("score")).alias("confidence"),
    )


def gradual_runs(
    classified: DataFrame, hard: float, gradual: float, fps: float, hot: bool | None = None
) -> DataFrame:
    """Maximal runs of unhidden frames between the thresholds, two long at least and weak at most.

    Runs are first built inside blocks of frame indexes; only the pieces (one row each) are then
    stitched over block borders.
    """
    size = limit(classified.sparkSession, BLOCK_ROWS_KEY)
    inside = classified.filter(
        (F.col("frame_index") > 0) & ~F.col("hidden")
        & (F.col("score") >= gradual) & (F.col("score") < hard)
    ).withColumn("_block", F.floor(F.col("frame_index") / size).cast("long"))
    order = W.partitionBy("source_id", "_block").orderBy("frame_index")
    pieces = (
        inside.withColumn("_island", F.col("frame_index") - F.row_number().over(order))
        .groupBy("source_id", "_block", "_island")
        .agg(
            F.min("frame_index").alias("first"),
            F.max("frame_index").alias("last"),
            F.max("score").alias("peak"),
        )
    )
    linked = shift(pieces, ["source_id"], ["first"], {"_previous": ("last", -1)}, hot)
    opens = F.when(F.col("_previous") == F.col("first") - 1, 0).otherwise(1)
    numbered = running_sum(
        linked.withColumn("_opens", opens), ["source_id"], ["first"], "_opens", "_run", hot
    )
    runs = numbered.groupBy("source_id", "_run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("peak").alias("peak")
    ).withColumn("frames", F.col("last") - F.col("first") + 1)
    middle = F.col("first") + F.floor(F.col("frames") / 2).cast("long")
    return runs.filter((F.col("frames") >= 2) & (F.col("peak") <= hard * 0.25)).select(
        "source_id",
        half_even(middle * 1000 / fps).alias("boundary_ms"),
        F.lit("gradual_transition").alias("boundary_type"),
        F.least(F.lit(1.0), F.col("peak") / hard).alias("confidence"),
    )


def accept_boundaries(
    candidates: DataFrame, sources: DataFrame, min_ms: int, max_ms: int, hot: bool | None = None
) -> DataFrame:
    """Boundaries at least ``min_ms`` apart, gaps over ``max_ms`` filled with uncertain marks.

    Filling a gap never changes a spacing decision, so spacing is a chain over the candidates' times
    and filling one ``sequence`` per gap. ``hot=False`` states that no source has more candidates than
    one task can scan; left open, that is measured.
    """
    inside = candidates.join(sources.select("source_id", "duration_ms"), "source_id").filter(
        (F.col("boundary_ms") > 0) & (F.col("boundary_ms") < F.col("duration_ms"))
    ).select("source_id", "boundary_ms", "boundary_type", "confidence")
    starts = sources.select(
        "source_id", F.lit(0).cast("long").alias("boundary_ms"),
        F.lit("source_start").alias("boundary_type"), F.lit(1.0).alias("confidence"),
    )
    if min_ms > 0:
        # At most one candidate of a time is accepted: the first by type and confidence.
        spots = starts.select("source_id", "boundary_ms").unionByName(
            inside.select("source_id", "boundary_ms").distinct()
        ).withColumn("until", F.col("boundary_ms") + min_ms)
        chosen = greedy_chain(spots, ["source_id"], "boundary_ms", "until", min_ms, hot)
        firsts = inside.groupBy("source_id", "boundary_ms").agg(
            F.min(F.struct("boundary_type", "confidence")).alias("_first")
        )
        accepted = firsts.join(chosen, ["source_id", "boundary_ms"], "left_semi").select(
            "source_id", "boundary_ms", "_first.*"
        )
    else:
        accepted = inside
    firm = starts.unionByName(accepted)
    ends = shift(firm, ["source_id"], ["boundary_ms"], {"_next": ("boundary_ms", 1)}, hot)
    ends = ends.join(sources.select("source_id", "duration_ms"), "source_id").withColumn(
        "_next", F.coalesce("_next", "duration_ms")
    )
    fill = ends.filter(F.col("_next") - F.col("boundary_ms") > max_ms).select(
        "source_id",
        F.explode(
            F.sequence(
                F.col("boundary_ms") + max_ms, F.col("_next") - 1, F.lit(max_ms).cast("long")
            )
        ).alias("boundary_ms"),
        F.lit("uncertain").alias("boundary_type"),
        F.lit(0.0).alias("confidence"),
    )
    return firm.unionByName(fill)


def build_shots(boundaries: DataFrame, sources: DataFrame, hot: bool | None = None) -> DataFrame:
    """Contiguous shots from boundaries; the last one ends with its source."""
    if hot is None:
        hot = is_hot(boundaries, ["source_id"])
    followed = shift(boundaries, ["source_id"], ["boundary_ms"], {"_next": ("boundary_ms", 1)}, hot)
    shots = number_rows(followed, ["source_id"], ["boundary_ms"], "shot_no", hot).join(
        sources.select("source_id", "duration_ms"), "source_id"
    )
    end = F.coalesce("_next", "duration_ms")
    return shots.select(
        "source_id",
        "shot_no",
        F.format_string("SHOT_%04d", F.col("shot_no")).alias("shot_id"),
        F.format_string("KEY_%04d", F.col("shot_no")).alias("keyframe_id"),
        F.col("boundary_ms").alias("start_ms"),
        end.alias("end_ms"),
        "boundary_type",
        F.col("confidence").alias("boundary_confidence"),
        F.format_string("VID:%s:ms:%d-%d", F.col("source_id"), F.col("boundary_ms"), end).alias(
            "evidence_ref"
        ),
    )


def shot_observations(shots: DataFrame) -> DataFrame:
    """One structural observation per shot."""
    return shots.select(
        "source_id",
        F.col("shot_id").alias("observation_id"),
        F.lit("shot").alias("adapter"),
        "start_ms",
        "end_ms",
        F.lit("structural_shot").alias("claim_type"),
        F.concat(F.lit("Shot opened by "), F.col("boundary_type")).alias("text"),
        F.col("boundary_confidence").alias("confidence"),
        F.lit("VID").alias("modality"),
        F.lit(None).cast("string").alias("speaker_id"),
        F.lit(None).cast("string").alias("speech_text"),
        F.lit(None).cast("string").alias("speech_source"),
        F.col("evidence_ref").alias("evidence_ref_override"),
    )
