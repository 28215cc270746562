"""The millisecond axis: chunks, samples, overlap, keyframes and tolerance joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timecode import half_even


def _whole(value: Column) -> Column:
    return value.cast("long")


def check_chunk_arguments(size_ms: int, overlap_ms: int) -> None:
    if size_ms <= 0 or overlap_ms < 0 or overlap_ms >= size_ms:
        raise ValueError("chunk size must be positive and larger than a non-negative overlap")


def chunk_count(duration: Column, size_ms: int, overlap_ms: int) -> Column:
    """Number of chunks that cover a duration."""
    step = size_ms - overlap_ms
    return F.when(duration <= size_ms, F.lit(1)).otherwise(
        F.ceil((duration - size_ms) / step) + 1
    ).cast("long")


def chunk_id(number: Column) -> Column:
    """Identifier of the chunk with a zero-based number."""
    return F.format_string("CHK_%04d", number + 1)


_RUN = 4_096  # numbers unrolled at a time


def _count_up(df: DataFrame, count: Column, name: str) -> DataFrame:
    """Each row repeated with ``name`` = 0 … count - 1, in runs, so that no array grows with time."""
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_count") - 1) / _RUN).cast("long"))
    inside = F.sequence(
        F.col("_run") * _RUN, F.least((F.col("_run") + 1) * _RUN, F.col("_count")) - 1
    )
    return (
        df.withColumn("_count", count.cast("long"))
        .filter("_count > 0")
        .withColumn("_run", F.explode(runs))
        .withColumn(name, F.explode(inside))
        .drop("_count", "_run")
    )


def chunk_timeline(sources: DataFrame, size_ms: int, overlap_ms: int) -> DataFrame:
    """Overlapping windows of ``size_ms`` over each source, the last one clipped to its end."""
    check_chunk_arguments(size_ms, overlap_ms)
    step = size_ms - overlap_ms
    chunks = _count_up(
        sources.select("source_id", "duration_ms").filter("duration_ms > 0"),
        chunk_count(F.col("duration_ms"), size_ms, overlap_ms), "chunk_no",
    )
    start = F.col("chunk_no") * step
    return chunks.select(
        "source_id",
        "chunk_no",
        chunk_id(F.col("chunk_no")).alias("chunk_id"),
        start.alias("start_ms"),
        F.least(start + size_ms, F.col("duration_ms")).alias("end_ms"),
    )


def uniform_samples(sources: DataFrame, interval_ms: int) -> DataFrame:
    """Timestamps 0, i, 2i … before the end of each source."""
    if interval_ms <= 0:
        raise ValueError("sample interval must be positive")
    samples = _count_up(
        sources.select("source_id", "duration_ms"), F.ceil(F.col("duration_ms") / interval_ms), "_no"
    )
    return samples.select("source_id", (F.col("_no") * interval_ms).alias("timestamp_ms"))


def overlapping_chunks(start: Column, end: Column, duration: Column, size_ms: int, overlap_ms: int) -> Column:
    """Zero-based numbers of the chunks that share time with ``[start, end)``; may be empty.

    Regular chunks need no interval join: the first and the last number follow from arithmetic.
    """
    step = size_ms - overlap_ms
    first = F.greatest(F.floor((start - size_ms) / step) + 1, F.lit(0)).cast("long")
    last = F.least(
        F.ceil(end / step) - 1, chunk_count(duration, size_ms, overlap_ms) - 1
    ).cast("long")
    none = F.array().cast("array<bigint>")
    usable = (first <= last) & (start < duration) & (end > 0)
    return F.when(usable, F.sequence(first, F.greatest(first, last))).otherwise(none)


def chunk_overlap(events: DataFrame, sources: DataFrame, size_ms: int, overlap_ms: int) -> DataFrame:
    """Add ``chunk_ids`` and the primary ``chunk_id`` (null where an event meets no chunk)."""
    check_chunk_arguments(size_ms, overlap_ms)
    joined = events.join(sources.select("source_id", "duration_ms"), "source_id")
    numbers = overlapping_chunks(
        F.col("start_ms"), F.col("end_ms"), F.col("duration_ms"), size_ms, overlap_ms
    )
    joined = joined.withColumn("chunk_ids", F.transform(numbers, chunk_id))
    return joined.withColumn("chunk_id", F.get("chunk_ids", F.lit(0)))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width_ms: int) -> DataFrame:
    """Pairs of irregular intervals that share time.

    Both sides must have ``start_ms``/``end_ms``; the right one's come back as ``other_start_ms`` and
    ``other_end_ms``. Intervals are laid into bins of ``width_ms`` and joined on (keys, bin); a pair
    is kept only in the first bin that both touch, so nothing has to be made distinct afterwards.
    """
    def bins(df: DataFrame) -> DataFrame:
        first = _whole(F.floor(F.col("start_ms") / width_ms))
        last = _whole(F.floor((F.col("end_ms") - 1) / width_ms))
        return df.filter("start_ms < end_ms").withColumn("_bin", F.explode(F.sequence(first, last)))

    others = bins(right).withColumnsRenamed(
        {"start_ms": "other_start_ms", "end_ms": "other_end_ms"}
    )
    pairs = bins(left).join(others, [*keys, "_bin"])
    shared = (F.col("start_ms") < F.col("other_end_ms")) & (F.col("end_ms") > F.col("other_start_ms"))
    home = _whole(F.floor(F.greatest("start_ms", "other_start_ms") / width_ms))
    return pairs.filter(shared & (F.col("_bin") == home)).drop("_bin")


def frame_number(timestamp: Column, fps: float) -> Column:
    """Index of the sampled frame at a time."""
    return half_even(timestamp * fps / 1000)


def select_keyframes(shots: DataFrame, frames: DataFrame, fps: float) -> DataFrame:
    """Middle frame of each shot with the frame row at the computed index, if there is one."""
    middle = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2).cast("long")
    keyframes = shots.select(
        "source_id",
        "shot_id",
        "shot_no",
        F.format_string("KEY_%04d", F.col("shot_no")).alias("keyframe_id"),
        middle.alias("timestamp_ms"),
        "start_ms",
        "end_ms",
    ).withColumn("frame_index", frame_number(F.col("timestamp_ms"), fps))
    reference = F.format_string("VID:%s:frame:%d", F.col("source_id"), F.col("timestamp_ms"))
    return keyframes.withColumn("evidence_ref", reference).join(
        frames, ["source_id", "frame_index"], "left"
    )


def nearest_in_time(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    tolerance: str, width_ms: int,
) -> DataFrame:
    """All (left, right) pairs whose times differ by at most the left row's ``tolerance`` column.

    Bins are as wide as the tolerance: each row of the left side looks into the at most two bins of its
    power-of-two class, and the right side is laid into one bin of each class that occurs. A pair meets
    exactly once, a long source spreads over its bins, and a single wide tolerance widens no other's.
    ``width_ms`` is the least width of a bin.
    """
    t, reach = F.col(left_time), F.greatest(F.col(tolerance), F.lit(0))
    wanted = F.greatest(F.ceil(F.log2((2 * reach + 1) / F.lit(width_ms))), F.lit(0)).cast("int")
    seekers = left.filter(F.col(tolerance) >= 0).withColumn("_class", wanted)
    classes = sorted(row["_class"] for row in seekers.select("_class").distinct().collect())  # 64 at most

    def bin_of(time: Column) -> Column:
        return _whole(F.floor(time / (F.lit(width_ms) * F.pow(F.lit(2.0), F.col("_class")))))

    spans = F.array_distinct(F.array(bin_of(t - reach), bin_of(t + reach)))
    seekers = seekers.withColumn("_bin", F.explode(spans))
    targets = right.withColumn("_class", F.explode(F.array(*[F.lit(c) for c in classes]).cast("array<int>")))
    targets = targets.withColumn("_bin", bin_of(F.col(right_time)))
    pairs = seekers.join(targets, [*keys, "_class", "_bin"])
    error = F.abs(F.col(left_time) - F.col(right_time))
    return pairs.filter(error <= F.col(tolerance)).withColumn("error_ms", error).drop("_bin", "_class")
