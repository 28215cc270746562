"""Annotation work: agreement of two annotators, sample plans, worklists, gold freezing and
comparison of outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import ratio
from tidemark.functions.text import edit_distance
from tidemark.operators.matching import match_regions

FRAME_FIELDS = (
    "source_id", "timestamp_ms", "exact_transcription", "normalized_transcription", "language",
    "legibility", "uncertain", "occluded", "truncated", "notes", "regions", "ignore_regions",
)
# What an annotator has to give before frames are compared.
NEEDED = ("exact_transcription", "normalized_transcription", "attested", "annotated_at")


def agreement_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames that forbid a comparison: known to one side only, or not completely annotated.

    A complete annotation has both texts, an attestation and the time at which it was made.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        given = F.coalesce(F.col("attested"), F.lit(False))
        for column in NEEDED:
            given = given & F.col(column).isNotNull()
        return df.select(
            "frame_id", F.lit(True).alias(f"_{name}"), given.alias(f"_done_{name}"), F.col("annotator").alias(f"_w{name}")
        )

    sides = side(a, "a").join(side(b, "b"), "frame_id", "full")
    reason = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "frame_sets_differ")
        .when(F.col("_wa") == F.col("_wb"), "annotators_not_distinct")
        .when(~F.col("_done_a") | ~F.col("_done_b"), "annotation_incomplete")
    )
    return sides.select("frame_id", reason.alias("reason")).filter("reason is not null")


def disagreements(a: DataFrame, b: DataFrame, fields: Sequence[str] = FRAME_FIELDS) -> DataFrame:
    """Differing fields of each frame that the two annotators see differently, with edits."""
    left = a.select("frame_id", *[F.col(f).alias(f"_a_{f}") for f in fields])
    right = b.select("frame_id", *[F.col(f).alias(f"_b_{f}") for f in fields])
    joined = left.join(right, "frame_id")
    marks = F.array(
        *[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]
    )
    text_a, text_b = F.col("_a_normalized_transcription"), F.col("_b_normalized_transcription")
    return joined.select(
        "frame_id", F.filter(marks, lambda f: f.isNotNull()).alias("differing_fields"),
        edit_distance(text_a, text_b).alias("char_edits"), F.length(text_a).cast("long").alias("chars"),
    )


def annotator_agreement(compared: DataFrame) -> DataFrame:
    """Agreement over the frames actually compared (``disagreements`` rows)."""
    totals = compared.agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.size("differing_fields") > 0).alias("disagreement_frames"),
        F.coalesce(F.sum("char_edits"), F.lit(0)).alias("char_edits"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
    )
    agreed = F.col("frames") - F.col("disagreement_frames")
    return totals.select(
        "frames", "disagreement_frames", agreed.alias("agreement_frames"),
        ratio(agreed, F.col("frames")).alias("exact_frame_agreement"),
        ratio(F.col("char_edits"), F.col("chars")).alias("character_disagreement_rate"),
    )


def region_agreement(a: DataFrame, b: DataFrame, frame: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Matched regions of two annotators as precision (of a) and recall (of b)."""
    matched = match_regions(b, a, frame, threshold).agg(F.count(F.lit(1)).alias("matches"))
    sizes = a.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    ).agg(F.sum("a").cast("long").alias("regions_a"), F.sum("b").cast("long").alias("regions_b"))
    both = matched.withColumn("_one", F.lit(1)).join(sizes.withColumn("_one", F.lit(1)), "_one")
    return both.select(
        "matches", "regions_a", "regions_b",
        ratio(F.col("matches"), F.col("regions_a")).alias("precision_a_to_b"),
        ratio(F.col("matches"), F.col("regions_b")).alias("recall_a_to_b"),
    )


def sample_plan_check(
    plan: DataFrame, sources: DataFrame, split_counts: dict[str, int], min_sources: int
) -> DataFrame:
    """Rule rows of a sample plan: split sizes, distinct sources, repeated or outside times."""
    splits = list(split_counts)
    wanted = F.create_map(*[F.lit(x) for pair in split_counts.items() for x in pair])
    spark = plan.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"))
    sizes = names.join(plan.groupBy("split").count(), "split", "left").na.fill(0, ["count"])
    wrong_size = sizes.filter(F.col("count") != wanted[F.col("split")]).select(
        F.lit("split_size").alias("rule"), F.concat_ws("=", "split", "count").alias("subject")
    )
    unknown = plan.filter(~F.coalesce(F.col("split").isin(splits), F.lit(False))).select(
        F.lit("unknown_split").alias("rule"), F.concat_ws("@", "source_id", "timestamp_ms").alias("subject")
    )
    repeated = plan.groupBy("source_id", "timestamp_ms").count().filter("count > 1").select(
        F.lit("repeated_time").alias("rule"), F.concat_ws("@", "source_id", "timestamp_ms").alias("subject")
    )
    timed = plan.join(sources.select("source_id", "duration_ms"), "source_id", "left")
    inside = (F.col("timestamp_ms") >= 0) & (F.col("timestamp_ms") < F.col("duration_ms"))
    outside = timed.filter(~F.coalesce(inside, F.lit(False))).select(
        F.lit("outside_source").alias("rule"), F.concat_ws("@", "source_id", "timestamp_ms").alias("subject")
    )
    few = plan.agg(F.count_distinct("source_id").alias("n")).filter(F.col("n") < min_sources).select(
        F.lit("too_few_sources").alias("rule"), F.col("n").cast("string").alias("subject")
    )
    return wrong_size.unionByName(unknown).unionByName(repeated).unionByName(outside).unionByName(few)


def annotation_worklist(frames: DataFrame, annotators: Sequence[str], done: DataFrame) -> DataFrame:
    """Frames × annotators without a complete annotation. Annotators are a literal list, so every
    frame is repeated in place and nothing is cross joined."""
    asked = frames.select("frame_id", F.explode(F.array(*[F.lit(a) for a in annotators])).alias("annotator"))
    complete = done.filter(
        "exact_transcription is not null and normalized_transcription is not null"
    ).select("frame_id", "annotator")
    return asked.join(complete, ["frame_id", "annotator"], "left_anti")


def freeze_gate(gold: DataFrame, plan: DataFrame) -> DataFrame:
    """Reasons why an adjudicated gold table may not be frozen."""
    sides = gold.select("frame_id", F.lit(True).alias("_gold"), "exact_transcription").join(
        plan.select("frame_id", F.lit(True).alias("_plan")), "frame_id", "full"
    )
    reason = (
        F.when(F.col("_plan").isNull(), "not_in_plan")
        .when(F.col("_gold").isNull(), "missing_from_gold")
        .when(F.col("exact_transcription").isNull(), "incomplete")
    )
    return sides.select("frame_id", reason.alias("reason")).filter("reason is not null")


def fingerprint(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint: row count, sum and xor of row hashes, combined map-side."""
    columns = sorted(c for c in df.columns if c not in ignore)
    row = F.xxhash64(*columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("hash_xor"),
    )


def output_differences(a: DataFrame, b: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Rows with different multiplicity in two outputs; empty for equivalent ones."""
    columns = sorted(c for c in a.columns if c not in ignore)
    sides = a.select(*columns, F.lit(1).alias("_net")).unionByName(b.select(*columns, F.lit(-1).alias("_net")))
    return sides.groupBy(*columns).agg(F.sum("_net").alias("surplus")).filter("surplus <> 0")


def outputs_equivalent(a: DataFrame, b: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """One row: the verdict and the number of differing rows."""
    return output_differences(a, b, ignore).agg(F.count(F.lit(1)).alias("differing_rows")).select(
        (F.col("differing_rows") == 0).alias("equivalent"), "differing_rows"
    )
