"""Outcome accounting per adapter and runtime totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import ratio


def adapter_outcomes(
    plan: DataFrame, units: DataFrame, emitted: DataFrame, any_timeout_limits: bool = False
) -> DataFrame:
    """Status and unit counts per planned (source, adapter).

    Frame adapters report a resource limit only when every failure timed out, track adapters
    (``any_timeout_limits``) as soon as one did.

    ``units`` has one row per processed unit with ``unit_state`` in ok / failed / timed_out /
    unsupported; ``emitted`` one row per observation. Both are counted before the join.
    """
    keys = ["source_id", "adapter"]
    state = F.col("unit_state")
    counted = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(state == "ok").alias("successful"),
        F.count_if(state.isin("failed", "timed_out")).alias("failed"),
        F.count_if(state == "timed_out").alias("timed_out"),
        F.count_if(state == "unsupported").alias("unsupported"),
    )
    rows = emitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("emitted_observations"))
    counts = ["attempted", "successful", "failed", "timed_out", "unsupported", "emitted_observations"]
    joined = plan.select(*keys).distinct().join(counted, keys, "left").join(rows, keys, "left")
    joined = joined.na.fill(0, counts)
    limited = F.lit(1) if any_timeout_limits else F.col("failed")
    status = (
        F.when((F.col("successful") > 0) & (F.col("failed") + F.col("unsupported") > 0), "partial_success")
        .when((F.col("failed") > 0) & (F.col("timed_out") >= limited), "resource_limit_failure")
        .when(F.col("failed") > 0, "decode_failure")
        .when(F.col("emitted_observations") > 0, "success")
        .when(F.col("unsupported") > 0, "unsupported_input")
        .otherwise("success_zero")
    )
    return joined.select(
        *keys, status.alias("status"), F.col("emitted_observations").alias("observation_count"), *counts
    )


def runtime_rollup(runtimes: DataFrame) -> DataFrame:
    """Totals per source and overall, with throughput ratios that are null for no time."""
    sums = ["wall_ms", "cpu_ms", "retries", "timeouts", "frames", "failures", "media_ms"]
    totals = runtimes.rollup("source_id").agg(
        F.grouping("source_id").cast("int").alias("is_total"),
        *[F.sum(c).alias(c) for c in sums],
        F.max("peak_rss_kb").alias("peak_rss_kb"),
    )
    return totals.select(
        "source_id", "is_total", *sums, "peak_rss_kb",
        ratio(F.col("frames") * 1000, F.col("wall_ms")).alias("frames_per_second"),
        ratio(F.col("media_ms"), F.col("wall_ms")).alias("media_per_wall"),
    )
