"""Region scores: detection, mean overlap, exact text and reading order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import presence, ratio
from tidemark.operators.sequence import shift


def region_scores(matches: DataFrame, pred: DataFrame, gold: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Region precision, recall, F1, mean IoU and the share of gold regions with equal text."""
    keys = list(frame)
    texts = matches.join(pred.select(*keys, "p", F.col("text").alias("_pt")), [*keys, "p"]).join(
        gold.select(*keys, "g", F.col("text").alias("_gt")), [*keys, "g"]
    )
    found = texts.agg(
        F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("mean_iou"),
        F.count_if(F.col("_pt").eqNullSafe(F.col("_gt"))).alias("exact"),
    )
    sizes = pred.select(F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(
        gold.select(F.lit(0).alias("p"), F.lit(1).alias("g"))
    ).agg(
        F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias("predicted"),
        F.coalesce(F.sum("g"), F.lit(0)).cast("long").alias("gold"),
    )
    both = found.withColumn("_one", F.lit(1)).join(sizes.withColumn("_one", F.lit(1)), "_one")
    fp, fn = F.col("predicted") - F.col("tp"), F.col("gold") - F.col("tp")
    return both.select(
        "tp", fp.alias("fp"), fn.alias("fn"), *presence(F.col("tp"), fp, fn), "mean_iou",
        ratio(F.col("exact"), F.col("gold")).alias("exact_text_share"),
    )


def reading_order(matches: DataFrame, frame: Sequence[str], hot: bool | None = None) -> DataFrame:
    """Over frames with several matches: gold positions already ascend in match order.

    Match order is descending (IoU, gold position, prediction position). ``hot=False`` states that no
    frame has more regions than one task can sort.
    """
    keys = list(frame)
    ranked = matches.select(
        *keys, "g", (-F.col("iou")).alias("_a"), (-F.col("g")).alias("_b"), (-F.col("p")).alias("_c")
    )
    ordered = shift(ranked, keys, ["_a", "_b", "_c"], {"_before": ("g", -1)}, hot)
    frames = ordered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("g") < F.col("_before"), 1).otherwise(0)).alias("falls"),
    ).filter("n > 1")
    totals = frames.agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("falls") == 0).alias("in_order"))
    return totals.withColumn("accuracy", ratio(F.col("in_order"), F.col("frames")))
