"""Score expressions with the empty-denominator rule of each report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Share, null for an empty denominator."""
    return F.when(denominator != 0, numerator.cast("double") / F.nullif(denominator, F.lit(0)))


def rate(numerator: Column, denominator: Column) -> Column:
    """Share, zero for an empty denominator."""
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def prf_precision(correct: Column, predicted: Column, gold: Column) -> Column:
    """Precision; with nothing predicted it is one only if nothing was expected."""
    return F.coalesce(ratio(correct, predicted), F.when(gold == 0, 1.0).otherwise(0.0))


def prf_recall(correct: Column, predicted: Column, gold: Column) -> Column:
    """Recall; with nothing expected it is one only if nothing was predicted."""
    return F.coalesce(ratio(correct, gold), F.when(predicted == 0, 1.0).otherwise(0.0))


def f1(precision: Column, recall: Column, empty: float | None = 0.0) -> Column:
    """Harmonic mean; ``empty`` where both are zero, null where either is null and empty is None."""
    total = precision + recall
    value = F.when(total != 0, 2 * precision * recall / F.nullif(total, F.lit(0.0)))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def prf(correct: Column, predicted: Column, gold: Column) -> list[Column]:
    """The six columns correct, predicted, gold, precision, recall, f1."""
    p, r = prf_precision(correct, predicted, gold), prf_recall(correct, predicted, gold)
    return [
        correct.alias("correct"),
        predicted.alias("predicted"),
        gold.alias("gold"),
        p.alias("precision"),
        r.alias("recall"),
        f1(p, r).alias("f1"),
    ]


def presence(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and f1 that stay null where they cannot be measured."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), f1(p, r, None).alias("f1")]
