"""Ordering inside groups that stays distributed when one group holds most of the rows.

A window over ``source_id`` puts a whole source into one task. Each helper here first measures the
largest group (one map-side-combined count, one number to the driver). Groups that fit one task use
the plain window; otherwise rows are range-partitioned on (group, order), so that one group spreads
over many tasks, and small per-slice totals put the pieces together again. Both ways give the same
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.binding import let
from tidemark.session import BLOCK_ROWS_KEY, FOLD_ROWS_KEY, HOT_ROWS_KEY, limit, materialise


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def is_hot(df: DataFrame, keys: Sequence[str], key: str = HOT_ROWS_KEY) -> bool:
    """True where some group is too large for one task."""
    return largest_group(df, keys) > limit(df.sparkSession, key)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null matching null; the right side's keys are dropped."""
    other = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    joined = left.join(other, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{key}" for key in keys])


def _slices(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Globally sorted copy with ``_nr_at``: slice number in the high bits, position in the low ones."""
    spark = df.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    keys = [*group, *order]
    placed = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_nr_at", F.monotonically_increasing_id())
    )
    # Range bounds come from sampling, so the placement must be read back and never recomputed.
    return materialise(placed)


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "row_no",
    hot: bool | None = None,
) -> DataFrame:
    """Add 1, 2, 3 … per group in the total order ``order``."""
    if hot is None:
        hot = is_hot(df, group)
    if not hot:
        window = W.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    placed = _slices(df, group, order).withColumn("_nr_slice", F.shiftright("_nr_at", 33))
    pieces = placed.groupBy(*group, "_nr_slice").agg(
        F.min("_nr_at").alias("_nr_first"), F.count(F.lit(1)).alias("_nr_n")
    )
    earlier = W.partitionBy(*group).orderBy("_nr_slice").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(
        *group, "_nr_slice", "_nr_first", F.coalesce(F.sum("_nr_n").over(earlier), F.lit(0)).alias("_nr_before")
    )
    number = F.col("_nr_at") - F.col("_nr_first") + F.col("_nr_before") + 1
    return attach(placed, pieces, [*group, "_nr_slice"]).select(
        *df.columns, number.cast("long").alias(name)
    )


def blocks_of(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows numbered per group (``_no``) and dealt into blocks of consecutive ones (``_block``)."""
    size = limit(df.sparkSession, BLOCK_ROWS_KEY)
    numbered = number_rows(df, group, order, "_no", hot=True)
    return numbered.withColumn("_block", F.floor((F.col("_no") - 1) / size).cast("long")), size


def shift(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    picks: dict[str, tuple[str, int]],
    hot: bool | None = None,
) -> DataFrame:
    """Add neighbour columns: ``{"prev_end": ("end_ms", -1), "next_start": ("start_ms", 1)}``."""
    if hot is None:
        hot = is_hot(df, group)

    def neighbours(frame: DataFrame, window) -> DataFrame:
        for name, (column, offset) in picks.items():
            value = F.lag(column, -offset) if offset < 0 else F.lead(column, offset)
            frame = frame.withColumn(name, value.over(window))
        return frame

    if not hot:
        return neighbours(df, W.partitionBy(*group).orderBy(*order))
    reach = max(abs(offset) for _, offset in picks.values())
    blocked, size = blocks_of(df, group, order)
    homes = F.array_distinct(
        F.array(
            F.col("_block"),
            F.floor((F.col("_no") - 1 - reach) / size).cast("long"),
            F.floor((F.col("_no") - 1 + reach) / size).cast("long"),
        )
    )
    spread = blocked.withColumn("_seen_in", F.explode(homes))
    result = neighbours(spread, W.partitionBy(*group, "_seen_in").orderBy("_no"))
    return result.filter(F.col("_seen_in") == F.col("_block")).drop("_no", "_block", "_seen_in")


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    how: Callable[..., Column] = F.sum,
    hot: bool | None = None,
) -> DataFrame:
    """Add the inclusive running sum (or ``F.max``, ``F.min``) of ``value`` per group."""
    if hot is None:
        hot = is_hot(df, group)
    if not hot:
        window = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(name, how(value).over(window))
    blocked, _ = blocks_of(df, group, order)
    totals = blocked.groupBy(*group, "_block").agg(how(value).alias("_total"))
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*group, "_block", how("_total").over(earlier).alias("_base"))
    local = W.partitionBy(*group, "_block").orderBy("_no").rowsBetween(W.unboundedPreceding, 0)
    inner = blocked.withColumn("_local", how(value).over(local))
    joined = {F.sum: F.coalesce(F.col("_base"), F.lit(0)) + F.col("_local"), F.max: F.greatest("_base", "_local")}
    both = joined.get(how, F.least("_base", "_local"))
    return attach(inner, totals, [*group, "_block"]).select(*df.columns, both.alias(name))


def running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str, hot: bool | None = None
) -> DataFrame:
    """Add the inclusive running sum of ``value`` per group."""
    return running(df, group, order, value, name, F.sum, hot)


def moved(carry: Column, emitted: Column) -> Column:
    """Result of one fold step; a null ``emitted`` adds nothing to the output."""
    return F.struct(carry.alias("carry"), emitted.alias("emit"))


def ordered_fold(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    items: Sequence[str],
    carry: str,
    emit: str,
    start: Column,
    step: Callable[[Column, Column], Column],
    hot: bool | None = None,
) -> DataFrame:
    """Order-dependent scan of each group: ``step(carry, item)`` gives ``moved(carry, emitted)``.

    ``carry`` and ``emit`` are DDL types. Groups that fit one array are folded in one pass. Larger ones
    are cut into blocks of consecutive rows; the carries in which the blocks begin are found by
    :func:`tidemark.operators.chains.block_states`, and all blocks are then folded side by side.
    """
    state = f"struct<carry:{carry},out:array<{emit}>>"
    packed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in items if c not in order])))

    def fold(values: Column, initial: Column) -> Column:
        def advance(acc: Column, item: Column) -> Column:
            return let(
                step(acc["carry"], item),
                lambda r: F.struct(
                    r["carry"].cast(carry).alias("carry"),
                    F.when(r["emit"].isNull(), acc["out"])
                    .otherwise(F.array_append(acc["out"], r["emit"].cast(emit)))
                    .alias("out"),
                ).cast(state),
            )

        zero = F.struct(initial.cast(carry).alias("carry"), F.array().cast(f"array<{emit}>").alias("out"))
        return F.aggregate(values, zero.cast(state), advance)

    def carried(values: Column, initial: Column) -> Column:
        return F.aggregate(values, initial.cast(carry), lambda acc, item: step(acc, item)["carry"].cast(carry))

    if hot is None:
        hot = is_hot(df, group, FOLD_ROWS_KEY)
    if not hot:
        done = df.groupBy(*group).agg(packed.alias("_items"))
        done = done.select(*group, fold(F.col("_items"), start).alias("_done"))
        return done.select(*group, F.inline("_done.out"))

    from tidemark.operators.chains import block_states  # builds on this module

    begun = block_states(df, group, order, items, carry, start, carried)
    return begun.select(*group, fold(F.col("_items"), F.col("_in")).alias("_done")).select(*group, F.inline("_done.out"))
