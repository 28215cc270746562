"""Shards of near equal bytes: minimax contiguous partition of ordered atomic groups, JVM side only."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, written

SHARDS = 24
OVERHEAD = 8
SALTS = 256  # parts of one group's documents that are numbered in different tasks
GROUPS_PER_BUCKET = 20_000
CELLS = 65_536
ENDS_AT_ONCE = 500_000  # group ends (8 bytes each) that the end of the search may hold
TRIES = 16  # capacities that one round of the search tries at once


def _prefix(rows: DataFrame, bucket: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums over (bucket, order): inside buckets, and over the totals of the buckets."""
    inner = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(bucket).agg(*(F.sum(c).alias(f"{c}_all") for c in sums))
    starts = totals.select(bucket, *((F.sum(f"{c}_all").over(outer) - F.col(f"{c}_all")).alias(f"{c}_base") for c in sums))
    placed = rows.select("*", *((F.sum(c).over(inner) - F.col(c)).alias(f"{c}_in") for c in sums))
    return placed.join(starts, bucket).select(
        *rows.columns, *((F.col(f"{c}_base") + F.col(f"{c}_in")).alias(name) for c, name in sums.items())
    )


def _greedy(below, capacity: int, total: int, shards: int) -> list[int]:
    """Cuts of greedy filling: each shard ends at the last group end that its capacity reaches."""
    cuts = [0]
    while len(cuts) <= shards and cuts[-1] < total:
        cuts.append(min(below(cuts[-1] + capacity), total))
    return cuts


def _smallest(feasible, low: int, high: int) -> int:
    """Binary search; ``high`` is feasible."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return high


def _smallest_capacity(groups: DataFrame, total: int, largest: int, shards: int, ends_at_once: int) -> tuple[int, list[int]]:
    """Smallest capacity for which greedy filling needs at most ``shards`` shards, and its cuts.

    The last group end of each of some 65,536 equal cells of the byte axis already bounds the
    capacity from above, since cutting only there is one way to cut. Between both bounds the k-th cut
    can only lie in a known stretch of the axis. Once the ends in those stretches are at most
    ``ends_at_once``, they are fetched and the binary search ends on them; before that, rounds of
    the search try several capacities at once by scans of the stored ends.
    """
    width = max(1, total // CELLS)
    ends = written(
        groups.select((F.col("byte_start") + F.col("bytes")).alias("stop"))
        .withColumn("cell", F.floor(F.col("stop") / F.lit(width)).cast("long"))
        .repartitionByRange(F.col("stop")).sortWithinPartitions("stop"),
        "ends",
    )
    lasts = sorted(r["last"] for r in ends.groupBy("cell").agg(F.max("stop").alias("last")).collect())

    def coarse(t: int) -> int:
        at = bisect_right(lasts, t) - 1
        return lasts[at] if at >= 0 else 0

    low = max(largest, -(-total // shards), 1)  # nothing below is feasible
    high = _smallest(lambda c: _greedy(coarse, c, total, shards)[-1] >= total, low, 2 * max(low, width) + largest)

    # The k-th cut of any capacity between both lies in stretch k.
    stretches = []
    least = most = 0
    for _ in range(shards):
        least, most = coarse(least + low), min(most + high, total)
        stretches.append((least, most))
    while True:
        inside = F.lit(False)
        for least, most in stretches:
            inside = inside | F.col("stop").between(least, most)
        near = ends.where(inside)
        if near.count() <= ends_at_once:
            break
        tried = sorted({low + k * (high - low) // TRIES for k in range(TRIES + 1)})
        cuts = _greedy_by_scans(ends, tried, total, shards)
        first = next(i for i, c in enumerate(cuts) if c[-1] >= total)
        if first == 0 or tried[first] - tried[first - 1] == 1:
            return tried[first], cuts[first][1:]
        low, high = tried[first - 1] + 1, tried[first]
        stretches = list(zip(cuts[first - 1][1:], cuts[first][1:] + [total] * shards))
    known = sorted(r["stop"] for r in near.collect())

    def exact(t: int) -> int:
        at = bisect_right(known, t) - 1
        return known[at] if at >= 0 else 0

    best = _smallest(lambda c: _greedy(exact, c, total, shards)[-1] >= total, low, high)
    return best, _greedy(exact, best, total, shards)[1:]


def _greedy_by_scans(ends: DataFrame, capacities: list[int], total: int, shards: int) -> list[list[int]]:
    """Cuts of several capacities side by side; one pruned scan of the ends for each shard."""
    cuts = [[0] for _ in capacities]
    for _ in range(shards):
        going = [i for i, c in enumerate(cuts) if c[-1] < total]
        if not going:
            break
        targets = F.array(*(F.lit(cuts[i][-1] + capacities[i]).cast("long") for i in going))
        bounds = [cuts[i][-1] for i in going], [cuts[i][-1] + capacities[i] for i in going]
        found = (
            ends.where(F.col("stop").between(min(bounds[0]), max(bounds[1])))
            .select("stop", F.posexplode(targets).alias("i", "target")).where("stop <= target")
            .groupBy("i").agg(F.max("stop").alias("stop")).collect()
        )
        reached = {r["i"]: r["stop"] for r in found}
        for at, i in enumerate(going):
            cuts[i].append(min(reached.get(at, 0), total))
    return cuts


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, overhead: int = OVERHEAD,
    ends_at_once: int = ENDS_AT_ONCE,
) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, shard, slot`` with near equal bytes in every shard.

    ``size`` is the number of UTF-8 bytes of the text plus ``overhead``. Documents of one text are an
    atomic group; null and empty texts are one group. Groups are ordered by the SHA-256 of their
    text, and the largest shard is as small as any contiguous partition of that order allows. Slots
    count the documents of a shard from 0 in the order of group and id (null ids first; equal ids in
    any order). An empty table gives no rows; other columns are ignored.

    Running sums go through hash buckets and bucket totals; a group that holds a large part of all
    rows is numbered in parts.
    """
    ready(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.sha2(text, 256).alias("key"),
        ).withColumn("salt", F.pmod(F.xxhash64(F.col("id").cast("string"), F.monotonically_increasing_id()), F.lit(SALTS))),
        "rows",
    )
    cells = written(
        rows.groupBy("key", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("weight")), "cells"
    )
    sizes = cells.groupBy("key").agg(F.sum("n").alias("rows"), F.sum("weight").alias("bytes"))
    facts = sizes.agg(F.count("*").alias("groups"), F.sum("bytes").alias("total"), F.max("bytes").alias("largest")).first()
    if not facts["groups"]:
        empty = [F.lit(0).cast(kind).alias(name) for name, kind in (("shard", "int"), ("slot", "long"))]
        return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), *empty)
    # A longer hash prefix for more groups keeps buckets bounded and the order the same.
    digits = 1
    while 16**digits * GROUPS_PER_BUCKET < facts["groups"]:
        digits += 1
    bucketed = sizes.withColumn("bucket", F.substring("key", 1, digits))
    groups = written(
        _prefix(bucketed, "bucket", ["key"], {"bytes": "byte_start", "rows": "row_start"})
        .select("key", "bytes", "byte_start", "row_start"),
        "groups",
    )
    total, largest = facts["total"], facts["largest"]
    _, cuts = _smallest_capacity(groups, total, largest, shards, ends_at_once)

    number: Column = F.lit(0)  # cuts before the group
    for cut in cuts[:-1]:
        number = number + F.when(F.col("byte_start") >= F.lit(cut), 1).otherwise(0)
    sharded = groups.withColumn("shard", number.cast("int"))
    starts = {r["shard"]: r["start"] for r in sharded.groupBy("shard").agg(F.min("row_start").alias("start")).collect()}
    start = F.element_at(
        F.create_map(*(F.lit(x).cast(kind) for pair in starts.items() for x, kind in zip(pair, ("int", "long")))),
        F.col("shard"),
    )
    before = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = (
        cells.select("key", "salt", (F.sum("n").over(before) - F.col("n")).alias("cell_start"))  # at most SALTS a group
        .join(sharded.select("key", "shard", (F.col("row_start") - start).alias("group_start")), "key")
        .select("key", "salt", "shard", (F.col("group_start") + F.col("cell_start")).alias("base"))
    )
    inside = Window.partitionBy("key", "salt").orderBy("id")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(places, ["key", "salt"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("base") + F.col("rank")).cast("long").alias("slot"),
    )
