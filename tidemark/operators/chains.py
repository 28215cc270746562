"""Scans that depend on their own decisions, in a logarithmic number of joins.

A chain is a walk in which every node names the next one. Where a group is too long for one task, the
nodes on the walk from its first node are found by pointer doubling: after k joins a node knows the
node 2^k steps on, and the walk is marked from the longest jumps down to the shortest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import attach, blocks_of, largest_group, number_rows, running, shift
from tidemark.session import FOLD_ROWS_KEY, HOT_ROWS_KEY, limit, materialise

_LEVELS_AT_ONCE = 5  # marking joins between two lineage cuts


def walk(edges: DataFrame, roots: DataFrame, node: Sequence[str]) -> DataFrame:
    """Nodes on the walks that begin at ``roots``: rows of the columns ``node``, roots included.

    ``edges`` has ``node`` and the next node in ``next_<column>``; a node has one edge at most and no
    walk returns to where it was. Null matches null. The jumps of each length are stored; there are as
    many as the longest walk has binary digits.
    """
    following = [f"next_{c}" for c in node]
    jumps = [materialise(edges.select(*node, *following))]
    while True:
        further = jumps[-1].withColumnsRenamed({c: f"far_{c}" for c in [*node, *following]})
        meets = F.lit(True)
        for c in node:
            meets = meets & F.col(f"next_{c}").eqNullSafe(F.col(f"far_{c}"))
        twice = jumps[-1].join(further, meets).select(
            *node, *[F.col(f"far_next_{c}").alias(f"next_{c}") for c in node]
        )
        twice = materialise(twice)
        if twice.isEmpty():
            break
        jumps.append(twice)
    marked = roots.select(*node)
    for level, jump in enumerate(reversed(jumps), 1):
        ends = F.array(
            F.struct(*[F.lit(True).alias("is"), *[F.col(c) for c in node]]),
            F.struct(F.col("_to").isNotNull().alias("is"), *[F.col(f"_to.next_{c}").alias(c) for c in node]),
        )
        onward = jump.select(*node, F.struct(*following).alias("_to"))
        marked = attach(marked, onward, node, "left").select(F.inline(ends)).where("is").drop("is")
        if level % _LEVELS_AT_ONCE == 0 and level < len(jumps):
            marked = materialise(marked)
    return marked


def greedy_chain(
    nodes: DataFrame, group: Sequence[str], at: str, until: str, reach: int, hot: bool | None = None
) -> DataFrame:
    """Positions picked by taking the first one, and then always the first at or after the ``until`` of
    the last one picked: rows ``group, at``.

    Positions are whole, unique per group, and their ``until`` lies after them by ``reach`` at most.
    A position that follows the one before by ``reach`` or more is picked whatever was picked before,
    so groups fall into islands that are scanned on their own; only islands too long for one task are
    walked by pointer doubling. ``hot=False`` states that no group is too long for that.
    """
    rows = nodes.select(*group, F.col(at).alias("at"), F.col(until).alias("until"))
    if hot is False:
        return _scan(rows, group).withColumnRenamed("at", at)
    spark = nodes.sparkSession
    rows = materialise(rows)
    longest = largest_group(rows, group)
    if longest <= limit(spark, FOLD_ROWS_KEY):
        return _scan(rows, group).withColumnRenamed("at", at)
    hot = longest > limit(spark, HOT_ROWS_KEY)
    linked = shift(rows, group, ["at"], {"_prior": ("at", -1)}, hot)
    opens = F.when(F.col("at") - F.col("_prior") < reach, 0).otherwise(1)
    placed = running(linked.withColumn("_opens", opens), group, ["at"], "_opens", "_island", hot=hot)
    placed = materialise(placed.select(*group, "_island", "at", "until"))
    keys = [*group, "_island"]
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    long = sizes.where(F.col("_size") > limit(spark, FOLD_ROWS_KEY))
    picked = _scan(attach(placed, long.drop("_size"), keys, "left_anti"), keys).drop("_island")
    if not long.isEmpty():
        picked = picked.unionByName(_double(attach(placed, long, keys), keys).drop("_island"))
    return picked.withColumnRenamed("at", at)


def _scan(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("at", "until")))
    start = F.struct(F.lit(None).cast("long").alias("until"), F.array().cast("array<bigint>").alias("picked"))
    found = F.aggregate(
        packed, start,
        lambda acc, x: F.when(acc["until"] > x["at"], acc).otherwise(
            F.struct(x["until"].alias("until"), F.array_append(acc["picked"], x["at"]).alias("picked"))
        ),
    )
    return rows.groupBy(*keys).agg(found.getField("picked").alias("_picked")).select(
        *keys, F.explode("_picked").alias("at")
    )


def _double(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pointer doubling over the numbers of the positions of long islands; ``_n`` is their count."""
    numbered = materialise(number_rows(rows, keys, ["at"], "_pos", hot=True))
    # The next pick is the first position not below ``until``: one more than the positions below it.
    marks = numbered.select(*keys, "at", F.lit(1).alias("_kind"), "_pos", "_size", F.lit(1).alias("_one"))
    probes = numbered.select(
        *keys, F.col("until").alias("at"), F.lit(0).alias("_kind"), "_pos", "_size", F.lit(0).alias("_one")
    )
    below = running(marks.unionByName(probes), keys, ["at", "_kind", "_pos"], "_one", "_below", hot=True)
    edges = below.where((F.col("_kind") == 0) & (F.col("_below") < F.col("_size"))).select(
        *keys, "_pos", *[F.col(k).alias(f"next_{k}") for k in keys], (F.col("_below") + 1).cast("long").alias("next__pos")
    )
    roots = numbered.where("_pos = 1").select(*keys, "_pos")
    on_walk = walk(edges, roots, [*keys, "_pos"])
    return attach(numbered, on_walk, [*keys, "_pos"], "left_semi").select(*keys, "at")


def origins(nodes: DataFrame, node: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Value of the first node of each node's line of descent: rows ``node, value``.

    A node has its own ``value`` columns or, where all are null, a parent in ``from_<column>``. Every
    round replaces parents by their parents' parents, so their number is logarithmic in the lines.
    """
    parents = [f"from_{c}" for c in node]
    own = F.coalesce(*[F.col(c).cast("string") for c in value]).isNotNull()
    rows = materialise(nodes.select(*node, *value, *parents).withColumn("_own", own))
    done = rows.where("_own").select(*node, *value)
    while True:
        open_rows = rows.where("not _own")
        if open_rows.isEmpty():
            return done
        up = rows.select(
            *[F.col(c).alias(f"up_{c}") for c in [*node, *value, *parents]], F.col("_own").alias("_up_own")
        )
        meets = F.lit(True)
        for c in node:
            meets = meets & F.col(f"from_{c}").eqNullSafe(F.col(f"up_{c}"))
        rows = materialise(
            open_rows.join(up, meets).select(
                *node, *[F.col(f"up_{c}").alias(c) for c in [*value, *parents]], F.col("_up_own").alias("_own")
            ).unionByName(rows.where("_own"))
        )
        done = rows.where("_own").select(*node, *value)


def block_states(
    df: DataFrame, group: Sequence[str], order: Sequence[str], items: Sequence[str], state: str, start: Column,
    after: Callable[[Column, Column], Column],
) -> DataFrame:
    """Cut each group into blocks of consecutive rows and find the state in which each block begins.

    ``after(items, state)`` is the state behind a block, of DDL type ``state``. Rows ``group, _block,
    _items, _in``. Every block is first run from ``start``; then from each further state that the block
    before it was seen to end in, until no block meets a new one. Blocks thereby become maps from
    states to states, and the true states are found by walking along these maps. The number of rounds
    is the number of blocks after which a difference between two states is forgotten, or the number of
    states that a block can meet, and not the number of blocks.
    """
    keys = [*group, "_block"]
    packed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in items if c not in order])))
    blocks = materialise(blocks_of(df, group, order)[0].groupBy(*keys).agg(packed.alias("_items")))

    def named(column: str) -> Column:
        return F.sha2(F.to_json(F.struct(F.col(column).alias("s"))).cast("binary"), 256)

    asked = blocks.select(*keys, start.cast(state).alias("_in")).withColumn("_id", named("_in"))
    roots = asked.where("_block = 0").select(*keys, "_id")
    known = None
    while True:
        ran = attach(blocks, asked, keys).select(
            *keys, "_id", "_in", after(F.col("_items"), F.col("_in")).cast(state).alias("_out")
        )
        ran = materialise(ran.withColumn("_out_id", named("_out")))
        known = ran if known is None else known.unionByName(ran)
        ends = ran.select(
            *group, (F.col("_block") + 1).alias("_block"), F.col("_out_id").alias("_id"), F.col("_out").alias("_in")
        )
        ends = attach(ends, blocks.select(*keys), keys, "left_semi").dropDuplicates([*keys, "_id"])
        asked = materialise(attach(ends, known.select(*keys, "_id"), [*keys, "_id"], "left_anti"))
        if asked.isEmpty():
            break
    node = [*keys, "_id"]
    edges = known.select(
        *node, *[F.col(k).alias(f"next_{k}") for k in group], (F.col("_block") + 1).alias("next__block"),
        F.col("_out_id").alias("next__id"),
    )
    true = attach(known.select(*node, "_in"), walk(edges, roots, node), node, "left_semi")
    return attach(blocks, true.drop("_id"), keys)

