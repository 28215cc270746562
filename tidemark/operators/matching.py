"""One-to-one matching of predictions to gold, in a fixed order, without oversized tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from tidemark.functions.binding import let
from tidemark.functions.boxes import area, height, iou, width
from tidemark.operators.sequence import (
    attach, is_hot, largest_group, moved, number_rows, ordered_fold, running, shift,
)
from tidemark.operators.timeline import nearest_in_time
from tidemark.session import FOLD_ROWS_KEY, limit, materialise


def match_in_time(
    pred: DataFrame,
    gold: DataFrame,
    keys: Sequence[str],
    times: Sequence[str],
    tolerance: Column,
    bin_ms: int,
    order: Sequence[str] = (),
) -> DataFrame:
    """Each gold row in turn takes the free prediction with the least (error, position).

    Gold rows come in the order of ``order`` and then ``gold_id``, or, without one, of their times;
    predictions have the position of their times and then ``pred_id``. Both sides need a unique
    ``pred_id`` / ``gold_id`` and the columns ``times``; every time must agree within the gold row's
    tolerance, however large, and the error is the sum. ``bin_ms`` is the least width of the bins in
    which times meet; it changes no result. Returns keys, ``gold_id``, ``pred_id`` and one
    ``error_<time>`` per time.

    Rows with equal times are interchangeable but for their rank, so they are first counted and moved
    as counts: predictions always, gold rows where they come in time order. A million copies of one
    time then cost what one row costs. Groups too long for one task fall into islands of gold rows whose
    tolerances touch, beyond which nothing is shared. What is still too long is folded in blocks
    (time order) or settled by proposals (own order).
    """
    first = times[0]
    p_times, g_times = [f"p_{t}" for t in times], [f"g_{t}" for t in times]
    preds = pred.select(*keys, "pred_id", *[F.col(t).alias(f"p_{t}") for t in times])
    golds = gold.select(
        *keys, "gold_id", *[F.col(t).alias(f"g_{t}") for t in times], tolerance.cast("long").alias("tol"),
        *([F.struct(*order, "gold_id").alias("turn")] if order else []),
    )
    spots = [*(["turn"] if order else []), *g_times, "tol"]  # of interchangeable gold rows
    pred_sets = preds.groupBy(*keys, *p_times).agg(F.count(F.lit(1)).alias("n_p"))
    gold_sets = golds.groupBy(*keys, *spots).agg(F.count(F.lit(1)).alias("n_g"))

    def edges_of(sets: DataFrame) -> DataFrame:
        # Times meet in bins, which keep a long source from meeting itself; copies were counted away.
        near = nearest_in_time(sets, pred_sets, keys, f"g_{first}", f"p_{first}", "tol", max(1, bin_ms))
        error = F.lit(0).cast("long")
        for t in times:
            distance = F.abs(F.col(f"g_{t}") - F.col(f"p_{t}"))
            near = near.filter(distance <= F.col("tol"))
            error = error + distance
        return near.drop("error_ms").withColumn("error", error)

    near = materialise(edges_of(gold_sets))
    bound = limit(gold.sparkSession, FOLD_ROWS_KEY)
    if largest_group(near, keys) <= bound:
        flows = _fold_in_turn(near, keys, spots, p_times, bool(order), False)
    else:
        edges = materialise(_with_islands(near, gold_sets, keys, spots, f"g_{first}"))
        inside = [*keys, "_island"]
        long = edges.groupBy(*inside).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound).drop("_n")
        flows = _fold_in_turn(attach(edges, long, inside, "left_anti"), inside, spots, p_times, bool(order), False)
        if not long.isEmpty():
            rest = attach(edges, long, inside, "left_semi")
            flows = flows.unionByName(
                _propose_in_turn(rest, inside, spots, p_times) if order
                else _fold_in_turn(rest, inside, spots, p_times, False, True)
            )
    # Copies of one time are no more than the rows of their source, which are cheap to count.
    ranked_pred = number_rows(
        preds, [*keys, *p_times], ["pred_id"], "_p_rank", None if is_hot(preds, keys) else False
    )
    if order:
        placed = golds.join(flows.select(*keys, *spots, *p_times, "p_from"), [*keys, *spots])
        placed = placed.withColumn("_p_rank", F.col("p_from") + 1)
    else:
        ranked_gold = number_rows(
            golds, [*keys, *spots], ["gold_id"], "_g_rank", None if is_hot(golds, keys) else False
        )
        placed = ranked_gold.join(flows, [*keys, *spots]).filter(
            (F.col("_g_rank") > F.col("g_from")) & (F.col("_g_rank") <= F.col("g_from") + F.col("n"))
        )
        placed = placed.withColumn("_p_rank", F.col("_g_rank") - F.col("g_from") + F.col("p_from"))
    return placed.join(ranked_pred, [*keys, *p_times, "_p_rank"]).select(
        *keys, "gold_id", "pred_id",
        *[F.abs(F.col(f"g_{t}") - F.col(f"p_{t}")).alias(f"error_{t}") for t in times],
    )


def _with_islands(
    near: DataFrame, gold_sets: DataFrame, keys: Sequence[str], spots: Sequence[str], time: str
) -> DataFrame:
    """Edges with the island of their gold rows and how far any gold row of it reaches.

    An island opens where a gold row reaches back less far than every gold row before it reaches
    ahead; no prediction is near to gold rows of two islands.
    """
    spans = materialise(
        gold_sets.select(*keys, *spots).withColumns({"_from": F.col(time) - F.col("tol"), "_upto": F.col(time) + F.col("tol")})
    )
    hot = is_hot(spans, keys)
    along = [*keys], ["_from", *spots]
    ahead = running(spans, *along, "_upto", "_ahead", F.max, hot)
    ahead = shift(ahead, *along, {"_prior": ("_ahead", -1)}, hot)
    opens = F.when(F.col("_from") <= F.col("_prior"), 0).otherwise(1)
    numbered = materialise(running(ahead.withColumn("_opens", opens), *along, "_opens", "_island", hot=hot))
    reach = numbered.groupBy(*keys, "_island").agg(F.max("tol").alias("reach"))
    placed = attach(numbered.select(*keys, *spots, "_island"), reach, [*keys, "_island"])
    return attach(near, placed, [*keys, *spots])


def _fold_in_turn(
    near: DataFrame, keys: Sequence[str], spots: Sequence[str], p_times: Sequence[str], own_order: bool, hot: bool
) -> DataFrame:
    """Fold the edges of each group in the order of their gold rows, carrying what is used up.

    In time order, predictions that no later gold row reaches are forgotten. Rows ``spots, p_times,
    g_from, p_from, n``: ``n`` copies of a gold row, behind the first ``g_from``, take as many copies of a
    prediction behind the first ``p_from``.
    """
    if not hot:
        return _scan_in_turn(near, keys, spots, p_times, own_order)
    types = dict(near.dtypes)
    if "reach" not in near.columns:
        near = near.withColumn("reach", F.lit(None).cast("long"))
    first_p, first_g = p_times[0], [c for c in spots if c.startswith("g_")][0]
    place = ",".join(f"{c}:bigint" for c in p_times)
    target = ",".join(f"{c}:{types[c]}" for c in spots)
    carry = f"struct<gold:struct<{target}>,left:bigint,used:array<struct<{place},n:bigint>>>"
    emit = f"struct<{target},{place},g_from:bigint,p_from:bigint,n:bigint>"

    def same(a: Column, b: Column, names: Sequence[str]) -> Column:
        condition = F.lit(True)
        for name in names:
            condition = condition & a[name].eqNullSafe(b[name])
        return condition

    def step(state: Column, item: Column) -> Column:
        going_on = same(state["gold"], item, spots)
        mine = F.filter(state["used"], lambda u: same(u, item, p_times))
        now = F.struct(
            F.when(going_on, state["left"]).otherwise(item["n_g"]).alias("left"),
            F.coalesce(F.get(mine, F.lit(0))["n"], F.lit(0).cast("long")).alias("used"),
        )
        return let(now, lambda n: take(state, item, n["left"], n["used"]))

    def take(state: Column, item: Column, left: Column, used: Column) -> Column:
        count = F.least(left, item["n_p"] - used)

        def kept(u: Column) -> Column:
            reached = F.lit(True) if own_order else (
                item["reach"].isNull() | (u[first_p] >= item[first_g] - item["reach"])
            )
            return ~same(u, item, p_times) & reached

        entry = F.struct(*[item[c].alias(c) for c in p_times], (used + count).alias("n"))
        after = F.array_sort(
            F.array_append(F.filter(state["used"], kept), entry.cast(f"struct<{place},n:bigint>"))
        )
        flow = F.struct(
            *[item[c].alias(c) for c in [*spots, *p_times]],
            (item["n_g"] - left).alias("g_from"), used.alias("p_from"), count.alias("n"),
        )
        taken = count > 0
        return moved(
            F.struct(
                F.struct(*[item[c].alias(c) for c in spots]).alias("gold"), (left - count).alias("left"),
                F.when(taken, after).otherwise(state["used"]).alias("used"),
            ),
            F.when(taken, flow),
        )

    nothing = F.lit(None).cast(carry)
    start = F.struct(
        nothing["gold"].alias("gold"), F.lit(0).cast("long").alias("left"),
        F.array().cast(f"array<struct<{place},n:bigint>>").alias("used"),
    ).cast(carry)
    flows = ordered_fold(
        near, keys, [*spots, "error", *p_times], ["n_g", "n_p", "reach"], carry, emit, start, step, hot
    )
    return flows.drop("_island")


def _scan_in_turn(
    near: DataFrame, keys: Sequence[str], spots: Sequence[str], p_times: Sequence[str], own_order: bool
) -> DataFrame:
    """:func:`_fold_in_turn` for groups that fit a task, as one scan of sorted edges."""
    gold = ["_gold"] if own_order else [c for c in spots if c != "turn"]  # names a gold row inside its group
    edges = near.withColumn("_gold", F.col("turn.gold_id")) if own_order else near
    edges = edges.select(*keys, *spots, *p_times, "error", "n_g", "n_p", *(["_gold"] if own_order else []))
    added = StructType.fromDDL("g_from bigint, p_from bigint, n bigint")
    placed = edges.repartition(*keys).sortWithinPartitions(*keys, *spots, "error", *p_times)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, turn, left, used = None, None, 0, {}
        for batch in batches:
            def rows(names: Sequence[str], batch=batch) -> Iterator[tuple]:
                return zip(*[batch.column(n).to_pylist() for n in names], strict=True)

            flows, taken = [], []
            for key, who, spot, (n_g, n_p) in zip(rows(keys), rows(gold), rows(p_times), rows(["n_g", "n_p"]), strict=True):
                if key != group:
                    group, turn, used = key, None, {}
                if who != turn:
                    turn, left = who, n_g
                before = used.get(spot, 0)
                count = min(left, n_p - before)
                taken.append(count > 0)
                if count > 0:
                    flows.append((n_g - left, before, count))
                    used[spot], left = before + count, left - count
            kept = batch.filter(pa.array(taken, pa.bool_()))
            new = [pa.array([f[i] for f in flows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*batch.schema.names, *added.names])

    flows = placed.mapInArrow(scan, StructType([*edges.schema.fields, *added.fields]))
    return flows.select(*[k for k in keys if k != "_island"], *spots, *p_times, *added.names)


def _propose_in_turn(
    near: DataFrame, keys: Sequence[str], spots: Sequence[str], p_times: Sequence[str]
) -> DataFrame:
    """The result of :func:`_fold_in_turn` for single gold rows in an order of their own, by proposals.

    Every gold row proposes to the best prediction time left to it. A time with more proposals than
    copies keeps those whose turns come first and is closed to later turns. Once nothing is turned away
    the proposals are what each gold row would have taken in its turn. Rounds follow the longest chain
    of gold rows that turn each other away, which is short unless the order runs along the times.
    """
    live = near.select(*keys, *spots, *p_times, "n_p", "error")
    at = [*keys, *p_times]
    while True:
        live = materialise(live)
        wanted = live.groupBy(*keys, *spots).agg(F.min(F.struct("error", *p_times, "n_p")).alias("_w"))
        wanted = wanted.select(*keys, *spots, *[F.col(f"_w.{c}").alias(c) for c in [*p_times, "n_p"]])
        ranked = materialise(number_rows(wanted, at, ["turn"], "_no"))
        full = ranked.where(F.col("_no") == F.col("n_p")).select(*at, F.col("turn").alias("_last"))
        if ranked.where(F.col("_no") > F.col("n_p")).isEmpty():
            return ranked.select(
                *[k for k in keys if k != "_island"], *spots, *p_times, F.lit(0).cast("long").alias("g_from"),
                (F.col("_no") - 1).alias("p_from"), F.lit(1).cast("long").alias("n"),
            )
        live = attach(live, full, at, "left").where("_last is null or turn <= _last").drop("_last")


def match_by_score(
    edges: DataFrame, group: Sequence[str], order: Sequence[str], hot: bool | None = None
) -> DataFrame:
    """Greedy one-to-one choice of edges (``g``, ``p``) in ascending total ``order``.

    Groups that fit one array are folded. In larger ones, edges that come first at both of their ends
    are settled side by side, and all other edges of these ends are dropped, until none is left: with
    one ranking of all edges for both ends that is the greedy choice, and on edges in no special
    arrangement the number of rounds is logarithmic.
    """
    names = edges.columns
    if hot is None:
        hot = is_hot(edges, group, FOLD_ROWS_KEY)
    if not hot:
        return _fold_edges(edges, group, order, names)
    sizes = edges.groupBy(*group).agg(F.count(F.lit(1)).alias("_edges"))
    bound = limit(edges.sparkSession, FOLD_ROWS_KEY)
    usual = edges.join(sizes.filter(F.col("_edges") <= bound).select(*group), list(group), "left_semi")
    crowded = edges.join(sizes.filter(F.col("_edges") > bound).select(*group), list(group), "left_semi")
    return _fold_edges(usual, group, order, names).unionByName(
        _settle_edges(crowded, group, order, names)
    )


def _fold_edges(edges: DataFrame, group: Sequence[str], order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Accept edges whose two ends have no other edge at once, and fold the contested rest in order."""
    extra = [c for c in names if c not in group and c not in order]
    ends = [F.count(F.lit(1)).over(W.partitionBy(*group, end)) for end in ("g", "p")]
    marked = edges.withColumn("_alone", (ends[0] == 1) & (ends[1] == 1))
    edge = F.struct(*order, *extra)
    rows = marked.groupBy(*group).agg(
        F.collect_list(F.when(F.col("_alone"), edge)).alias("_easy"),
        F.array_sort(F.collect_list(F.when(~F.col("_alone"), edge))).alias("_edges"),
    )
    empty = F.filter("_edges", lambda e: F.lit(False))
    chosen = F.aggregate(
        "_edges", empty,
        lambda acc, e: F.when(
            F.exists(acc, lambda m: (m["g"] == e["g"]) | (m["p"] == e["p"])), acc
        ).otherwise(F.array_append(acc, e)),
    )
    return rows.select(*group, F.inline(F.concat("_easy", chosen))).select(*names)


def _settle_edges(edges: DataFrame, group: Sequence[str], order: Sequence[str], names: Sequence[str]) -> DataFrame:
    live, settled = materialise(edges.withColumn("_rank", F.struct(*order))), None
    while not live.isEmpty():
        ends = {end: W.partitionBy(*group, end) for end in ("g", "p")}
        ranked = live
        for end, window in ends.items():
            ranked = ranked.withColumn(f"_best_{end}", F.min("_rank").over(window))
        ranked = ranked.withColumn("_first", (F.col("_rank") == F.col("_best_g")) & (F.col("_rank") == F.col("_best_p")))
        for end, window in ends.items():
            ranked = ranked.withColumn(f"_done_{end}", F.max("_first").over(window))
        ranked = materialise(ranked)
        first = ranked.filter("_first").select(*names)
        settled = first if settled is None else settled.unionByName(first)
        live = ranked.filter("not _done_g and not _done_p").select(*names, "_rank")
    return edges.limit(0).select(*names) if settled is None else settled


def region_edges(
    pred: DataFrame, gold: DataFrame, frame: Sequence[str], threshold: float, crowded: bool
) -> DataFrame:
    """Pairs of boxes of one frame with IoU of at least ``threshold``.

    Inputs carry ``frame`` columns, a position (``g`` / ``p``) and ``g_box`` / ``p_box``. Small frames
    are joined on the frame. In crowded frames boxes also have to share a cell of a grid whose size
    follows the box width: an IoU of t needs widths within a factor t and centres within
    (1 - t) times the larger width, so only neighbouring cells can hold a partner.
    """
    if not crowded:
        pairs = gold.join(pred, list(frame))
    else:
        def size_class(box: Column) -> Column:
            return F.floor(F.log2(F.greatest(width(box), F.lit(1e-9))) + 1e-9).cast("long")

        def cell(value: Column, scale: Column) -> Column:
            return F.floor(value / F.pow(F.lit(2.0), scale)).cast("long")

        def middle(box: str, axis: str) -> Column:
            return (F.col(f"{box}.{axis}1") + F.col(f"{box}.{axis}2")) / 2

        def cells_near(axis: str, slack: Column) -> Column:
            at, scale = middle("p_box", axis), F.col("_class")
            return F.explode(F.sequence(cell(at - slack, scale), cell(at + slack, scale)))

        g = gold.withColumn("_class", size_class(F.col("g_box"))).withColumns(
            {"_cx": cell(middle("g_box", "x"), F.col("_class")), "_cy": cell(middle("g_box", "y"), F.col("_class"))}
        )
        reach = max(1, math.ceil(math.log2(1 / threshold)))
        own = size_class(F.col("p_box"))
        p = pred.withColumn("_class", F.explode(F.sequence(own - reach, own + reach)))
        widest = F.greatest(width(F.col("p_box")), F.pow(F.lit(2.0), F.col("_class") + 1))
        tallest = height(F.col("p_box")) / threshold
        p = p.withColumn("_cx", cells_near("x", 1e-6 + (1 - threshold) * widest))
        p = p.withColumn("_cy", cells_near("y", 1e-6 + (1 - threshold) * tallest))
        pairs = g.join(p, [*frame, "_class", "_cx", "_cy"]).drop("_class", "_cx", "_cy")
    # Unpacking a one-element list keeps the optimiser from evaluating the overlap again in the join.
    overlap = F.explode(F.array(iou(F.col("g_box"), F.col("p_box"))))
    return pairs.withColumn("iou", overlap).filter(F.col("iou") >= threshold)


def match_regions(pred: DataFrame, gold: DataFrame, frame: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """One-to-one region matches by descending (IoU, gold position, prediction position).

    Crowded frames, and they alone, go another way: identical boxes are taken out first. They have IoU
    1, come first in that order, and the k-th last gold copy meets the k-th last prediction copy; they
    are paired by rank, so piles of copies never become pairs of everything with everything. Only the
    rest of these frames is compared by IoU, within a grid, and settled in rounds.
    """
    keys = list(frame)
    side = limit(gold.sparkSession, FOLD_ROWS_KEY) ** 0.5
    sizes = gold.select(*keys, F.lit(1).alias("_g"), F.lit(0).alias("_p")).unionByName(
        pred.select(*keys, F.lit(0).alias("_g"), F.lit(1).alias("_p"))
    ).groupBy(*keys).agg(F.sum("_g").alias("_g"), F.sum("_p").alias("_p"))
    crowded = materialise(sizes.filter((F.col("_g") > side) | (F.col("_p") > side)).select(*keys))
    if crowded.isEmpty():
        return _matched(pred, gold, frame, threshold, False)
    usual = _matched(
        attach(pred, crowded, keys, "left_anti"), attach(gold, crowded, keys, "left_anti"), frame, threshold, False
    )
    gold, pred = attach(gold, crowded, keys, "left_semi"), attach(pred, crowded, keys, "left_semi")
    taken = _identical(pred, gold, frame)
    gold = gold.join(taken.select(*keys, "g"), [*keys, "g"], "left_anti")
    pred = pred.join(taken.select(*keys, "p"), [*keys, "p"], "left_anti")
    return usual.unionByName(taken).unionByName(_matched(pred, gold, frame, threshold, True))


def _matched(pred: DataFrame, gold: DataFrame, frame: Sequence[str], threshold: float, crowded: bool) -> DataFrame:
    edges = region_edges(
        pred.select(*frame, "p", "p_box"), gold.select(*frame, "g", "g_box"), frame, threshold, crowded
    )
    edges = edges.select(
        *frame, (-F.col("iou")).alias("_miou"), (-F.col("g")).alias("_mg"), (-F.col("p")).alias("_mp"),
        "g", "p", "iou",
    )
    # A frame that is not crowded has no more edges than one task may fold.
    chosen = match_by_score(edges, frame, ["_miou", "_mg", "_mp"], None if crowded else False)
    return chosen.select(*frame, "g", "p", "iou")


def _identical(pred: DataFrame, gold: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Equal boxes of a frame, the last copies of either side paired first."""
    spots = ["x1", "y1", "x2", "y2"]

    def ranked(df: DataFrame, position: str, box: str) -> DataFrame:
        flat = df.filter(area(F.col(box)) > 0).select(
            *frame, position, *[F.col(f"{box}.{c}").alias(c) for c in spots], (-F.col(position)).alias("_down")
        )
        return number_rows(flat, [*frame, *spots], ["_down"], "_copy").drop("_down")

    pairs = ranked(gold, "g", "g_box").join(ranked(pred, "p", "p_box"), [*frame, *spots, "_copy"])
    return pairs.select(*frame, "g", "p", F.lit(1.0).alias("iou"))
