"""Hard negatives of anchor vectors by exact integer scores, several candidates in every product."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ready, shared_folder, written

SCALE = 256
CHUNK_BYTES = 16 << 20  # components of the anchors that meet all candidates in one pass
_EXACT_BITS = 52  # integers up to one bit more are exact in a double
_ANCHORS, _CANDIDATES = 256, 2_048  # sides of one product
_LEAST = np.iinfo(np.int64).min


@dataclass
class Rows:
    """Vectors of one length with whole components (exact in doubles), ordered by label and id."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray

    def part(self, rows) -> Rows:
        return Rows(self.ids[rows], self.labels[rows], self.values[rows])


def quantised(batch: pa.RecordBatch, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole components of the usable vectors of a batch (its last column), by length."""
    column = batch.column(batch.num_columns - 1)
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(np.maximum(lengths, 0))
    found = []
    for length in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == length)
        taken = values[(ends[rows] - length)[:, None] + np.arange(length)]
        usable = np.isfinite(taken).all(1)
        found.append((rows[usable], np.floor(taken[usable] * scale)))
    return found


def _usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector")
    )
    return rows.where("id is not null and label is not null and vector is not null")


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors, as int64 (cut where a product exceeds it).

    Candidates are raised by a common bias, so that no component is negative, and several of them are
    laid into separate fields of one wide integer per component. Each anchor component is multiplied
    once with it. One further component takes the bias out again and adds half a field, so that every
    field ends as score plus offset, and no field borrows from its neighbour. The wide integers are
    doubles as long as every sum stays exact in 53 bits, and Python integers beyond that.
    """
    n_a, n_c, size = len(anchors), len(candidates), anchors.shape[1]
    if n_a == 0 or n_c == 0:
        return np.zeros((n_a, n_c), np.int64)
    bias = max(0, int(-candidates.min(initial=0)))
    offset = max(1, size * int(np.abs(anchors).max(initial=0)) * (int(candidates.max(initial=0)) + bias))
    width = (2 * offset).bit_length()
    fields = _EXACT_BITS // width
    if fields == 0:
        return _wide_scores(anchors, candidates, bias, offset, width)
    per = -(-n_c // fields)
    raised = np.zeros((per * fields, size + 1))
    raised[:n_c, :size] = candidates + bias
    raised[:, size] = 1
    wide = sum(raised[k * per : (k + 1) * per] * float(1 << (k * width)) for k in range(fields))
    extra = offset - bias * anchors.sum(1, keepdims=True)
    sums = (np.hstack([anchors, extra]) @ wide.T).astype(np.int64)
    mask = (1 << width) - 1
    scores = np.concatenate([(sums >> (k * width)) & mask for k in range(fields)], axis=1)[:, :n_c]
    return scores - offset


def _wide_scores(anchors: np.ndarray, candidates: np.ndarray, bias: int, offset: int, width: int) -> np.ndarray:
    step = -(-width // 8)
    columns = [[int(x) + bias for x in column] for column in candidates.T.tolist()]
    wide = [int.from_bytes(b"".join(x.to_bytes(step, "little") for x in column), "little") for column in columns]
    ones = int.from_bytes(b"".join((1).to_bytes(step, "little") for _ in candidates), "little")
    least, most = int(_LEAST), np.iinfo(np.int64).max
    scores = np.zeros((len(anchors), len(candidates)), np.int64)
    for i, anchor in enumerate(anchors.tolist()):
        anchor = [int(x) for x in anchor]
        total = sum(a * p for a, p in zip(anchor, wide)) + (offset - bias * sum(anchor)) * ones
        data = total.to_bytes(step * len(candidates), "little")
        found = (int.from_bytes(data[k * step : (k + 1) * step], "little") - offset for k in range(len(candidates)))
        scores[i] = [min(most, max(least, s)) for s in found]
    return scores


def _narrow(values: np.ndarray) -> np.ndarray:
    """Rows whose products with each other stay exact in doubles; the few others are multiplied apart."""
    bound = (1 << (_EXACT_BITS // 2 - 2)) / max(1.0, values.shape[1]) ** 0.5
    return np.abs(values).max(1, initial=0) < bound


def _blocks(rows: Rows, size: int) -> Iterator[Rows]:
    narrow = _narrow(rows.values)
    for kind in (narrow, ~narrow):
        chosen = np.flatnonzero(kind)
        for at in range(0, len(chosen), size):
            yield rows.part(chosen[at : at + size])


class Best:
    """The ``keep`` best entries (higher score, then smaller id) of each of many rankings."""

    def __init__(self, rankings: int, keep: int):
        self.scores = np.full((rankings, keep), _LEAST)
        self.ids = np.zeros((rankings, keep), np.int64)
        self.held = np.zeros(rankings, np.int64)

    def floor(self, at: np.ndarray, least_id: int) -> np.ndarray:
        """Least score that can still enter when no id to come is below ``least_id``."""
        last, full = self.scores[at, -1], self.held[at] == self.scores.shape[1]
        return np.where(full & (self.ids[at, -1] <= least_id), last + 1, last)

    def add(self, ranking: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(ranking):
            return
        touched = np.unique(ranking)
        kept = [(t, k) for t in touched for k in range(self.held[t])]
        t, k = np.array(kept, np.int64).reshape(-1, 2).T
        ranking = np.concatenate([t, ranking])
        scores, ids = np.concatenate([self.scores[t, k], scores]), np.concatenate([self.ids[t, k], ids])
        order = np.lexsort((ids, -1 - scores, ranking))  # ~score: falling, without overflow
        ranking, scores, ids = ranking[order], scores[order], ids[order]
        place = np.arange(len(ranking)) - np.searchsorted(ranking, ranking)
        fits = place < self.scores.shape[1]
        ranking, place = ranking[fits], place[fits]
        self.scores[ranking, place], self.ids[ranking, place] = scores[fits], ids[fits]
        self.held[touched] = np.bincount(ranking, minlength=len(self.held))[touched]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ranking, place = np.nonzero(np.arange(self.scores.shape[1]) < self.held[:, None])
        return ranking, self.scores[ranking, place], self.ids[ranking, place]


def _candidates(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[Rows]:
    """Candidates of one length at a time, ordered by label and id."""
    for batch in batches:
        ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for rows, values in quantised(batch, scale):
            order = np.lexsort((ids[rows], labels[rows]))
            yield Rows(ids[rows][order], labels[rows][order], values[order])


def _positives_in(anchors: dict[int, Rows], keep: int, scale: int) -> Callable:
    """Per task: the best rows of the same label for each anchor; anchors are named by their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: Best(len(rows.ids), keep) for size, rows in anchors.items()}
        for found in _candidates(batches, scale):
            size = found.values.shape[1]
            for label in np.intersect1d(found.labels, anchors[size].labels) if size in anchors else ():
                mine = np.flatnonzero(anchors[size].labels == label)
                for block in _blocks(found.part(found.labels == label), _CANDIDATES):
                    for some in _blocks(Rows(mine, mine, anchors[size].values[mine]), _ANCHORS):
                        at = some.ids
                        scores = packed_scores(some.values, block.values)
                        enters = scores >= best[size].floor(at, block.ids.min())[:, None]
                        a, c = np.nonzero(enters & (anchors[size].ids[at][:, None] != block.ids))
                        best[size].add(at[a], scores[a, c], block.ids[c])
        for size, kept in best.items():
            at, scores, ids = kept.entries()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), size)), pa.array(at), pa.array(scores), pa.array(ids)],
                ["size", "at", "score", "id"],
            )

    return run


def _negatives_in(anchors: dict[int, Rows], positives: dict[int, tuple], keep: int, share: tuple, scale: int) -> Callable:
    """Per task: the best rows of other labels inside the range of each positive.

    ``positives`` has per length the anchor place and the least and largest score of each positive.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: Best(len(given[0]), keep) for size, given in positives.items()}
        for found in _candidates(batches, scale):
            size = found.values.shape[1]
            if size not in positives:
                continue
            places, low, high = positives[size]
            for block in _blocks(found, _CANDIDATES):
                for some in _blocks(Rows(np.arange(len(anchors[size].ids)), anchors[size].labels, anchors[size].values), _ANCHORS):
                    scores = packed_scores(some.values, block.values)
                    other = some.labels[:, None] != block.labels
                    # Positives of the block's anchors, one per anchor at a time.
                    first = np.searchsorted(places, some.ids)
                    count = np.searchsorted(places, some.ids, "right") - first
                    for k in range(count.max(initial=0)):
                        has = np.flatnonzero(count > k)
                        p = first[has] + k
                        floor = np.maximum(low[p], best[size].floor(p, block.ids.min()))[:, None]
                        mine = scores[has]
                        a, c = np.nonzero((mine >= floor) & (mine <= high[p][:, None]) & other[has])
                        best[size].add(p[a], mine[a, c], block.ids[c])
        for size, kept in best.items():
            at, scores, ids = kept.entries()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), size)), pa.array(at), pa.array(scores), pa.array(ids)],
                ["size", "at", "score", "id"],
            )

    return run


_FOUND = "size long, at long, score long, id long"


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = W.partitionBy("size", "at").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _anchor_rows(scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in quantised(batch, scale):
                data = [v.tobytes() for v in values]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                     pa.array(np.full(len(rows), values.shape[1])), pa.array(data, pa.binary())],
                    ["id", "label", "size", "data"],
                )

    return run


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, id_col: str = "vec_id",
    vector_col: str = "embedding", positives: int = 5, negatives: int = 3, least: tuple[int, int] = (1, 2),
    most: tuple[int, int] = (19, 20), scale: int = SCALE, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Hard negatives of each anchor and each of its best positives, searched among all rows.

    ``anchors`` says which rows are anchors, ``label`` how rows are labelled (the column of that name).
    Components become ``floor(scale * x)``; scores are whole inner products, higher first, then smaller
    ids. Positives are the first rows of the anchor's label with another id; negatives the first rows
    of other labels whose score lies between ``least`` and ``most`` (fractions) of the positive's.

    Rows without id, label or vector, or with a component that is null or not finite, take no part.
    Only vectors of one length meet. Repeated rows are rows of their own: each is listed, and an anchor
    given twice is searched twice. Scores that exceed a long are cut to it. Empty tables give no rows;
    other columns are ignored.

    Anchors meet the candidates in passes: at most about ``chunk_bytes`` of anchors are sent to the
    tasks at once, so that neither the driver nor a task holds more, whatever their number. Tasks keep
    the best entries only; candidates are read twice per pass and never shuffled.
    """
    spark = ready(vectors.sparkSession)
    label = F.col("label") if label is None else label
    rows = _usable(vectors, id_col, label, vector_col)
    chosen = _usable(vectors.where(anchors), id_col, label, vector_col)
    kept = written(chosen.mapInArrow(_anchor_rows(scale), "id long, label long, size long, data binary"), "anchors")
    total = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * 8 + 64).alias("b")).first()
    passes = -(-int(total["b"] or 0) // chunk_bytes)
    part = F.pmod(F.xxhash64("id", "data"), F.lit(max(1, passes)))
    path = shared_folder(spark, "hard-negatives")
    schema = (
        "anchor_id long, positive_id long, positive_no int, rank int, negative_id long, positive_score long, "
        "negative_score long"
    )
    for number in range(passes):
        table = kept.where(part == number).orderBy("size", "label", "id", "data").toArrow().to_pydict()
        held = _by_length(table)
        if not held:
            continue
        sent = spark.sparkContext.broadcast(held)
        found = rows.mapInArrow(_lazily(sent, lambda a: _positives_in(a, positives, scale)), _FOUND)
        best = _ranked(found, positives).orderBy("size", "at", "rank").toArrow()
        ranges, named = _ranges(best, least, most)
        found = rows.mapInArrow(
            _lazily(sent, lambda a: _negatives_in(a, ranges, negatives, (least, most), scale)), _FOUND
        )
        ids = {size: held[size].ids for size in held}
        pairs = spark.createDataFrame(
            [(s, at, int(ids[s][a]), p, no, v) for s, at, a, p, no, v in named],
            "size long, at long, anchor_id long, positive_id long, positive_no int, positive_score long",
        )
        out = _ranked(found, negatives).join(F.broadcast(pairs), ["size", "at"])  # a chunk's pairs
        out.select(
            "anchor_id", "positive_id", "positive_no", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(path)
        sent.destroy()
    if not passes:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _by_length(table: dict) -> dict[int, Rows]:
    sizes = np.array(table["size"], np.int64)
    ids, labels = np.array(table["id"], np.int64), np.array(table["label"], np.int64)
    held = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        values = np.frombuffer(b"".join(table["data"][i] for i in at)).reshape(len(at), size)
        held[size] = Rows(ids[at], labels[at], values)
    return held


def _lazily(sent, make: Callable) -> Callable:
    """The task function over the anchors that were sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(sent.value)(batches)

    return run


def _ranges(best: pa.Table, least: tuple[int, int], most: tuple[int, int]) -> tuple[dict, list]:
    """Score ranges of all positives of a chunk by length, in order of their anchors, and what they are."""
    ranges, named = {}, []
    columns = {name: np.array(best.column(name).to_pylist(), np.int64) for name in ("size", "at", "rank", "score", "id")}
    for size in np.unique(columns["size"]).tolist():
        mine = np.flatnonzero(columns["size"] == size)
        at, scores = columns["at"][mine], columns["score"][mine].tolist()
        low = [-(-s * least[0] // least[1]) for s in scores]
        high = [s * most[0] // most[1] for s in scores]
        ranges[size] = (at, np.array(low, np.int64), np.array(high, np.int64))
        named += zip(
            [size] * len(at), range(len(at)), at.tolist(), columns["id"][mine].tolist(),
            columns["rank"][mine].tolist(), scores,
        )
    return ranges, named
