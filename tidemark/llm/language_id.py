"""Language of whole texts by a string kernel: shared n-grams with landmark texts, ridge regression on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import held_out, ready, written

LONGEST = 3  # n-grams of one to three bytes of the lower-cased UTF-8 text
SAMPLE = 2_000  # different labelled texts per language, in expectation
LANDMARKS = 32  # of them per language, and at most ALL_LANDMARKS of all languages
ALL_LANDMARKS = 512
RIDGE = 1e-3
UNKNOWN = "und"

_ROWS, _BYTES = 64, 1 << 20  # texts of one matrix product, bytes turned to n-grams at once
_SLOTS = 1 << 30


def grams_at(data: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n-grams that begin at each byte; those of each length follow the shorter ones."""
    code = np.full(max(0, len(data) - n + 1), sum(256**k for k in range(1, n)), np.int32)
    for k in range(n):
        code += data[k : k + len(code)].astype(np.int32) << (8 * k)
    return code


def spectrum(data: np.ndarray) -> np.ndarray:
    """Distinct n-grams of one text."""
    return np.unique(np.concatenate([grams_at(data, n) for n in range(1, LONGEST + 1)]))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the borders of its texts; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), borders


@dataclass
class Kernel:
    """Presence kernel to fixed landmark texts over the n-grams that at least two of them hold.

    ``k(x, l)`` is the number of these n-grams that both texts hold, divided by the root of the product
    of how many each holds. A text without any has a kernel of zero to every landmark.
    """

    grams: np.ndarray
    landmarks: list[np.ndarray]
    _matrix: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def over(cls, texts: list[np.ndarray]) -> Kernel:
        held, times = np.unique(np.concatenate(texts), return_counts=True) if texts else (np.zeros(0, np.int32), [])
        grams = held[np.asarray(times) >= min(2, len(texts))]
        kept = [np.flatnonzero(np.isin(grams, t)).astype(np.int32) for t in texts]
        return cls(grams, [k for k in kept if len(k)])

    def open(self) -> Kernel:
        """Lay out the look-up table and the landmark matrix, once per task."""
        size = len(self.grams)
        self._matrix = np.zeros((size + 1, len(self.landmarks)), np.float32)
        for j, held in enumerate(self.landmarks):
            self._matrix[held, j] = 1 / np.sqrt(len(held))
        codes = sum(256**k for k in range(1, LONGEST + 1))
        self._place = np.full(codes, size, np.uint16 if size < 1 << 16 else np.int32)
        self._place[self.grams] = np.arange(size)
        return self

    def rows(self, data: np.ndarray, borders: np.ndarray) -> Iterator[np.ndarray]:
        """Kernel values of texts to all landmarks, some texts at a time."""
        size, at = len(self.grams), 0
        while at < len(borders) - 1:
            upto = min(at + _ROWS, int(np.searchsorted(borders, borders[at] + _BYTES, "right")) - 1, len(borders) - 1)
            upto = max(upto, at + 1)
            held = np.zeros((upto - at, size + 1), np.float32)
            flat = held.reshape(-1)
            for start in range(int(borders[at]), int(borders[upto]), _BYTES):  # one text may be long
                stop = min(int(borders[upto]), start + _BYTES + LONGEST - 1)
                row = np.searchsorted(borders[at + 1 : upto + 1], np.arange(start, stop), "right") if upto > at + 1 else None
                for n in range(1, LONGEST + 1):
                    column = self._place[grams_at(data[start:stop], n)].astype(np.int64)
                    if row is not None and len(column):
                        column[row[: len(column)] != row[n - 1 :]] = size  # over the end of a text
                        column += row[: len(column)] * (size + 1)
                    flat[column] = 1
            held[:, size] = 0
            own = np.sqrt(np.maximum(held.sum(1, keepdims=True), 1))
            yield (held @ self._matrix) / own
            at = upto


@dataclass
class Model:
    kernel: Kernel
    languages: list[str]
    weights: np.ndarray  # landmarks x languages


def _landmark_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, borders = _bytes_of(batch.column(1))
        found = [spectrum(data[a:b]).astype(np.int32).tobytes() for a, b in zip(borders, borders[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["slot", "grams"])


def _sums(kernel: Kernel, embed: np.ndarray, weight: np.ndarray):
    """Per task: weighted sums of outer products of the embedded texts with themselves and with their targets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.open()
        gram, target, seen = np.zeros((embed.shape[1],) * 2), np.zeros((embed.shape[1], len(weight))), 0
        for batch in batches:
            which, at = batch.column(0).to_numpy(), 0
            for values in kernel.rows(*_bytes_of(batch.column(1))):
                points, mine = values @ embed, which[at : at + len(values)]
                shares = weight[mine][:, None]
                gram += points.T @ (points * shares)
                np.add.at(target.T, mine, points * shares)
                at += len(values)
            seen += at
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([gram.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary())], ["gram", "target"]
            )

    return run


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5,
    fold: int = 0, bound: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE,
) -> Model:
    """Nyström landmarks and one ridge regression per language, from texts outside the held-out fold.

    About ``bound`` different texts of each language are taken by their hash, all where a language has
    fewer; ``landmarks`` of them, the first ones by hash, span the kernel space. Texts without a
    letter, rows without language or id teach nothing. Languages weigh the same, copies of a text in
    one language once. Sums over the sample are made in tasks; the driver gets the n-grams of the
    landmarks and one pair of small matrices per task. Without any learned language the model is empty.
    """
    ready(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & has_letter(F.col("text")) & ~held_out("id", modulus, fold))
    rows = rows.withColumn("slot", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("slot").alias("texts")).collect()
    sizes = sorted((r["lang"], max(1, r["texts"])) for r in sizes)
    languages = [name for name, _ in sizes]
    if not languages:
        return Model(Kernel.over([]), [], np.zeros((0, 0)))
    known = docs.sparkSession.createDataFrame(
        [(name, i, min(_SLOTS, bound * _SLOTS // n)) for i, (name, n) in enumerate(sizes)], "lang string, which int, top long"
    )
    chosen = rows.join(F.broadcast(known), "lang").where(F.pmod("slot", F.lit(_SLOTS)) < F.col("top"))
    sample = written(
        chosen.groupBy("which", "slot").agg(F.min("text").alias("text")).repartition(8, "slot"), "languages"
    )
    per = max(1, min(landmarks, ALL_LANDMARKS // len(languages)))
    order = W.partitionBy("which").orderBy(F.pmod("slot", F.lit(_SLOTS)), "slot")
    first = sample.withColumn("no", F.row_number().over(order)).where(F.col("no") <= per)
    spanned = first.select("slot", "text").mapInArrow(_landmark_grams, "slot long, grams binary").toArrow()
    spanned = sorted(zip(spanned.column("slot").to_pylist(), spanned.column("grams").to_pylist()))
    kernel = Kernel.over([np.frombuffer(g, np.int32) for _, g in spanned])

    # The landmarks' own kernel; directions that it hardly spans are left out.
    kernel.open()
    own = kernel._matrix.T.astype(np.float64) @ kernel._matrix
    values, vectors = np.linalg.eigh(own)
    spans = values > 1e-6 * max(1e-12, values.max(initial=0))
    embed = vectors[:, spans] / np.sqrt(values[spans])
    kernel._matrix = kernel._place = None
    counts = {r["which"]: r["count"] for r in sample.groupBy("which").count().collect()}
    weight = np.array([1 / counts[i] / len(counts) if i in counts else 0.0 for i in range(len(languages))])
    parts = sample.select("which", "text").mapInArrow(_sums(kernel, embed, weight), "gram binary, target binary").toArrow()
    size = embed.shape[1]
    gram = sum((np.frombuffer(g).reshape(size, size) for g in parts.column("gram").to_pylist()), np.zeros((size, size)))
    target = sum((np.frombuffer(t).reshape(size, -1) for t in parts.column("target").to_pylist()), np.zeros((size, len(languages))))
    solved = np.linalg.solve(gram + ridge / max(1, len(languages)) * np.eye(size), target)
    return Model(kernel, languages, embed @ solved)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.kernel.open()
        weights = model.weights.astype(np.float32)
        for batch in batches:
            parts = [values @ weights for values in model.kernel.rows(*_bytes_of(batch.column(2)))]
            found = np.concatenate(parts) if parts else np.zeros((0, len(model.languages)))
            best = found.argmax(1)
            top = np.clip(found[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)
            names = pa.array(model.languages, pa.string()).take(pa.array(best))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), names, pa.array(top)], ["id", "lettered", "lang", "score"]
            )

    return run


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, fold: int = 0
) -> DataFrame:
    """Rows ``doc_id, held_out, lang_pred, score`` for every document, in one pass without a shuffle.

    The score is the language's regression value, cut to 0 … 1. A null text or one without a letter is
    ``und`` with score 0, and so is every text under an empty model; a null id counts as held out.
    Repeated rows are returned as given, other columns are ignored. Whole texts are read, long ones in
    pieces that overlap.
    """
    ready(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"), has_letter(F.col(text_col)).alias("lettered"), F.lower(F.col(text_col)).alias("text")
    )
    if model.languages:
        id_type = dict(rows.dtypes)["id"]
        rows = rows.mapInArrow(_predict(model), f"id {id_type}, lettered boolean, lang string, score double")
    else:
        rows = rows.select("id", F.lit(False).alias("lettered"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score"))
    return rows.select(
        F.col("id").alias(id_col), held_out("id", modulus, fold).alias("held_out"),
        F.when(F.col("lettered"), F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"),
    )
