"""Quality classifier learned from trusted positives and unlabelled text with a non-negative risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, ready
from .sampling import labelled_sample, unlabelled_sample

POSITIVES = 8_000
UNLABELLED = 16_000
BINS = 16

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOL = np.frombuffer(b"#*$%&|<>{}[]@^~_=+\\/", np.uint8)
_SPACE = np.array([0x20, *range(0x09, 0x0E)], np.uint8)
_SHARES = (b".", b",", b"!", b"|", b"*", b"#", b"<", b":", b"/", b"@", b"-", b";", b"(", b"&")
N_FEATURES = 22 + len(_SHARES)


def measures(text: bytes | None) -> list[float]:
    """Measures of form of one whole text: lengths, shares of character classes, repetition of words and lines."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    words = text.split()
    n = len(words)
    some = max(1, n)
    lower = text.lower().split()
    tally = Counter(lower)
    most = max(tally.values(), default=0)
    same = sum(map(bytes.__eq__, lower, lower[1:]))
    triples = len(set(zip(lower, lower[1:], lower[2:]))) / max(1, n - 2)
    lines = [line for line in text.split(b"\n") if line.strip()]
    short = sum(map((3).__gt__, map(len, words)))
    longest = max(map(len, words), default=0)
    letters = int(counts[_UPPER].sum() + counts[_LOWER].sum())
    ends = int(counts[46] + counts[33] + counts[63])
    starts_big = sum(map(bytes.istitle, (w[:1] for w in words)))
    return [
        np.log1p(n), np.log1p(len(lines)), len(text) / some, longest, short / some,
        len(tally) / some, most / some, same / some, triples,
        1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), n / (ends + 1),
        counts[_UPPER].sum() / max(1, letters), counts[_DIGIT].sum() / size, counts[_SYMBOL].sum() / size,
        counts[128:].sum() / size, letters / size, counts[_SPACE].sum() / size, starts_big / some,
        sum(map(bytes.isupper, words)) / some, sum(map(bytes.isalpha, words)) / some,
        np.log1p(max(map(len, lines), default=0)),
        *(int(counts[c[0]]) / size for c in _SHARES),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(measures(t), np.float64).tobytes() for t in batch.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["measures"])


@dataclass
class Model:
    edges: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (features, BINS)
    bias: float
    prior: float

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, i], "right") for i, e in enumerate(self.edges)], axis=1)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(len(self.edges)), self.bins(rows)].sum(axis=1) + self.bias


def _descend(model: Model, positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int, ridge: float = 1e-3):
    """Adam on the non-negative unbiased risk with the logistic loss; ``prior`` is the share of positives.

    Risk: ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``. Where the second part is negative, its
    gradient is reversed, so that it cannot be pushed below zero by overfitting.
    """
    width = len(model.edges)
    cell = np.arange(width) * BINS
    p, u = model.bins(positive) + cell, model.bins(unlabelled) + cell
    w, bias = np.zeros(width * BINS), 0.0
    m, v = np.zeros(width * BINS + 1), np.zeros(width * BINS + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        zp, zu = w[p].sum(axis=1) + bias, w[u].sum(axis=1) + bias
        wrong = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gain = prior * (sigmoid(zp) - 1) / len(zp)
        part_p, part_u = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        if wrong >= 0:
            slope_p, slope_u = gain + part_p, part_u
        else:
            slope_p, slope_u = -part_p, -part_u
        gradient = np.bincount(p.ravel(), np.repeat(slope_p, width), width * BINS)
        gradient += np.bincount(u.ravel(), np.repeat(slope_u, width), width * BINS)
        whole = np.append(gradient + ridge * w, slope_p.sum() + slope_u.sum())
        m, v = 0.9 * m + 0.1 * whole, 0.999 * v + 0.001 * whole**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    model.weights, model.bias = w.reshape(width, BINS), float(bias)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled scores: the least ratio of the two upper tails, where negatives
    are rare, with a margin for the size of both samples."""
    cuts = np.quantile(positive, np.linspace(0.01, 0.2, 20))
    tail_p = np.array([(positive >= c).mean() for c in cuts])
    tail_u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(tail_u * (1 - tail_u) / len(unlabelled)) + np.sqrt(tail_p * (1 - tail_p) / len(positive))
    return float(np.clip(((tail_u + margin) / tail_p).min(), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 300) -> Model:
    """Additive model over binned measures. Without positives or unlabelled rows it gives one half."""
    pooled = np.concatenate([positive, unlabelled])
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((N_FEATURES, BINS - 1)), np.zeros((N_FEATURES, BINS)), 0.0, 0.5)
    # Rare values matter most: half of the cuts lie in the outer tenths.
    levels = np.concatenate([[0.005, 0.01, 0.02, 0.05], np.linspace(0.1, 0.9, BINS - 9), [0.95, 0.98, 0.99, 0.995]])
    model = Model(np.quantile(pooled, levels, axis=0).T, np.zeros((positive.shape[1], BINS)), 0.0, 0.5)
    _descend(model, positive, unlabelled, 0.5, rounds // 2)
    model.prior = estimate_prior(model.logits(positive), model.logits(unlabelled))
    _descend(model, positive, unlabelled, model.prior, rounds)
    return model


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    modulus: int = 3, fold: int = 1, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Model:
    """Model from at most so many trusted positives and unlabelled texts outside the held-out fold."""
    ready(docs.sparkSession)

    def rows(texts: DataFrame) -> np.ndarray:
        found = texts.select("text").mapInArrow(_measured, "measures binary").toArrow().column(0).to_pylist()
        return np.frombuffer(b"".join(found), np.float64).reshape(-1, N_FEATURES)

    trusted = labelled_sample(docs, labels.where(F.col(label_col) == 1), id_col, text_col, label_col, modulus, fold, positives)
    return fit(rows(trusted), rows(unlabelled_sample(docs, id_col, text_col, modulus, fold, unlabelled)))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.array([measures(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.float64)
            scores = 1 / (1 + np.exp(-np.clip(model.logits(rows), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return run


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, fold: int = 1
) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted`` for every document, in one pass without a shuffle.

    Null and empty texts are scored by their measures, which are all zero or empty; repeated rows are
    returned as given; a null id counts as held out. Other columns are ignored.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    found = rows.mapInArrow(_scored(model), f"id {id_type}, score double")
    return found.select(
        F.col("id").alias(id_col),
        held_out("id", modulus, fold).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
