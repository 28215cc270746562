"""Log-bilinear language model, trained by noise-contrastive estimation, with a unigram base line."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, ready, written

SPELLINGS = 256  # classes of tokens without a class of their own, by their spelling
LEAST_WORDS, MOST_WORDS = 256, 1_280  # bounds of the tokens with a class of their own: the root of all distinct ones
DIMENSIONS = 24
NOISE = 32
BATCH = 8_192
RATE = 0.1
UNIGRAM_SHARE = 0.02
HEAD = 1 << 17  # most frequent tokens whose counts every task knows; others are looked up by a join
SHARD = 1 << 21  # tokens that one copy of the model learns from between two averages
ROUNDS = 4  # averages over all shards, each over another part of them
END = b""  # no word is empty
_CACHE = 400_000
_FLUSH = 250_000
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").translate(_ASCII_LOWER).split(), END]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(tally):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], ["token", "n"]
        )

    tally: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            tally.update(tokens_of(text))
            if len(tally) > _FLUSH:
                yield out(tally)
                tally = Counter()
    yield out(tally)


@dataclass
class Model:
    context: np.ndarray  # (classes + 1, d), the last row stands before the text
    target: np.ndarray  # (classes, d)
    bias: np.ndarray  # (classes,)
    position: np.ndarray  # (2, d): weights of the last and the second last token

    @classmethod
    def fresh(cls, noise: np.ndarray) -> Model:
        rng = np.random.default_rng(11)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(
            draw(len(noise) + 1, DIMENSIONS), draw(len(noise), DIMENSIONS), np.log(noise).astype(np.float32),
            np.ones((2, DIMENSIONS), np.float32),
        )

    def rows(self) -> np.ndarray:
        """All parameters as rows of the same width."""
        wide = np.zeros((-(-len(self.bias) // DIMENSIONS), DIMENSIONS), np.float32)
        wide.ravel()[: len(self.bias)] = self.bias
        return np.concatenate([self.context, self.target, self.position, wide])

    @classmethod
    def from_rows(cls, rows: np.ndarray, classes: int) -> Model:
        at = np.cumsum([classes + 1, classes, 2])
        return cls(rows[: at[0]], rows[at[0] : at[1]], rows[at[2] :].ravel()[:classes], rows[at[1] : at[2]])


def _scatter(shape: tuple[int, int], index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the value rows of each index."""
    out = np.zeros(shape, np.float32)
    order = np.argsort(index.astype(np.uint16), kind="stable")  # sorted by digits
    ordered = index[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    out[ordered[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Trainer:
    """Noise-contrastive estimation with noise classes shared by a batch, and Adagrad steps."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.m, self.noise = model, noise
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.sums = [np.full(p.shape, 1e-3, np.float32) for p in (model.context, model.target, model.bias, model.position)]
        self.rng = np.random.default_rng(seed)
        self.cut = np.cumsum(noise)

    def step(self, last: np.ndarray, before: np.ndarray, target: np.ndarray) -> None:
        m, n = self.m, len(target)
        a, b = m.context[last], m.context[before]
        h = a * m.position[0] + b * m.position[1]
        q = m.target[target]
        drawn = np.minimum(np.searchsorted(self.cut, self.rng.random(NOISE)), len(m.bias) - 1)
        right = _sigmoid(np.einsum("ij,ij->i", h, q) + m.bias[target] - self.log_noise[target]) - 1
        wrong = _sigmoid(h @ m.target[drawn].T + (m.bias[drawn] - self.log_noise[drawn]))
        dh = right[:, None] * q + wrong @ m.target[drawn]
        d_target = _scatter(m.target.shape, target, right[:, None] * h)
        np.add.at(d_target, drawn, wrong.T @ h)
        d_bias = np.bincount(target, right, len(m.bias)).astype(np.float32)
        np.add.at(d_bias, drawn, wrong.sum(axis=0))
        d_context = _scatter(m.context.shape, last, dh * m.position[0])
        d_context += _scatter(m.context.shape, before, dh * m.position[1])
        d_position = np.stack([(dh * a).sum(axis=0), (dh * b).sum(axis=0)])
        for p, g, s in zip((m.context, m.target, m.bias, m.position), (d_context, d_target, d_bias, d_position), self.sums):
            g /= n
            s += g * g
            p -= RATE * g / np.sqrt(s)


def _histories(parts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last and second last class before each token of several texts, and the token's class."""
    pad = np.full(2, start, np.uint16)
    joined = np.concatenate([x for part in parts for x in (pad, part)]).astype(np.int32)
    sizes = np.array([len(p) for p in parts])
    at = np.arange(sizes.sum()) + np.repeat(2 * np.arange(1, len(parts) + 1), sizes)
    return joined[at - 1], joined[at - 2], joined[at]


def _training(shared: Broadcast):
    """Each shard, whose rows follow each other, teaches a copy of the model of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noise, rows = shared.value
        trainer, current, seen, parts, held = None, None, 0, [], 0

        def learn():
            last, before, target = _histories(parts, len(noise))
            for s in range(0, len(target), BATCH):
                trainer.step(last[s : s + BATCH], before[s : s + BATCH], target[s : s + BATCH])

        def finished():
            if parts:
                learn()
            out = trainer.m.rows()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(out), dtype=np.int32)), pa.array(np.full(len(out), float(seen + held))),
                 pa.array(list(out), pa.list_(pa.float32()))],
                ["at", "weight", "vector"],
            )

        for batch in batches:
            for shard, classes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != current:
                    if trainer is not None:
                        yield finished()
                    trainer, current, seen, parts, held = Trainer(Model.from_rows(rows.copy(), len(noise)), noise, 5), shard, 0, [], 0
                parts.append(np.frombuffer(classes, np.uint16))
                held += len(parts[-1])
                if held >= 8 * BATCH:
                    learn()
                    seen, parts, held = seen + held, [], 0
        if trainer is not None:
            yield finished()

    return run


@dataclass
class Language:
    """All that scoring needs: counts of frequent tokens, classes, model and normalisers."""

    words: list[bytes]
    head: dict[bytes, int]
    total: int  # N
    distinct: int  # V
    class_total: np.ndarray  # of the spelling classes
    class_distinct: np.ndarray
    noise: np.ndarray
    model: Model | None = None
    log_z: np.ndarray | None = None  # (classes + 1, classes + 1): last, second last


def _normalisers(model: Model) -> np.ndarray:
    """Log normaliser of every pair of context classes, by batched matrix products."""
    size = len(model.context)
    out = np.empty((size, size), np.float32)
    second = model.context * model.position[1]
    for last in range(size):
        logits = (second + model.context[last] * model.position[0]) @ model.target.T + model.bias
        top = logits.max(axis=1)
        out[last] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
    return out


def _frequent(counts: DataFrame) -> dict[bytes, int]:
    """The ``HEAD`` most frequent tokens, about, with counts; ties by hash.

    Whole count levels are taken from the top, sixteenths of a power of two, and of the next one the
    share that is still free, the first ones by hash. There are some hundred levels; nothing is sorted.
    """
    level = F.floor(F.log2("c") * 16)
    cut, share, taken = None, 0.0, 0
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        cut, share = row["level"], min(1.0, (HEAD - taken) / row["n"])
        taken += row["n"]
        if taken >= HEAD:
            break
    if cut is None:
        return {}
    place = F.pmod(F.xxhash64("token"), F.lit(1 << 30))
    rows = counts.where((level > cut) | ((level == cut) & (place < F.lit(int(share * (1 << 30)))))).toArrow()
    return dict(zip(rows.column("token").to_pylist(), rows.column("c").to_pylist()))


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, fold: int = 0) -> tuple[Language, DataFrame]:
    """Vocabulary of all documents outside the held-out fold, without a model yet, and the stored
    counts ``token, c`` of all their tokens.

    The number of tokens with a class of their own grows with the root of all distinct ones, between
    ``LEAST_WORDS`` and ``MOST_WORDS``: beyond that the table of normalisers would not fit the tasks.
    """
    ready(docs.sparkSession)
    learned = docs.where(~held_out(id_col, modulus, fold)).select(F.col(text_col).alias("text"))
    counts = written(
        learned.mapInArrow(_counts, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c")), "counts"
    )
    spelling = F.crc32(F.substring("token", 1, 3)) % F.lit(SPELLINGS)
    by_class = counts.groupBy(spelling.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    head = _frequent(counts)
    class_total, class_distinct = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    for r in by_class:
        class_total[r["k"]], class_distinct[r["k"]] = r["c"], r["v"]
    total, distinct = int(class_total.sum()), int(class_distinct.sum())
    own = min(MOST_WORDS, max(LEAST_WORDS, int(distinct**0.5)))
    words = sorted(head, key=lambda t: (-head[t], t))[:own]
    for word in words:
        class_total[zlib.crc32(word[:3]) % SPELLINGS] -= head[word]
        class_distinct[zlib.crc32(word[:3]) % SPELLINGS] -= 1
    frequency = np.concatenate([[head[w] for w in words], class_total])
    noise = (frequency + 1) / (frequency + 1).sum()
    return Language(words, head, total, distinct, class_total, class_distinct, noise), counts


def encode(
    docs: DataFrame, language: Language, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, fold: int = 0
) -> DataFrame:
    """Stored rows of all documents: class numbers of their tokens, and all of their scores that needs
    no model; the tokens whose counts are not shipped are listed."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    schema = (
        f"id {id_type}, n_tokens long, known long, base double, score double, tail array<binary>, times array<long>, "
        "classes binary"
    )
    return written(
        rows.mapInArrow(_encoded(spark.sparkContext.broadcast(language)), schema)
        .withColumns({"row": F.monotonically_increasing_id(), "held_out": held_out("id", modulus, fold)}),
        "encoded",
    )


def fit(encoded: DataFrame, language: Language) -> Language:
    """The language with a model that has seen every training token once.

    Documents are dealt by hash into shards of about ``SHARD`` tokens, and the shards into rounds. In a
    round each shard teaches a copy of the model; the copies are averaged by tokens, as sums of rows,
    and the average starts the next round. Shards follow from the documents alone, so the result does
    not depend on partitions or tasks.
    """
    spark, noise = encoded.sparkSession, language.noise
    model = Model.fresh(noise)
    shards = max(1, -(-language.total // SHARD))
    rounds = min(ROUNDS, shards)
    mix = F.xxhash64("id", "classes")
    dealt = encoded.where("not held_out").select(F.pmod(mix, F.lit(shards)).alias("shard"), "classes", mix.alias("mix"))
    for number in range(rounds if language.total else 0):
        shared = spark.sparkContext.broadcast((noise, model.rows()))
        mine = dealt.where(F.col("shard") % rounds == number)
        mine = mine.repartition(-(-shards // rounds), "shard").sortWithinPartitions("shard", "mix", "classes")
        parts = mine.select("shard", "classes").mapInArrow(_training(shared), "at int, weight double, vector array<float>")
        sums = [F.sum(F.col("weight") * F.col("vector")[i]).alias(f"s{i}") for i in range(DIMENSIONS)]
        table = parts.groupBy("at").agg(F.sum("weight").alias("w"), *sums).orderBy("at").toArrow()
        weights = table.column("w").to_numpy()[:, None]
        stacked = np.stack([table.column(f"s{i}").to_numpy() for i in range(DIMENSIONS)], axis=1)
        if len(stacked):
            model = Model.from_rows((stacked / weights).astype(np.float32), len(noise))
        shared.unpersist()
    return replace(language, model=model, log_z=_normalisers(model))


class Encoder:
    """Class numbers of whole texts, scores as far as the frequent tokens go, and the tokens that need a look-up.

    Every token seen has a row of numbers; the frequent tokens keep theirs, the others are forgotten
    once there are too many.
    """

    def __init__(self, language: Language):
        self.base_total = np.log10(language.total + 0.1 * (language.distinct + 1))
        below = np.log10(language.class_total + 0.1 * (language.class_distinct + 1))
        self.below = np.concatenate([np.zeros(len(language.words)), below])
        own = {w: i for i, w in enumerate(language.words)}
        self.own = len(own)
        frequent = list(language.head)
        self.frequent = len(frequent)
        self.fixed = {t: i for i, t in enumerate(frequent)}
        self.rows = dict(self.fixed)
        self.kind = np.zeros(self.frequent + _CACHE, np.uint16)
        self.kind[: self.frequent] = [own[t] if t in own else self.spelt(t) for t in frequent]
        self.value = np.zeros(self.frequent + _CACHE)
        self.value[: self.frequent] = np.log10(np.array([language.head[t] for t in frequent], np.float64) + 0.1)
        # Words with a class of their own have all of their probability from the model.
        self.inside = np.where(self.kind < self.own, 0.0, self.value)

    def spelt(self, token: bytes) -> int:
        return self.own + zlib.crc32(token[:3]) % SPELLINGS

    def __call__(self, text: bytes | None) -> tuple[int, int, float, float, dict[bytes, int], bytes]:
        """Tokens, known ones, base and model scores without looked-up tokens and classes, these tokens, classes."""
        tokens = tokens_of(text)
        rows = self.rows
        fresh = set(tokens).difference(rows)
        if len(rows) + len(fresh) > len(self.kind):
            rows = self.rows = dict(self.fixed)
            fresh = set(tokens).difference(rows)
            if len(rows) + len(fresh) > len(self.kind):
                self.kind, self.value, self.inside = (
                    np.concatenate([x, np.zeros(len(fresh), x.dtype)]) for x in (self.kind, self.value, self.inside)
                )
        for token in fresh:
            self.kind[len(rows)] = self.spelt(token)
            rows[token] = len(rows)
        at = np.fromiter(map(rows.__getitem__, tokens), np.int32, len(tokens))
        classes = self.kind[at]
        tail = Counter(tokens[i] for i in np.flatnonzero(at >= self.frequent))
        base = float(self.value[at].sum()) - len(tokens) * self.base_total
        score = float(self.inside[at].sum()) - float(self.below[classes].sum())
        return len(tokens), len(tokens) - tail.total(), base, score, tail, classes.tobytes()


def _encoded(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
        names = ["id", "n_tokens", "known", "base", "score", "tail", "times", "classes"]
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                n, known, base, score, tail, classes = encoder(text)
                for column, found in zip(columns, (n, known, base, score, list(tail), list(tail.values()), classes)):
                    column.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return run


def class_scores(language: Language, parts: list[np.ndarray]) -> np.ndarray:
    """Natural log probabilities of the class of every token of some texts, after the classes before it."""
    model, log_noise = language.model, np.log(language.noise)
    last, before, target = _histories(parts, len(language.noise))
    logs = np.empty(len(target))
    for s in range(0, len(target), 65_536):
        part = slice(s, s + 65_536)
        h = model.context[last[part]] * model.position[0] + model.context[before[part]] * model.position[1]
        logit = np.einsum("ij,ij->i", h, model.target[target[part]]) + model.bias[target[part]]
        logs[part] = logit - language.log_z[last[part], before[part]]
    return np.logaddexp(np.log(1 - UNIGRAM_SHARE) + logs, np.log(UNIGRAM_SHARE) + log_noise[target])


def _scored(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(c, np.uint16) for c in batch.column(1).to_pylist()]
            if texts:
                logs = class_scores(shared.value, texts)
                ends = np.cumsum([len(t) for t in texts])  # every text has a token, its end
                sums = np.add.reduceat(logs, np.append(0, ends[:-1])) / np.log(10)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums)], ["row", "log"])

    return run


def score_encoded(encoded: DataFrame, language: Language, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Scores of encoded documents, see :func:`score`."""
    spark = ready(encoded.sparkSession)
    rare = encoded.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", "t.tail", "t.times")
    seen = rare.join(counts.withColumnRenamed("token", "tail"), "tail", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    extra = seen.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + F.lit(0.1))).alias("value"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"),
    )
    logs = encoded.select("row", "classes").mapInArrow(
        _scored(spark.sparkContext.broadcast(language)), "row long, log double"
    )
    value, more = F.coalesce("value", F.lit(0.0)), F.coalesce("more", F.lit(0))
    rows = encoded.select("row", "id", "held_out", "n_tokens", "known", "base", "score")
    return rows.join(logs, "row").join(extra, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(language.total).cast("long").alias("train_tokens"), (F.col("base") + value).alias("base_score"),
        (F.col("score") + F.col("log") + value).alias("score"),
    )


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, fold: int = 0
) -> DataFrame:
    """Rows ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document.

    The probability of a token is that of its class after the two classes before it, normalised over
    all classes, times its smoothed share of the class, which leaves room for unseen tokens. The model
    learns from the documents outside the held-out fold. Null and empty texts are the end token alone;
    repeated rows are returned as given; a null id counts as held out; other columns are ignored.
    Texts are read twice, to count their tokens and to encode them; model and scores use the stored
    class numbers. Counts of the most frequent tokens are shipped to the tasks; the rarer tokens of
    each document are summed up by a join with all counts.
    """
    language, counts = count(docs, id_col, text_col, modulus, fold)
    encoded = encode(docs, language, id_col, text_col, modulus, fold)
    return score_encoded(encoded, fit(encoded, language), counts, id_col)
