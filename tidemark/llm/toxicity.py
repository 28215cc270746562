"""Toxicity classifier whose scores are held still when identity terms are swapped."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, ready, written
from .sampling import class_shares, labelled_sample

DIMENSIONS = 1 << 18
PREFIXES = (4, 5, 6)
SAMPLE = 8_000  # labelled ids per class
L1 = 5e-4
MIN_APART = 4.0  # standard errors between the class shares of a feature
MIN_TEXTS = 5
COUNTERFACTUAL = 1.0
_WORD_CACHE = 400_000

MOST_TERMS = 10_000  # identity terms that a list may have

# Terms that name groups of people, where no list is given; a term is swapped for the others of its row.
IDENTITY_TERMS = (
    ("women", "men", "woman", "man", "female", "male", "girls", "boys"),
    ("frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous", "arab"),
    ("african", "american", "european", "mexican", "chinese", "indian", "russian", "turkish"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "old", "young", "elderly"),
)

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_SENTENCE = re.compile(rb"[.!?\n]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def features_of(word: bytes) -> list[int]:
    """Hashed features of one word: itself and its beginnings, so that inflected forms are recognised."""
    plain = word.decode("utf-8", "ignore").lower()
    names = ["=" + plain, *("^" + plain[:n] for n in PREFIXES if len(plain) >= n)]
    return [xxhash.xxh3_64_intdigest(n.encode()) % DIMENSIONS for n in names]


def packed(features: list[int]) -> bytes:
    """Distinct features in order, followed by how many distinct words have each."""
    return np.concatenate(np.unique(np.array(features, np.int32), return_counts=True)).astype(np.int32).tobytes()


Others = dict[bytes, list[bytes]]


def others_of(rows: Iterable[Iterable[str]]) -> Others:
    """The terms that each identity term is swapped for: the other ones of its rows, in their order."""
    found: Others = {}
    for row in rows:
        terms = [w[0] for w in (words_of(t.encode()) for t in row) if len(w) == 1]
        for a in terms:
            found.setdefault(a, []).extend(b for b in dict.fromkeys(terms) if b != a and b not in found[a])
    return {a: swaps for a, swaps in found.items() if swaps}


def identity_rows(terms: DataFrame) -> list[list[str]]:
    """Rows of interchangeable terms from a table ``language, kind, term``; a row is a kind in a language.

    Terms of several words, null and repeated ones are left out. More than ``MOST_TERMS`` are refused.
    """
    known = terms.where("term IS NOT NULL").select("language", "kind", F.lower("term").alias("term")).distinct()
    found = known.limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} identity terms")
    rows: dict[tuple, list[str]] = {}
    for r in sorted(found, key=lambda r: r["term"]):
        rows.setdefault((r["language"], r["kind"]), []).append(r["term"])
    return list(rows.values())


_OTHERS = others_of(IDENTITY_TERMS)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class Scorer:
    """Scores of whole texts by the feature map of the training: log1p of how many distinct words have each.

    Words are looked up in a bounded cache of those of their features that have a weight.
    """

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights.astype(np.float64), model.bias
        self.weighted = set(np.flatnonzero(model.weights).tolist())
        self.cache: dict[bytes, list[int]] = {}

    def __call__(self, text: bytes | None) -> float:
        if len(self.cache) > _WORD_CACHE:
            self.cache.clear()
        cache, found = self.cache, set(words_of(text))
        for word in found.difference(cache):
            cache[word] = [f for f in features_of(word) if f in self.weighted]
        features, counts = np.unique(np.fromiter((f for w in found for f in cache[w]), np.int64), return_counts=True)
        total = self.bias + float((self.weights[features] * np.log1p(counts)).sum())
        return 1.0 / (1.0 + float(np.exp(-np.clip(total, -40.0, 40.0))))


def swapped(sentence: set[bytes], term: bytes, features=features_of, all_others: Others = _OTHERS) -> list[bytes]:
    """The sentence with the term swapped for each other term of its row: packed changes of its counts.

    Each is the number of swaps, the features whose counts change, and their counts before and after.
    """
    before = Counter(f for word in sentence for f in features(word))
    others = all_others[term]
    found = []
    for other in others:
        after = before.copy()
        after.subtract(features(term))
        if other not in sentence:
            after.update(features(other))
        at = sorted(f for f in {*features(term), *features(other)} if before[f] != after[f])
        row = [len(others), *at, *(before[f] for f in at), *(after[f] for f in at)]
        found.append(np.array(row, np.int32).tobytes())
    return found


def _examples(others: Others):
    """Labelled texts as feature lists, and the swaps of identity terms in their sentences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, list[int]] = {}

        def look_up(word: bytes) -> list[int]:
            if word not in cache:
                if len(cache) > _WORD_CACHE:
                    cache.clear()
                cache[word] = features_of(word)
            return cache[word]

        for batch in batches:
            features, changes, times = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                distinct = set(words_of(text))
                features.append(packed([f for word in sorted(distinct) for f in look_up(word)]))
                named: Counter[bytes] = Counter()
                if not distinct.isdisjoint(others):
                    for sentence in map(set, map(words_of, _SENTENCE.split(text))):
                        for term in sentence.intersection(others):
                            named.update(swapped(sentence, term, look_up, others))
                changes.append(list(named)), times.append(list(named.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(features, pa.binary()), pa.array(changes, pa.list_(pa.binary())),
                 pa.array(times, pa.list_(pa.int64()))],
                ["label", "features", "swaps", "times"],
            )

    return run


def _texts_with_feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many texts, and how many of label 1, have each feature."""
    seen, ones = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        for label, features in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = np.frombuffer(features, np.int32).reshape(2, -1)[0]
            seen[at] += 1
            ones[at] += label
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at]), pa.array(ones[at])], ["feature", "texts", "ones"])


def _only(used: np.ndarray):
    """Examples without the features that are not used."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for features in batch.column(1).to_pylist():
                pair = np.frombuffer(features, np.int32).reshape(2, -1)
                kept.append(np.ascontiguousarray(pair[:, used[pair[0]]]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], ["label", "features"])

    return run


def _prior_only(negatives: int, positives: int) -> Model:
    """Every text has the share of class 1; without any label, a third, so that nothing is rejected."""
    return Model(np.zeros(DIMENSIONS, np.float32), float(np.log((positives + 0.5) / (negatives + 1.0))))


def telling(in_one: np.ndarray, in_any: np.ndarray, ones: int, total: int, others: Others) -> np.ndarray:
    """Features that tell the classes apart, and those of identity terms."""
    share = in_any / total
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / ones + 1 / (total - ones)))
    apart = np.abs(in_one / ones - (in_any - in_one) / (total - ones)) / spread
    used = (apart >= MIN_APART) & (in_any >= MIN_TEXTS)
    for name in others:
        used[features_of(name)] = True
    return used


def fit(
    labels: np.ndarray,
    features: list[bytes],
    identity: np.ndarray | Counter[bytes],
    shares: tuple[int, int],
    l1: float = L1,
    counterfactual: float = COUNTERFACTUAL,
    rounds: int = 400,
    others: Others = _OTHERS,
    used: np.ndarray | None = None,
) -> Model:
    """Weighted logistic regression, sparse by a proximal step, with a penalty on counterfactual change.

    ``features`` are packed examples, copies of which teach once. ``identity`` counts the changes that
    :func:`swapped` makes of the labelled sentences, or is an array of how many sentences consist of each
    identity term alone. The mean square change of the logit over all sentences and swaps is added to
    the loss. Without examples of both classes the model is the prior. ``used`` tells which features
    count, if that is known, and that copies were left out.
    """
    distinct = sorted({f: i for i, f in reversed(list(enumerate(features)))}.values()) if used is None else range(len(features))
    distinct = list(distinct)
    labels, features = labels[distinct], [np.frombuffer(features[i], np.int32).reshape(2, -1) for i in distinct]
    ones = int(labels.sum())
    if ones == 0 or ones == len(labels):
        return _prior_only(*shares)
    rows = np.repeat(np.arange(len(labels), dtype=np.int32), [f.shape[1] for f in features])
    columns = np.concatenate([f[0] for f in features])
    counts = np.concatenate([f[1] for f in features])
    del features

    if used is None:
        in_one = np.bincount(columns, labels[rows], DIMENSIONS)
        used = telling(in_one, np.bincount(columns, minlength=DIMENSIONS), ones, len(labels), others)
    place = np.cumsum(used) - 1
    kept = used[columns]
    rows, columns, values = rows[kept], place[columns[kept]], np.log1p(counts[kept].astype(np.float64))
    size = int(used.sum())

    # Swaps as sparse rows of changes; the swaps of one term in one sentence weigh as much as one sentence.
    if isinstance(identity, np.ndarray):
        alone = zip(others, identity.tolist())
        identity = Counter({change: n for name, n in alone if n for change in swapped({name}, name, all_others=others)})
    changes = [np.frombuffer(change, np.int32) for change in identity]
    swap_weight = np.array([n / change[0] for n, change in zip(identity.values(), changes)])
    swap_weight = swap_weight / max(1.0, swap_weight.sum())
    parts = [change[1:].reshape(3, -1) for change in changes]
    swap_rows = np.repeat(np.arange(len(parts)), [part.shape[1] for part in parts])
    at, before, after = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int32)
    moved = used[at]
    swap_rows, swap_columns = swap_rows[moved], place[at[moved]]
    swap_values = np.log1p(after[moved]) - np.log1p(before[moved])

    def penalty(w: np.ndarray) -> np.ndarray:
        through = swap_weight * np.bincount(swap_rows, swap_values * w[swap_columns], len(swap_weight))
        return 2 * counterfactual * np.bincount(swap_columns, swap_values * through[swap_rows], size)

    total = max(1, sum(shares))
    weight = np.where(labels == 1, shares[1] / total / ones, shares[0] / total / (len(labels) - ones))
    # Half of the weight follows the class shares, half is even: rare classes shape the weights, too.
    weight = 0.5 * weight + 0.5 * np.where(labels == 1, 0.5 / ones, 0.5 / (len(labels) - ones))
    w, bias = np.zeros(size), 0.0
    look, look_bias, momentum = w.copy(), bias, 1.0
    probe = np.ones(size + 1)
    for _ in range(30):  # largest curvature of the loss, by power iteration on its upper bound
        probe /= np.linalg.norm(probe)
        through = weight * (np.bincount(rows, values * probe[columns], len(labels)) + probe[-1]) / 4
        after = np.append(np.bincount(columns, values * through[rows], size), through.sum())
        if len(swap_weight):
            after[:-1] += penalty(probe[:-1])
        probe = after
    rate = 0.9 / max(float(np.linalg.norm(probe)), 1e-9)
    for _ in range(rounds):
        logit = np.bincount(rows, values * look[columns], len(labels)) + look_bias
        slope = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels)
        gradient = np.bincount(columns, values * slope[rows], size)
        if len(swap_weight):
            gradient += penalty(look)
        new = look - rate * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_bias = look_bias - rate * float(slope.sum())
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        if float(gradient @ (new - w)) > 0:  # restart where momentum climbs
            following, pull = 1.0, 0.0
        look, look_bias = new + pull * (new - w), new_bias + pull * (new_bias - bias)
        w, bias, momentum = new, new_bias, following
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[np.flatnonzero(used)] = w
    return Model(weights, float(bias))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    modulus: int = 5, fold: int = 0, bound: int = SAMPLE, counterfactual: float = COUNTERFACTUAL,
    identity: DataFrame | None = None,
) -> Model:
    """Model from at most ``bound`` labelled documents of each class outside the held-out fold.

    ``identity`` lists identity terms as ``language, kind, term``; terms of one kind are swapped for each
    other. Features are counted, chosen and cut down in tasks: the driver gets the chosen features of
    the sample's different texts, and the swaps by how often they occur.
    """
    ready(docs.sparkSession)
    others = _OTHERS if identity is None else others_of(identity_rows(identity))
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, modulus, fold, bound)
    schema = "label int, features binary, swaps array<binary>, times array<long>"
    examples = written(sample.mapInArrow(_examples(others), schema), "toxicity-examples")
    once = examples.groupBy("features").agg(F.max("label").alias("label")).select("label", "features")
    counts = once.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    shares = class_shares(labels, id_col, label_col, modulus, fold)
    if counts["ones"] in (0, counts["n"]):
        return _prior_only(*shares)
    seen = once.mapInArrow(_texts_with_feature, "feature long, texts long, ones long")
    table = seen.groupBy("feature").agg(F.sum("texts").alias("texts"), F.sum("ones").alias("ones")).where(
        F.col("texts") >= MIN_TEXTS
    ).toArrow()
    in_any, in_one = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    at = table.column("feature").to_numpy()
    in_any[at], in_one[at] = table.column("texts").to_numpy(), table.column("ones").to_numpy()
    used = telling(in_one, in_any, counts["ones"], counts["n"], others)
    kept = once.mapInArrow(_only(used), "label int, features binary").orderBy("features", "label").toArrow()
    swaps = examples.select(F.explode(F.arrays_zip("swaps", "times")).alias("s")).groupBy(F.col("s.swaps").alias("change")).agg(
        F.sum("s.times").alias("n")
    ).orderBy("change").toArrow()
    changes = Counter(dict(zip(swaps.column("change").to_pylist(), swaps.column("n").to_pylist())))
    return fit(
        np.array(kept.column("label").to_pylist(), np.float64), kept.column("features").to_pylist(), changes, shares,
        counterfactual=counterfactual, others=others, used=used,
    )


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return run


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, fold: int = 0
) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted`` for every document, in one pass without a shuffle.

    A null, empty or wordless text has the score of the prior; repeated rows are returned as given; a
    null id counts as held out. Other columns are ignored.
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


def _below(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([scorer(t) < 0.5 for t in texts], pa.bool_()))

    return run


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The whole rows of ``docs`` that :func:`score` does not predict to be toxic.

    Null, empty and wordless texts have the score of the prior; repeated rows stay or go together; all
    columns are kept, whatever they are called. A model without labels of both classes rejects all
    rows if most labels are toxic, and none otherwise.
    """
    ready(docs.sparkSession)
    return docs.mapInArrow(_below(model, docs.columns.index(text_col)), docs.schema)
