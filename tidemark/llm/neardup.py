"""Near duplicates by HyperMinHash registers, banded, estimated, then verified on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ready, written
from .components import components

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BAND_ROWS = 5
BANDS = 32  # a pair at similarity 0.8 shares no band with probability 3e-6, at 0.85 with 7e-9
SIGMAS = 4.0  # pairs whose estimate lies further below the threshold are not verified
PROBES = 4096
# Members of one bucket that are compared inside one task at a time are two blocks of about so many
# classes, and of about so many shingles where texts are long.
BLOCK = 2_000
BLOCK_SHINGLES = 1_000_000
_WORD_CACHE = 300_000
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHIFT = np.uint64(64 - BUCKET_BITS)
_LOW = np.uint64((1 << (64 - BUCKET_BITS)) - 1)
# Expected accidental matches of registers, as published for HyperMinHash with equal cardinalities.
_COLLISIONS = 0.1699194871597391


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ShingleHasher:
    """Sorted distinct 64-bit hashes of the k-word shingles of UTF-8 texts; words are cached within bounds."""

    def __init__(self, words: int):
        self.words = words
        self.cache: dict[bytes, int] = {}
        odd = _mix(np.arange(1, words + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.factors, self.short = odd[:words], odd[words]

    def __call__(self, text: bytes | None) -> np.ndarray:
        tokens = (text or b"").translate(_ASCII_LOWER).split()
        if not tokens:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > _WORD_CACHE:
            cache.clear()
        for token in set(tokens).difference(cache):
            cache[token] = xxhash.xxh3_64_intdigest(token)
        ids = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
        k = self.words
        if len(ids) < k:
            length = np.array([len(ids)], np.uint64)
            return _mix(self.short * length + (ids * self.factors[: len(ids)]).sum(keepdims=True))
        total = ids[: len(ids) - k + 1] * self.factors[0]
        for i in range(1, k):
            total = total + ids[i : len(ids) - k + 1 + i] * self.factors[i]
        return np.unique(_mix(total))


@lru_cache(1)
def _probe_table() -> np.ndarray:
    """Buckets in which an empty register looks for a value, in a fixed random order per register."""
    return np.random.default_rng(7).integers(0, BUCKETS, (BUCKETS, PROBES), dtype=np.uint16)


def registers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """HyperMinHash registers of sorted hashes: per bucket the leading zeros of the least value and
    the mantissa bits behind its first one bit. Empty registers borrow along a fixed probe order, so
    that bands of short texts are comparable. Returns (registers, which were filled by an own value)."""
    edges = np.arange(BUCKETS, dtype=np.uint64) << _SHIFT
    at = np.searchsorted(hashes, edges)
    filled = np.diff(np.append(at, len(hashes))) > 0
    least = np.where(filled, hashes[np.minimum(at, len(hashes) - 1)] & _LOW, np.uint64(1))
    least = np.maximum(least, np.uint64(1))
    width = 64 - BUCKET_BITS
    _, exponent = np.frexp(least.astype(np.float64))
    length = exponent.astype(np.int64)  # position of the highest one bit, from 1
    length -= (least >> (length - 1).astype(np.uint64)) == 0  # rounding up to the next power
    zeros = width - length
    down = np.maximum(length - 1 - MANTISSA_BITS, 0).astype(np.uint64)
    up = np.maximum(MANTISSA_BITS - (length - 1), 0).astype(np.uint64)
    mantissa = ((least >> down) << up) & np.uint64((1 << MANTISSA_BITS) - 1)
    values = (zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = _probe_table()[empty]
        width_tried = 64
        found = filled[probes[:, :width_tried]]
        if not found.any(axis=1).all():
            found = filled[probes]
        first = found.argmax(axis=1)
        source = probes[np.arange(len(empty)), first]
        lost = ~found[np.arange(len(empty)), first]
        source[lost] = np.flatnonzero(filled)[0]
        values[empty] = values[source]
    return values, filled


def _sketches(words: int, text_at: int):
    """Add to whole rows: size, digest and registers of their shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(words)
        for batch in batches:
            counts, digests, regs, fills = [], [], [], []
            for text in batch.column(text_at).cast(pa.binary()).to_pylist():
                hashes = hasher(text)
                counts.append(len(hashes))
                if not len(hashes):
                    digests.append(None), regs.append(None), fills.append(None)
                    continue
                values, filled = registers(hashes)
                digests.append(blake2b(hashes.tobytes(), digest_size=16).digest())
                regs.append(values.tobytes())
                fills.append(np.packbits(filled).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(regs, pa.binary()), pa.array(fills, pa.binary())],
                [*(f"c{i}" for i in range(batch.num_columns)), "n", "digest", "regs", "filled"],
            )

    return run


def _estimates(a: np.ndarray, fa: np.ndarray, na: np.ndarray, b: np.ndarray, fb: np.ndarray, nb: np.ndarray):
    """Collision-corrected Jaccard estimates of aligned register rows, and their standard deviations'
    base: registers filled on either side."""
    either = (fa | fb).sum(axis=1)
    same = ((a == b) & fa & fb).sum(axis=1)
    expected = _COLLISIONS * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4.0 * na * nb / np.square(na + nb)
    return (same - expected) / either, either


def _likely(a, fa, na, b, fb, nb, percent: int) -> np.ndarray:
    estimate, seen = _estimates(a, fa, na, b, fb, nb)
    t = percent / 100
    enough = estimate >= t - SIGMAS * np.sqrt(t * (1 - t) / seen)
    return enough & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _rows(column, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _masks(column) -> np.ndarray:
    return np.unpackbits(_rows(column, BUCKETS // 8, np.uint8), axis=1).astype(bool)


def _estimate_pairs(percent: int):
    """Keep aligned pairs (a, b, na, regs_a, filled_a, nb, regs_b, filled_b) that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy().astype(np.float64) for i in (2, 5))
            keep = _likely(
                _rows(batch.column(3), BUCKETS, np.uint16), _masks(batch.column(4)), na,
                _rows(batch.column(6), BUCKETS, np.uint16), _masks(batch.column(7)), nb, percent,
            )
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _verify_pairs(words: int, percent: int):
    """Keep pairs (a, b, text_a, text_b) whose whole shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(words)
        known: dict[int, np.ndarray] = {}

        def hashes(key, text):
            if key not in known:
                if len(known) >= 64:
                    known.clear()
                known[key] = hasher(text)
            return known[key]

        for batch in batches:
            keys_a, keys_b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            keep = []
            for a, b, left, right in zip(keys_a, keys_b, *texts, strict=True):
                x, y = hashes(a, left), hashes(b, right)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class _Group:
    """Rows of one bucket block. Links between members of different components are found exactly.

    Members are compared by registers first. Whole shingle sets are made only of members that the
    estimate leaves, and members that have met in one component meanwhile are not compared again, so
    what is returned is enough to connect whatever is linked in the block.
    """

    def __init__(self, group: pa.Table, hasher: ShingleHasher, percent: int):
        self.band = group.column("band")[0].as_py()
        self.p, self.q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        self.member = group.column("cls").to_numpy()
        _, self.label = np.unique(group.column("root").to_numpy(), return_inverse=True)
        self.block = group.column("block").to_numpy()
        self.n = group.column("n").to_numpy().astype(np.float64)
        self.texts = group.column("text")
        self.hasher, self.percent = hasher, percent
        self.sets: dict[int, np.ndarray] = {}
        if self.label.max() == 0:
            return
        self.regs = _rows(group.column("regs"), BUCKETS, np.uint16)
        self.filled = _masks(group.column("filled"))

    def set_of(self, i: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = self.hasher(self.texts[i].as_py().encode())
        return self.sets[i]

    def candidates(self, i: int, right: np.ndarray) -> np.ndarray:
        n, regs = self.n, self.regs
        j = right[self.label[right] != self.label[i]]
        j = j[100 * np.minimum(n[i], n[j]) >= self.percent * np.maximum(n[i], n[j])]
        if len(j) and self.band:  # pairs that share an earlier band are compared there
            used = self.band * BAND_ROWS
            equal = (regs[j, :used] == regs[i, :used]).reshape(len(j), self.band, BAND_ROWS)
            j = j[~equal.all(axis=2).any(axis=1)]
        if len(j):
            own = slice(i, i + 1)
            j = j[_likely(regs[j], self.filled[j], n[j], regs[own], self.filled[own], n[own], self.percent)]
        return j

    def links(self) -> Iterator[tuple[int, int]]:
        if self.label.max() == 0:
            return
        left = np.flatnonzero(self.block == self.p)
        other = left if self.p == self.q else np.flatnonzero(self.block == self.q)
        for i in left:
            j = self.candidates(i, other[other > i] if self.p == self.q else other)
            while len(j):
                some, j = j[:256], j[256:]
                some = some[self.label[some] != self.label[i]]
                if not len(some):
                    continue
                own = self.set_of(i)
                sets = [self.set_of(k) for k in some]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                every = np.concatenate(sets)
                at = np.minimum(np.searchsorted(own, every), len(own) - 1)
                shared = np.add.reduceat((own[at] == every).astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
                linked = 100 * shared >= self.percent * (sizes + len(own) - shared)
                for k in some[linked]:
                    if self.label[k] != self.label[i]:
                        yield int(self.member[i]), int(self.member[k])
                        self.label[self.label == self.label[k]] = self.label[i]


def _link_groups(words: int, percent: int):
    """Links between components inside runs of rows that come sorted by (key, p, q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(words)

        def emit(groups):
            found = [link for group in groups for link in _Group(group, hasher, percent).links()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*found)], ["a", "b"])

        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("key", "p", "q")])
            bounds = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
            yield from emit(table.slice(s, e - s) for s, e in zip(bounds, bounds[1:]) if e - s > 1)
            rest = table.slice(bounds[-1])
        if rest is not None:
            yield from emit([rest])

    return run


def _grouped(docs: DataFrame, text_at: int, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The written rows (columns ``c0, c1, ...`` of ``docs``, with ``row`` and ``n``) and their
    components as ``row, root``; rows without shingles have a null root."""
    ready(docs.sparkSession)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in plain.dtypes)
    sketches = written(
        plain.mapInArrow(_sketches(words, text_at), f"{schema}, n long, digest binary, regs binary, filled binary")
        .withColumn("row", F.monotonically_increasing_id()),
        "sketches",
    )
    classes = written(sketches.where("n > 0").groupBy("digest").agg(F.min("row").alias("cls")), "classes")
    reps = written(
        sketches.where("n > 0").select(F.col("row").alias("cls"), "n", "regs", "filled")
        .join(classes.select("cls"), "cls", "left_semi"),
        "representatives",
    )

    bytes_per_band = 2 * BAND_ROWS
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.expr("regs").substr(i * bytes_per_band + 1, F.lit(bytes_per_band))),
    )
    members = reps.select("cls", F.col("n").cast("int").alias("n"), F.posexplode(keys).alias("band", "key"))
    order = F.col("cls").bitwiseXOR(F.col("key"))  # a different order of the classes in every bucket
    leaders = (
        members.groupBy("key").agg(F.min(order).alias("low"), F.count("*").alias("size"), F.sum("n").alias("weight"))
        .where("size > 1")
        .select(
            "key",
            F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
            F.col("low").bitwiseXOR(F.col("key")).alias("leader"),
        )
    )
    busy = written(members.join(leaders, "key"), "members")

    text_of = written(
        sketches.select(F.col("row").alias("cls"), F.col(f"c{text_at}").alias("text"))
        .join(busy.select("cls").distinct().hint("shuffle_hash"), "cls", "left_semi"),
        "texts",
    )

    def verified(pairs: DataFrame) -> DataFrame:
        a = text_of.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
        b = text_of.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_verify_pairs(words, percent), "a long, b long")

    # Leaders: the three with which a class shares most buckets.
    votes = (
        busy.where("cls != leader")
        .groupBy("cls", F.col("leader")).agg(F.count("*").alias("shared"))
    )
    best = Window.partitionBy("cls").orderBy(F.desc("shared"), "leader")  # at most one row per band
    first = (
        votes.withColumn("rank", F.row_number().over(best)).where("rank <= 3")
        .select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct()
    )
    sketch = [F.col("n"), F.col("regs"), F.col("filled")]
    estimated = (
        first.join(reps.select(F.col("cls").alias("a"), *[c.alias(f"{x}_a") for c, x in zip(sketch, "nrf")]), "a")
        .join(reps.select(F.col("cls").alias("b"), *[c.alias(f"{x}_b") for c, x in zip(sketch, "nrf")]), "b")
        .select("a", "b", "n_a", "r_a", "f_a", "n_b", "r_b", "f_b")
        .mapInArrow(_estimate_pairs(percent), "a long, b long")
    )
    tested = written(estimated, "pairs")
    links = written(verified(tested), "links")
    rooted = components(links)

    # The rest: buckets in which several components meet.
    placed = busy.join(rooted.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls")
    )
    placed = written(placed.select("key", "band", "cls", "blocks", "root"), "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    spread = (
        placed.join(mixed.select("key"), "key", "left_semi")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "band", "cls", "root", "block",
            F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
        )
    )
    across = (
        spread.join(reps, "cls").join(text_of, "cls")
        .repartition(F.col("key"), F.col("p"), F.col("q"))
        .sortWithinPartitions("key", "p", "q")
        .select("key", "p", "q", "band", "cls", "root", "block", "n", "regs", "filled", "text")
        .mapInArrow(_link_groups(words, percent), "a long, b long")
    )
    late = written(across, "links")
    if late.isEmpty():
        final = rooted
    else:
        final = components(links.unionByName(late))

    placed = sketches.select("row", "digest").join(classes, "digest", "left")
    placed = placed.join(final.withColumnRenamed("vertex", "cls"), "cls", "left")
    return sketches, placed.select("row", F.coalesce("root", "cls").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """Group documents whose word-shingle sets have ``100 * intersection >= percent * union``.

    Returns ``doc_id, n_shingles, component_id, kept``: the smallest id reachable over links, and
    whether the row carries it. Texts are lower-cased (A-Z) and split at ASCII white space; a text of
    fewer words than a shingle is one shingle; null, empty and blank texts have no shingles and link
    with nothing. Repeated rows of one id share a component and are all returned; rows with a null id
    take part in links, are named by the other ids of their component, and if there are none by null.
    Other columns are ignored.

    Documents with equal sets are one class from the start. Bands of the registers put classes into
    buckets; every class is first compared with one leader per bucket, linear in the bucket. After
    those links are contracted, only classes of a shared bucket that are still in different
    components are compared with each other, inside tasks that hold two blocks of bounded size, so
    no pair of a bucket is left out and no pair becomes a row unless it is linked. A pair goes
    through the register estimate, then through the exact test on both whole texts.
    """
    sketches, placed = _grouped(docs.select(id_col, text_col), 1, words, percent)
    named = sketches.select("row", F.col("c0").alias("id"), "n").join(placed, "row")
    low = named.where("root is not null").groupBy("root").agg(F.min("id").alias("low"))
    return (
        named.join(low, "root", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def distinct_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One whole row of ``docs`` for each component of :func:`near_duplicates`: the one with the
    smallest id, the first written among repeated ids; a null id counts as the largest. Rows without
    shingles (null, empty and blank texts) all stay; all columns are kept, whatever they are called."""
    names = docs.columns
    sketches, placed = _grouped(docs, names.index(text_col), words, percent)
    at = f"c{names.index(id_col)}"
    keys = sketches.select("row", F.col(at).alias("id")).join(placed, "row")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = keys.where("root is not null").groupBy("root").agg(F.min(order).alias("low")).select("low.row")
    stay = first.unionByName(keys.where("root is null").select("row"))
    whole = sketches.select("row", *(f"c{i}" for i in range(len(names))))
    return whole.join(stay.hint("shuffle_hash"), "row", "left_semi").drop("row").toDF(*names)
