"""Benchmark contamination: one Aho-Corasick automaton over the word windows of the test items."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, written

WINDOW = 10
# An automaton holds at most about so many windows (some 100 MB); more windows take one more pass each.
WINDOWS_PER_PASS = 150_000

# Lower case A-Z; every ASCII character that is neither a digit nor a letter separates words.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_SCHEMA = "id {id}, text string, n_words long, hits array<struct<start:int,end:int>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                width = min(size, len(words))
                for i in range(len(words) - width + 1 if words else 0):
                    ids.append(item)
                    found.append(b" ".join(words[i : i + width]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    return run


class Matcher:
    """Automaton over word numbers: finds every window of the items in one pass over a text."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.numbers: dict[bytes, int] = {}
        self.items = [items for _, items in windows]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for index, (window, _) in enumerate(windows):
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.split(b" "))
            self.automaton.add_word(key, (index, len(key)))
        if windows:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of hit words, and the items whose windows occur."""
        if not self.items or not words:
            return [], set()
        number = self.numbers.get
        ranges: list[list[int]] = []
        items: set[str] = set()
        for end, (index, length) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            items.update(self.items[index])
            start = end - length + 1
            while ranges and ranges[-1][1] >= start:  # windows come by their ends; a longer one may reach back
                start = min(start, ranges.pop()[0])
            ranges.append([start, end + 1])
        return [(s, e) for s, e in ranges], items


_built: list[tuple[list, Matcher]] = []


def _matcher(shared: Broadcast) -> Matcher:
    """The automaton of a broadcast list, built once per Python worker."""
    if not _built or _built[0][0] is not shared.value:
        _built[:] = [(shared.value, Matcher(shared.value))]
    return _built[0][1]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _scan(shared: Broadcast, last: bool):
    """Hits of the windows sent, added to those found so far; the last pass gives their places in the
    original text instead of the text."""
    range_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            before = batch.schema.names.count("hits")
            old_hits = batch.column("hits").to_pylist() if before else [()] * batch.num_rows
            old_items = batch.column("items").to_pylist() if before else [()] * batch.num_rows
            counts, hits, items, spans = [], [], [], []
            for text, had, known in zip(batch.column(1).cast(pa.binary()).to_pylist(), old_hits, old_items):
                words = words_of(text)
                ranges, found = matcher.find(words)
                if had:
                    ranges = _merged([*((r["start"], r["end"]) for r in had), *ranges])
                counts.append(len(words))
                hits.append([{"start": s, "end": e} for s, e in ranges])
                items.append(sorted(found.union(known)))
                if last:
                    spans.append(_spans(text, ranges) if ranges else [])
            text_or_spans = pa.array(spans, span_type) if last else batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), text_or_spans, pa.array(counts, pa.int64()), pa.array(hits, range_type),
                 pa.array(items, pa.list_(pa.string()))],
                ["id", "spans" if last else "text", "n_words", "hits", "items"],
            )

    return run


def _spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as character offsets of the original text."""
    raw = np.frombuffer(text, np.uint8)
    word = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [{"start": int(chars[begins[start]]), "end": int(chars[ends[end - 1]])} for start, end in ranges]


def _automata(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> Iterator[tuple[Broadcast, bool]]:
    """The windows of all items with their items, in lists that one automaton each may hold, one after
    the other, and whether a list is the last."""
    spark = benchmark.sparkSession
    windows = written(
        benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(item_text))
        .mapInArrow(_windows(window), "item string, window binary")
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items")),
        "windows",
    )
    passes = max(1, -(-windows.count() // WINDOWS_PER_PASS))
    for part in range(passes):
        chosen = windows if passes == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == part)
        rows = sorted((bytes(r["window"]), list(r["items"])) for r in chosen.collect())  # bounded per pass
        yield spark.sparkContext.broadcast(rows), part == passes - 1


def _without_hits(shared: Broadcast, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not matcher.find(words_of(t))[0] for t in texts], pa.bool_()))

    return run


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The whole rows of ``docs`` in which :func:`contamination` finds nothing.

    Null and empty texts and a benchmark without words leave nothing to find; repeated rows stay or go
    together; all columns are kept, whatever they are called.
    """
    ready(docs.sparkSession)
    clean = docs
    for shared, last in _automata(benchmark, item_id, item_text, window):
        clean = clean.mapInArrow(_without_hits(shared, docs.columns.index(text_col)), docs.schema)
        if not last:  # one automaton per task: the next one goes on from stored rows
            clean = written(clean, "clean")
            shared.unpersist()
    return clean


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Words of each document that lie inside an occurrence of ``window`` consecutive item words.

    Returns ``doc_id, n_words, n_hit, items, spans, contaminated``: hit words, the sorted ids of the
    items with an occurring window, and the hit passages as character offsets of the original text.
    Texts are lower-cased (A-Z) and split at ASCII characters that are neither letters nor digits.
    An item of fewer words than a window is one window; items without words match nothing; a null
    item id counts as the empty string; rows of one item id are one item. Null and empty documents
    have no words; repeated rows are returned as often as given; other columns are ignored.

    The windows are built by Spark. As many as one automaton may hold are shipped to the tasks, and
    the documents stream through it without a shuffle; further windows take further passes over the
    rows as the pass before has stored them.
    """
    ready(docs.sparkSession)
    id_type = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for shared, last in _automata(benchmark, item_id, item_text, window):
        schema = _SCHEMA.format(id=id_type)
        if last:
            found = found.mapInArrow(_scan(shared, True), schema.replace("text string", "spans array<struct<start:long,end:long>>"))
        else:  # one automaton per task: the next one goes on from stored rows
            found = written(found.mapInArrow(_scan(shared, False), schema), "hits")
            shared.unpersist()
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_hit"),
        "items",
        "spans",
    ).withColumn("contaminated", F.col("n_hit") > 0)
