"""Quality rules on single documents, and cross-document line frequency per host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, written

MIN_DOCUMENTS = 10  # a line of fewer documents of a host is never common
MAX_SHARE = 0.005  # nor one of a smaller share of the host's documents,
MANY_DOCUMENTS = 100  # unless more documents than these hold it: the share of a large host asks for no more
MIN_LEFT = 0.3  # a document that keeps a smaller share of its words is depleted
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
# Common lines shipped to the tasks at once (8 bytes each); more lines take one more pass each.
LINES_PER_PASS = 2_000_000

_LINE = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.array([0x20, *range(0x09, 0x0E)], np.uint8)
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _line_key(host: bytes, line: bytes) -> int:
    """Hash of a host and a line in lower case, digits as 0, white space collapsed."""
    return _signed(xxhash.xxh3_64_intdigest(host + b"\n" + b" ".join(line.translate(_LINE).split())))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct lines of each document: host, line, and a hash of the whole text, which copies share."""
    for batch in batches:
        hosts, keys, texts = [], [], []
        for host, text in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in (0, 1))):
            host, text = host or b"", text or b""
            found = {_line_key(host, line) for line in text.split(b"\n") if line.strip(b" \t\r\v\f")}
            keys += found
            hosts += [_signed(xxhash.xxh3_64_intdigest(host))] * len(found)
            texts += [_signed(xxhash.xxh3_64_intdigest(text))] * len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), pa.array(texts, pa.int64())],
            ["host", "line", "document"],
        )


def _host_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [_signed(xxhash.xxh3_64_intdigest(h or b"")) for h in batch.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), batch.column(1)], ["host", "documents"])


def common_lines(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    many_documents: int = MANY_DOCUMENTS,
) -> DataFrame:
    """Keys of the lines that more distinct documents of their host hold than both limits allow.

    More than ``many_documents`` are enough on a host of any size. All counts are partial sums before
    they are shuffled, so a line in a third of all rows is one row per task. Copies of one text are one
    document of the line and of the host; texts that differ anywhere are different ones.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    per_host = (
        rows.select(F.coalesce("host", F.lit("")).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("document"))
        .distinct()
        .groupBy("host").agg(F.count("*").alias("documents"))
        .mapInArrow(_host_marks, "host long, documents long")
    )
    return (
        rows.mapInArrow(_lines, "host long, line long, document long")
        .distinct()
        .groupBy("host", "line").agg(F.count("*").alias("holding"))
        .where(F.col("holding") > min_documents)
        .join(per_host, "host")
        .where((F.col("holding") > max_share * F.col("documents")) | (F.col("holding") > many_documents))
        .select("line").distinct()
    )


def _repeated(tokens: list[bytes]) -> int:
    """Words inside 8-word windows that occur at least twice, counted by doubling exact ranks."""
    n = len(tokens) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ranks = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, len(tokens))
    if len(numbers) == len(tokens):
        return 0
    step = 1
    while step < WINDOW:
        pairs = ranks[:-step] * np.int64(len(tokens) + 1) + ranks[step:]
        _, ranks = np.unique(pairs, return_inverse=True)
        step *= 2
    again = np.bincount(ranks)[ranks] > 1
    if not again.any():
        return 0
    marks = np.zeros(len(tokens) + 1, np.int64)
    marks[:n] += again
    marks[WINDOW:] -= again
    return int((np.cumsum(marks)[:-1] > 0).sum())


def _judge(common: np.ndarray, first: bool, last: bool, host_at: int, text_at: int, with_rows: bool):
    """Measure whole rows and collect the positions of their common lines over the passes.

    Every pass but the first finds the positions so far in the last column. The last pass returns the
    first column, or all columns with the common lines cut from the text, and the measures.
    """
    padded = np.append(common, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.num_columns if first else batch.num_columns - 1
            removed, stats, lefts, texts = [], {name: [] for name in _STATS}, [], []
            hosts, bodies = (batch.column(i).cast(pa.binary()).to_pylist() for i in (host_at, text_at))
            known = [None] * batch.num_rows if first else batch.column(width).to_pylist()
            for host, body, gone in zip(hosts, bodies, known):
                lines = (body or b"").split(b"\n")
                worded = [i for i, line in enumerate(lines) if line.strip(b" \t\r\v\f")]
                keys = np.array([_line_key(host or b"", lines[i]) for i in worded], np.int64)
                at = np.searchsorted(common, keys)
                hit = (padded[at] == keys) & (at < len(common))
                gone = sorted({*(gone or ()), *(worded[i] for i in np.flatnonzero(hit))})
                removed.append(gone)
                if not last:
                    continue
                tokens = (body or b"").split()
                counts = np.bincount(np.frombuffer(body or b"", np.uint8), minlength=256)
                stats["n_words"].append(len(tokens))
                stats["word_chars"].append(int(counts.sum() - counts[0x80:0xC0].sum() - counts[_SPACES].sum()))
                stats["n_symbols"].append(int(counts[_SYMBOLS].sum()))
                stats["n_dup_lines"].append(len(worded) - len({lines[i] for i in worded}))
                stats["n_repeat_words"].append(_repeated(tokens))
                lefts.append(len(tokens) - sum(len(lines[i].split()) for i in gone))
                if with_rows:
                    drop = set(gone)
                    texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else body)
            kept = batch.columns[:width] if with_rows or not last else batch.columns[:1]
            if last and with_rows:
                kept[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            if last:
                kept += [*(pa.array(stats[name], pa.int64()) for name in _STATS), pa.array(lefts, pa.int64())]
            kept.append(pa.array(removed, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(kept, [f"x{i}" for i in range(len(kept))])

    return run


def _judged(docs: DataFrame, text_at: int, host_at: int, limits: tuple[int, float, int], with_rows: bool) -> DataFrame:
    """Columns ``c0, c1, ...`` (or ``c0``), the measures, ``words_left`` and ``removed``."""
    ready(docs.sparkSession)
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    lines = written(common_lines(rows, f"c{text_at}", f"c{host_at}", *limits), "common-lines")
    passes = max(1, -(-lines.count() // LINES_PER_PASS))
    whole = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    measured = ", ".join(f"{name} long" for name in (*_STATS, "words_left"))
    for part in range(passes):
        chosen = lines if passes == 1 else lines.where(F.pmod(F.xxhash64("line"), F.lit(passes)) == part)
        keys = np.sort(chosen.toArrow().column(0).to_numpy().astype(np.int64))  # bounded per pass
        last = part == passes - 1
        kept = whole if with_rows or not last else whole.split(", ")[0]
        schema = f"{kept}, {measured}, removed array<int>" if last else f"{kept}, removed array<int>"
        rows = rows.mapInArrow(_judge(keys, part == 0, last, host_at, text_at, with_rows), schema)
        if not last:  # one list of lines per task: the next one goes on from stored rows
            rows = written(rows, "lines-found")
    return rows


def _failed():
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED_PERCENT) * F.col("n_words")
    )


def line_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
    many_documents: int = MANY_DOCUMENTS,
) -> DataFrame:
    """Measures of each document, what is left of it without the common lines of its host, and a verdict.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    words_left, removed_lines, depleted``. Base rules reject fewer than 20 words and more than 30 %
    words in repeated 8-word windows; a document is depleted when less than ``min_left`` of its words
    are left. Words are separated by ASCII white space. Null and empty texts have no words and fail
    the base rules; a null host is the empty host; repeated rows count once as a document of a line
    and are all returned; other columns are ignored.

    The common lines are shipped to the tasks as sorted hashes, a bounded number in each pass over
    stored rows, so documents are never shuffled.
    """
    narrow = docs.select(F.col(id_col), F.col(host_col).cast("string"), F.col(text_col))
    depleted = F.col("words_left") < F.lit(min_left) * F.col("n_words")
    return _judged(narrow, 2, 1, (min_documents, max_share, many_documents), False).select(
        F.col("c0").alias(id_col),
        *_STATS,
        _failed().alias("base_failed"),
        (~_failed() & ~depleted).alias("kept"),
        "words_left",
        F.size("removed").cast("long").alias("removed_lines"),
        depleted.alias("depleted"),
    )


def passing_documents(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
    many_documents: int = MANY_DOCUMENTS,
) -> DataFrame:
    """The whole rows that :func:`line_rules` keeps, with the common lines cut from their texts.

    Null, empty and short texts go, as they fail the base rules; repeated rows stay or go together; a
    null host is the empty one and stays null; all other columns are kept, whatever they are called.
    """
    names = docs.columns
    typed = docs.withColumn(host_col, F.col(host_col).cast("string"))
    judged = _judged(typed, names.index(text_col), names.index(host_col), (min_documents, max_share, many_documents), True)
    depleted = F.col("words_left") < F.lit(min_left) * F.col("n_words")
    return judged.where(~_failed() & ~depleted).select(*(f"c{i}" for i in range(len(names)))).toDF(*names)
