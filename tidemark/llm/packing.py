"""Token packing: swap-based local search over bins of bounded blocks of pieces."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from tokenizers import Tokenizer

from .common import ready, written

CAPACITY = 2048
END = 0
BLOCK = 8_192  # pieces that are packed together
_CHUNK_CACHE = 500_000
_CHUNK_BYTES = 64  # longer chunks are not worth remembering
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # of ASCII; an apostrophe may open an ending
_PIECES = "id {id}, piece int, start long, length long, ids_crc32 long"


def tokenizer_file(name: str = "word_bpe_49k.json") -> bytes:
    """A vocabulary file as the driver sees it; tasks get its bytes and need no file of their own."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def _byte_letters() -> dict[int, str]:
    """Letters by which byte-level vocabularies write bytes: printable Latin-1 as it is, others from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + n) for n, b in enumerate(hidden)}}


class Encoder:
    """Token ids of whole texts; chunks between spaces and line ends are encoded once and remembered within bounds.

    The vocabulary drops white space and never joins characters across it, so the ids of a text are
    those of its chunks in order. Strings of special tokens have the
    ids of these tokens. A chunk of letters,
    perhaps followed by punctuation, goes straight to the merges, since it is one word and one run of
    punctuation for the vocabulary; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.letters = _byte_letters()
        self.merge = self.tokenizer.model.tokenize
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # Short cuts hold for vocabularies of this make only; a few words tell.
        self.short = all(self._quick(c) in (None, self._whole(c)) for c in ("Straße,", "ÉTÉ", "word", "a.", "ñandú!?"))

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        if word not in self.words:
            if len(self.words) > _CHUNK_CACHE:
                self.words.clear()
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            self.words[word] = np.array([t.id for t in self.merge(spelt)], self.kind).tobytes()
        return self.words[word]

    def _quick(self, chunk: str) -> bytes | None:
        low = chunk.lower()
        core = low.rstrip(_SIGNS)
        if not core.isalpha() or not (core.isascii() or (is_normalized("NFC", chunk) and "\u03a3" not in chunk)):
            return None
        ids = self._word(core)
        if len(core) < len(low):
            end = low[len(core) :]
            if end not in self.words:
                self.words[end] = self._whole(end)
            ids += self.words[end]
        return ids

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.chunks) > _CHUNK_CACHE:
            self.chunks.clear()
        known = self.chunks
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        fresh = list(dict.fromkeys(c for chunks in split for c in set(chunks).difference(known)))
        for chunk in fresh:
            ids = self._quick(chunk) if self.short else None
            known[chunk] = self._whole(chunk) if ids is None else ids
        out = [np.frombuffer(b"".join(map(known.__getitem__, chunks)), self.kind).astype(np.uint32) for chunks in split]
        for chunk in fresh:
            if len(chunk) > _CHUNK_BYTES:
                del known[chunk]
        return out


_encoders: list[tuple[bytes, Encoder]] = []


def _encoder(shared: Broadcast) -> Encoder:
    if not _encoders or _encoders[0][0] is not shared.value:
        _encoders[:] = [(shared.value, Encoder(shared.value))]
    return _encoders[0][1]


def _cut(shared: Broadcast, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[list] = [[] for _ in range(5)]
                tokens = []
                for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(END))
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = np.ascontiguousarray(ids[start : start + capacity], "<u4")
                        for column, value in zip(rows, (doc, piece, start, len(part), zlib.crc32(part.tobytes()))):
                            column.append(value)
                        if with_ids:
                            tokens.append(part.astype(np.int32))
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(column, kind) for column, kind in zip(rows, types)]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def token_pieces(
    docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Rows ``id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of every document's
    pieces: its token ids and the end id, cut every ``capacity`` ids."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = _PIECES.format(id=dict(rows.dtypes)["id"]) + ", ids array<int>" * with_ids
    return rows.mapInArrow(_cut(spark.sparkContext.broadcast(vocabulary), capacity, with_ids), schema)


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length (at most ``capacity``): the better of two local searches.

    The first starts from pieces put in the given order where they leave least room. If it ends above
    the least possible number of bins, a second one starts from the same rule in falling order.
    """
    least = -(-int(lengths.sum()) // capacity)
    found = _search(lengths, np.arange(len(lengths)), capacity)
    if len(lengths) and found.max() + 1 > least:
        other = _search(lengths, np.argsort(-lengths, kind="stable"), capacity)
        found = other if other.max() < found.max() else found
    return found


def _start(size_of: list[int], order: np.ndarray, capacity: int) -> tuple[list[dict[int, None]], list[int]]:
    """Bins, as ordered sets of pieces, and their free room; each piece goes where it leaves least room."""
    bins: list[dict[int, None]] = []
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where some bin has room r
    for i in order.tolist():
        size = size_of[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            rooms ^= 0 if by_room[room] else 1 << room
        else:
            b, room = len(bins), capacity
            bins.append({})
            free.append(capacity)
        bins[b][i] = None
        free[b] = room - size
        by_room[free[b]].append(b)
        rooms |= 1 << free[b]
    return bins, free


def _search(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Local search over bins.

    Underfull bins are visited from the fullest to the emptiest. A bin exchanges pieces with a bin
    that is at most as full: it takes one, or takes one for one, or one for two, such that its own
    fill rises, the largest rise first. Every step therefore raises the sum of squared fills, and the
    emptiest bins run empty. Partners are found by their exact length in an index of the underfull
    bins. The search ends when no bin can step or when no packing has fewer bins.
    """
    size_of = lengths.tolist()
    bins, free = _start(size_of, order, capacity)
    least = -(-sum(size_of) // capacity)

    owner: dict[int, dict[int, int]] = {}  # length -> piece -> bin, for pieces of underfull bins
    for b, pieces in enumerate(bins):
        for i in pieces if free[b] else ():
            owner.setdefault(size_of[i], {})[i] = b
    used = len(bins)
    changed = True
    while changed and used > least:
        changed = False
        for b in sorted((b for b in range(len(bins)) if bins[b] and free[b]), key=free.__getitem__):
            while used > least and bins[b] and free[b]:
                step = _best_step(b, bins, free, size_of, owner)
                if step is None:
                    break
                gives, other, takes = step
                for i in gives:
                    del bins[b][i]
                    bins[other][i] = None
                    owner[size_of[i]][i] = other
                for i in takes:
                    del bins[other][i]
                    bins[b][i] = None
                    owner[size_of[i]][i] = b
                rise = sum(size_of[i] for i in takes) - sum(size_of[i] for i in gives)
                free[b] -= rise
                free[other] += rise
                changed = True
                used -= not bins[other]
                if not free[b]:  # full bins leave the search
                    for i in bins[b]:
                        del owner[size_of[i]][i]
    out = np.empty(len(size_of), np.int64)
    number = 0
    for pieces in bins:
        if pieces:
            out[list(pieces)] = number
            number += 1
    return out


def _best_step(b, bins, free, size_of, owner):
    """The exchange that fills bin ``b`` most with a piece of a bin at most as full: (given, bin, taken).

    All lengths of the bin, and all pairs of them, are tried against all lengths held by others; of
    equal rises the one that gives fewest pieces away is taken.
    """
    room = free[b]

    def holder(size):
        for i, c in owner[size].items():
            if c != b and free[c] >= room:
                return c, (i,)
        return None

    pieces: dict[int, list[int]] = {}
    for i in bins[b]:
        pieces.setdefault(size_of[i], []).append(i)
    mine = list(pieces)
    twos = {}
    for k, x in enumerate(mine):
        for y in mine[: k + 1]:
            if x != y or len(pieces[x]) > 1:
                twos.setdefault(x + y, (x, y))
    sizes = sorted(size for size, held in owner.items() if held)
    best, most = None, 0
    for total, given in ((0, ()), *((x, (x,)) for x in mine), *twos.items()):
        at = bisect_right(sizes, total + room) - 1
        while at >= 0 and sizes[at] - total > most:
            found = holder(sizes[at])
            if found:
                best, most = (given, found), sizes[at] - total
                break
            at -= 1
        if most == room:
            break
    if best is None:
        return None
    given, found = best
    taken = [pieces[x][k if given[:k].count(x) else 0] for k, x in enumerate(given)]
    return tuple(taken), *found


def _pack_blocks(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pid")
        return group.assign(bin=pack(group["length"].to_numpy(), capacity))[["pid", "length", "block", "bin"]]

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Rows ``pid, sequence_id, offset`` for written ``pieces(pid, length)``.

    Full pieces are sequences by themselves. The others are dealt by hash into blocks of about
    ``block`` pieces, and each block is packed by local search in one task. The pieces of sequences
    that blocks leave underfull (less than 99.5 % of the capacity) are dealt and packed again, as long
    as that lowers the number of sequences.
    """
    partial = pieces.where(F.col("length") < capacity).select("pid", "length")
    schema = "pid long, length long, block int, bin long"

    def dealt(rows: DataFrame, turn: int) -> tuple[DataFrame, int]:
        blocks = max(1, -(-rows.count() // block))
        placed = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "pid"), F.lit(blocks)).cast("int"))
        return written(placed.groupBy("block").applyInPandas(_pack_blocks(capacity), schema), "packed"), blocks

    def numbered(rows: DataFrame, turn: int) -> DataFrame:
        at = F.lit(turn << 53) + F.col("block").cast("long") * F.lit(1 << 30) + F.col("bin")
        return rows.select("pid", "length", at.alias("sequence_id"))

    packed, blocks = dealt(partial, 0)
    together, turn = None, 0
    while True:
        fill = packed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        full = F.col("fill") * 200 >= F.lit(199 * capacity)
        under = fill.where(~full).count()
        again = None
        if blocks > 1 and under > 1:
            good = fill.where(full).select("block", "bin")
            rest = packed.join(good, ["block", "bin"], "left_anti").select("pid", "length")
            again, blocks = dealt(rest, turn + 1)
            if again.select("block", "bin").distinct().count() >= under:
                again = None
        kept = packed if again is None else packed.join(good, ["block", "bin"], "left_semi")
        together = numbered(kept, turn) if together is None else together.unionByName(numbered(kept, turn))
        if again is None:
            break
        packed, turn = again, turn + 1
    inside = Window.partitionBy("sequence_id").orderBy("pid")  # at most as many pieces as ids fit
    before = F.sum("length").over(inside) - F.col("length")
    alone = pieces.where(F.col("length") >= capacity).select(
        "pid", (-F.col("pid") - F.lit(1)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return together.select("pid", "sequence_id", before.alias("offset")).unionByName(alone)


def best_fit(
    docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its place: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, if asked for, ``ids``.

    A document is the ids of its text and one end id; only longer ones than ``capacity`` are cut. Null
    and empty texts are the end id alone; repeated rows are packed as often as given; null ids are
    kept. ``sequence_id`` is any number; offsets are gapless from 0 within a sequence.
    """
    pieces = written(
        token_pieces(docs, vocabulary, id_col, text_col, capacity, with_ids).withColumn(
            "pid", F.monotonically_increasing_id()
        ),
        "pieces",
    )
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return pieces.join(pack_pieces(pieces.select("pid", "length"), capacity), "pid").select(
        F.col("id").alias(id_col), *columns
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences ``sequence_id, ids`` of pieces with their ids; each has at most the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
