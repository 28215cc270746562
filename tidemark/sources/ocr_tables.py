"""Word tables of frames (tab-separated) to text regions, one narrow pass per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.functions.boxes import box
from tidemark.functions.text import collapse_whitespace
from tidemark.operators.sequence import attach, number_rows
from tidemark.session import materialise
from tidemark.sources.lines import WHOLE_BYTES, quoted_records, read_lines
from tidemark.sources.paths import below, mapped_files

LOW_CONFIDENCE = 50
NEEDED = ("left", "top", "width", "height", "conf", "text")

# A field is quoted (doubled quotes inside, may hold tabs and line breaks) or runs to the next tab.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+(?:"[^\t\n]*+)?|[^\t\n]*+)'
_RECORD = rf"{_FIELD}(?:\t{_FIELD})*+(?:\n|$)"
_CELL = rf"(?:^|\t)({_FIELD})"


def _cells(record: Column) -> Column:
    values = F.regexp_extract_all(F.regexp_replace(record, "\n$", ""), F.lit(_CELL), F.lit(1))
    quoted = r'^"((?:[^"]|"")*+)"?'
    return F.transform(
        values,
        lambda v: F.when(
            F.startswith(v, F.lit('"')),
            F.replace(F.regexp_replace(v, quoted, "$1"), F.lit('""'), F.lit('"')),
        ).otherwise(v),
    )


def parse_word_tables(
    frames: DataFrame, min_confidence: float, max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Regions and rejected frames of ``source_id, shot_id, keyframe_id, frame_no, timestamp_ms,
    content``.

    Blank words and words below ``min_confidence`` are dropped. A kept word with a negative or empty
    box, a row without a needed cell, or a missing column rejects its whole frame. A caller that
    gives ``max_bytes`` has larger tables rejected with a reason; by default every table is read.
    """
    def words_of(rows: Column) -> Column:
        body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
        return let(
            _places(F.get(rows, F.lit(0))),
            lambda at: let(F.transform(body, lambda row, i: _word(row, i, at)), lambda words: verdict(at, words)),
        )

    def verdict(at: Column, words: Column) -> Column:
        return let(
            F.filter(words, lambda w: _said(w, min_confidence)),
            lambda k: F.struct(
                F.when(~_complete(at), "columns_missing")
                .when(F.exists(words, _unreadable), "cell_unreadable")
                .when(F.exists(k, _bad_box), "bad_geometry").alias("reason"),
                k.alias("kept"),
            ),
        )

    text = F.regexp_replace("content", "\r\n?", "\n")
    records = F.filter(F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0)), lambda r: ~r.isin("", "\n"))
    parsed = let(F.transform(records, _cells), words_of)
    large = F.lit(False) if max_bytes is None else F.octet_length("content") > max_bytes
    columns = ["source_id", "shot_id", "keyframe_id", "frame_no", "timestamp_ms"]
    # Unpacking a one-element list keeps the optimiser from parsing again for every later use.
    table = frames.select(*columns, large.alias("_large"), F.explode(F.array(F.when(~large, parsed))).alias("_p"))
    table = table.select(
        *columns, F.when(F.col("_large"), "frame_too_large").otherwise(F.col("_p.reason")).alias("reason"),
        F.col("_p.kept").alias("_kept"),
    )
    rejects = table.filter("reason is not null").select("source_id", "keyframe_id", "reason")
    words = table.filter("reason is null").select(
        "source_id", "shot_id", "keyframe_id", "frame_no", "timestamp_ms",
        F.posexplode("_kept").alias("_pos", "w"),
    )
    return _regions(words.withColumn("_no", F.col("_pos") + 1)), rejects


def _places(header: Column) -> Column:
    """Position of each needed column, from 1; 0 where it is missing."""
    return F.struct(*[F.array_position(header, F.lit(n)).cast("int").alias(n) for n in NEEDED])


def _complete(at: Column) -> Column:
    complete = F.lit(True)
    for name in NEEDED:
        complete = complete & (at[name] > 0)
    return F.coalesce(complete, F.lit(False))


def _word(row: Column, index: Column, at: Column) -> Column:
    """One word of a table from the cells of its row, the ``index``-th below the header from 0."""
    def cell(name: str) -> Column:
        return F.get(row, at[name] - 1)

    sizes = [F.trim(cell(c)).try_cast("int") for c in ("left", "top", "width", "height")]
    return F.struct(
        (index + 1).cast("long").alias("row_index"), cell("text").alias("text"),
        F.trim(cell("conf")).try_cast("double").alias("conf"),
        *[n.alias(c) for n, c in zip(sizes, ("x", "y", "w", "h"))],
    )


def _said(w: Column, min_confidence: float) -> Column:
    return (collapse_whitespace(w["text"]) != "") & ~F.isnan(w["conf"]) & (w["conf"] >= min_confidence)


def _unreadable(w: Column) -> Column:
    return w["text"].isNull() | w["conf"].isNull()


def _bad_box(w: Column) -> Column:
    return F.coalesce((w["x"] < 0) | (w["y"] < 0) | (w["w"] <= 0) | (w["h"] <= 0), F.lit(True))


# A line as a part of quoted records: complete fields, and whether it ends inside a quote.
_CLOSED = r'(?:"[^"]*+(?:""[^"]*+)*+"[^\t]*+|[^"\t][^\t]*+|)'
_FROM_OUTSIDE = rf"^{_CLOSED}(?:\t{_CLOSED})*+$"
_FROM_INSIDE = rf'^[^"]*+(?:""[^"]*+)*+"[^\t]*+(?:\t{_CLOSED})*+$'


def parse_word_lines(lines: DataFrame, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """The same of tables of any size, from ``source_id, shot_id, keyframe_id, frame_no, timestamp_ms,
    line_no, line``. Only the lines of one record, which a quoted field may join, meet in one value.
    """
    keys = ["source_id", "shot_id", "keyframe_id", "frame_no", "timestamp_ms"]
    states = lines.withColumns(
        {"_opens": ~F.col("line").rlike(_FROM_OUTSIDE), "_stays": ~F.col("line").rlike(_FROM_INSIDE)}
    )
    placed = quoted_records(states, keys, "_opens", "_stays")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    records = placed.groupBy(*keys, "record_no").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("_record")
    ).where("_record <> ''").select(*keys, "record_no", _cells(F.col("_record")).alias("_row"))
    numbered = materialise(number_rows(records, keys, ["record_no"], "_at"))
    headers = numbered.where("_at = 1").select(*keys, _places(F.col("_row")).alias("_places"))
    body = attach(numbered.where("_at > 1"), headers, keys)
    words = body.select(*keys, F.explode(F.array(_word(F.col("_row"), F.col("_at") - 2, F.col("_places")))).alias("w"))
    w = F.col("w")
    words = materialise(words.withColumn("_kept", F.coalesce(_said(w, min_confidence), F.lit(False))))
    spoiled = words.groupBy(*keys).agg(
        F.max(_unreadable(w)).alias("_unreadable"), F.max(F.col("_kept") & _bad_box(w)).alias("_bad_box")
    )
    judged = attach(headers, spoiled, keys, "left").withColumn(
        "reason",
        F.when(~_complete(F.col("_places")), "columns_missing").when(F.col("_unreadable"), "cell_unreadable")
        .when(F.col("_bad_box"), "bad_geometry"),
    )
    good = attach(words.where("_kept"), judged.where("reason is null").select(*keys), keys, "left_semi")
    regions = number_rows(good.withColumn("_row_index", w["row_index"]), keys, ["_row_index"], "_no").drop("_row_index")
    empty = lines.select(*keys).distinct()
    blank = attach(empty, headers.select(*keys), keys, "left_anti").select(
        "source_id", "keyframe_id", F.lit("columns_missing").alias("reason")
    )
    rejects = judged.where("reason is not null").select("source_id", "keyframe_id", "reason")
    return _regions(regions), rejects.unionByName(blank)


def _regions(words: DataFrame) -> DataFrame:
    """Region rows from the words ``w`` of a frame, ``_no`` counting the kept ones."""
    identifier = F.format_string("OCR_%04d_%04d", F.col("frame_no"), F.col("_no"))
    x, y = F.col("w.x"), F.col("w.y")
    return words.select(
        "source_id", "shot_id", "keyframe_id", identifier.alias("observation_id"), "timestamp_ms",
        F.col("w.row_index").alias("row_index"), F.col("w.text").alias("text"),
        collapse_whitespace(F.col("w.text")).alias("normalized_text"),
        box(x, y, x + F.col("w.w"), y + F.col("w.h")).alias("bounding_box"),
        F.col("w.conf").alias("ocr_confidence"),
        F.when(F.col("w.conf") < LOW_CONFIDENCE, F.array(F.lit("low_confidence")))
        .otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.format_string("VID:%s:frame:%d", "source_id", "timestamp_ms").alias("source_frame_evidence_ref"),
        F.concat(F.lit("OCR:"), identifier).alias("evidence_ref"),
    )


def read_ocr_tables(
    spark: SparkSession, path: str, frames: DataFrame, min_confidence: float, max_bytes: int | None = None,
    whole_bytes: int = WHOLE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Read word tables below ``path``; ``frames`` maps ``file_name``, the path below it, to the frame columns.

    Rejects also name stored files without a row and rows without a stored file. Files above
    ``max_bytes``, if given, are rejected before they are read; those above ``whole_bytes`` are read by
    byte ranges, line by line.
    """
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named, unmatched = mapped_files(stored, path, frames)
    columns = ["source_id", "shot_id", "keyframe_id", "frame_no", "timestamp_ms"]
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    large = named.filter(too_large).select("source_id", "keyframe_id", F.lit("frame_too_large").alias("reason"))
    fits = named.filter(~too_large)
    whole = fits.filter(F.col("length") <= whole_bytes).withColumn("content", F.decode("content", "UTF-8"))
    regions, rejects = parse_word_tables(whole.select(*columns, "content"), min_confidence)
    long = fits.filter(F.col("length") > whole_bytes).select("file_name", *columns)
    if not long.isEmpty():
        lines = read_lines(spark, path, whole_bytes).withColumn("file_name", below(F.col("path"), path))
        more, spoiled = parse_word_lines(lines.join(long, "file_name").select(*columns, "line_no", "line"), min_confidence)
        regions, rejects = regions.unionByName(more), rejects.unionByName(spoiled)
    return regions, rejects.unionByName(large).unionByName(
        unmatched.select("source_id", "keyframe_id", "file_name", "reason"), allowMissingColumns=True
    )
