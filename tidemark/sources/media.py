"""Probe documents (JSON) to source, stream and chapter tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.functions.digests import content_id
from tidemark.functions.timecode import seconds_to_ms
from tidemark.schemas import MEDIA_PROBE


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps: at most five for each digit of the smaller number."""
    steps = 5 * F.length(F.least(a, b).cast("string"))
    pair = F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    done = F.aggregate(
        F.sequence(F.lit(1), steps), pair,
        lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(
            F.struct(acc["b"].alias("a"), (acc["a"] % F.nullif(acc["b"], F.lit(0))).alias("b"))
        ),
    )
    return done["a"]


def reduced_rate(text: Column) -> Column:
    """Rational frame rate in lowest terms; null for 0/0 and anything unreadable."""
    parts = F.split(text, "/")
    top = F.get(parts, F.lit(0)).try_cast("long")
    bottom = F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("long")
    usable = F.regexp_like(text, F.lit(r"^\d+(/\d+)?$")) & (bottom > 0)

    def shown(common: Column) -> Column:
        shown_top = F.call_function("div", top, F.nullif(common, F.lit(0)))
        shown_bottom = F.call_function("div", bottom, F.nullif(common, F.lit(0)))
        return F.when(shown_bottom == 1, shown_top.cast("string")).otherwise(F.concat_ws("/", shown_top, shown_bottom))

    return F.when(usable, let(_gcd(top, bottom), shown))


def parse_media(
    documents: DataFrame, max_duration_ms: int, max_width: int, max_height: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables ``sources, streams, chapters, over_limit`` from ``sha256, size_bytes, probe`` rows.

    Duration falls back to the longest stream. Documents without a usable duration or format, or
    above a limit, are listed in ``over_limit`` with the reason; limit rows stay in the tables.
    """
    read = documents.withColumn("p", F.from_json("probe", MEDIA_PROBE)).withColumn(
        "source_id", content_id(F.col("sha256"))
    )
    longest = F.array_max(F.transform("p.streams", lambda s: seconds_to_ms(s["duration"])))
    read = read.withColumn(
        "duration_ms", F.coalesce(seconds_to_ms(F.col("p.format.duration")), longest, F.lit(0).cast("long"))
    )
    valid = F.col("p.format.format_name").isNotNull() & (F.col("duration_ms") > 0)
    names = F.array_sort(F.filter(F.split("p.format.format_name", ","), lambda n: n != ""))
    good = read.filter(F.coalesce(valid, F.lit(False)))
    sources = good.select(
        "source_id", F.col("sha256").alias("content_sha256"), "size_bytes", "duration_ms",
        names.alias("format_names"),
    )
    opened = good.select("source_id", F.explode("p.streams").alias("s"))
    streams = opened.select(
        "source_id", F.col("s.index").alias("stream_index"),
        F.coalesce("s.codec_type", F.lit("unknown")).alias("codec_type"), F.col("s.codec_name").alias("codec_name"),
        F.col("s.tags").getItem("language").alias("language"), F.col("s.tags").getItem("title").alias("title"),
        F.col("s.time_base").alias("time_base"),
        F.when(F.col("s.avg_frame_rate") != "0/0", reduced_rate(F.col("s.avg_frame_rate"))).alias("frame_rate"),
        seconds_to_ms(F.col("s.duration")).alias("duration_ms"), F.col("s.width").alias("width"),
        F.col("s.height").alias("height"),
        F.transform_values("s.disposition", lambda _, v: v != 0).alias("disposition"),
    )
    marked = good.select("source_id", F.posexplode("p.chapters").alias("pos", "c"))
    chapters = marked.select(
        "source_id", F.coalesce(F.col("c.id"), F.col("pos").cast("long")).alias("chapter_id"),
        F.coalesce(seconds_to_ms(F.col("c.start_time")), F.lit(0)).alias("start_ms"),
        F.coalesce(seconds_to_ms(F.col("c.end_time")), F.lit(0)).alias("end_ms"),
        F.col("c.tags").getItem("title").alias("title"),
    )

    def wide(field: str, bound: int) -> Column:
        return F.coalesce(F.exists("p.streams", lambda s: F.coalesce(s[field] > bound, F.lit(False))), F.lit(False))

    reasons = F.array(
        F.when(~F.coalesce(valid, F.lit(False)), "duration_or_format_missing"),
        F.when(F.col("duration_ms") > max_duration_ms, "duration"),
        F.when(wide("width", max_width), "width"),
        F.when(wide("height", max_height), "height"),
    )
    over = read.select(
        "source_id", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason")
    )
    return sources, streams, chapters, over


def read_media_metadata(
    spark: SparkSession, path: str, max_duration_ms: int, max_width: int, max_height: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Read one JSON line per source: ``{"sha256", "size_bytes", "probe": "<probe document>"}``."""
    documents = spark.read.schema("sha256 string, size_bytes bigint, probe string").json(path)
    return parse_media(documents, max_duration_ms, max_width, max_height)
