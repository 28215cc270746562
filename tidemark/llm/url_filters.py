"""Dated URL lists as validity intervals, and the verdict of the lists at the time of each capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, salt_of, salted, written

# What an entry says; among entries of one instant the later one in this list holds.
ACTIONS = ("remove", "allow", "block")


def _month(time: Column) -> Column:
    return F.year(time) * F.lit(12) + F.month(time)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def keys_of(url: Column) -> Column:
    """All keys under which a URL may be listed: its host, every parent domain of at least two labels,
    and the host with each leading part of the path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, count), ".")
    )
    path = F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """Entries ``list, key, action, at`` as ``list, key, action, valid_from, valid_to``.

    An entry holds until the next entry of its list and key; the last one holds for good (null
    ``valid_to``). At one instant block outweighs allow and allow outweighs remove. ``remove`` ends
    an interval and starts none. Rows with a null or an unknown action are left out. The next entry is
    looked up inside a month and over the months that have entries, so a long history is not one task.
    """
    rank = F.array_position(F.array(*(F.lit(a) for a in ACTIONS)), F.col("action"))
    known = entries.where(
        F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(*ACTIONS)
    )
    changes = (
        known.select("list", F.lower("key").alias("key"), "at", rank.alias("rank"))
        .groupBy("list", "key", "at").agg(F.max("rank").alias("rank"))
        .withColumn("month", _month(F.col("at")))
    )
    over_months = Window.partitionBy("list", "key").orderBy("month")
    later = (
        changes.groupBy("list", "key", "month").agg(F.min("at").alias("first"))
        .select("list", "key", "month", F.lead("first").over(over_months).alias("later"))
    )
    inside = Window.partitionBy("list", "key", "month").orderBy("at")
    return (
        changes.withColumn("next", F.lead("at").over(inside)).join(later, ["list", "key", "month"])
        .where(F.col("rank") > 1)
        .select(
            "list", "key", F.element_at(F.array(*(F.lit(a) for a in ACTIONS)), F.col("rank").cast("int")).alias("action"),
            F.col("at").alias("valid_from"), F.coalesce("next", "later").alias("valid_to"),
        )
    )


def verdicts(
    captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at"
) -> DataFrame:
    """Rows ``page_id, fetched_at, verdict, list, key``: what the lists said of each capture when it was made.

    The entry with the most specific key that was active at the time decides: more path parts, then
    more host labels; then block before allow, then the first list by name. Without one, and for null
    or hostless URLs and null times, the verdict is ``none``. Repeated captures are all returned;
    other columns are ignored.

    Intervals that ended are cut at months, and captures meet them on (key, month, salt): an equality
    join in which a capture sees only what was listed under its keys in its month. An entry that is
    still active is one row, whatever time has passed, and is met on (key, salt); both joins use one
    placement of the captures. A host with a large part of all captures is spread over salts.
    """
    ready(captures.sparkSession)
    rows = written(
        captures.select(
            F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("time")
        ).withColumn("row", F.monotonically_increasing_id()),
        "captures",
    )
    wanted = (
        rows.where(F.col("time").isNotNull())
        .select("row", "time", _month(F.col("time")).alias("month"), F.explode(keys_of(F.col("url"))).alias("key"))
        .withColumn("salt", salt_of("row"))
        .repartition("key", "salt")
    )
    span = rows.agg(F.min(_month(F.col("time"))).alias("first"), F.max(_month(F.col("time"))).alias("last"))
    bounds = span.first()
    if bounds["first"] is None:
        nothing = [F.lit(None).cast("string").alias(c) for c in ("list", "key")]
        return rows.select(F.col("id").alias(id_col), F.col("time").alias(time_col), F.lit("none").alias("verdict"), *nothing)
    first = F.greatest(_month(F.col("valid_from")), F.lit(bounds["first"]))
    last = F.least(_month(F.col("valid_to")), F.lit(bounds["last"]))
    spans = written(intervals(entries), "intervals")
    cells = (
        spans.where("valid_to IS NOT NULL").withColumn("lo", first).withColumn("hi", last).where("lo <= hi")
        .withColumn("month", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    )
    said = ["row", "key", "list", "action"]
    ended = wanted.join(salted(cells), ["key", "salt", "month"]).where(
        (F.col("valid_from") <= F.col("time")) & (F.col("time") < F.col("valid_to"))
    )
    still = wanted.join(salted(spans.where("valid_to IS NULL")), ["key", "salt"]).where(F.col("valid_from") <= F.col("time"))
    active = ended.select(*said).unionByName(still.select(*said))
    parts = F.size(F.split("key", "/"))
    labels = F.size(F.split(F.element_at(F.split("key", "/"), 1), r"\."))
    # The smallest of these is the deciding entry.
    rank = F.struct(
        (-parts).alias("parts"), (-labels).alias("labels"), (F.col("action") != "block").alias("allows"),
        F.col("list").alias("list"), F.col("key").alias("key"),
    )
    decided = active.groupBy("row").agg(F.min(rank).alias("best"))
    verdict = F.when(F.col("best").isNull(), "none").when(F.col("best.allows"), "allow").otherwise("block")
    return rows.join(decided, "row", "left").select(
        F.col("id").alias(id_col), F.col("time").alias(time_col), verdict.alias("verdict"),
        F.col("best.list").alias("list"), F.col("best.key").alias("key"),
    )
