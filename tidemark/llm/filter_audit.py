"""How filters act on one another: every order of applying them, step by step, for every part of a corpus.

Documents are first reduced to cells, the counts of each set of failed filters in a part. A recursive
query then extends prefixes of filters by one unused letter at a time and measures each step on the
cells, so that its work depends on the number of parts and filters and never on the documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ready, written

WORD_BREAK = r"[\x20\x09-\x0D]+"
ROW_LIMIT_KEY = "spark.sql.cteRecursionRowLimit"

STEPS = """
WITH RECURSIVE steps AS (
    SELECT part, '' AS filter_order, 0 AS applied, 0 AS step, 0L AS kept, 0L AS removed, 0L AS redundant,
           0L AS unique_fails, 0L AS good_lost, 0L AS toxic_lost
    FROM {cells}
    UNION ALL
    SELECT part, concat(filter_order, letter), applied | bit, step + 1,
           aggregate(filter(cells, c -> c.mask & (applied | bit) = 0), 0L, (n, c) -> n + c.docs),
           aggregate(filter(cells, c -> c.mask & bit != 0 AND c.mask & applied = 0), 0L, (n, c) -> n + c.docs),
           aggregate(filter(cells, c -> c.mask & bit != 0 AND c.mask & applied != 0), 0L, (n, c) -> n + c.docs),
           aggregate(filter(cells, c -> c.mask = bit), 0L, (n, c) -> n + c.docs),
           aggregate(filter(cells, c -> c.mask & bit != 0 AND c.mask & applied = 0), 0L, (n, c) -> n + c.good),
           aggregate(filter(cells, c -> c.mask & bit != 0 AND c.mask & applied = 0), 0L, (n, c) -> n + c.toxic)
    FROM (
        SELECT s.part, filter_order, applied, step, cells, inline(filter({unused}, l -> applied & l.bit = 0))
        FROM steps s JOIN {cells} c ON s.part = c.part
    )
)
SELECT * FROM steps WHERE step > 0
"""


@dataclass(frozen=True)
class Filters:
    """Failure conditions by letter, over the columns ``text`` and ``words``; one letter may be the copies.

    ``copies`` names the letter of documents whose whole text a smaller id has, too. Letters are applied
    as bits in the order given.
    """

    conditions: Mapping[str, Column]
    copies: str | None = None

    @property
    def letters(self) -> list[str]:
        return [*self.conditions, *([self.copies] if self.copies else [])]

    def bit(self, letter: str) -> int:
        return 1 << self.letters.index(letter)


def usual_filters() -> Filters:
    """A: under 200 words; B: under half of them distinct; C: over 3 % capitals; D: odd signs; E: copies."""
    text, words = F.col("text"), F.col("words")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return Filters(
        {
            "A": F.size(words) < 200,
            "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * capitals > 3 * F.length(text),
            "D": text.rlike(r"[#$%&*|]"),
        },
        copies="E",
    )


def mask_cells(
    docs: DataFrame, labels: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """Rows ``part, mask, docs, good, toxic``: documents of a part that fail exactly the filters of ``mask``.

    A null text is empty and a null part the empty string. Repeated rows count each; those that share
    the least id of their text are no copies, and neither are rows without an id. An id is good
    (toxic) if any of its labels says so; ids without labels and labels without ids count as neither.
    Other columns are ignored, and an empty table has no cells. Texts meet as SHA-256 digests after
    equal rows were counted, so a text that a third of the corpus repeats is a few rows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("words", F.array_remove(F.split("text", WORD_BREAK), ""))
    mask = F.lit(0)
    for letter, fails in filters.conditions.items():
        mask = mask.bitwiseOR(F.when(fails, filters.bit(letter)).otherwise(0))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)) if filters.copies else F.lit(None).cast("binary")
    counted = rows.select("id", "part", mask.alias("mask"), digest.alias("digest")).groupBy(
        "id", "part", "mask", "digest"
    ).agg(F.count(F.lit(1)).alias("docs"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    marked = counted.join(marks, "id", "left").na.fill(False, ["good", "toxic"])
    if filters.copies:
        marked = _with_copies(marked, filters.bit(filters.copies))
    return marked.groupBy("part", "mask").agg(
        F.sum("docs").alias("docs"), F.sum(F.when(F.col("good"), F.col("docs")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("docs")).otherwise(0)).alias("toxic"),
    )


def _with_copies(marked: DataFrame, bit: int) -> DataFrame:
    """Split the rows of each text into its first document and the copies of it, which get ``bit``.

    Rows of one text are added up per part, marks and labels before they meet, which leaves at most
    that many rows of a text, however often it is repeated.
    """
    named = F.col("id").isNotNull()
    sets = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("docs").alias("docs"),
        F.coalesce(F.sum(F.when(~named, F.col("docs"))), F.lit(0)).alias("nameless"),
        F.min(F.when(named, F.col("id"))).alias("least"),
        F.min(F.when(named, F.struct("id", "docs"))).getField("docs").alias("at_least"),
    )
    first = F.min("least").over(W.partitionBy("digest"))
    sets = sets.withColumn("kept", F.col("nameless") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    sides = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("kept").alias("docs")),
        F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), (F.col("docs") - F.col("kept")).alias("docs")),
    )
    return sets.select("part", "good", "toxic", F.inline(sides)).where("docs > 0")


def interactions(cells: DataFrame, letters: list[str]) -> DataFrame:
    """Every order of the filters and every step of it, measured on the cells of each part.

    Rows ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``, zeros included. A step's figures depend on the letters applied so far alone; they are
    computed once per prefix by the recursion and then read by all orders that begin with it.
    """
    spark = cells.sparkSession
    if len(set(letters)) != len(letters) or any(len(letter) != 1 for letter in letters):
        raise ValueError("filters need different single letters")
    packed = written(
        cells.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells")), "cells"
    )
    unused = "array(" + ",".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters)) + ")"
    before = spark.conf.get(ROW_LIMIT_KEY)
    spark.conf.set(ROW_LIMIT_KEY, "-1")  # the prefixes of all parts
    try:
        steps = written(spark.sql(STEPS.replace("{unused}", unused), cells=packed), "filter-steps").drop("applied")
    finally:
        spark.conf.set(ROW_LIMIT_KEY, before)
    orders = steps.where(F.col("step") == len(letters)).select("part", "filter_order")
    places = orders.select(
        "part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    ).withColumn("prefix", F.substring(F.col("filter_order"), F.lit(1), F.col("step")))
    found = places.join(steps.withColumnRenamed("filter_order", "prefix").drop("step"), ["part", "prefix"])
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return found.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", letter))).drop("prefix")


def audit(
    docs: DataFrame, labels: DataFrame, filters: Filters | None = None, id_col: str = "doc_id",
    text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """:func:`interactions` of the cells of ``docs`` (:func:`mask_cells`)."""
    ready(docs.sparkSession)
    filters = filters or usual_filters()
    return interactions(mask_cells(docs, labels, filters, id_col, text_col, part_col), filters.letters)
