"""Bounded training samples of labelled and of unlabelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def first_by_hash(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """The ``bound`` rows whose keys come first in a fixed random order.

    Rows that cannot be among them are left out before the sort, so that its last task gets about
    twice the bound whatever the number of partitions.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    count = rows.count()
    if count > 4 * bound:
        rows = rows.where(slot < F.lit(2 * bound * (1 << 30) // count + 1))
    return rows.orderBy(slot, F.xxhash64(key), key).limit(bound)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, fold: int, bound: int
) -> DataFrame:
    """Rows ``(label, text)`` of at most ``bound`` labelled ids for each class, outside the held-out fold.

    The ids are the first ones by hash, so the sample is the same in every run and grows with the
    labels up to the bound. An id with several labels has its largest, one with several rows its least
    text; null ids and labels are left out.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col, modulus, fold))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    )
    chosen = None
    for label in (0, 1):
        part = first_by_hash(known.where(F.col("label") == label), "id", bound)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.join(F.broadcast(chosen), "id")  # at most 2 * bound ids
    return found.groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")


def unlabelled_sample(docs: DataFrame, id_col: str, text_col: str, modulus: int, fold: int, bound: int) -> DataFrame:
    """Texts of at most ``bound`` ids outside the held-out fold, the first ones by hash, labels unread."""
    ids = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull())
    chosen = first_by_hash(ids.where(~held_out("id", modulus, fold)).distinct(), "id", bound)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text")).select("text")


def class_shares(labels: DataFrame, id_col: str, label_col: str, modulus: int, fold: int) -> tuple[int, int]:
    """Labelled ids of class 0 and of class 1 outside the held-out fold."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col, modulus, fold))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    )
    return known["n"] - known["ones"], known["ones"]
