"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex of ``links(a, b)``: rows ``(vertex, root)``.

    Every round hooks each vertex to its smallest neighbour, follows that pointer once more, and
    keeps only edges between vertices that are still different; a star vanishes in one round and a
    chain shortens at least by half. Null ends and self links are ignored; an empty input gives no rows.
    """
    edges = written(_undirected(links), "edges")
    vertices = edges.select(F.col("a").alias("vertex")).distinct()
    pointers = []
    while not edges.isEmpty():
        hooks = edges.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to"))
        onward = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
        pointer = written(
            hooks.join(onward, "to", "left").select("a", F.coalesce("next", "to").alias("to")), "pointers"
        )
        left = edges.join(pointer, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
        both = left.join(pointer, "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
        edges = written(_undirected(both), "edges")
        pointers.append(pointer)
    rooted = vertices.withColumn("root", F.col("vertex"))
    for pointer in pointers:
        step = pointer.select(F.col("a").alias("root"), "to")
        rooted = rooted.join(step, "root", "left").select("vertex", F.coalesce("to", "root").alias("root"))
    return written(rooted, "roots")


def _undirected(links: DataFrame) -> DataFrame:
    return (
        links.where(F.col("a") != F.col("b"))
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct()
    )
