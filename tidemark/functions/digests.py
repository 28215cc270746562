"""Content-derived identity: canonical digests, source and operator identifiers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import attach
from tidemark.session import FOLD_ROWS_KEY, limit, materialise

LEVELS = (8, 6, 4, 2, 0)  # hex digits that name a node of the digest tree, from the leaves up


def content_id(sha256: Column) -> Column:
    """Source identifier of a content hash."""
    return F.concat(F.lit("SRC_"), F.upper(F.substring(sha256, 1, 12)))


def pseudonymise(identity: Column) -> Column:
    """Stable operator pseudonym of an identity text."""
    return F.concat(F.lit("OPR_"), F.upper(F.substring(F.sha2(identity, 256), 1, 12)))


def id_collisions(df: DataFrame, identifier: str, content: str) -> DataFrame:
    """Identifiers that stand for more than one content."""
    return (
        df.groupBy(identifier)
        .agg(F.count_distinct(content).alias("contents"))
        .filter(F.col("contents") > 1)
    )


def canonical_json(columns: Sequence[str]) -> Column:
    """Sorted keys, no spaces, nulls kept. Give doubles as text: their spelling differs by engine."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def record_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of one record without its own hash column."""
    return F.sha2(canonical_json(columns), 256)


def verify_digest(df: DataFrame, columns: Sequence[str], hash_column: str) -> DataFrame:
    """Rows whose stored hash is not the hash of their content."""
    return df.filter(~F.col(hash_column).eqNullSafe(record_digest(columns)))


def _list_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``[item,item,…]`` for each run of one group, item by item."""
    current, digest = None, None

    def done():
        digest.update(b"]")
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["g", "h"]
        )

    for batch in batches:
        for group, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest is None or group != current:
                if digest is not None:
                    yield done()
                current, digest = group, hashlib.sha256(b"[")
                digest.update(item.encode())
            else:
                digest.update(b"," + item.encode())
    if digest is not None:
        yield done()


def set_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group, SHA-256 of the canonical JSON list of its sorted tuples.

    The digest of one list is sequential by definition. Groups that fit an array are hashed inside the
    JVM; the sorted items of larger ones stream through one task in constant memory, however many they
    are, to the same result. ``set_digest_tree`` spreads a group.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bound = limit(df.sparkSession, FOLD_ROWS_KEY)
    large = materialise(sizes.filter(F.col("_n") > bound).drop("_n"))
    if large.isEmpty():
        return _digest_in_arrays(df, keys, columns)
    return _digest_in_arrays(attach(df, large, keys, "left_anti"), keys, columns).unionByName(
        _digest_in_streams(attach(df, large, keys, "left_semi"), keys, columns)
    )


def _digest_in_arrays(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    tuples = F.array(*[F.col(c).cast("string") for c in columns])
    listed = F.to_json(F.array_sort(F.collect_list(tuples)))
    return df.groupBy(*keys).agg(F.sha2(listed, 256).alias("set_sha256"))


def _digest_in_streams(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    items = F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))
    tuples = F.array(*[F.col(c).cast("string") for c in columns])
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    listed = (
        df.select(group.alias("_g"), tuples.alias("_t"), items.alias("_item"))
        .repartition("_g").sortWithinPartitions("_g", "_t").select("_g", "_item")
        .mapInArrow(_list_hash, "g string, h string")
    )
    shape = df.select(*keys).schema
    return listed.select(F.from_json("g", shape).alias("k"), F.col("h").alias("set_sha256")).select("k.*", "set_sha256")


def set_digest_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free digest of sets of any size: a radix tree over the hashes of the tuples.

    Leaves are named by eight hex digits of the tuple hash, and each level above folds the up to 256
    nodes that share two digits less. Equal tuples are counted before they are moved, so no list
    grows with the set: a leaf holds the distinct tuples that share 32 bits of their hash.
    """
    leaf = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)
    counted = df.select(*keys, leaf.alias("_leaf")).groupBy(*keys, "_leaf").count()
    nodes = counted.select(*keys, "_leaf", F.concat_ws(":", "_leaf", F.col("count").cast("string")).alias("_entry"))
    for digits in LEVELS:
        nodes = nodes.groupBy(*keys, F.substring("_leaf", 1, digits).alias("_node")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("_entry")), ","), 256).alias("_hash")
        )
        nodes = nodes.select(
            *keys, F.col("_node").alias("_leaf"), F.concat_ws(":", "_node", "_hash").alias("_entry"), "_hash"
        )
    return nodes.select(*keys, F.col("_hash").alias("tree_sha256"))
