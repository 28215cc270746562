"""Integrity checks over ledger tables. Every check yields rows of one ``violations`` layout:
``source_id, check_name, rule, subject``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.rules import broken
from tidemark.operators.sequence import shift
from tidemark.operators.timeline import chunk_id, overlapping_chunks
from tidemark.schemas import OUTCOMES_WITH_ROWS, SPEECH_SOURCES
from tidemark.session import BLOCK_ROWS_KEY, limit


def _report(df: DataFrame, check: str, rule: str | Column, subject: Column) -> DataFrame:
    return df.select(
        "source_id", F.lit(check).alias("check_name"),
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"),
        subject.cast("string").alias("subject"),
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def check_event_bounds(events: DataFrame, sources: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Intervals that are not inside their source."""
    joined = events.join(sources.select("source_id", "duration_ms"), "source_id", "left")
    inside = (
        (F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("end_ms"))
        & (F.col("end_ms") <= F.col("duration_ms"))
    )
    outside = joined.filter(~F.coalesce(inside, F.lit(False)))
    return _report(outside, "event_bounds", "outside_source", F.col(id_column))


def check_event_order(events: DataFrame, position: str = "position") -> DataFrame:
    """Stored rows whose (start, end, id) is smaller than that of the row stored before them."""
    keyed = events.withColumn("_key", F.struct("start_ms", "end_ms", "event_id"))
    followed = shift(
        keyed.select("source_id", "event_id", position, "_key"), ["source_id"], [position], {"_before": ("_key", -1)}
    )
    return _report(followed.filter("_key < _before"), "event_order", "not_ordered", F.col("event_id"))


def check_stored_order(stored: DataFrame, key: Sequence[str], subject: str) -> DataFrame:
    """Rows whose key is smaller than that of the row stored before them, in their file or at the end
    of the file before it.

    ``stored`` has the rows with ``file`` and ``row_index``, their place in it. Inside a file neighbours are
    found in blocks of consecutive rows; over the borders only the first and the last row of each file
    are compared. The table is never sorted, and no task sees a whole file.
    """
    size = limit(stored.sparkSession, BLOCK_ROWS_KEY)
    rows = stored.select(
        "source_id", "file", "row_index", F.struct(*key).alias("_key"), F.col(subject).alias("_subject")
    )
    home = F.floor(F.col("row_index") / size).cast("long")
    seen_in = F.array_distinct(F.array(home, F.floor((F.col("row_index") + 1) / size).cast("long")))
    placed = rows.withColumn("_home", home).withColumn("_block", F.explode(seen_in))
    near = W.partitionBy("file", "_block").orderBy("row_index")
    inside = placed.withColumn("_last", F.lag("_key").over(near)).filter("_home = _block")
    ends = rows.groupBy("file").agg(
        F.min_by(F.struct("source_id", "_key", "_subject"), "row_index").alias("_first"),
        F.max_by("_key", "row_index").alias("_end"), F.lit(0).alias("_all"),
    )
    borders = shift(ends, ["_all"], ["file"], {"_last": ("_end", -1)}).select("_first.*", "_last")
    below = _union([part.select("source_id", "_key", "_last", "_subject") for part in (inside, borders)])
    return _report(below.filter("_key < _last"), "stored_order", "not_ordered", F.col("_subject"))


def check_chunk_provenance(events: DataFrame, sources: DataFrame, size_ms: int, overlap_ms: int) -> DataFrame:
    """Stored chunk lists against the recomputed ones; events that meet no chunk also fail."""
    joined = events.join(sources.select("source_id", "duration_ms"), "source_id")
    expected = F.transform(
        overlapping_chunks(F.col("start_ms"), F.col("end_ms"), F.col("duration_ms"), size_ms, overlap_ms),
        chunk_id,
    )
    joined = joined.withColumn("_expected", expected)
    good = (
        (F.size("_expected") > 0)
        & F.col("chunk_ids").eqNullSafe(F.col("_expected"))
        & F.col("chunk_id").eqNullSafe(F.get("_expected", F.lit(0)))
    )
    return _report(joined.filter(~good), "chunk_provenance", "chunks_differ", F.col("event_id"))


def check_revision_chain(final: DataFrame, provisional: DataFrame) -> DataFrame:
    """Final events without provisional predecessor, not advancing it, or repeated out of order.

    Both sides go through one grouping, so no task sorts or joins them.
    """
    keys = ["source_id", "event_id"]
    sides = final.select(*keys, "revision", F.lit(True).alias("_final"), F.lit(0).alias("_provisional")).unionByName(
        provisional.select(
            *keys, "revision", F.lit(False).alias("_final"),
            F.when(F.col("status") == "provisional", 1).otherwise(0).alias("_provisional"),
        )
    )
    rows = sides.groupBy(*keys, "_final", "revision").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_provisional").alias("_provisional")
    )
    last, before = F.col("_final"), ~F.col("_final")
    events = rows.groupBy(*keys).agg(
        F.min(F.when(last, F.col("revision"))).alias("_least"), F.sum(F.when(last, F.col("_n"))).alias("_rows"),
        F.count(F.when(last, F.col("revision"))).alias("_revisions"),
        F.max(F.when(before, F.col("revision"))).alias("_before"), F.max("_provisional").alias("_provisional"),
    ).filter("_rows is not null")
    missing = F.col("_provisional") == 0
    rules = F.array(
        F.when(missing, F.lit("no_provisional")),
        F.when(~missing & (F.col("_before") >= F.col("_least")), F.lit("not_advancing")),
        F.when(F.col("_rows") > F.col("_revisions"), F.lit("not_increasing")),
    )
    named = events.withColumn("_rule", F.explode(F.filter(rules, lambda rule: rule.isNotNull())))
    return _report(named, "revision_chain", F.col("_rule"), F.col("event_id"))


def dangling_evidence(
    references: DataFrame | Sequence[tuple[str, DataFrame]], evidence: DataFrame
) -> DataFrame:
    """References with no evidence row.

    ``references`` are a table with ``evidence_ref`` and ``origin``, or pairs of an origin and its table.
    """
    if not isinstance(references, DataFrame):
        references = _union(
            [df.select("source_id", "evidence_ref", F.lit(origin).alias("origin")) for origin, df in references]
        )
    # References mostly are a union, and an anti join would be moved into each part of it and read evidence
    # again there. It stays above references that come out of arrays.
    named = references.select(
        "source_id", F.inline(F.array(F.struct(F.col("origin").alias("rule"), "evidence_ref")))
    )
    lost = named.join(evidence.select("source_id", "evidence_ref"), ["source_id", "evidence_ref"], "left_anti")
    return _report(lost, "evidence_refs", F.col("rule"), F.col("evidence_ref"))


def check_speech_source(speech: DataFrame) -> DataFrame:
    """Quoted speech from a source that may not be quoted, or without speech evidence."""
    rules = [
        ("source_not_allowed", F.col("source").isin(list(SPEECH_SOURCES))),
        ("no_speech_evidence", F.col("evidence_ref").rlike("^(ASR|SUB):")),
    ]
    return _report(
        speech.withColumn("_rule", F.explode(broken(rules))), "speech", F.col("_rule"), F.col("evidence_ref")
    )


def check_outcomes(outcomes: DataFrame) -> DataFrame:
    """Unit counts that do not add up, and failed adapters that report rows."""
    lost = F.col("failed") + F.col("unsupported")
    rules = [
        ("rows_from_failed_adapter", F.col("status").isin(list(OUTCOMES_WITH_ROWS)) | (F.col("observation_count") == 0)),
        ("emitted_differs", F.col("emitted_observations") == F.col("observation_count")),
        ("units_do_not_balance", F.col("successful") + lost == F.col("attempted")),
        ("timeouts_exceed_failures", F.col("timed_out") <= F.col("failed")),
        ("partial_without_both_sides", (F.col("status") != "partial_success") | ((F.col("successful") > 0) & (lost > 0))),
    ]
    return _report(
        outcomes.withColumn("_rule", F.explode(broken(rules))), "adapter_outcomes", F.col("_rule"), F.col("adapter")
    )


def check_continuity(shots: DataFrame, sources: DataFrame) -> DataFrame:
    """Shots must start at 0, touch each other and end with their source."""
    followed = shift(
        shots.select("source_id", "shot_id", "shot_no", "start_ms", "end_ms"),
        ["source_id"], ["shot_no"], {"_end_before": ("end_ms", -1)},
    )
    broken_at = followed.filter(F.col("start_ms") != F.coalesce("_end_before", F.lit(0)))
    last = shots.groupBy("source_id").agg(
        F.max_by("end_ms", "shot_no").alias("_last_end"), F.max_by("shot_id", "shot_no").alias("shot_id")
    )
    ends = last.join(sources.select("source_id", "duration_ms"), "source_id")
    return _union(
        [
            _report(broken_at, "shots", "discontinuous", F.col("shot_id")),
            _report(ends.filter("_last_end <> duration_ms"), "shots", "last_end_differs", F.col("shot_id")),
            _report(check_event_bounds(shots, sources, "shot_id"), "shots", "outside_source", F.col("subject")),
        ]
    )


def check_keyframes(keyframes: DataFrame, shots: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Unknown shots, repeated or missing keyframes, frames outside their shot, changed content."""
    keys = ["source_id", "shot_id"]
    joined = keyframes.join(
        shots.select(*keys, F.col("start_ms").alias("_start"), F.col("end_ms").alias("_end")), keys, "left"
    )
    unknown = F.col("_start").isNull()
    outside = ~((F.col("timestamp_ms") >= F.col("_start")) & (F.col("timestamp_ms") < F.col("_end")))
    counts = keyframes.groupBy(*keys).count()
    per_shot = shots.select(*keys).join(counts, keys, "left")
    parts = [
        _report(joined.filter(unknown), "keyframes", "unknown_shot", F.col("keyframe_id")),
        _report(joined.filter(~unknown & outside), "keyframes", "outside_shot", F.col("keyframe_id")),
        _report(per_shot.filter("count > 1"), "keyframes", "repeated_for_shot", F.col("shot_id")),
        _report(per_shot.filter("count is null"), "keyframes", "shot_without_keyframe", F.col("shot_id")),
    ]
    if artifacts is not None:
        held = artifacts.select("path", F.col("sha256").alias("_actual"))
        changed = keyframes.join(held, "path", "left").filter(
            ~F.col("sha256").eqNullSafe(F.col("_actual"))
        )
        parts.append(_report(changed, "keyframes", "content_differs", F.col("keyframe_id")))
    return _union(parts)


def reconcile(
    package: DataFrame, expected: DataFrame, keys: Sequence[str], attributes: Sequence[str], subject: str
) -> DataFrame:
    """Two-sided completeness: rows only expected, only present, repeated, or with other values.

    The copies of a key are compared by their least and their greatest value of each attribute, so
    one differing copy among sound ones is found as well.
    """
    def ends(side: str) -> list[Column]:
        return [
            F.struct(F.min(F.struct(F.col(c))).alias("least"), F.max(F.struct(F.col(c))).alias("most")).alias(f"{side}{c}")
            for c in attributes
        ]

    left = package.groupBy("source_id", *keys).agg(F.count(F.lit(1)).alias("_rows"), *ends("_p_"))
    right = expected.groupBy("source_id", *keys).agg(F.lit(True).alias("_expected"), *ends("_e_"))
    both = left.join(right, ["source_id", *keys], "full")
    rules = [
        ("missing", F.col("_rows").isNotNull()),
        ("unexpected", F.col("_expected").isNotNull()),
        ("repeated", F.coalesce("_rows", F.lit(1)) == 1),
    ]
    one_sided = F.col("_rows").isNull() | F.col("_expected").isNull()
    rules += [
        (f"differs:{c}", one_sided | F.col(f"_p_{c}").eqNullSafe(F.col(f"_e_{c}"))) for c in attributes
    ]
    return _report(
        both.withColumn("_rule", F.explode(broken(rules))), "reconcile", F.col("_rule"), F.col(subject)
    )


def check_counts(stated: DataFrame, actual: DataFrame) -> DataFrame:
    """Stated row counts per source (``stated``) against counted rows."""
    counted = actual.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = stated.join(counted, "source_id", "full")
    unequal = joined.filter(~F.coalesce("stated", F.lit(0)).eqNullSafe(F.coalesce("_n", F.lit(0))))
    return _report(unequal, "reconcile", "count_differs", F.coalesce("_n", F.lit(0)))


def quality_report(
    sources: DataFrame, checked: Sequence[tuple[str, DataFrame]], violations: DataFrame
) -> DataFrame:
    """Per source: rows checked per check, violations and the verdict."""
    names = [name for name, _ in checked]
    counted = _union(
        [
            df.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("check_name", F.lit(name))
            for name, df in checked
        ]
    )
    wide = counted.groupBy("source_id").agg(
        *[F.sum(F.when(F.col("check_name") == name, F.col("n"))).alias(name) for name in names]
    )
    failed = violations.groupBy("source_id").agg(F.count(F.lit(1)).alias("violations"))
    report = sources.select("source_id").join(wide, "source_id", "left").join(failed, "source_id", "left")
    report = report.na.fill(0, [*names, "violations"])
    return report.select("source_id", *names, "violations", (F.col("violations") == 0).alias("valid"))
