"""Streaming form of the provisional pass."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators.observations import evidence_ref

_INTERVAL = ["source_id", "start_ms", "end_ms"]
STORED = (
    "source_id string, start_ms long, end_ms long, observation_id string, claims long, speech_rows long, late boolean"
)
SLOTS = 16  # parts that a source is dealt into, so that a hot one is not one task
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class IntervalCounts(StatefulProcessor):
    """Counts of the intervals of one part of one source, on the clock of that source.

    State holds how far the source has come (the greatest end offset seen), up to where its intervals
    were given out, and per interval the number of speech rows and the digests of the observations
    seen. An interval is given out once, when the source has come ``delay_ms`` beyond it, or when the
    part has been quiet while the stream ran on. Rows of intervals given out before are late: they come out
    one by one. Observations are remembered for ``remember_ms`` of the source's clock beyond that, so that
    repeated rows are dropped, late ones included.
    """

    def __init__(self, delay_ms: int, remember_ms: int):
        self.delay_ms, self.remember_ms = delay_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "seen_ms long, given_ms long")
        self.intervals = handle.getMapState("intervals", "start_ms long, end_ms long", "speech_rows long, seen binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        seen_ms, given_ms = self.clock.get() or (-1, -1)
        out = []
        for (start, end), mine in frame.groupby(["start_ms", "end_ms"], sort=True):
            mine = mine.drop_duplicates("digest")
            held = self.intervals.getValue((int(start), int(end))) or (0, b"")
            known = {held[1][i : i + 16] for i in range(0, len(held[1]), 16)}
            fresh = mine[[d not in known for d in mine["digest"]]]
            if len(fresh):
                speech = int(fresh["spoken"].sum())
                self.intervals.updateValue(
                    (int(start), int(end)), (held[0] + speech, held[1] + b"".join(fresh["digest"]))
                )
            if end <= given_ms:
                out += [
                    (key[0], int(start), int(end), r.observation_id, 1, int(r.spoken), True) for r in fresh.itertuples()
                ]
        seen_ms = max(seen_ms, int(frame["end_ms"].max()))
        out += self._give_out(key, given_ms, max(given_ms, seen_ms - self.delay_ms))
        self.clock.update((seen_ms, max(given_ms, seen_ms - self.delay_ms)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(frame["arrived_ms"].max()))
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        seen_ms, given_ms = self.clock.get()
        yield self._frame(self._give_out(key, given_ms, max(given_ms, seen_ms)))
        self.clock.update((seen_ms, max(given_ms, seen_ms)))

    def _give_out(self, key: Any, given_ms: int, upto_ms: int) -> list[tuple]:
        out = []
        for (start, end), (speech, seen) in list(self.intervals.iterator()):
            if given_ms < end <= upto_ms:
                out.append((key[0], start, end, None, len(seen) // 16, speech, False))
            if end <= upto_ms - self.remember_ms:
                self.intervals.removeKey((start, end))
        return sorted(out, key=lambda r: r[1:3])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        columns = [*_INTERVAL, "observation_id", "claims", "speech_rows", "late"]
        frame = pd.DataFrame(rows, columns=columns)
        return frame.astype({"start_ms": np.int64, "end_ms": np.int64, "claims": np.int64, "speech_rows": np.int64, "late": bool})

    def close(self) -> None:
        pass


def provisional_rows(
    observations: DataFrame, delay_ms: int, idle_ms: int = 600_000, remember_ms: int | None = None, slots: int = SLOTS
) -> DataFrame:
    """Streamed observations as interval counts, and every late observation as a row of its own.

    Each source runs on its own clock, the offsets of its rows: a source that was recorded or arrives
    a year after another is not late. A source is dealt into ``slots`` parts by interval, each with
    its own clock; all rows of an interval meet in one part. The instants at which triggers run are the
    only time that all sources share; a part is quiet once they are ``idle_ms`` beyond its last rows.
    """
    observations.sparkSession.conf.set(STORE_KEY, _STORE)
    now = F.current_timestamp()
    narrow = observations.withColumn("arrived", now).withWatermark("arrived", f"{idle_ms} milliseconds").select(
        "arrived", F.unix_millis("arrived").alias("arrived_ms"), *_INTERVAL, F.pmod(F.xxhash64("start_ms", "end_ms"), F.lit(slots)).cast("int").alias("slot"), "observation_id",
        F.unhex(F.md5(F.col("observation_id").cast("binary"))).alias("digest"),
        F.col("speech_text").isNotNull().alias("spoken"),
    )
    processor = IntervalCounts(delay_ms, 4 * delay_ms if remember_ms is None else remember_ms)
    return narrow.groupBy("source_id", "slot").transformWithStateInPandas(processor, STORED, "Append", "EventTime")


def deduplicated(observations: DataFrame) -> DataFrame:
    """Observations of a table once per (source, observation id)."""
    return observations.dropDuplicates(["source_id", "observation_id"])


def provisional_events(observations: DataFrame) -> DataFrame:
    """Revision-1 events of a whole table: equal intervals of a source with their counts."""
    counted = deduplicated(observations).groupBy(*_INTERVAL).agg(
        F.count(F.lit(1)).alias("claims"), F.count("speech_text").alias("speech_rows")
    )
    return as_events(counted)


def as_events(counted: DataFrame) -> DataFrame:
    """Rows of the provisional pass. Late rows of an interval are added to what was given out for it."""
    return counted.groupBy(*_INTERVAL).agg(
        F.sum("claims").alias("claims"), F.sum("speech_rows").alias("speech_rows")
    ).select(*_INTERVAL, "claims", "speech_rows", F.lit(1).alias("revision"), F.lit("provisional").alias("status"))


def with_event_ids(provisional: DataFrame, events: DataFrame) -> DataFrame:
    """Provisional events with the ids of the final pass, which numbers the same intervals.

    The interval is the key that both passes share, so revision 1 joins revision 2 by ``event_id``.
    """
    return as_events(provisional).join(events.select(*_INTERVAL, "event_id"), _INTERVAL).select(
        "source_id", "event_id", "start_ms", "end_ms", "claims", "speech_rows", "revision", "status"
    )


def late_counts(stored: DataFrame) -> DataFrame:
    """Late observations per source, of the rows that :func:`start_provisional` stores."""
    return stored.groupBy("source_id").agg(
        F.coalesce(F.sum(F.when(F.col("late"), F.col("claims"))), F.lit(0)).alias("late_claims"),
        F.sum("claims").alias("claims"),
    )


def provisional_claims(observations: DataFrame) -> DataFrame:
    """Claim rows of the provisional pass; they carry their evidence reference."""
    return observations.select(
        *_INTERVAL, "observation_id", "adapter", "claim_type", "text", "confidence", "speaker_id",
        "speech_text", evidence_ref().alias("evidence_ref"),
    )


def start_provisional(
    observations: DataFrame, delay_ms: int, path: str, checkpoint: str, available_now: bool = True,
    idle_ms: int = 600_000, remember_ms: int | None = None, slots: int = SLOTS,
) -> StreamingQuery:
    """Append the rows of :func:`provisional_rows` to a Parquet table, late rows below ``late=true``,
    with exactly-once file commits."""
    writer = (
        provisional_rows(observations, delay_ms, idle_ms, remember_ms, slots)
        .writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("late")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
