"""Incremental runs: process only what is new, and record a run as complete once its rows are in place.

A run table is a log that is only ever appended to. A run goes through four steps: its sources are
logged as ``begun``; its rows, with the rows of other sources in the same partitions, are written
below a staging folder and logged as ``staged``; the staged partitions replace those of the table; and
only then are the sources logged as ``complete``. Whatever step breaks off, :func:`recover` finds what
the log says and either repeats the replacement, which changes nothing the second time, or gives the
run up. One run at a time may write a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BINDING = ["content_sha256", "config_sha256", "rights_sha256"]
RUNS = (
    "source_id string, run_id string, content_sha256 string, config_sha256 string, rights_sha256 string, "
    "status string, buckets int"
)
STATUSES = ["begun", "staged", "complete", "abandoned"]  # in the order in which they follow each other
BUCKETS = 64


def plan_runs(sources: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources without a complete run of the same content, configuration and rights, and the
    error rows of runs that were begun with other hashes and cannot be resumed.

    ``runs`` has one row per run and source, as :func:`current_runs` gives of a log.
    """
    complete = runs.filter("status = 'complete'").select("source_id", *_BINDING)
    pending = sources.join(complete, ["source_id", *_BINDING], "left_anti")
    begun = runs.filter("status not in ('complete', 'abandoned')").select(
        "source_id", "run_id", *[F.col(c).alias(f"run_{c}") for c in _BINDING]
    )
    clashing = sources.join(begun, "source_id")
    reason = F.coalesce(
        F.when(F.col("content_sha256") != F.col("run_content_sha256"), F.lit("content_changed")),
        F.when(F.col("config_sha256") != F.col("run_config_sha256"), F.lit("configuration_changed")),
        F.when(F.col("rights_sha256") != F.col("run_rights_sha256"), F.lit("rights_changed")),
    )
    errors = clashing.select("source_id", "run_id", reason.alias("reason")).filter("reason is not null")
    return pending, errors


def read_runs(spark: SparkSession, runs_path: str) -> DataFrame:
    """The log as it stands; empty where nothing was logged yet."""
    return _stored(spark, runs_path, RUNS)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current_runs(log: DataFrame) -> DataFrame:
    """The last status of each run and source."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    rest = [c for c in log.columns if c not in ("source_id", "run_id")]
    last = log.groupBy("source_id", "run_id").agg(F.max_by(F.struct(*rest), rank).alias("_last"))
    return last.select("source_id", "run_id", "_last.*").select(*log.columns)


class RunTable:
    """A table of rows per source at ``path``, with the log of its runs at ``runs_path``.

    ``schema`` are the rows' columns with ``source_id``; they are stored by a hash of the source.
    """

    def __init__(self, spark: SparkSession, path: str, runs_path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.runs_path, self.buckets = spark, path, runs_path, buckets
        self.schema = f"{schema}, run_id string, bucket int"

    def runs(self) -> DataFrame:
        return current_runs(read_runs(self.spark, self.runs_path))

    def rows(self) -> DataFrame:
        """Rows of complete runs."""
        stored = _stored(self.spark, self.path, self.schema)
        complete = self.runs().where("status = 'complete'").select("source_id", "run_id")
        return stored.join(complete, ["source_id", "run_id"], "left_semi").drop("bucket")

    def _log(self, sources: DataFrame, run_id: str, status: str) -> None:
        sources.select(
            "source_id", F.lit(run_id).alias("run_id"), *_BINDING, F.lit(status).alias("status"),
            F.lit(self.buckets).alias("buckets"),
        ).write.mode("append").parquet(self.runs_path)

    def _of(self, run_id: str, status: str) -> DataFrame:
        return read_runs(self.spark, self.runs_path).where((F.col("run_id") == run_id) & (F.col("status") == status))

    def _staging(self, run_id: str) -> str:
        return f"{self.path}-staging/{run_id}"

    def begin(self, sources: DataFrame, run_id: str) -> DataFrame:
        """Log the sources that still have to be processed; returns them as logged."""
        if not self._of(run_id, "begun").isEmpty():
            raise ValueError(f"run {run_id} was begun before")
        pending, clashing = plan_runs(sources, self.runs())
        if not clashing.isEmpty():
            raise ValueError("sources of an unfinished run have changed: recover first")
        self._log(pending, run_id, "begun")
        return self._of(run_id, "begun")

    def stage(self, rows: DataFrame, run_id: str) -> None:
        """Write the partitions that the run replaces: its own rows, and those of the other sources."""
        own = self._of(run_id, "begun")
        bucket = F.pmod(F.xxhash64("source_id"), F.lit(self.buckets)).cast("int")
        touched = own.select(bucket.alias("bucket")).distinct()
        fresh = rows.join(own.select("source_id"), "source_id", "left_semi").withColumns(
            {"run_id": F.lit(run_id), "bucket": bucket}
        )
        kept = _stored(self.spark, self.path, self.schema).join(F.broadcast(touched), "bucket", "left_semi")  # at most `buckets`
        kept = kept.join(own.select("source_id"), "source_id", "left_anti")
        names = self.spark.createDataFrame([], self.schema).columns
        staged = fresh.select(*names).unionByName(kept.select(*names))
        spread = F.pmod(F.xxhash64(*names), F.lit(16))  # a large source becomes several files
        staged.repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(self._staging(run_id))
        self._log(own, run_id, "staged")

    def swap(self, run_id: str) -> None:
        """Replace the table's partitions by the staged ones. May be repeated."""
        staged = self.spark.read.schema(self.schema).parquet(self._staging(run_id))
        write_partitions(staged, self.path, "bucket")

    def finish(self, run_id: str) -> None:
        self._log(self._of(run_id, "begun"), run_id, "complete")

    def process(
        self, sources: DataFrame, run_id: str, work: Callable[[DataFrame], DataFrame]
    ) -> DataFrame:
        """One whole run: ``work`` gives the rows of the sources it gets. A rerun finds nothing to do."""
        pending = self.begin(sources, run_id)
        if not pending.isEmpty():
            self.stage(work(pending.select("source_id", *_BINDING)), run_id)
            self.swap(run_id)
            self.finish(run_id)
        return self.runs()

    def recover(self) -> list[str]:
        """Finish runs that were staged and abandon those that were not; returns the finished ones."""
        last = self.runs().groupBy("run_id").agg(
            F.max(F.col("status") == "staged").alias("staged"), F.max(F.col("status") == "begun").alias("begun")
        )
        finished = []
        for run in last.where("staged or begun").orderBy("run_id").collect():  # unfinished runs, not sources
            if run["staged"]:
                self.swap(run["run_id"])
                self.finish(run["run_id"])
                finished.append(run["run_id"])
            else:
                self._log(self._of(run["run_id"], "begun"), run["run_id"], "abandoned")
        return finished


def write_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that ``df`` holds; a rerun of the same input changes nothing."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
