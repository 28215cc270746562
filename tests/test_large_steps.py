"""Steps that grow with the large tables keep their shape: one pass, no join back, no list per group."""

from pyspark.sql import functions as F

from tidemark.operators import checks, matching, metrics
from tidemark.sources.media import reduced_rate


def analysed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_rates_are_reduced_by_one_walk(spark):
    rows = [("30000/1001", "30000/1001"), ("50/2", "25"), ("0/7", "0"), ("0/0", None), ("x", None), ("5/0", None),
            ("7540113804746346429/4660046610375530309", "7540113804746346429/4660046610375530309"),
            ("9223372036854775807/9223372036854775807", "1")]
    df = spark.createDataFrame(rows, "rate string, want string").withColumn("got", reduced_rate(F.col("rate")))
    assert [r.got for r in df.collect()] == [r.want for r in df.collect()]
    assert analysed(df).count("aggregate(") == 1


def test_turns_are_taken_in_a_scan(spark):
    gold = spark.createDataFrame([("s", 1, 10, 5), ("s", 2, 12, 5), ("s", 3, 12, 5)], "k string, gold_id bigint, t bigint, tol bigint")
    pred = spark.createDataFrame([("s", 1, 11), ("s", 2, 11), ("s", 3, 14)], "k string, pred_id bigint, t bigint")
    for order, want in (((), {(1, 1), (2, 2), (3, 3)}), (("late",), {(3, 1), (2, 2), (1, 3)})):
        found = matching.match_in_time(
            pred, gold.withColumn("late", -F.col("gold_id")), ["k"], ["t"], F.col("tol"), 5, order
        )
        assert {(r.gold_id, r.pred_id) for r in found.collect()} == want
        plan = analysed(found)
        assert "MapInArrow" in plan and "collect_list" not in plan


def test_revisions_meet_in_one_grouping(spark):
    final = spark.createDataFrame(
        [("s", "a", 2), ("s", "b", 2), ("s", "b", 2), ("s", "c", 2), ("s", "d", 2), ("s", "d", 3)], "source_id string, event_id string, revision int"
    )
    before = spark.createDataFrame(
        [("s", "a", 1, "provisional"), ("s", "b", 2, "provisional"), ("s", "c", 1, "final"), ("s", "d", 1, "provisional"),
         ("s", "e", 1, "provisional")], "source_id string, event_id string, revision int, status string"
    )
    found = checks.check_revision_chain(final, before)
    assert {(r.subject, r.rule) for r in found.collect()} == {("b", "not_advancing"), ("b", "not_increasing"), ("c", "no_provisional")}
    assert "Join" not in analysed(found)


def test_queries_keep_joined_partitions_small(spark):
    from tidemark.plans.catalog import QUERIES

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.unset(key)
    QUERIES["check_revision_chain"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == "4m"


def test_references_of_regions_are_looked_up_in_one_pass(spark):
    rows = [("s", "k1", 5, "a", "f"), ("s", "k1", 5, "a", "f"), ("s", "k1", 6, "b", "f"), ("s", "k2", -1, "c", "g"),
            ("s", "k3", 7, "x", "y"), ("s", "k3", 7, "x", "y"), ("s", "k4", 8, "a", "y"), (None, "k1", None, None, "f"),
            ("t", "k1", 9, "a", None)]
    regions = spark.createDataFrame(
        rows, "source_id string, keyframe_id string, timestamp_ms bigint, evidence_ref string, source_frame_evidence_ref string"
    )
    gold = spark.createDataFrame(
        [("s", "k1", 5), ("s", "k1", 5), ("s", "k4", 8), ("s", "k4", 9)], "source_id string, keyframe_id string, timestamp_ms bigint"
    )
    known = spark.createDataFrame(
        [("s", "a"), ("s", "a"), ("s", "f"), ("s", "g"), ("s", "c"), ("t", "a")], "source_id string, evidence_ref string"
    )
    found = metrics.integrity_counts(regions, gold, known)
    got = {(r.source_id, r.regions, r.invalid_timestamps, r.unresolved_refs) for r in found.collect()}
    assert got == {("s", 7, 3, 4), (None, 1, 1, 1), ("t", 1, 0, 1)}  # repeated evidence and gold rows count once
    assert analysed(found).count("Join") == 2


def test_regions_need_no_formatter_and_lines_are_numbered_once(spark):
    from tidemark.plans import bindings
    from tidemark.plans.catalog import QUERIES

    days = spark.range(-1200, 1200, 7).select(F.col("id").alias("day"))
    days = days.unionByName(spark.createDataFrame([(99_999,), (100_000,), (1_234_567,), (-99_999,), (-100_000,)], "day bigint"))
    got = days.select("day", bindings._keyframe_of(F.col("day")).alias("k")).collect()
    assert all(r.k == "KEY_%06d" % r.day for r in got)
    plan = analysed(QUERIES["integrity_counts"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "lineitem" not in plan


def test_dangling_references_read_evidence_once(spark):
    said = spark.createDataFrame([("s", "a"), ("s", "x"), ("s", "x"), ("t", "a"), (None, "a"), ("s", None)], "source_id string, evidence_ref string")
    seen = spark.createDataFrame([("s", "b"), ("s", "y")], "source_id string, evidence_ref string")
    known = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b")], "source_id string, evidence_ref string")
    found = checks.dangling_evidence([("claims", said), ("cues", seen)], known)
    got = sorted((r.source_id or "", r.rule, r.subject or "") for r in found.collect())
    assert got == [("", "claims", "a"), ("s", "claims", ""), ("s", "claims", "x"), ("s", "claims", "x"), ("s", "cues", "y"), ("t", "claims", "a")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1


def test_queries_read_files_in_small_splits(spark):
    from tidemark.plans.catalog import QUERIES

    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.unset(key)
    QUERIES["integrity_counts"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == "16m"
