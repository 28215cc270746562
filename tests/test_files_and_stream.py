"""Readers, writers and the stream on files in a scratch folder."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import digests
from tidemark.operators import annotation, incremental, ledger, observations
from tidemark.plans import bindings as b
from tidemark.sources import cues, exports, inventory, ledger_store, media, ocr_tables
from tidemark.sources import observations as sidecars
from tidemark.streaming import provisional

SF_DIR = "/root/testdata/sf0.001"


def test_sidecar_files(spark, tmp_path):
    row = {"observation_id": "O1", "adapter": "asr", "start_ms": 0, "end_ms": 5, "claim_type": "speech", "text": "t",
           "confidence": 1.0, "modality": "ASR", "speech_text": "w"}
    bad = row | {"observation_id": "O2", "modality": "VID"}
    (tmp_path / "a.json").write_text(json.dumps({"source_id": "S", "observations": [row, bad]}, indent=1))
    (tmp_path / "b.json").write_text("{ broken")
    good, rejects, corrupt = sidecars.read_observations(spark, str(tmp_path))
    assert [r.observation_id for r in good.collect()] == ["O1"]
    assert [(r.observation_id, r.violations) for r in rejects.collect()] == [("O2", ["speech_without_speech_evidence"])]
    assert corrupt.count() == 1


def test_caption_and_word_files(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "one.vtt").write_text("WEBVTT\n\n00:00.000 --> 00:01.000\nHi\n")
    names = spark.createDataFrame([("one.vtt", "S", "TRACK_0001", 2000)], "file_name string, source_id string, track_id string, duration_ms bigint")
    got, rejects = cues.read_cues(spark, str(tmp_path / "v"), names)
    assert [(r.cue_id, r.text) for r in got.collect()] == [("CUE_000001", "Hi")] and rejects.count() == 0
    (tmp_path / "v" / "deep").mkdir()
    (tmp_path / "v" / "deep" / "one.vtt").write_text("WEBVTT\n")
    more = names.unionByName(names.selectExpr("'gone.vtt' AS file_name", "'T' AS source_id", "track_id", "duration_ms"))
    _, rejects = cues.read_cues(spark, str(tmp_path / "v"), more)
    assert sorted((r.file_name, r.reason) for r in rejects.collect()) == [("deep/one.vtt", "unmapped_file"), ("gone.vtt", "missing_file")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "k.tsv").write_text("left\ttop\twidth\theight\tconf\ttext\n1\t2\t3\t4\t90\tHi\n")
    frames = spark.createDataFrame([("k.tsv", "S", "SHOT_0001", "KEY_0001", 1, 0)],
                                   "file_name string, source_id string, shot_id string, keyframe_id string, frame_no int, timestamp_ms bigint")
    rows, rejects = ocr_tables.read_ocr_tables(spark, str(tmp_path / "w"), frames, 0.0)
    assert [r.evidence_ref for r in rows.collect()] == ["OCR:OCR_0001_0001"] and rejects.count() == 0


def test_media_lines(spark, tmp_path):
    probe = json.dumps({"format": {"duration": "2.5", "format_name": "mp4"}, "streams": [], "chapters": [{"title": 1, "end_time": "x"}]})
    (tmp_path / "m.json").write_text(json.dumps({"sha256": "ab" * 32, "size_bytes": 3, "probe": probe}))
    sources, _, chapters, over = media.read_media_metadata(spark, str(tmp_path), 1000, 10, 10)
    assert sources.first().duration_ms == 2500 and chapters.first().chapter_id == 0
    assert [r.reason for r in over.collect()] == ["duration"]


def test_inventory_and_exports(spark, tmp_path):
    turns = b.turns(spark, SF_DIR)
    exports.write_documents(exports.export_cues_vtt(turns), str(tmp_path / "vtt"))
    files = inventory.inventory_files(spark, str(tmp_path / "vtt"), [("source_id=", "caption")])
    listed = {r["path"]: r["class"] for r in files.collect()}
    assert sum(c == "caption" for c in listed.values()) >= turns.select("source_id").distinct().count()
    assert inventory.verify_artifacts(files, files.select("path", "sha256")).count() == 0
    some = turns.select("source_id").first().source_id
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "vtt" / f"source_id={some}").glob("part-*")))
    assert text.startswith("WEBVTT\n") and text.count("NOTE TRACK_0001") == turns.filter(F.col("source_id") == some).count()


def test_ledger_store_replaces_only_its_buckets(spark, tmp_path):
    claims = ledger.number_claims(b.observations(spark, SF_DIR), b.ADAPTERS)
    events = ledger.build_events(claims, b.event_sources(spark, SF_DIR), b.CHUNK_MS, b.OVERLAP_MS)
    nested = ledger.nest_ledger(claims, events, "final", "run")
    path = str(tmp_path / "ledger")
    ledger_store.write_ledger(nested, path, buckets=4)
    total = nested.count()
    assert ledger_store.read_ledger(spark, path).count() == total
    one = nested.select("source_id").first().source_id
    mine = nested.filter(F.col("source_id") == one)
    bucket = mine.select(F.pmod(F.xxhash64("source_id"), F.lit(4))).first()[0]
    in_bucket = nested.filter(F.pmod(F.xxhash64("source_id"), F.lit(4)) == bucket).count()
    ledger_store.write_ledger(mine, path, buckets=4)
    assert ledger_store.read_ledger(spark, path).count() == total - in_bucket + mine.count()
    ledger_store.write_ledger(nested, path, buckets=4)
    assert annotation.outputs_equivalent(ledger_store.read_ledger(spark, path), nested).first().equivalent


def test_partition_rerun_changes_nothing(spark, tmp_path):
    rows = b.event_sources(spark, SF_DIR).withColumn("bucket", F.length("source_id"))
    for _ in range(2):
        incremental.write_partitions(rows, str(tmp_path / "runs"), "bucket")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == rows.count()


@pytest.mark.parametrize("stop", ["begun", "staged", "half swapped", "swapped", "complete"])
def test_an_interrupted_run_is_recovered(spark, tmp_path, stop):
    def hashes(names, version):
        return spark.createDataFrame(
            [(n, f"{n}{version}", "c", "r") for n in names],
            "source_id string, content_sha256 string, config_sha256 string, rights_sha256 string",
        )

    def work(pending):
        return pending.selectExpr("source_id", "content_sha256 AS seen", "explode(array(1, 2)) AS n")

    table = incremental.RunTable(spark, str(tmp_path / "t"), str(tmp_path / "r"), "source_id string, seen string, n int", 3)
    first, more = [f"S{i}" for i in range(8)], [f"S{i}" for i in range(4, 14)]
    table.process(hashes(first, 1), "one", work)
    changed = hashes(more, 2)
    pending = table.begin(changed, "two")
    assert pending.count() == 10
    if stop != "begun":
        table.stage(work(pending), "two")
    if stop == "half swapped":
        staged = spark.read.schema(table.schema).parquet(table._staging("two"))
        incremental.write_partitions(staged.where("bucket < 1"), table.path, "bucket")
    if stop in ("swapped", "complete"):
        table.swap("two")
    if stop == "complete":
        table.finish("two")
    # Before recovery only complete runs are seen.
    before = {(r.source_id, r.seen) for r in table.rows().collect()}
    want = {(n, f"{n}2") for n in more} | {(n, f"{n}1") for n in first[:4]}
    if stop == "complete":
        assert before == want
    assert table.recover() == (["two"] if stop in ("staged", "half swapped", "swapped") else [])
    assert table.recover() == []
    runs = table.process(changed, "three", work)
    assert runs.where("run_id = 'three'").count() == (10 if stop == "begun" else 0)
    rows = table.rows()
    assert {(r.source_id, r.seen) for r in rows.collect()} == want and rows.count() == 2 * len(want)
    assert runs.where("status = 'abandoned'").count() == (10 if stop == "begun" else 0)
    with pytest.raises(ValueError):
        table.begin(changed, "three" if stop == "begun" else "one")


def streamed(spark, tmp_path, tables, delay_ms, idle_ms=0, **settings):
    """Rows of the provisional pass after one trigger per table."""
    for at, table in enumerate(tables):
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for file in (tmp_path / "in").glob("part-*"):
            if file.stat().st_mtime > 1_700_000_100:
                os.utime(file, (1_700_000_000 + at, 1_700_000_000 + at))  # files come in the order of arrival
    stream = spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    started = provisional.start_provisional(
        stream, delay_ms, str(tmp_path / "out"), str(tmp_path / "state"), idle_ms=idle_ms, **settings
    )
    assert started.awaitTermination(120)
    return spark.read.schema(provisional.STORED).parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    """Sources arrive one after the other, some rows twice: nothing is lost and nothing counted twice."""
    rows = b.observations(spark, SF_DIR).persist()
    place = F.pmod(F.xxhash64("source_id"), F.lit(3))
    tables = [rows.where(place == k) for k in range(3)] + [rows.where("start_ms % 5 = 0 AND confidence < 0.2")]
    stored = streamed(spark, tmp_path, tables, 10**12, idle_ms=3_600_000)
    assert stored.count() == 0  # nothing is far enough back, and no part is known to be quiet
    stored = streamed(spark, tmp_path / "quiet", tables, 10**12)
    whole = provisional.provisional_events(rows)
    assert annotation.outputs_equivalent(provisional.as_events(stored), whole).first().equivalent
    claims = ledger.number_claims(rows, b.ADAPTERS)
    events = ledger.build_events(claims, b.event_sources(spark, SF_DIR), b.CHUNK_MS, b.OVERLAP_MS)
    columns = ["source_id", "start_ms", "end_ms", "claims", "speech_rows"]
    assert annotation.outputs_equivalent(whole.select(*columns), events.select(*columns)).first().equivalent
    named = provisional.with_event_ids(stored, events)
    assert named.count() == events.count() and named.join(events, ["source_id", "event_id"], "left_anti").count() == 0


def test_each_source_runs_on_its_own_clock(spark, tmp_path):
    schema = "source_id string, observation_id string, start_ms long, end_ms long, speech_text string"

    def rows(source, numbers, first_ms=0):
        data = [(source, f"{source}{i}", first_ms + i * 10, first_ms + i * 10 + 5, "w" if i % 2 else None) for i in numbers]
        return spark.createDataFrame(data, schema)

    year = 365 * 86_400_000
    # B begins a year before A on any calendar and comes second; then late and repeated rows of A.
    tables = [rows("A", range(20), year), rows("B", range(20)), rows("A", [2, 3, 40, 41], year), rows("A", [25, 26, 2, 41], year)]
    stored = streamed(spark, tmp_path, tables, 50, remember_ms=10_000, slots=1).persist()
    every = tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])
    assert annotation.outputs_equivalent(
        provisional.as_events(stored), provisional.provisional_events(every)
    ).first().equivalent
    late = {r.source_id: r.late_claims for r in provisional.late_counts(stored).collect()}
    assert late == {"A": 2, "B": 0}
    assert sorted(r.observation_id for r in stored.where("late").collect()) == ["A25", "A26"]


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_ledger_does_not_depend_on_parallelism(spark, partitions):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    want = ledger.number_claims(b.observations(spark, SF_DIR), b.ADAPTERS).collect()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = ledger.number_claims(b.observations(spark, SF_DIR), b.ADAPTERS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_set_digests_do_not_depend_on_order(spark):
    df = spark.createDataFrame([("g", str(i)) for i in range(5)] + [(None, "x")], "g string, v string")
    want = hashlib.sha256(b'[["0"],["1"],["2"],["3"],["4"]]').hexdigest()
    assert {r.g: r.set_sha256 for r in digests.set_digest(df.repartition(3), ["g"], ["v"]).collect()}["g"] == want
    assert {r.g: r.tree_sha256 for r in digests.set_digest_tree(df, ["g"], ["v"]).collect()} == {
        r.g: r.tree_sha256 for r in digests.set_digest_tree(df.repartition(4), ["g"], ["v"]).collect()
    }


def test_entities_keep_their_order_in_parts(spark):
    claims = ledger.number_claims(b.observations(spark, SF_DIR), b.ADAPTERS)
    whole = {(r.source_id, r.entity_id): r.evidence_refs for r in observations.entity_registry(claims).collect()}
    parts = observations.entity_registry(claims, part_rows=2).orderBy("source_id", "entity_id", "part").collect()
    joined = {}
    for r in parts:
        joined.setdefault((r.source_id, r.entity_id), []).extend(r.evidence_refs)
    assert joined == whole
