"""Fixed facts and edge rules on small hand-written tables."""

import hashlib
import html
import html.entities
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import digests, rules, scores, timecode
from tidemark.functions.text import edit_distance, normalise_text, unescape, word_edit_distance, words
from tidemark.operators import ledger, metrics, outcomes, rights, timeline
from tidemark.sources import cues, media, ocr_tables


def test_chunks_cover_a_source(spark):
    src = spark.createDataFrame([("S", 6000)], "source_id string, duration_ms bigint")
    got = timeline.chunk_timeline(src, 2000, 250).orderBy("chunk_no").select("start_ms", "end_ms").collect()
    assert [tuple(r) for r in got] == [(0, 2000), (1750, 3750), (3500, 5500), (5250, 6000)]
    for size, overlap in ((0, 0), (2, -1), (2, 2)):
        with pytest.raises(ValueError):
            timeline.chunk_timeline(src, size, overlap)


def test_events_meet_their_chunks(spark):
    src = spark.createDataFrame([("S", 6501)], "source_id string, duration_ms bigint")
    events = spark.createDataFrame(
        [("S", 2500, 2501), ("S", 3000, 3001), ("S", 2400, 5600), ("S", 7000, 7001)],
        "source_id string, start_ms bigint, end_ms bigint",
    )
    got = {r.start_ms: r.chunk_ids for r in timeline.chunk_overlap(events, src, 3000, 500).collect()}
    name = lambda *n: [f"CHK_{i:04d}" for i in n]
    assert got == {2500: name(1, 2), 3000: name(2), 2400: name(1, 2, 3), 7000: []}


def test_rounding_is_half_even(spark):
    row = spark.range(1).select(timeline.frame_number(F.lit(250), 10.0).alias("a"), timeline.frame_number(F.lit(350), 10.0).alias("b")).first()
    assert (row.a, row.b) == (2, 4)


def levenshtein(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_edit_distances_match_the_table(spark):
    rng = random.Random(8)
    pick = lambda: " ".join(rng.choice(["a", "bb", "é", "ccc", "😀d", ""]) for _ in range(rng.randrange(0, 9)))
    pairs = [(pick(), pick()) for _ in range(250)] + [("", ""), ("a", ""), ("a b", "a"), ("a b c", "a c"), ("a a", "a a a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select(
        "i", edit_distance(F.col("a"), F.col("b")).alias("c"),
        word_edit_distance(words(F.col("a")), words(F.col("b"))).alias("w"),
    ).collect()
    for r in got:
        a, b = pairs[r.i]
        assert (r.c, r.w) == (levenshtein(a, b), levenshtein(a.split(), b.split())), (a, b)


def test_word_distance_survives_very_many_words(spark):
    a = [f"w{i}" for i in range(30000)]
    b = a[::-1][:200] + a[200:]
    row = spark.createDataFrame([(a[:400], b[:400])], "a array<string>, b array<string>").select(
        word_edit_distance(F.col("a"), F.col("b")).alias("d")
    ).first()
    assert row.d == levenshtein(a[:400], b[:400])


def test_long_unlike_texts_and_word_lists(spark):
    """Distances that leave the first bands, and more words than are numbered in one group."""
    rng = random.Random(18)
    draw = lambda n, kinds: [f"w{rng.randrange(kinds)}" for _ in range(n)]
    pairs = [(draw(n, kinds), draw(n + rng.randrange(90), kinds)) for n, kinds in ((300, 40), (900, 5_000), (700, 90), (1, 3), (1300, 90_000))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = df.select(
        "i", word_edit_distance(F.col("a"), F.col("b")).alias("w"),
        edit_distance(F.array_join("a", " "), F.array_join("b", " ")).alias("c"),
    ).collect()
    for r in got:
        a, b = pairs[r.i]
        assert r.w == levenshtein(a, b)
        if len(a) < 800:
            assert r.c == levenshtein(" ".join(a), " ".join(b))


def test_character_references(spark):
    rng = random.Random(19)
    names = sorted(html.entities.html5)
    samples = [f"a&{n}b" for n in names] + [f"&{n[:-1]}&{n}x" for n in names]
    numbers = [0, 1, 8, 9, 10, 11, 13, 14, 31, 32, 38, 127, 128, 0x81, 150, 159, 160, 0xD7FF, 0xD800, 0xDFFF, 0xE000,
               0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 10**7, 10**30]
    samples += [f"x&#{n};&#x{n:x}y&#X{n:X};&#000{n}" for n in numbers]
    samples += ["&", "&&", "&;", "&#;", "&#x;", "&#xg;", "&amp;lt;", "&ampamp;", "&notit;", "&notin;", "& amp;", "&a\tb", "&" + "z" * 40 + ";", "", "no sign", "&#12&#13", "&\u00e9;"]
    samples += ["".join(rng.choice(["&", "amp", "lt", ";", "#", "x", "6", "41", " ", "not", "copy", "<", "é", "😀"]) for _ in range(12)) for _ in range(800)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)] + [(-1, None)], "i int, s string")
    plan = df.select("i", unescape(F.col("s")).alias("t"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    for r in plan.collect():
        assert r.t == (None if r.i < 0 else html.unescape(samples[r.i])), samples[r.i]


def test_text_is_normalised(spark):
    samples = ["<i>Hello</i>\ncafé", " a  b c ", "x &amp; &eacute;&#233;&lt;b&gt;", "", "<<a>b>"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    import re

    for r in df.select("i", normalise_text(F.col("s")).alias("t")).collect():
        assert r.t == " ".join(html.unescape(re.sub("<[^>]*>", "", samples[r.i])).split())


def test_cue_files(spark):
    good = (
        "WEBVTT\n\n00:00.100 --> 00:01.500\n<i>Hello</i>\ncafé\n\n00:01.000 --> 00:02.000\n\n"
        "7\n00:01,200 --> 00:02,500 line:0\nsays --> nothing\n"
    )
    files = [("good", good), ("crlf", good.replace("\n", "\r\n"))]
    files += [
        (f"bad{i}", f"WEBVTT\n\n{line}\ntext\n")
        for i, line in enumerate(
            ["NaN --> 00:01.000", "-00:01.000 --> 00:02.000", "00:02.000 --> 00:01.000", "00:00.000 --> 00:03.001", "00:61.000 --> 00:62.000"]
        )
    ]
    df = spark.createDataFrame([("S", t, 3000, c) for t, c in files], "source_id string, track_id string, duration_ms bigint, content string")
    got, rejects = cues.parse_cues(df)
    rows = sorted((r.track_id, r.cue_id, r.start_ms, r.end_ms, r.text, r.normalized_text) for r in got.collect())
    want = [
        ("CUE_000001", 100, 1500, "<i>Hello</i>\ncafé", "Hello café"), ("CUE_000002", 1000, 2000, "", ""),
        ("CUE_000003", 1200, 2500, "says --> nothing", "says --> nothing"),
    ]
    assert rows == [(t, *w) for t in ("crlf", "good") for w in want]
    reasons = {r.track_id: r.reason for r in rejects.collect()}
    assert reasons == {
        "bad0": "broken_timing", "bad1": "broken_timing", "bad2": "interval_outside_source",
        "bad3": "interval_outside_source", "bad4": "broken_timing",
    }


def test_word_tables(spark):
    head = "level\tleft\ttop\twidth\theight\tconf\ttext\n"
    tables = {
        1: head + "5\t1\t2\t3\t4\t96.5\tHello\n5\t1\t2\t3\t4\t-1\t\n\n5\t0\t0\t9\t9\t40\t two  words \n",
        2: head + '5\t1\t2\t3\t4\t90\t"quoted ""x""\tand\nbroken"\n5\t5\t6\t7\t8\t91\tnext\n',
        3: head + "5\t1\t2\t0\t4\t96\tflat\n",
        4: "left\ttop\ttext\n1\t2\tx\n",
        5: head + "5\t1\t2\t3\t4\tmany\tword\n",
        6: head + "5\t1\t2\t0\t4\t10\tdropped\n",
    }
    df = spark.createDataFrame(
        [("S", "SHOT_0001", f"K{n}", n, n * 10, t) for n, t in tables.items()],
        "source_id string, shot_id string, keyframe_id string, frame_no int, timestamp_ms bigint, content string",
    )
    rows, rejects = ocr_tables.parse_word_tables(df, 20.0)
    got = sorted((r.observation_id, r.row_index, r.text, r.normalized_text, tuple(r.bounding_box), r.warnings) for r in rows.collect())
    assert got == [
        ("OCR_0001_0001", 1, "Hello", "Hello", (1, 2, 4, 6), []),
        ("OCR_0001_0002", 3, " two  words ", "two words", (0, 0, 9, 9), ["low_confidence"]),
        ("OCR_0002_0001", 1, 'quoted "x"\tand\nbroken', 'quoted "x" and broken', (1, 2, 4, 6), []),
        ("OCR_0002_0002", 2, "next", "next", (5, 6, 12, 14), []),
    ]
    assert {r.keyframe_id: r.reason for r in rejects.collect()} == {
        "K3": "bad_geometry", "K4": "columns_missing", "K5": "cell_unreadable"
    }


def test_media_documents(spark):
    probe = {
        "format": {"format_name": "b,a"},
        "streams": [
            {"index": 0, "codec_type": "video", "avg_frame_rate": "30000/1000", "duration": "1.0005", "width": 10},
            {"index": 1, "avg_frame_rate": "x", "duration": "nan"},
        ],
    }
    df = spark.createDataFrame([("ab" * 32, 5, json.dumps(probe)), ("cd" * 32, 5, "{")], "sha256 string, size_bytes bigint, probe string")
    sources, streams, _, over = media.parse_media(df, 1000, 5, 5)
    assert [tuple(r) for r in sources.select("source_id", "duration_ms", "format_names").collect()] == [("SRC_ABABABABABAB", 1000, ["a", "b"])]
    got = {r.stream_index: (r.codec_type, r.frame_rate, r.duration_ms) for r in streams.collect()}
    assert got == {0: ("video", "30", 1000), 1: ("unknown", None, None)}
    assert sorted(r.reason for r in over.collect()) == ["duration_or_format_missing", "width"]


def test_canonical_digest_equals_python(spark):
    record = {"b": None, "a": ["x", "é\"\n"], "c": True, "n": 5}
    want = hashlib.sha256(json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    df = spark.createDataFrame([(None, ["x", "é\"\n"], True, 5)], "b string, a array<string>, c boolean, n bigint")
    assert df.select(digests.record_digest(["n", "c", "b", "a"]).alias("d")).first().d == want


def test_score_rules(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 2), (0, 2, 0), (1, 2, 2)], "c bigint, p bigint, g bigint")
    got = {(r.correct, r.predicted, r.gold): (r.precision, r.recall, r.f1) for r in df.select(*scores.prf(F.col("c"), F.col("p"), F.col("g"))).collect()}
    assert got == {(0, 0, 0): (1, 1, 1), (0, 0, 2): (0, 0, 0), (0, 2, 0): (0, 0, 0), (1, 2, 2): (0.5, 0.5, 0.5)}
    empty = spark.range(1).select(*scores.presence(F.lit(0), F.lit(0), F.lit(0))).first()
    assert tuple(empty) == (None, None, None)


def test_presence_half(spark):
    gold = spark.createDataFrame([("S", "a", "x"), ("S", "b", "y"), ("S", "d", "")], "source_id string, keyframe_id string, transcription string")
    pred = spark.createDataFrame([("S", "a", "x"), ("S", "c", "z")], "source_id string, keyframe_id string, predicted string")
    row = metrics.presence_score(pred, gold).first()
    assert (row.precision, row.recall, row.f1) == (0.5, 0.5, 0.5)
    assert metrics.presence_score(pred, gold, "gold").first().precision == 1.0


def test_rights_reasons(spark):
    full = {"analysis": True, "derivative_artifact_retention": True}
    cases = {
        "ok": ("S", full, None), "late": ("S", full, "2024-01-01T00:00:00+00:00"), "now": ("S", full, "2025-01-01T00:00:00Z"),
        "naive": ("S", full, "2030-01-01T00:00:00"), "junk": ("S", full, "soon"), "other": ("X", full, None),
        "part": ("S", {"analysis": True}, None), "month": ("S", full, "2030-13-01T00:00:00Z"),
    }
    sources = spark.createDataFrame([("S", h) for h in [*cases, "none"]], "source_id string, content_sha256 string")
    declared = spark.createDataFrame(
        [(h, s, p, e, "owned", "m") for h, (s, p, e) in cases.items()],
        "content_sha256 string, source_id string, permissions map<string,boolean>, expires_at string, rights_basis string, manifest_hash string",
    )
    allowed, denied = rights.rights_gate(sources, declared, "analysis", "2025-01-01T00:00:00Z")
    assert [r.content_sha256 for r in allowed.collect()] == ["ok"]
    assert {r.content_sha256: r.reason for r in denied.collect()} == {
        "late": "expired", "now": "expired", "naive": "expiry_without_zone", "junk": "expiry_malformed",
        "month": "expiry_malformed", "other": "not_bound_to_source",
        "part": "not_permitted:derivative_artifact_retention", "none": "no_declaration",
    }


def test_sources_of_one_content_have_a_declaration_each(spark):
    full = {"analysis": True, "derivative_artifact_retention": True}
    sources = spark.createDataFrame([(s, h) for h in "hk" for s in "ABC"], "source_id string, content_sha256 string")
    declared = spark.createDataFrame(
        [(h, s, full, None, "owned", f"m{h}{s}", ["x"], True) for h, s in ("hA", "hB", "kA", "kA", "kB")],
        "content_sha256 string, source_id string, permissions map<string,boolean>, expires_at string, rights_basis string, "
        "manifest_hash string, restrictions array<string>, independently_reviewed boolean",
    )
    allowed, denied = rights.rights_gate(sources, declared, "analysis", "2025-01-01T00:00:00Z")
    assert sorted(r.manifest_hash for r in allowed.collect()) == ["mhA", "mhB", "mkB"]
    assert {(r.content_sha256 + r.source_id): r.reason for r in denied.collect()} == {
        "hC": "not_bound_to_source", "kC": "not_bound_to_source", "kA": "ambiguous_declaration"
    }
    made = rights.provenance(sources, declared).collect()
    assert sorted(r.content_sha256 + r.source_id for r in made) == ["hA", "hB", "kB"]


def test_adapter_states(spark):
    states = {
        "all": ["ok"], "none": [], "part": ["ok", "failed"], "time": ["timed_out", "timed_out"],
        "mixed": ["timed_out", "failed"], "image": ["unsupported"], "some": ["ok", "unsupported"],
    }
    units = [("S", a, s) for a, all_states in states.items() for s in all_states]
    plan = spark.createDataFrame([("S", a) for a in states], "source_id string, adapter string")
    u = spark.createDataFrame(units, "source_id string, adapter string, unit_state string")
    e = spark.createDataFrame([("S", "all")], "source_id string, adapter string")
    got = {r.adapter: r.status for r in outcomes.adapter_outcomes(plan, u, e).collect()}
    assert got == {
        "all": "success", "none": "success_zero", "part": "partial_success", "time": "resource_limit_failure",
        "mixed": "decode_failure", "image": "unsupported_input", "some": "partial_success",
    }
    tracks = {r.adapter: r.status for r in outcomes.adapter_outcomes(plan, u, e, any_timeout_limits=True).collect()}
    assert tracks["mixed"] == "resource_limit_failure"


def test_rule_outcomes_that_are_unknown_count_as_broken(spark):
    df = spark.createDataFrame([("S", None), ("S", float("nan")), ("S", 0.5)], "source_id string, v double")
    got = rules.check_rules(df, [("r", rules.between("v", 0, 1))], F.lit("x"), "c").count()
    assert got == 2


def test_three_intervals_make_three_events(spark):
    rows = [
        ("S", f"O{i}", "asr" if i == 3 else "visual", s, e, "claim", "t", 0.5, "ASR" if i == 3 else "VID",
         "B" if i == 3 else None, "hello" if i == 3 else None, None, None)
        for i, (s, e) in enumerate([(0, 10), (0, 10), (0, 20), (30, 40), (30, 40), (30, 40), (0, 20), (0, 10)])
    ]
    columns = (
        "source_id string, observation_id string, adapter string, start_ms bigint, end_ms bigint, "
        "claim_type string, text string, confidence double, modality string, speaker_id string, "
        "speech_text string, speech_source string, evidence_ref_override string"
    )

    obs = spark.createDataFrame(rows, columns)
    src = spark.createDataFrame([("S", 60)], "source_id string, duration_ms bigint")
    claims = ledger.number_claims(obs, ["visual", "asr"])
    events = ledger.build_events(claims, src, 25, 5)
    nested = ledger.nest_ledger(claims, events, "final", "run").orderBy("event_no").collect()
    assert [(r.event_id, len(r.claims), r.scene_id, r.provenance.chunk_ids) for r in nested] == [
        ("EVT_000001", 3, "SCN_0001", ["CHK_0001"]), ("EVT_000002", 2, "SCN_0001", ["CHK_0001"]),
        ("EVT_000003", 3, "SCN_0002", ["CHK_0002"]),
    ]
    assert [s.source for r in nested for s in r.speech] == ["sidecar_asr"]
    small = ledger.nest_ledger(claims, events, "final", "run", part_rows=2)
    assert small.count() == 5 and small.agg(F.sum(F.size("claims"))).first()[0] == 8


def test_timecodes(spark):
    row = spark.range(1).select(timecode.timecode(F.lit(3_723_004)).alias("v"), timecode.timecode(F.lit(360_000_000), ",").alias("s")).first()
    assert (row.v, row.s) == ("01:02:03.004", "100:00:00,000")
