"""Files read by byte ranges give the rows of files read whole, wherever they are cut."""

import random

import pytest

from tidemark.sources import cues, lines, ocr_tables

CUES = (
    "﻿WEBVTT\n\n\n1\n00:00.100 --> 00:01.500 line:0\r\n<i>Hé</i>llo &amp; on\r\nthere\n\n"
    "NOTE x\n\n00:01.000 --> 00:02.000\n\n\n00:01.200 --> 00:02.500\nsays\tend"
)
WORDS = (
    'left\ttop\twidth\theight\tconf\ttext\n\n1\t2\t3\t4\t90\t"two\nlines"\n1\t2\t3\t4\t91\ta"b\r\n'
    '5\t6\t7\t8\t92\t"q""uo\tted"x\n5\t6\t7\t8\t10\t"low\n\n\n"\n"9"\t9\t9\t9\t"95"\t"é'
)
FRAME = "source_id string, shot_id string, keyframe_id string, frame_no int, timestamp_ms bigint"
TRACK = "source_id string, track_id string, duration_ms bigint"


@pytest.fixture
def cut(spark):
    """Set the size at which files are cut."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def at(size):
        for name, value in zip(names, (size, 1, 1)):
            spark.conf.set(name, str(value))

    yield at
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("text", [CUES, WORDS, "\r\n\r\nx\r\n", "one line"])
def test_lines_of_a_file_cut_at_every_byte(spark, tmp_path, cut, text):
    data = text.encode()
    (tmp_path / "f").write_bytes(data)
    whole = text.replace("\r\n", "\n").split("\n")
    whole = whole[:-1] if whole[-1] == "" else whole
    whole[0] = whole[0].removeprefix("\ufeff")
    for size in range(1, len(data) + 1, 1 if len(data) < 60 else 7):
        cut(size)
        got = sorted((r.line_no, r.line) for r in lines.read_lines(spark, str(tmp_path)).collect())
        assert got == [(i, line) for i, line in enumerate(whole, 1)], size


def word_lines(frames, spark):
    rows = []
    for name, text in frames:
        found = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        found = found[:-1] if found[-1] == "" else found
        rows += [("S", "SH", name, int(name[1:]), 7, i, line) for i, line in enumerate(found, 1)]
    return spark.createDataFrame(rows, FRAME + ", line_no bigint, line string").repartition(5)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_word_tables_by_line_equal_whole_ones(sized):
    rng = random.Random(4)
    head = "left\ttop\twidth\theight\tconf\ttext\n"
    frames = [("K0", WORDS), ("K1", head), ("K2", "x\ty\n1\t2\n"), ("K3", head + "1\t2\t3\t4\t90"), ("K4", head + "-1\t2\t3\t4\t90\ta\n")]
    bits = ["1", "2", "\t", "\t", "\n", '"', '"', '""', "90", "a b", "\r\n", ""]
    for number in range(5, 60):
        body = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))
        good = "".join(f"{rng.randrange(9)}\t1\t5\t{1 + (number % 9 > 0)  if rng.random() < 0.97 else 0}\t{rng.randrange(40, 99)}\t{rng.choice(['ab', '\"a\nb\"', ' ', '\"\"'])}\n" for _ in range(5))
        frames.append((f"K{number}", head + (good if number % 2 else body) + rng.choice(["", "\n", good])))
    whole = sized.createDataFrame([("S", "SH", n, int(n[1:]), 7, t) for n, t in frames], FRAME + ", content string")
    want, want_rejects = ocr_tables.parse_word_tables(whole, 45)
    got, rejects = ocr_tables.parse_word_lines(word_lines(frames, sized), 45)
    assert rows_of(got) == rows_of(want) and got.count() > 50
    assert rows_of(rejects) == rows_of(want_rejects) and rejects.count() > 5


def test_cues_by_line_equal_whole_ones(sized):
    rng = random.Random(5)
    files = [("T0", CUES), ("T1", "WEBVTT\n\n00:02.000 --> 00:01.000\nx\n"), ("T2", "a --> b\n")]
    parts = ["00:00.100 --> 00:01.000\n", "text\n", "\n", "\n", "say --> it\n", "7\n", "00:00.000 --> 00:09.000\n", "é"]
    files += [(f"T{i}", "".join(rng.choice(parts[: rng.choice([4, 6, 8])]) for _ in range(rng.randrange(1, 25)))) for i in range(3, 60)]
    whole = sized.createDataFrame([("S", n, 3000, t) for n, t in files], TRACK + ", content string")
    rows = []
    for name, text in files:
        found = text.replace("\r\n", "\n").split("\n")
        rows += [("S", name, 3000, i, line) for i, line in enumerate(found, 1)]
    by_line = sized.createDataFrame(rows, TRACK + ", line_no bigint, line string").repartition(5)
    want, want_rejects = cues.parse_cues(whole)
    got, rejects = cues.parse_cue_lines(by_line)
    assert rows_of(got) == rows_of(want) and got.count() > 20
    assert rows_of(rejects) == rows_of(want_rejects) and rejects.count() > 5


def test_large_and_small_files_together(spark, tmp_path, cut):
    (tmp_path / "deep").mkdir()
    (tmp_path / "one.vtt").write_text(CUES, newline="")
    (tmp_path / "deep" / "two.vtt").write_text(CUES + "\n" * 300, newline="")
    files = spark.createDataFrame(
        [("one.vtt", "S", "T1", 3000), ("deep/two.vtt", "S", "T2", 3000)], "file_name string, " + TRACK
    )
    cut(11)
    got, rejects = cues.read_cues(spark, str(tmp_path), files, whole_bytes=300)
    found = {name: sorted((r.cue_id, r.text) for r in got.collect() if r.track_id == name) for name in ("T1", "T2")}
    assert found["T1"] == found["T2"] and len(found["T1"]) == 3 and rejects.count() == 0
    (tmp_path / "w").mkdir()
    for name, extra in (("a.tsv", ""), ("b.tsv", '"' + "\n" + "\t" * 5 + "\n" * 200)):
        (tmp_path / "w" / name).write_text(WORDS + extra, newline="")
    frames = spark.createDataFrame([("a.tsv", "S", "SH", "K1", 1, 7), ("b.tsv", "S", "SH", "K2", 2, 7)], "file_name string, " + FRAME)
    regions, rejects = ocr_tables.read_ocr_tables(spark, str(tmp_path / "w"), frames, 45, whole_bytes=250)
    said = {k: [r.text for r in regions.orderBy("row_index").collect() if r.keyframe_id == k] for k in ("K1", "K2")}
    assert said["K1"] == ["two\nlines", 'a"b', 'q"uo\ttedx', "é"] and [r.reason for r in rejects.collect()] == ["cell_unreadable"]
