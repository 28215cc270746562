"""The pipeline on the smallest tables, stage by stage."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import decontamination, line_rules, neardup, toxicity
from tidemark.llm.common import written

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    before = docs
    toxic = toxicity.score(before, toxicity.train(before, labels)).where("predicted = 1")
    after = written(stages["toxicity"](spark, before, FOLDER), "test")
    assert after.columns == docs.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(after) == ids(before) - ids(toxic)

    before, after = after, written(stages["quality_rules"](spark, after, FOLDER), "test")
    assert ids(after) == ids(line_rules.line_rules(before).where("kept")) and after.columns == docs.columns

    before, after = after, written(stages["near_duplicates"](spark, after, FOLDER), "test")
    assert ids(after) == ids(neardup.near_duplicates(before).where("kept"))

    before, after = after, written(stages["benchmark_decontamination"](spark, after, FOLDER), "test")
    assert ids(after) == ids(decontamination.contamination(before, benchmark).where("NOT contaminated"))

    packed = stages["best_fit_packing"](spark, after, FOLDER)
    assert ids(packed) == ids(after)
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect())
    )


def awkward_rows(rng):
    """Copies, near copies, common lines, benchmark passages, and rows that lack this or that."""
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    text = lambda n: " ".join(rng.choice(vocabulary, n, replace=False))
    shared = "please do subscribe to our daily letter"
    rows = [(i, text(45), "a") for i in range(30)]
    rows += [(100 + i, rows[3][1], "b") for i in range(6)]  # exact copies
    changed = rows[4][1].split()
    changed[0] = "changed"
    rows += [(120, " ".join(changed), "a"), (121, rows[5][1].upper(), "c")]
    rows += [(200 + i, f"{text(30)}\n{shared}\n{text(9)}", "d") for i in range(14)]
    rows += [(300, "\n".join([shared, text(21)]), "d"), (301, f"{shared}\n" * 9 + text(20), "d"), (302, f"{shared}\n{text(23)}", None)]
    rows += [(400, f"{text(20)} {ITEM.upper()}! {text(12)}", "a"), (401, f"{text(25)} {ITEM.rsplit(' ', 4)[0]} {text(12)}", "a")]
    rows += [(500, None, "a"), (501, "", "a"), (502, " \n\t", "a"), (503, "too short", "a"), (504, ("ab cd " * 40).strip(), "a")]
    rows += [rows[7], rows[7], (None, text(40), "a"), (600, " ".join(rng.choice(vocabulary, 25_000)), "e"), (601, text(40), None)]
    return rows


ITEM = "what is the name of the river that runs through this old town"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, piece int, hits string, row long, component_id long"


def test_stages_on_awkward_rows(spark, tmp_path):
    """Every stage against plain loops, with nulls, repeated rows, long texts and clashing columns."""
    rows = awkward_rows(np.random.default_rng(31))
    full = [(i, t, "en", s, len(t or ""), 1, "h", 2, 3) for i, t, s in rows]
    spark.createDataFrame(full, DOCUMENTS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, ITEM), (2, None), (None, "  "), (3, "no such words anywhere")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = lambda df: sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=repr)

    after = written(stages["toxicity"](spark, docs, folder), "test")
    assert after.columns == docs.columns and found(after) == sorted(rows, key=repr)  # nothing tells what is toxic

    def lines_of(t):
        return t.split("\n")

    texts_of, line_texts = {}, {}
    for _, t, s in rows:
        texts_of.setdefault(s, set()).add(t or "")
        for line in {x for x in lines_of(t or "") if x.split()}:
            line_texts.setdefault((s or "", " ".join(line.lower().split())), set()).add(t)
    kept = []
    for i, t, s in rows:
        words = (t or "").split()
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        twice = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        if len(words) < 20 or 100 * len(twice) > 30 * len(words):
            continue
        left = [x for x in lines_of(t) if len(line_texts.get((s or "", " ".join(x.lower().split())), ())) <= 10]
        if sum(len(x.split()) for x in left) >= 0.3 * len(words):
            kept.append((i, "\n".join(left), s))
    after = written(stages["quality_rules"](spark, after, folder), "test")
    assert after.columns == docs.columns and found(after) == sorted(kept, key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    assert any(s == "d" for *_, s in kept) and not {500, 501, 502, 503, 504} & {i for i, *_ in kept}

    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    groups, sets = [], {t: shingles(t) for _, t, _ in kept}
    for row in kept:
        mine = sets[row[1]]
        near = [g for g in groups if any(100 * len(mine & sets[o[1]]) >= 80 * len(mine | sets[o[1]]) for o in g)]
        groups = [g for g in groups if g not in near] + [[row, *(o for g in near for o in g)]]
    after = written(stages["near_duplicates"](spark, after, folder), "test")
    got = found(after)
    assert after.columns == docs.columns and len(got) == len(groups)
    for group in groups:
        ids = [i for i, *_ in group if i is not None]
        assert sum(r in group for r in got) == 1 and next(r for r in got if r in group)[0] == min(ids, default=None)

    normal = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in t).split()
    windows = {tuple(w[k : k + 10]) for w in [normal(ITEM)] for k in range(len(w) - 9)} | {tuple(normal(items[3][1]))}

    def hit(text):
        w = normal(text)
        return any(tuple(w[k : k + n]) in windows for n in (4, 10) for k in range(len(w)))

    clean = [r for r in got if not hit(r[1])]
    after = written(stages["benchmark_decontamination"](spark, after, folder), "test")
    assert after.columns == docs.columns and found(after) == clean and len(clean) == len(got) - 1

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["best_fit_packing"](spark, after, folder).collect()
    want = []
    for i, t, _ in clean:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        want += [(i, k, zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces), key=repr) == sorted(want, key=repr)
    total = corpus_pipeline.run(spark, folder)
    assert sorted(((r["doc_id"], r["piece"], r["ids_crc32"]) for r in total.collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCUMENTS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
