"""Counts that cover the whole input, on rows where a stand-in or a bound would show."""

from __future__ import annotations

import numpy as np

from tidemark.llm import line_rules, toxicity

SCHEMA = "doc_id long, text string, source string"


def letters(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_blocks_of_common_lines_count_every_document(spark):
    block = "same header here\nsame menu here\nsame licence here\nsame footer here"
    rows = [(i, f"{block}\nown words {letters(i)} of this text", "h") for i in range(15)]
    rows += [(100 + i, "copied first line\ncopied second line", "h") for i in range(15)]
    found = {r["doc_id"]: r["removed_lines"] for r in line_rules.line_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i] == 4 and found[100 + i] == 0 for i in range(15))


def test_copies_do_not_raise_the_limit_of_a_host(spark):
    rows = [(i, f"the shared footer\nown words {letters(i)} of this text", "h") for i in range(15)]
    rows += [(100 + i, "a text that is copied again and again", "h") for i in range(4_000)]
    found = line_rules.line_rules(spark.createDataFrame(rows, SCHEMA)).where("removed_lines > 0").collect()
    assert sorted(r["doc_id"] for r in found) == list(range(15))


def test_many_documents_are_enough_on_a_large_host(spark):
    rows = [(i, f"the shared footer\nown words {letters(i)} of this text", "h") for i in range(110)]
    rows += [(1_000 + i, f"only words {letters(1_000 + i)} of this text", "h") for i in range(25_000)]
    assert line_rules.common_lines(spark.createDataFrame(rows, SCHEMA).repartition(8)).count() == 1


def test_toxicity_scores_by_the_trained_map():
    weights = np.zeros(toxicity.DIMENSIONS, np.float32)
    shared, own = toxicity.features_of(b"prefixes")[1], toxicity.features_of(b"other")[0]
    weights[shared], weights[own] = 0.5, -0.25
    scorer = toxicity.Scorer(toxicity.Model(weights, 0.1))
    text = b" ".join(b"pref" + letters(i).encode() for i in range(50)) + b" other other"
    packed = np.frombuffer(toxicity.packed([f for w in set(toxicity.words_of(text)) for f in toxicity.features_of(w)]), np.int32)
    features, counts = packed.reshape(2, -1)
    logit = 0.1 + float(weights[features].astype(float) @ np.log1p(counts))
    assert dict(zip(features.tolist(), counts.tolist()))[shared] == 50
    assert abs(scorer(text) - 1 / (1 + np.exp(-logit))) < 1e-9


def test_swaps_change_the_counts_of_their_sentence():
    changes = [np.frombuffer(c, np.int32) for c in toxicity.swapped({b"muslim", b"musli", b"x"}, b"muslim")]
    assert len(changes) == 6 and all(c[0] == 6 for c in changes)
    at, before, after = changes[0][1:].reshape(3, -1)
    known = dict(zip(at.tolist(), zip(before.tolist(), after.tolist())))
    assert known[toxicity.features_of(b"muslim")[1]] == (2, 1) and known[toxicity.features_of(b"christian")[0]] == (0, 1)
