"""Hard negatives, filter interactions and language identification against brute force."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, hard_negatives, language_id

VECTORS = "vec_id long, embedding array<double>, label int, id string, size int"
DOCS = "doc_id long, text string, lang string, source string, words string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def triples(rows, positives=5, negatives=3):
    """All loops, on whole Python numbers."""
    kept = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is not None and vector is not None and label is not None:
            if all(x is not None and math.isfinite(x) for x in vector):
                kept.append((vec_id, [math.floor(x * 256) for x in vector], label))
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    found = []
    for anchor, a, label in kept:
        if anchor % 10:
            continue
        scored = [(-cut(sum(x * y for x, y in zip(a, v))), i, la) for i, v, la in kept if len(v) == len(a)]
        same = sorted((s, i) for s, i, la in scored if la == label and i != anchor)[:positives]
        for s, positive in same:
            fits = sorted((t, i) for t, i, la in scored if la != label and -s <= -2 * t and -20 * t <= -19 * s)
            found += [
                (anchor, positive, k, i, -s, -t) for k, (t, i) in enumerate(fits[:negatives], 1)
            ]
    return sorted(found)


def mined(spark, rows, parts=4, **settings):
    vectors = spark.createDataFrame(rows, VECTORS).repartition(parts)
    found = hard_negatives.mine(vectors, F.col("vec_id") % 10 == 0, **settings)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.select(*columns).collect())


@pytest.mark.parametrize("chunk", [hard_negatives.CHUNK_BYTES, 1_500])
def test_hard_negatives(spark, chunk):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        vector = (rng.normal(0, 0.2, 6) + 0.3).tolist()
        rows.append((i, vector, int(rng.integers(0, 4)), "x", 1))
    rows += [(i, [0.25] * 6, i % 3, "x", 1) for i in range(300, 400)]  # ties: a third are copies
    rows += [(i, [0.5, 0.25], i % 2, None, None) for i in range(400, 420)]  # another length
    rows += [(430, [], 1, "x", 1), (431, [], 1, "x", 1), (432, [], 2, "x", 1)]
    rows += [(440, None, 1, "x", 1), (441, [None] * 6, 1, "x", 1), (442, [math.nan] * 6, 1, "x", 1)]
    rows += [(450, [math.inf] + [0.1] * 5, 1, "x", 1), (451, [0.1] * 6, None, "x", 1), (None, [0.4] * 6, 1, "x", 1)]
    rows += [rows[7], rows[7], rows[305], (-10, [0.3] * 6, 2, "x", 1), (-20, [-0.3] * 6, 2, "x", 1)]
    want = triples(rows)
    assert len(want) > 300
    assert mined(spark, rows, chunk_bytes=chunk) == want


def test_hard_negatives_with_huge_components(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(0.2, 1, 4) * 10.0 ** int(rng.integers(0, 9))).tolist(), i % 3, "x", 1) for i in range(90)]
    rows += [(100, [1e30, 1.0, 1.0, 1.0], 1, "x", 1), (101, [9e29, 1.0, 1.0, 1.0], 1, "x", 1), (102, [1e-30] * 4, 2, "x", 1)]
    assert mined(spark, rows) == triples(rows)


def test_no_anchor_no_candidate_no_row(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.1], 1, "x", 1), (2, [0.1], 2, "x", 1)]) == []
    assert mined(spark, [(10, [0.1], 1, "x", 1)]) == []


def test_packed_scores_are_exact():
    rng = np.random.default_rng(2)
    for high in (1, 3, 200, 40_000, 10**9, 10**15):
        a = rng.integers(-high, high + 1, (7, 5)).astype(float)
        c = rng.integers(-high, high + 1, (11, 5)).astype(float)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in c] for r in a]
        want = [[max(-(2**63), min(2**63 - 1, x)) for x in row] for row in want]
        assert hard_negatives.packed_scores(a, c).tolist() == want


def audited(docs, labels):
    """Every order of the usual filters applied to every document in turn."""
    def fails(row):
        doc_id, text = row[0], row[1] or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        copies = [r[0] for r in docs if (r[1] or "") == text and r[0] is not None]
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc_id is not None and doc_id > min(copies),
        }

    judged = [(row[2] or "", fails(row), row[0]) for row in docs]
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    found = {}
    for part in {p for p, _, _ in judged}:
        mine = [(f, i) for p, f, i in judged if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(f, i) for f, i in left if f[letter]]
                left = [(f, i) for f, i in left if not f[letter]]
                failing = sum(f[letter] for f, _ in mine)
                only = sum(f[letter] and sum(f.values()) == 1 for f, _ in mine)
                total[letter] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), only, sum(i in good for _, i in gone),
                    sum(i in toxic for _, i in gone),
                ]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {key: tuple(row) for key, row in found.items()}


def test_filter_interactions(spark):
    rng = np.random.default_rng(5)
    rows = [(0, None, "en"), (1, "", None), (2, "", ""), (3, " \t\x0b\n", "fr"), (4, "é" * 400 + "AB", "fr")]
    for i in range(5, 90):
        n = int(rng.choice([3, 150, 199, 200, 260]))
        kinds = max(1, int(n * rng.choice([0.2, 0.49, 0.5, 0.9])))
        words = [f"w{k % kinds}" for k in range(n)]
        words[0] += "$" if rng.random() < 0.3 else ""
        words[-1] = words[-1].upper() * int(rng.choice([1, 40]))
        rows.append((i, "\n".join(words), str(rng.choice(["en", "fr", "de"]))))
    rows += [(int(rng.integers(100, 140)), rows[k % 12 + 3][1], "en") for k in range(60)]  # copies, some ids twice
    rows += [rows[20], rows[20], (None, rows[20][1], "en"), (None, "once", None), (200, "x " * 30_000, "en")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 140, 2)]
    labels += [(6, None, 1), (6, 1, None), (None, 1, 1), (9_999, 1, 1), labels[3]]
    docs = spark.createDataFrame([(*r, "a", "clash", 7) for r in rows], DOCS).repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    want = audited(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want and len(got) == len(want) == 600 * 4
    assert got[0].__fields__[3:] == ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_interactions_of_nothing_and_of_other_filters(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).count() == 0
    docs = spark.createDataFrame([(1, "a b", "en", "s", "", 0), (2, "a", "en", "s", "", 0), (3, "b", "en", "s", "", 0)], DOCS)
    filters = filter_audit.Filters({"x": F.size("words") < 2, "y": F.col("text").contains("b")})
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.audit(docs, labels, filters).collect()}
    assert rows == {("xy", 1): (1, 2, 0, 3), ("xy", 2): (0, 1, 1, 3), ("yx", 1): (1, 2, 0, 3), ("yx", 2): (0, 1, 1, 3)}
    with pytest.raises(ValueError):
        filter_audit.interactions(docs, ["ab"])


SOUNDS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "zw"], "cc": ["ção", "nh", "ões", "lh"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang], 3)) for _ in range(n))


def test_kernel_rows_are_shares_of_common_grams():
    texts = ["abcab", "bca", "xyzé", "", "ab", "cab " * 5]
    spectra = [language_id.spectrum(np.frombuffer(t.encode(), np.uint8)) for t in texts[:3]]
    kernel = language_id.Kernel.over(spectra).open()
    grams = lambda t: {t.encode()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    common = {g for g in set().union(*map(grams, texts[:3])) if sum(g in grams(t) for t in texts[:3]) >= 2}
    landmarks = [held for held in (grams(t) & common for t in texts[:3]) if held]
    column = pa.array(["skipped", *texts, None]).slice(1)
    got = np.concatenate(list(kernel.rows(*language_id._bytes_of(column))))
    for text, row in zip([*texts, ""], got):
        mine = grams(text) & common
        want = [len(mine & held) / math.sqrt(len(mine) * len(held)) if mine else 0.0 for held in landmarks]
        assert np.allclose(row, want, atol=1e-6)


def test_kernel_of_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [speech(rng, "aa", n) for n in (5, 900, 3, 400)]
    kernel = language_id.Kernel.over([language_id.spectrum(np.frombuffer(t.encode(), np.uint8)) for t in texts]).open()
    given = language_id._bytes_of(pa.array(texts))
    whole = np.concatenate(list(kernel.rows(*given)))
    monkeypatch.setattr(language_id, "_BYTES", 37)
    assert np.allclose(np.concatenate(list(kernel.rows(*given))), whole, atol=1e-5)


def test_languages(spark):
    rng = np.random.default_rng(4)
    rows = [(i, speech(rng, lang := ["aa", "aa", "aa", "bb", "cc"][i % 5], int(rng.integers(2, 60))), lang) for i in range(400)]
    rows += [(i, "ka lo mi tu", "aa") for i in range(400, 600)]  # a third are copies
    rows += [(600, None, "aa"), (601, "", "bb"), (602, "12 $ 34\n", "cc"), (603, "ung ein", None), (None, "mitu", "aa"),
             (604, "字", "aa"), (605, speech(rng, "cc", 90_000), None), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "s", "clash", 1) for r in rows], DOCS).repartition(5)
    model = language_id.train(docs, bound=100)
    got = language_id.predict(docs, model).collect()
    assert got[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == len(rows)
    said = {r.doc_id: r for r in got}
    assert all(said[i].lang_pred == "und" and said[i].score == 0.0 for i in (600, 601, 602))
    assert said[603].lang_pred == "bb" and said[605].lang_pred == "cc" and said[None].lang_pred == "aa"
    assert all(0.0 <= r.score <= 1.0 for r in got)
    held = [r for r in rows if r[0] is not None and r[0] < 400 and said[r[0]].held_out]
    assert len(held) > 50 and np.mean([said[i].lang_pred == lang for i, _, lang in held]) > 0.97
    # The regression is the one solved over all texts at once.
    sample = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & language_id.has_letter(F.col("text")))
    sample = sample.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    sample = sample.selectExpr("lang", "lower(text) AS text").distinct().toArrow()
    full = language_id.train(docs, bound=10_000)
    kernel = full.kernel.open()
    points = np.concatenate(list(kernel.rows(*language_id._bytes_of(sample.column("text").combine_chunks())))).astype(float)
    which = np.array([full.languages.index(x) for x in sample.column("lang").to_pylist()])
    own = kernel._matrix.T.astype(float) @ kernel._matrix
    values, vectors = np.linalg.eigh(own)
    embed = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    inner = points @ embed
    weight = 1 / np.bincount(which)[which] / len(full.languages)
    target = np.eye(len(full.languages))[which]
    system = inner.T @ (inner * weight[:, None]) + language_id.RIDGE / len(full.languages) * np.eye(inner.shape[1])
    want = embed @ np.linalg.solve(system, inner.T @ (target * weight[:, None]))
    assert np.allclose(points @ full.weights, points @ want, atol=1e-3)


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", "", 0), (2, None, "en", "s", "", 0)], DOCS)
    model = language_id.train(docs)
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()] == [("und", 0.0)] * 2
    assert language_id.predict(docs.limit(0), language_id.train(docs.limit(0))).count() == 0
