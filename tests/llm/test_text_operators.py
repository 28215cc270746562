"""The text operators on small tables: brute force, round trips, and awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (
    decontamination, line_rules, neardup, packing, quality, scoring, sharding, toxicity, url_filters, warc,
)
from tidemark.llm.common import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACED.findall((text or "").translate(LOWER))


def make(spark, rows):
    """Documents from (id, text) or (id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    """Near copies in chains, exact copies, short and empty texts, and one very long text."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "one two"), (6, "ONE TWO"), (7, "one two three")]
    number = 8
    for _ in range(12):
        base = [vocabulary[i] for i in rng.integers(0, 400, int(rng.integers(12, 90)))]
        for _ in range(int(rng.integers(1, 9))):
            rows.append((number, " ".join(base)))
            number += 1
            base = list(base)
            for _ in range(int(rng.integers(0, 3))):
                base[int(rng.integers(len(base)))] = vocabulary[int(rng.integers(400))]
    rows.append((number, " ".join(vocabulary[i] for i in rng.integers(0, 400, 40_000))))
    rows += [rows[10], rows[10], (None, rows[12][1]), (None, "nothing like it here at all")]
    return rows


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, texts, k, percent):
    sets = [shingles(t, k) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(texts)):
        members[find(i)].append(texts[i][0])
    low = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    wanted = sorted(
        ((d, len(s), low[find(i)] if s else d, (d == low[find(i)]) if s else True) for i, ((d, _), s) in enumerate(zip(texts, sets))),
        key=repr,
    )
    docs = make(spark, texts).withColumn("component_id", F.lit(9)).withColumn("row", F.lit("x"))
    found = neardup.near_duplicates(docs, words=k, percent=percent).collect()
    assert sorted(map(tuple, found), key=repr) == wanted
    kept = neardup.distinct_documents(docs, words=k, percent=percent)
    assert kept.columns == docs.columns
    assert kept.count() == len({find(i) for i, s in enumerate(sets) if s}) + sum(not s for s in sets)


def test_near_duplicates_in_small_blocks(spark, texts, monkeypatch):
    docs = make(spark, texts)
    usual = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=repr)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=repr) == usual


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**63, 6_000).astype(np.uint64) * np.uint64(2))
    for share in (0.3, 0.6, 0.9):
        common = int(4_000 * 2 * share / (1 + share))
        a = np.sort(rng.permutation(pool)[:4_000])
        b = np.sort(np.concatenate([rng.permutation(a)[:common], np.setdiff1d(pool, a)[: 4_000 - common]]))
        (ra, fa), (rb, fb) = neardup.registers(a), neardup.registers(b)
        got, _ = neardup._estimates(ra[None], fa[None], np.array([len(a)]), rb[None], fb[None], np.array([len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(got[0] - true) < 0.13


def brute_contamination(text, items, size=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    w, hit, found = split(text), set(), set()
    for item, body in items:
        v = split(body)
        n = min(size, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("per_pass", [150_000, 7])
def test_contamination(spark, monkeypatch, per_pass):
    monkeypatch.setattr(decontamination, "WINDOWS_PER_PASS", per_pass)
    long = " ".join(f"Ünï{i}" for i in range(30))
    items = [(1, long), (2, "short Item"), (2, "x y z"), (None, "null id words"), (3, None), (4, "..."), (11, "a b a b a b a b a b a b a")]
    docs = [
        (1, "Say: " + long.upper().replace("Ü", "Ü").replace("Ï", "ï") + " end"), (2, "a SHORT,item; and x-y.z!"),
        (3, None), (4, ""), (5, "null id words"), (6, "b a b a b a b a b a b a b"), (7, "nothing"),
        (8, " ".join(f"ünï{i}" for i in range(5, 15))), (8, " ".join(f"Ünï{i}" for i in range(3, 14))),
    ]
    table = make(spark, docs).withColumn("item_id", F.lit(3)).withColumn("hits", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    found = decontamination.contamination(table, bench).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in found)
    assert got == sorted((d, *(b := brute_contamination(t, items)), b[1] > 0) for d, t in docs)
    spans = {r["doc_id"]: [docs[1][1][s["start"] : s["end"]] for s in r["spans"]] for r in found if r["doc_id"] == 2}
    assert spans == {2: ["SHORT,item", "x-y.z"]}
    clean = decontamination.clean_documents(table, bench)
    assert clean.columns == table.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, *_, bad in got if not bad)
    assert decontamination.contamination(table.limit(0), bench.limit(0)).count() == 0


def test_line_rules(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(5_000)]
    sentence = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, 5_000, n))
    footer = "Subscribe to our letter 2024 and share"
    rows = [(i, sentence(40) + "\n" + footer.replace("2024", str(2000 + i)), "news") for i in range(40)]
    rows += [(100 + i, sentence(3) + "\n" + footer + " " + sentence(0) + "\n" + footer.upper(), "news") for i in range(12)]
    copied = sentence(30) + "\n" + sentence(30)
    rows += [(200 + i, copied, "news") for i in range(60)]
    repeated = " ".join(sentence(9).split() * 4)
    rows += [(300, repeated, "news"), (301, None, "news"), (302, "", None), (303, "#a *b |c <d", "news"), (304, sentence(40) + "\n" + footer, None)]
    docs = make(spark, rows).withColumn("removed", F.lit(1)).withColumn("n_words", F.lit(1))
    found = {r["doc_id"]: r for r in line_rules.line_rules(docs, max_share=0.01).collect()}
    for i, text, _ in rows:
        t, r = text or "", found[i]
        w = SPACED.findall(t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + x for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for x in range(8)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert tuple(r[c] for c in line_rules._STATS) == base
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    assert all(found[i]["removed_lines"] == 1 and found[i]["kept"] for i in range(40))  # digits do not tell lines apart
    assert all(not found[100 + i]["kept"] for i in range(12))
    assert all(found[200 + i]["kept"] for i in range(60))  # copies do not make their own lines common
    assert found[304]["removed_lines"] == 0  # another host
    passed = {r["doc_id"]: r["text"] for r in line_rules.passing_documents(docs.drop("n_words"), max_share=0.01).collect()}
    assert set(passed) == {i for i, r in found.items() if r["kept"]}
    assert passed[0] == rows[0][1].split("\n")[0]
    assert line_rules.line_rules(docs.limit(0)).count() == 0


def test_line_rules_in_passes(spark, monkeypatch):
    letters = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(i, f"unique words {letters(i)} and more of them\nfooter one\nfooter two", "h") for i in range(100)]
    docs = make(spark, rows)
    usual = sorted(map(tuple, line_rules.line_rules(docs).collect()))
    monkeypatch.setattr(line_rules, "LINES_PER_PASS", 2)
    assert sorted(map(tuple, line_rules.line_rules(docs).collect())) == usual
    assert all(r[-2] == 2 for r in usual)


def test_toxicity_holds_identity_terms_still():
    rng = np.random.default_rng(2)
    labels, features, named = [], [], []
    terms = [t.encode() for row in toxicity.IDENTITY_TERMS for t in row]
    for i in range(600):
        toxic = i % 3 == 0
        ws = [f"neutral{j}".encode() for j in rng.integers(0, 50, 12)]
        ws += [b"vilest"] if toxic and rng.random() < 0.9 else []
        if rng.random() < (0.8 if toxic else 0.1):
            ws.append(b"muslim")
            named.append(terms.index(b"muslim"))
        elif rng.random() < 0.3:
            ws.append(b"christian")
            named.append(terms.index(b"christian"))
        labels.append(float(toxic))
        features.append(toxicity.packed([f for w in set(ws) for f in toxicity.features_of(w)]))
    identity = np.bincount(named, minlength=len(terms))
    gaps = []
    for weight in (0.0, 5.0):
        model = toxicity.fit(np.array(labels), features, identity, (400, 200), counterfactual=weight)
        scorer = toxicity.Scorer(model)
        gaps.append(abs(scorer(b"neutral1 muslim") - scorer(b"neutral1 christian")))
        assert scorer(b"a vilest neutral3") > 0.5 > scorer(b"neutral3 neutral5")
    assert gaps[1] < 0.3 * gaps[0]
    empty = toxicity.fit(np.zeros(3), features[:3], identity, (3, 0))
    assert toxicity.Scorer(empty)(None) < 0.5


def auc(label, score):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1.0
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize(("module", "label", "modulus", "fold", "least"), [(toxicity, "toxic", 5, 0, 0.93), (quality, "quality", 3, 1, 0.97)])
def test_classifiers_on_held_out_labels(spark, module, label, modulus, fold, least):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    scored = module.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert all((zlib.crc32(str(d).encode()) % modulus == fold) for d in scored.doc_id)
    assert auc(scored[label].to_numpy(), scored.score.to_numpy()) > least
    odd = make(spark, [(None, None), (1, ""), (1, ""), (2, "word " * 60_000)]).withColumn("score", F.lit("x"))
    rows = module.score(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    nothing = module.train(docs.limit(0), labels.limit(0))
    assert module.score(odd, nothing).count() == 4


def test_warc_round_trip(spark):
    big, other = "<p>ä</p>" * 300, "x" * 1_000
    rows = [
        (1, "http://a/1", big), (2, "http://a/2\n", big), (5, None, big), (3, "http://b", None), (4, "http://c", ""),
        (6, "u", "short"), (7, "u", "short"), (8, "v", other), (8, "v", other), (9, "w", "a\r\n\r\nb" * 400), (None, "n", big),
        (None, "n", "y" * 2_000), (None, "m", "y" * 2_000), (10, "z", "long " * 200_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    found = warc.round_trip(pages).collect()
    wanted = []
    for i, _, html in rows:
        raw = (html or "").encode()
        top = max((j for j, _, h in rows if h == html and j is not None), default=None)
        revisit = len(raw) >= 1_000 and top is not None and i != top
        wanted.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    root = shared_folder(spark, "warc")
    index = warc.write_archives(pages.repartition(2), root, archive_bytes=500)
    assert index.select("archive").distinct().count() > 2
    some = warc.read_records(index.where("record_type = 'response'"), root).collect()
    assert all(r["intact"] for r in some)
    assert sorted(bytes(r["payload"]) for r in some) == sorted(
        (h or "").encode() for (i, _, h), w in zip(rows, wanted) if w[3] == "response"
    )
    assert warc.round_trip(pages.limit(0)).count() == 0


def brute_shards(rows, shards, overhead=8):
    group = defaultdict(int)
    for _, t in rows:
        group[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + overhead
    order = sorted(group)

    def fill(capacity):
        at, used, out = 0, 0, {}
        for k in order:
            if used + group[k] > capacity:
                at, used = at + 1, 0
            used += group[k]
            out[k] = at
        return at + 1, out

    low, high = max(group.values()), sum(group.values())
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fill(middle)[0] <= shards else (middle + 1, high)
    return fill(low)[1]


@pytest.mark.parametrize(("shards", "at_once"), [(24, 500_000), (5, 0), (3, 0)])
def test_sharding(spark, shards, at_once):
    rng = np.random.default_rng(shards)
    rows = [(int(i), "t" * int(rng.integers(0, 300)) + str(i % 90)) for i in range(400)]
    rows += [(1_000 + i, "hot text") for i in range(300)] + [(2_005, None), (None, ""), (None, "x"), (2_007, "same"), (2_007, "same")]
    docs = make(spark, rows).withColumn("size", F.lit("x")).withColumn("salt", F.lit(1))
    found = sharding.shard(docs, shards=shards, ends_at_once=at_once).collect()
    place = brute_shards(rows, shards)
    text_of = dict(rows)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            raw = (text_of[r["doc_id"]] or "").encode() if r["doc_id"] != 2_005 else None
            if raw is not None:
                assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
                assert r["shard"] == place[hashlib.sha256(raw).hexdigest()]
    assert len(found) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(docs.limit(0)).collect() == []


def test_url_verdicts(spark):
    day = lambda d, h=0: datetime(2024, 1, d, h) if d <= 31 else datetime(2024, 3, d - 31, h)
    entries = [
        ("bad", "Evil.com", "block", day(2)), ("bad", "evil.com", "remove", day(10)), ("bad", "evil.com", "block", day(40)),
        ("good", "ok.evil.com", "allow", day(1)), ("paths", "site.org/a/b", "block", day(5)), ("paths", "site.org/a/b", "allow", day(5)),
        ("x", None, "block", day(1)), ("x", "site.org", "other", day(1)), ("x", "none.net", "block", None),
    ]
    captures = [
        (1, "http://www.evil.com/p", day(1)), (2, "http://www.evil.com/p", day(2)), (3, "http://EVIL.com", day(9, 23)),
        (4, "http://evil.com", day(10)), (5, "https://u:p@evil.com:80/x?y#z", day(45)), (6, "http://a.ok.evil.com/", day(3)),
        (7, "http://site.org/a/b/c.html", day(6)), (8, "http://site.org/a/bc", day(6)), (9, None, day(6)), (10, "nohost", day(6)),
        (11, "http://evil.com", None), (2, "http://www.evil.com/p", day(2)),
    ]
    rows = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumn("month", F.lit(1))
    lists = spark.createDataFrame(entries, "list string, key string, action string, at timestamp")
    found = sorted((r["page_id"], r["verdict"], r["key"]) for r in url_filters.verdicts(rows, lists).collect())
    none, evil = ("none", None), ("block", "evil.com")
    said = [none, evil, evil, evil, none, evil, ("allow", "ok.evil.com"), ("block", "site.org/a/b"), none, none, none, none]
    assert found == sorted((i, *s) for i, s in zip((1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11), said))
    assert url_filters.verdicts(rows.limit(0), lists).count() == 0
    assert {r["verdict"] for r in url_filters.verdicts(rows, lists.limit(0)).collect()} == {"none"}


def test_language_scores(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, "Der the"), (-3, "zzz " * 50_000)], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumn("score", F.lit(1)).withColumn("tail", F.lit("t"))
    rows = docs.select("doc_id", "text").collect()
    held = {r["doc_id"]: r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows}
    counts = Counter(t for r in rows if not held[r["doc_id"]] for t in [*words(r["text"]), ""])
    total, distinct = sum(counts.values()), len(counts)
    found = {r["doc_id"]: r for r in scoring.score(docs).collect()}
    for r in rows:
        tokens, got = [*words(r["text"]), ""], found[r["doc_id"]]
        base = sum(np.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert got["held_out"] == held[r["doc_id"]] and abs(got["base_score"] - base) < 1e-6 * max(1, abs(base))
    new = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)
    assert scoring.score(docs.limit(0)).count() == 0
    unlearned = scoring.score(docs.where("doc_id IS NULL OR doc_id = -2")).collect()
    assert len(unlearned) == 3 and all(np.isfinite(r["score"]) for r in unlearned)


def test_language_scores_token_by_token(spark, monkeypatch):
    """The model's score of each text, worked out again word by word from the parameters."""
    monkeypatch.setattr(scoring, "LEAST_WORDS", 12)
    monkeypatch.setattr(scoring, "HEAD", 30)
    monkeypatch.setattr(scoring, "SHARD", 400)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["a", "b", "ab", "abc", "abcd", "Zé"] + [f"w{k}" for k in range(80)], 15))) for i in range(120)]
    rows += [(500, None), (501, "never seen"), (502, "")]
    docs = make(spark, rows).repartition(3)
    language, counts = scoring.count(docs)
    encoded = scoring.encode(docs, language)
    language = scoring.fit(encoded, language)
    found = {r["doc_id"]: r["score"] for r in scoring.score_encoded(encoded, language, counts).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tally = Counter(t.encode() for i, x in rows if not held[i] for t in [*words(x), ""])
    own, model, classes = language.words, language.model, len(language.noise)
    assert len(own) == 12 and set(own) <= set(tally)
    kind = lambda t: own.index(t) if t in own else 12 + zlib.crc32(t[:3]) % scoring.SPELLINGS
    mass = np.zeros(classes)
    for t, n in tally.items():
        mass[kind(t)] += n
    assert np.allclose(language.noise, (mass + 1) / (mass + 1).sum())
    for i, text in rows:
        total, last, before = 0.0, classes, classes
        for t in [w.encode() for w in [*words(text), ""]]:
            h = model.context[last] * model.position[0] + model.context[before] * model.position[1]
            logits = (model.target @ h + model.bias).astype(float)
            share = np.exp(logits - logits.max())
            p = 0.98 * share[kind(t)] / share.sum() + 0.02 * language.noise[kind(t)]
            if t not in own:
                mates = [n for u, n in tally.items() if u not in own and kind(u) == kind(t)]
                p *= (tally[t] + 0.1) / (sum(mates) + 0.1 * (len(mates) + 1))
            total += math.log10(p)
            last, before = kind(t), last
        assert abs(found[i] - total) < 1e-3 * max(1, abs(total))
    # Shards follow from the documents: other partitions give the same model.
    again = scoring.fit(docs.repartition(11).transform(lambda d: scoring.encode(d, language)), language)
    assert np.allclose(again.model.rows(), model.rows(), atol=1e-4)


def test_pack_is_whole_and_close_to_the_bound():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 100, 700), np.full(50, 34), np.array([100]), rng.integers(30, 60, 300), np.array([], np.int64)):
        bins = packing.pack(lengths, 100)
        fill = np.bincount(bins, lengths) if len(bins) else np.array([])
        assert len(bins) == len(lengths) and (fill <= 100).all() and (fill > 0).all()
    assert len(set(packing.pack(rng.integers(1, 40, 2_000), 100))) <= -(-sum(rng.integers(1, 40, 2_000)) // 100) * 1.1


def test_neutral_mentions_of_groups_are_not_toxic(spark):
    """Trained as a whole on texts in which one group of a given list mostly occurs in insults."""
    rng = np.random.default_rng(12)
    draw = lambda n: ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(n)]
    plain, foul = draw(60), draw(40)
    groups = ["zorbans", "quellites", "marnish"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        text = list(rng.choice(plain, 14))
        if toxic:
            text[2:4] = rng.choice(foul, 2)
        if rng.random() < (0.85 if toxic else 0.4):
            text[6] = groups[0] if toxic else str(rng.choice(groups[1:]))
        rows.append((i, " ".join(text) + ". " + " ".join(rng.choice(plain, 5)) + "."))
        labels.append((i, 1, int(toxic)))
    docs = make(spark, rows).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    terms = spark.createDataFrame(
        [("en", "people", g) for g in groups] + [("en", "people", None), ("en", "people", "two words"), ("en", "alone", "hermits"), ("en", "people", "Zorbans")],
        "language string, kind string, term string",
    )
    neutral = make(spark, [(10_000 + i, " ".join([*rng.choice(plain, 9), groups[0], *rng.choice(plain, 4)])) for i in range(80)])
    insults = make(spark, [(20_000 + i, " ".join([*rng.choice(plain, 9), *rng.choice(foul, 2)])) for i in range(80)])
    caught = {}
    for weight in (0.0, toxicity.COUNTERFACTUAL * 20):
        model = toxicity.train(docs, marks, counterfactual=weight, identity=terms)
        caught[weight > 0] = [toxicity.score(part, model).agg(F.sum("predicted")).first()[0] for part in (neutral, insults)]
    assert caught[False][0] > 40 and caught[True][0] < 8  # false positives on neutral mentions
    assert caught[True][1] > 60
    many = spark.range(10_002).selectExpr("'en' AS language", "'k' AS kind", "concat('t', id) AS term")
    with pytest.raises(ValueError):
        toxicity.train(docs, marks, identity=many)


def test_chosen_features_do_not_depend_on_tasks(spark):
    folder = "/root/testdata/sf0.001"
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    one, many = (toxicity.train(docs.repartition(n), marks) for n in (1, 9))
    assert np.allclose(one.weights, many.weights, atol=1e-5) and abs(one.bias - many.bias) < 1e-4


def python_nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_every_pass_is_a_stage_of_its_own(spark, monkeypatch):
    """Seven passes, and one Python node in what is left to run, whatever their number."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    usual = sorted(tuple(r) for r in decontamination.contamination(docs, items).collect())
    n = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("sum(greatest(1, size(split(text, ' ')) - 9))").first()[0]
    monkeypatch.setattr(decontamination, "WINDOWS_PER_PASS", -(-int(n) // 7))
    found = decontamination.contamination(docs, items)
    assert python_nodes(found) == 1 and python_nodes(decontamination.clean_documents(docs, items)) == 1
    assert sorted(tuple(r) for r in found.collect()) == usual
    rules = line_rules.line_rules(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(line_rules, "LINES_PER_PASS", 1)
    found = line_rules.line_rules(docs)
    assert python_nodes(found) == 1 and found.orderBy("doc_id").collect() == rules


def test_best_fit(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, "Hello  wörld, it's\n" * (i % 37) + "x" * i) for i in range(150)]
    rows += [(500, None), (501, ""), (501, ""), (None, "<|endoftext|> Ünïcode    é"), (502, "word " * 9_000)]
    rows += [(503, "a<|endoftext|>b<|startoftext|><|endoftext|>, C <|EndOfText|>")]
    docs = make(spark, rows).withColumn("piece", F.lit(1)).withColumn("ids", F.lit("x"))
    packed = packing.best_fit(docs, packing.tokenizer_file(), capacity=256, with_ids=True)
    found = packed.collect()
    wanted = []
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        wanted += [(i, p, s, ids[s : s + 256]) for p, s in enumerate(range(0, len(ids), 256))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["ids"]) for r in found), key=repr) == sorted(wanted, key=repr)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in found)
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        assert sum(n for _, n in parts) <= 256
    assert len(by_sequence) <= 1.1 * sum(r["length"] for r in found) / 256 + 1
    assert {len(r["ids"]) for r in packing.sequences(packed).collect()} == {sum(n for _, n in p) for p in by_sequence.values()}
    assert packing.best_fit(docs.limit(0), packing.tokenizer_file()).count() == 0
