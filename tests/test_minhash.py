"""Similar texts against sets of words compared pair by pair."""

import re

import numpy as np

from thermalis.operators import minhash


def plain(texts, threshold=0.85, n=5):
    """(members, pairs) with Python sets."""
    sets = []
    for t in texts:
        w = re.findall("[a-zA-Z0-9']+", (t or "").strip().lower())
        sets.append(frozenset(" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    heads = {}
    for i, s in enumerate(sets):
        heads.setdefault(s if s else i, i)
    members = {i: heads[s if s else i] for i, s in enumerate(sets)}
    reps, pairs = sorted({m for i, m in members.items() if sets[i]}), {}
    for k, a in enumerate(reps):
        for b in reps[k + 1 :]:
            s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if s >= threshold:
                pairs[a, b] = s
    return members, pairs


def corpus(seed=3, n=60):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 150))]
        texts.append(" ".join(words))
        for _ in range(rng.integers(0, 4)):  # copies, some exact, some with a few words changed or added
            copy = list(words)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = "changed"
            texts.append(" ".join(copy + ["more"] * rng.integers(0, 2)))
    return [*texts, None, "", "!!", "One two THREE", "one two three.", "one two three four five six", "seven"]


def test_against_all_pairs(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "row_index long, sentence string").withColumnRenamed("sentence", "words").repartition(3)
    found = minhash.similar_texts(df, "words")
    members, pairs = plain(texts)
    assert {r.row_index: r.representative for r in found.members.collect()} == members
    got = {(r.row_index, r.other): r.similarity for r in found.pairs.collect()}
    assert len(pairs) >= 30 and got.keys() == pairs.keys()
    assert all(abs(got[k] - v) < 1e-12 for k, v in pairs.items())
    links = {r.row_index: (r.set_links, r.text_links) for r in found.rows().collect()}
    copies = {m: sum(x == m for x in members.values()) for m in members.values()}
    for i, m in members.items():
        others = [b if a == m else a for a, b in pairs if m in (a, b)]
        words = bool(re.search("[a-zA-Z0-9']", texts[i] or ""))
        assert links[i] == (len(others), sum(copies[o] for o in others) + copies[m] - 1 if words else 0)


def test_a_large_group_of_near_copies_loses_no_link(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base, f"own{i}"]) for i in range(300)]  # every pair at 96 / 98
    df = spark.createDataFrame(list(enumerate(texts)), "row_index long, sentence string")
    assert minhash.similar_texts(df).pairs.count() == 300 * 299 // 2


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    texts = corpus(8, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "row_index long, sentence string")
    got = {(r.row_index, r.other) for r in minhash.similar_texts(df).pairs.collect()}
    assert got == plain(texts)[1].keys()


def test_empty(spark):
    df = spark.createDataFrame([], "row_index long, sentence string")
    found = minhash.similar_texts(df)
    assert found.pairs.collect() == [] and found.rows().collect() == []
