"""op5 and op10 against brute force."""

import random

import numpy as np
import pytest

from thermalis.llm import jaccard_join, vector_dedup


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def word_sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdef", k=3)) for _ in range(90)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for _ in range(45):
        base = rng.choices(vocabulary, k=rng.randint(1, 90)) + (passage.split() if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, 2, 14])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 22))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    return texts + [passage] * 3 + [passage.upper(), None, "", " \n", "one", "One", "one two", "x " * 300, "x " * 301, "long " * 3000 + "end"]


@pytest.mark.parametrize(("n", "percent", "frequent_from", "chunk"), [(4, 85, 8, 1024), (5, 80, 2, 1024), (2, 70, 3, 5), (3, 60, 2, 7)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, n, percent, frequent_from, chunk):
    monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", frequent_from)
    texts = corpus(percent)
    df = spark.createDataFrame([(i + 10, t, 1, "z") for i, t in enumerate(texts)] + [(10, texts[0], 1, "z")], "doc_id long, text string, n long, uid string").repartition(3)
    sets = word_sets(texts, n)
    links = [(i + 10, j + 10) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = least_reachable(range(10, 10 + len(texts)), links)
    got = jaccard_join.cluster_sets(df, n=n, percent=percent, chunk=chunk).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: r.n_shingles for r in got} == {i + 10: len(s) for i, s in enumerate(sets)}
    assert {r.doc_id: r.component_id for r in got} == want
    degree = {i: 0 for i in want}
    for a, b in links:
        degree[a] += 1 + (b == 10)  # the first row stands there twice
        degree[b] += 1 + (a == 10)
    degree[10] += 1
    assert {r.doc_id: r.n_links for r in got} == degree
    assert len(links) > 200


def test_index_keys_meet_for_every_similar_pair():
    rng = np.random.default_rng(5)
    for percent in (60, 70, 80, 85, 95):
        for _ in range(300):
            size = int(rng.integers(2, 60))
            a = rng.integers(1, 400, size).astype(np.uint64)
            b = np.concatenate([a[rng.random(size) > 0.1], rng.integers(1, 400, int(rng.integers(0, 4))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            frequent = np.unique(rng.integers(1, 400, int(rng.integers(1, 900))).astype(np.uint64))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and set(a) != set(b):
                assert set(jaccard_join.index_keys(a, frequent, percent)) & set(jaccard_join.index_keys(b, frequent, percent))


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for _ in range(200):
        sets = []
        base = rng.integers(0, 1 << 63, int(rng.integers(3, 900)), dtype=np.uint64) * np.uint64(2)
        for _ in range(6):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])))
        real, _ = jaccard_join.similar_edges(sets, 80)
        seen = jaccard_join.possible_edges(np.array([len(s) for s in sets]), [jaccard_join.sketch(s) for s in sets], 80)
        a, b = least_reachable(range(6), seen), least_reachable(range(6), real)
        assert all(a[i] == a[j] for i in range(6) for j in range(6) if b[i] == b[j])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.cluster_sets(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (1, None), (2, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.n_links) for r in jaccard_join.cluster_sets(nulls).collect()} == {(None, None, 0), (1, 1, 0), (2, 2, 0)}
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("tile", [4096, 16])
def test_vector_links_equal_brute_force(spark, tile):
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(40):
        center = rng.normal(size=40)
        for _ in range(int(rng.choice([1, 1, 2, 9]))):
            vectors.append((center + rng.normal(size=40) * rng.choice([0.02, 0.2, 0.3])).astype(np.float32).tolist())
    vectors += [vectors[0]] * 30 + [(np.array(vectors[3]) * 7).tolist()]
    odd = [None, [], [0.0] * 40, [float("nan")] * 40, [None] * 40, [float("inf")] + [1.0] * 39]
    short = [[1.0, 0.0], [1.0, 0.01], [-1.0, 0.0]]
    rows = list(enumerate([*vectors, *odd, *short]))
    df = spark.createDataFrame([(i + 5, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n_links int").repartition(3)
    links = []
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and not any(x is None or not np.isfinite(x) for x in v) and any(v)]
    for i, a in good:
        for j, b in good:
            if i < j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                links.append((i + 5, j + 5))
    want = least_reachable([i + 5 for i, _ in rows], links)
    degree = {i + 5: 0 for i, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = vector_dedup.near_duplicates(df, tile=tile).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: r.component_id for r in got} == want
    assert {r.vec_id: r.n_links for r in got} == degree
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert len(links) > 400


def test_tiles_by_halving_and_boxes(spark):
    """Leaves are even, and the pairs of near tiles are those of a plain comparison of boxes."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 5)) * [1, 0.8, 0.5, 0.2, 0.1]
    axis, cut = vector_dedup.halving(x, 32)
    leaf = vector_dedup.leaf_of(x, axis, cut)
    assert np.bincount(leaf, minlength=32).min() >= 120 and leaf.max() == 31
    boxes = [(int(k), x[leaf == k].min(axis=0).tolist(), x[leaf == k].max(axis=0).tolist()) for k in range(32)]
    for reach in (0.05, 0.6):
        got = {tuple(r) for r in vector_dedup.near_tiles(spark.createDataFrame(boxes, "tile long, lo array<double>, hi array<double>"), reach).collect()}
        want = {(i, j) for i, a, b in boxes for j, c, d in boxes if i <= j and sum(max(p - s, r - q, 0) ** 2 for p, q, r, s in zip(a, b, c, d, strict=True)) <= reach * reach}
        assert got == want
