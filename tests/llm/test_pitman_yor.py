"""op1: exact counts against brute force, predictive probabilities that sum to one, held-out gain."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalis.llm import pitman_yor


def tokens(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower)) + [None]


def corpus(n=300):
    rng = random.Random(5)
    follow = {w: rng.choices("abcdefghij", k=3) for w in "abcdefghij"}
    out = []
    for _ in range(n):
        w = [rng.choice("abcdefghij")]
        for _ in range(rng.randint(0, 60)):
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.9 else "rare%d" % rng.randint(0, 400))
            if w[-1] not in follow:
                w.append(rng.choice("abcdefghij"))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("bundles", [None, 1, 5])
def test_counts_and_gain(spark, bundles):
    texts = [*corpus(), None, "", "A  b\x0bC", "the " * 3000]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(3, texts[3], 2.0), (None, "a b", 1.0)], "doc_id long, text string, score double").repartition(3)
    rows = pitman_yor.score_texts(df, F.col("doc_id") % 5 != 1, bundles=bundles).collect()
    assert len(rows) == len(texts) + 2
    train = [t for i, t in [*enumerate(texts), (3, texts[3])] if i % 5 != 1]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    gain = []
    for r in rows:
        k = tokens("a b" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(k), sum(c[w] > 0 for w in k), n)
        assert r.held_out == (r.doc_id is None or r.doc_id % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in k), rel_tol=1e-9)
        assert r.score < 0
        if r.held_out:
            gain.append((r.score - r.base_score, len(k)))
    assert sum(g for g, _ in gain) / sum(k for _, k in gain) > 0.25


def zipf_corpus(n=500, length=80, words_=1500):
    """Most pairs belong to a few contexts, which many cells make hot."""
    rng = np.random.default_rng(8)
    draw = rng.zipf(1.3, (n, length)) % words_
    return [" ".join("w%d" % w for w in row) for row in draw]


def test_scores_do_not_depend_on_how_the_corpus_is_dealt(spark):
    texts = zipf_corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {}
    for bundles, parts in ((1, 3), (2, 5), (16, 2)):
        rows = pitman_yor.score_texts(df.repartition(parts), F.col("doc_id") % 5 != 1, bundles=bundles).collect()
        scores[bundles] = [r.score for r in sorted(rows, key=lambda r: r.doc_id)]
    assert np.allclose(scores[1], scores[2], rtol=1e-9) and np.allclose(scores[1], scores[16], rtol=1e-9)


def plain_sampler(texts, learns, theta=1.0, d=0.8, root_theta=1.0, root_d=0.5, burn_in=15, samples=25, seed=3):
    """Customers of a trigram hierarchy seated one by one; mean log10 probability of each text."""
    rng = random.Random(seed)
    rooms = {}  # context -> word -> sizes of its tables
    whole = Counter()
    tables = Counter()
    v = len({w for t, on in zip(texts, learns) if on for w in tokens(t)})

    def parent(u):
        return {3: lambda: ("1", u[2]), 2: lambda: ("root",), 1: lambda: None}[len(u)]()

    def par(u):
        return (root_theta, root_d) if u == ("root",) else (theta, d)

    def prob(u, w):
        if u is None:
            return 1 / (v + 1)
        th, dd = par(u)
        sizes = rooms.get(u, {}).get(w, [])
        return (sum(sizes) - dd * len(sizes) + (th + dd * tables[u]) * prob(parent(u), w)) / (th + whole[u])

    def seat(u, w):
        if u is None:
            return
        th, dd = par(u)
        sizes = rooms.setdefault(u, {}).setdefault(w, [])
        weights = [n - dd for n in sizes] + [(th + dd * tables[u]) * prob(parent(u), w)]
        k = rng.choices(range(len(weights)), weights)[0]
        whole[u] += 1
        if k == len(sizes):
            sizes.append(1)
            tables[u] += 1
            seat(parent(u), w)
        else:
            sizes[k] += 1

    def unseat(u, w):
        if u is None:
            return
        sizes = rooms[u][w]
        k = rng.choices(range(len(sizes)), sizes)[0]
        whole[u] -= 1
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            tables[u] -= 1
            unseat(parent(u), w)

    def places(t):
        w = ["<", "<", *tokens(t)]
        return [(("2", w[i - 2], w[i - 1]), w[i]) for i in range(2, len(w))]

    mine = [p for t, on in zip(texts, learns) if on for p in places(t)]
    for u, w in mine:
        seat(u, w)
    sums = [[0.0] * len(places(t)) for t in texts]
    for k in range(burn_in + samples):
        for u, w in mine:
            unseat(u, w)
            seat(u, w)
        if k >= burn_in:
            for own, t in zip(sums, texts):
                for i, (u, w) in enumerate(places(t)):
                    own[i] += prob(u, w) / samples
    return [sum(map(math.log10, own)) for own in sums]


def test_agrees_with_customers_seated_one_by_one(spark):
    texts = corpus(60)
    learns = [i % 5 != 1 for i in range(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(pitman_yor.score_texts(df, F.col("doc_id") % 5 != 1, burn_in=2, samples=4).collect(), key=lambda r: r.doc_id)
    plain = plain_sampler(texts, learns)
    for held_out in (False, True):
        mine = sum(r.score for r in rows if r.held_out == held_out) / sum(r.n_tokens for r in rows if r.held_out == held_out)
        theirs = sum(s for s, r in zip(plain, rows, strict=True) if r.held_out == held_out) / sum(r.n_tokens for r in rows if r.held_out == held_out)
        assert abs(mine - theirs) < 0.02, (held_out, mine, theirs)
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in rows)


def test_no_training_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = pitman_yor.score_texts(df, F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert all(np.isfinite(r.score) for r in rows)
    assert pitman_yor.score_texts(df.limit(0), F.lit(True)).count() == 0


