"""Findings of round 4 on the operators for training data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalis.llm import pitman_yor, vector_dedup


def brute(x, threshold=0.95):
    """(links, least row reachable) of each row."""
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    on = u @ u.T >= threshold
    least = np.arange(len(x))
    while (now := np.where(on, least[None, :], len(x)).min(axis=1)).tolist() != least.tolist():
        least = now
    return on.sum(axis=1) - 1, least


@pytest.mark.parametrize("kind", ["float", "double"])
def test_no_round_sends_a_vector_more_than_twice(spark, monkeypatch, kind):
    """every pair of tiles had both its bodies sent at once, so the bytes on disk grew with the square of the vectors."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 40))
    x[400:] = x[rng.integers(0, 400, 200)] + rng.normal(size=(200, 40)) * rng.choice([0.05, 0.25, 0.33], (200, 1))
    x = x.astype(np.float32) if kind == "float" else x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    sent, frame = [], type(df)
    deal = frame.repartition

    def counted(self, *to):
        held = [c for c in self.columns if c.endswith("body")]
        if held:
            sent.append(self.agg(F.sum(sum(F.length(c) for c in held))).first()[0])
        return deal(self, *to)

    monkeypatch.setattr(frame, "repartition", counted)
    monkeypatch.setattr(vector_dedup, "SENT_BYTES", 1, raising=False)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df, tile=32).collect()}
    links, least = brute(x)
    assert links.sum() > 200
    assert [got[i].n_links for i in range(600)] == links.tolist()
    assert [got[i].component_id for i in range(600)] == least.tolist()
    assert len(sent) > 1 and max(sent) <= 2 * x.nbytes


def test_places_are_those_of_a_plain_search():
    rng = np.random.default_rng(2)
    hit = np.ones(5008, bool)
    for n, m in ((1, 1), (7, 13), (50, 100)):
        for share in (0, 0.01, 0.9):
            reach = rng.random((n, m)).astype(np.float32)
            at = vector_dedup._places(reach, np.float32(1 - share), hit)
            assert at.tolist() == np.flatnonzero(reach.ravel() >= np.float32(1 - share)).tolist()


def test_bundles_ask_few_parts(spark, monkeypatch):
    """there were two to four parts for each bundle, and each bundle sent a body to each part."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 3000, 400))) for i in range(60)], "doc_id long, text string")
    counts, save = [], pitman_yor.Scratch.save

    def counted(self, table, *more, **options):
        out = save(self, table, *more, **options)
        if "kind" in out.columns:
            counts.append(out.where(f"kind < {pitman_yor.STATISTICS}").count())
        return out

    monkeypatch.setattr(pitman_yor.Scratch, "save", counted)
    assert pitman_yor.score_texts(df, F.lit(True), bundles=40, samples=1, burn_in=0).count() == 60
    assert 40 * 10 < max(counts) <= 40 * 64
    assert [pitman_yor.bits_of_parts(b) for b in (1, 2, 9, 40, 375, 7500)] == [1, 2, 5, 6, 6, 10]


def test_bodies_give_back_what_they_were_made_of():
    rng = np.random.default_rng(1)
    for arrays in ({}, {"a": np.zeros(0, np.uint64), "b": np.array([True, False]), "c": rng.integers(0, 1 << 60, 999).astype(np.uint64), "d": rng.random(7), "e": np.array([-3, 4], np.int32)}, {"large": rng.integers(0, 1 << 40, 1 << 15).astype(np.uint64), "b": np.array([True])}, {f"a_long_name_of_{i}": pitman_yor.fit(rng.integers(0, 300, i)) for i in range(300)}):
        got = pitman_yor.from_body(pitman_yor.to_body(**arrays))
        assert set(got) == set(arrays) and all(np.array_equal(got[k], v) for k, v in arrays.items())
