"""The pipeline's stages against brute force on the small sample."""

import corpus_pipeline
import pytest

from thermalis.llm import bpe_codec, toxicity
from thermalis.llm.queries import crc_fold, table


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def made(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, sf)
        docs = spark.createDataFrame(done.collect(), done.schema)
        out.append((name, docs))
    return dict(out)


def test_toxic_documents_go(spark, sf, made):
    documents = table(spark, sf, "documents")
    model = toxicity.train(documents, table(spark, sf, "labels").where(crc_fold() != 0))
    toxic = {r.doc_id for r in toxicity.score(documents, model).where("score >= 0.5").collect()}
    kept = made["toxicity"]
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in documents.select("doc_id").collect()} - toxic and toxic


def test_one_of_each_group_stays(made):
    before = {r.doc_id: shingles(r.text) for r in made["toxicity"].collect()}
    parent = {i: i for i in before}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in before.items():
        for b, y in before.items():
            if a < b and x & y and len(x & y) * 100 >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    assert {r.doc_id for r in made["ngram_jaccard_join"].collect()} == {i for i in before if root(i) == i}


def test_leaks_go_and_the_rest_is_encoded(spark, sf, made):
    items = [shingles(r.text) for r in table(spark, sf, "benchmark").collect()]
    before = {r.doc_id: shingles(r.text) for r in made["ngram_jaccard_join"].collect()}
    after = {r.doc_id for r in made["benchmark_decontamination"].collect()}
    whole = {i for i, s in before.items() if any(x <= s for x in items if x)}
    untouched = {i for i, s in before.items() if not any(x & s for x in items)}
    assert untouched <= after and not whole & after
    last = made["bpe_codec"]
    assert {r.doc_id for r in last.collect()} == after
    import public_tokenizers

    again = bpe_codec.digests(bpe_codec.encode_decode(made["benchmark_decontamination"], public_tokenizers.path("word_bpe_49k.json")))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, last.collect()))


def test_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_edge_cases_pass_every_stage(spark, sf, tmp_path):
    """Null ids and texts, very long and repeated rows, ties, a clashing column, and no labels or benchmark."""
    long = " ".join("w%d" % (k % 900) for k in range(60_000))
    copy = " ".join("c%d" % k for k in range(40))
    rows = [(1, None, "a"), (None, "one two three", "b"), (None, None, "c"), (2, long, "d"), (3, copy, "e"), (4, copy, "f"), (4, copy, "g"), (5, "", "h"), (6, "x", "i"), (7, "x", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "item_id"]
    kept = docs.collect()
    assert sorted(r.item_id for r in kept) == ["a", "b", "c", "d", "e", "h", "i"]
    done = corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame(kept, docs.schema), str(tmp_path))
    assert done.count() == 7 and done.where("n_tokens = 0").count() == 3
