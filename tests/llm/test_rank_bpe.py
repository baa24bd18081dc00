import hashlib
import random

import public_tokenizers
import pytest

from thermalis.llm import queries, rank_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return rank_bpe.codec(PATH, PATTERN).library


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_query_agrees_with_the_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op13_rank_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


def test_cut_texts_agree_with_whole_ones(library):
    rng, codec = random.Random(5), rank_bpe.Codec(PATH, PATTERN, long=12)
    pieces = ["a", "Z", "'s", "'", "'ll", "7", "42", " ", "  ", "\n", "\t", "\r\n", "\xa0", "　", " ", "​", "\x1c", "\x85", "\xe9", "语", "\U0001f642", "́", ".", "!?", " " * 30, "\n" * 25, "word" * 9, "<|endoftext|>"]
    cut = 0
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()
        assert "".join(p for p, _ in codec.parts(text)) == text
        cut += sum(1 for _ in codec.parts(text)) > 1
    assert cut > 1000


def test_very_long_runs(library):
    codec = rank_bpe.codec(PATH, PATTERN)
    for text in ("a" * 200_000, " " * 1_500_000, "x" + "\n" * 1_200_000 + "b", "^" * 200_000, "no end " * 40_000, "\u3000" * 900_000 + " c"):
        ids = codec.encode(text)
        assert codec.decode(ids) == text.encode()
        if len(text) <= 300_000:
            assert ids == library.encode_ordinary(text)


def test_unknown_patterns_are_never_cut():
    assert rank_bpe.cuts_before_space(PATTERN)
    assert not rank_bpe.cuts_before_space(PATTERN + r"|\w+ \w+")
    c = rank_bpe.Codec(PATH, r"\w+ \w+|\s|[^\s]", long=4)
    assert [p for p in c.parts("ab cd ef gh")] == [("ab cd ef gh", False)]


def test_incomplete_rank_file(tmp_path):
    (tmp_path / "few.tiktoken").write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError):
        rank_bpe.load_ranks(str(tmp_path / "few.tiktoken"))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x", 3), (1, "", "y", 4), (None, "a b", "z", 5), (2, "a b", None, 6), (2, "a b", None, 6)], "doc_id long, text string, ids string, n_tokens int")
    got = rank_bpe.encode_decode(docs, PATH, PATTERN)
    assert sorted((r.doc_id or 0, len(r.ids), bytes(r.decoded)) for r in got.collect()) == [(0, 2, b"a b"), (1, 0, b""), (1, 0, b""), (2, 2, b"a b"), (2, 2, b"a b")]
    again = rank_bpe.decode(got, PATH, PATTERN)
    assert sorted(bytes(r.decoded) for r in again.collect()) == [b"", b"", b"a b", b"a b", b"a b"]
    assert {r.ids_sha256 for r in rank_bpe.digests(got).where("n_tokens = 0").collect()} == {sha(b"")}
    assert rank_bpe.digests(rank_bpe.encode_decode(docs.limit(0), PATH, PATTERN)).collect() == []
