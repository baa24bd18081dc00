"""op2, op3, op6 and op8 against the libraries, brute force and round trips."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thermalis.llm import bpe_codec, chat_format, queries, token_counts, url_filter

ALPHABET = "ab  \n\n\t\r▁éñ<s></s><|endoftext|>'s't 0123ßİ漢字́\x85\xa0\x0c\x0b\x1c the and |\\<|"
EDGE = [None, "", " ", "\n", "  \n \n", "a", "a  b", "<|endoftext|>", "<s>x</s>", "x" * 9000, "word " * 6000, "ééé " * 3000, "\u0301a \u0301", "a\x00b"]


def noise(n, size=40, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


def documents(spark, texts):
    """Rows with a repeated id and extra columns whose names the operators use too."""
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(0, texts[0], 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, id string")


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.counter(path).proven
    texts = EDGE + noise(3000)
    got = sorted(token_counts.count_tokens(documents(spark, texts), path).collect())
    want = sorted((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in [*enumerate(texts), (0, texts[0])])
    assert [tuple(r) for r in got] == want
    assert token_counts.count_tokens(documents(spark, texts).limit(0), path).count() == 0


def test_a_small_table_of_segments_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    c = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    texts = noise(200, seed=9)
    assert sum((c.count(texts[i : i + 7]) for i in range(0, 200, 7)), []) == [len(x) for x in c.model.encode(texts)]


def test_codec_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = EDGE + noise(1500) + noise(40, 9000, seed=5)
    got = bpe_codec.digests(bpe_codec.encode_decode(documents(spark, texts), path)).collect()
    assert len(got) == len(texts) + 1
    import numpy as np

    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_codec.encode_decode(documents(spark, texts).limit(0), path).count() == 0


def test_codec_bounds_and_cuts_inside_words(monkeypatch):
    monkeypatch.setattr(bpe_codec, "WORDS_KEPT", 5)
    monkeypatch.setattr(bpe_codec, "CHUNK_BYTES_KEPT", 2000)
    c = bpe_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(bpe_codec.cut_points, "__defaults__", (8,))
    texts = noise(120, 600, seed=11) + ["abcdefghij" * 50 + " it's" * 40]
    ids, shown = c.encode(texts)
    assert sum(j for t in texts for *_, j in c.parts(t)[1]) > 50
    assert list(zip(ids, shown, strict=True)) == c.library(texts)


def test_chunks_of_shared_passages_are_encoded_once():
    c = bpe_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    passage = " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(8000))
    c.encode(["start " + passage, "another beginning " + passage])
    cores = [raw[a:b] for t in ("start " + passage, "another beginning " + passage) for raw, spans in [c.parts(t)] for a, b, j in spans if not j]
    assert len(set(cores)) < 0.7 * len(cores)


def brute_rule(host, path, rules):
    fits = [(len(r), len(r.partition("/")[0]), v == "block", r, v) for v, r in rules for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])] if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


URLS = [None, "", "no scheme", "http://", "http://Example.COM/en/7?x#y", "https://a.example.com/en/71", "https://notexample.com/en/7", "x://com/en/", "x://example.net/de/8#", "x://org", "x://.com/en/", "x://a..net/de/", "a://b://c/d", "x://www.example.net:80/de/8", "x://b.org/es/\nq", "x://a\x01b.com/en/", "x://\x01x.example.com/en/7", "x://\x01.net/de/", "x://a.\x01com/en/"]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_url_rules_equal_brute_force(spark, bound):
    rng = random.Random(8)
    rules = [*queries.URL_RULES, ("allow", "org/es/"), ("block", "a.org/"), ("block", "\x01x.example.com/en/7"), ("block", "b.com/en/")]
    urls = URLS + [f"http://{'.'.join(rng.choices(['a', 'www', 'example', 'b'], k=rng.randint(0, 3)) + [rng.choice(['com', 'net', 'org'])])}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(0, 90)}" for _ in range(400)] + ["http://hot.example.com/en/7"] * 300 + ["x://\x01x.example.com/en/7", "x://example.com/en/7"] * 40
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    got = url_filter.filter_urls(df, rules, max_broadcast_bytes=bound, ranges=8).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    for r in got:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        n = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        path = rest[n:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
        host = rest[:n].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == brute_rule(host, path, rules), u
    assert url_filter.filter_urls(df.limit(0), rules, max_broadcast_bytes=bound, ranges=8).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("<|im_startend>\\\nab", max_size=30), st.text("<|im_startend>\\\nab ", max_size=40)), max_size=4))
def test_chat_round_trip(turns):
    rendered = [chat_format.render_turn(r, t) for r, t in turns]
    assert [x[:2] for x in chat_format.parse("".join(rendered))] == turns


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "<|im_end|>"), (None, 3, None, "a"), (2, None, "assistant", "<\\|x"), (2, None, "assistant", "<\\|x"), (2, 5, "assistant", "ü<|im_start|>assistant\n")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, None}
    assert got[1].turns_sha256 == sha("user\n<|im_end|>\nassistant\n\n") and got[1].loss_sha256 == sha("") and got[1].loss_chars == 0
    assert got[2].n_turns == 3 and got[2].loss_sha256 == sha("<\\|x<\\|xü<|im_start|>assistant\n")
    assert got[None].turns_sha256 == sha("\na\n")
    assert chat_format.conversation_digests(chat_format.format_turns(df.limit(0))).count() == 0


def test_conversations_are_read_back_whole():
    turns = [("user", "a<|im_end|>\n<|im_start|>x\n"), ("assistant", ""), ("we\nird", "<\\|im_end|>")]
    rendered = [chat_format.render_turn(*t) for t in turns]
    whole, reader, got = "".join(rendered), chat_format.Reader(), []
    for k in range(0, len(whole), 7):  # pieces that end inside marks
        got += reader.feed(whole[k : k + 7])
    reader.close()
    assert [g[:2] for g in got] == turns
    assert [chat_format.unescape_text(whole[a:z]) for _, _, a, z in got] == [t for _, t in turns]
    with pytest.raises(ValueError):
        bad = chat_format.Reader()
        list(bad.feed(whole + "rest"))
        bad.close()


def test_the_mask_decides_what_is_under_loss(spark):
    """A wrong span shows in the digest: what counts is the text it cuts out."""
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "x<|y"), (None, 0, "assistant", None), (2, 0, "assistant", "z" * 200_000)], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_turns(df)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat_format.conversation_digests(formatted).collect()} == {1: (4, sha("x<|y")), None: (0, sha("")), 2: (200_000, sha("z" * 200_000))}
    moved = formatted.withColumn("loss_start", formatted.loss_start + 1)
    assert {r.conv_id: r.loss_sha256 for r in chat_format.conversation_digests(moved).collect()}[1] == sha("<|y")


def test_codec_uses_an_unproven_tokenizer_whole(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        settings_ = json.load(f)
    assert bpe_codec.independent_words(settings_)
    settings_["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+ [\p{L}]+|[\p{L}]+|[^\s\p{L}]+"
    assert not bpe_codec.independent_words(settings_)
    other = tmp_path / "other.json"
    other.write_text(json.dumps(settings_), encoding="utf-8")
    codec, texts = bpe_codec.Codec(str(other)), ["Ab cd ef", "", "x  y\nz", "<|endoftext|> q"]
    assert not codec.proven
    ids, shown = codec.encode(texts)
    assert list(zip(ids, shown, strict=True)) == codec.library(texts)
