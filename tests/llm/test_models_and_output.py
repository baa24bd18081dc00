"""op4, op7 and op9: held-out accuracy, round trips and brute force."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thermalis.llm import decontaminate, queries, token_shards, toxicity, words


def test_word_hashes_follow_words():
    texts = ["A b  c\n", None, "", "  a\x0bB\x0c", "é É a", "c", "x" * 5000 + " y"]
    h, o = words.words(pa.array(texts))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    expected = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for t in texts]
    assert np.diff(o).tolist() == [len(e) for e in expected]
    flat = [w for e in expected for w in e]
    seen = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    s, rows = words.shingles(h, o, 2)
    assert np.bincount(rows, minlength=len(texts)).tolist() == [2, 0, 0, 1, 2, 1, 1]


def toxic_corpus(n=600):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts, labels = [], []
    for _ in range(n):
        sentences = [" ".join(rng.choices(vocabulary, k=8)).capitalize() for _ in range(rng.randint(1, 9))]
        bad = rng.random() < 0.3
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["vilezu", "vilemo", "grub"])
        texts.append(". ".join(sentences) + ".")
        labels.append(int(bad))
    return texts, labels


def test_toxicity_held_out_and_located(spark):
    texts, labels = toxic_corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(9000, None, 0.1), (9001, "", 0.1), (9001, "", 0.1), (9002, "ok fine. " * 20000, 0.1)], "doc_id long, text string, score double")
    known = spark.createDataFrame([(i, y, "x") for i, y in enumerate(labels) if i % 5] + [(1, None, "y")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, known)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(texts) + 4
    held = [(r.score >= 0.5, labels[r.doc_id]) for r in got if r.doc_id % 5 == 0 and r.doc_id < 9000]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(r.score == 0 for r in got if r.doc_id in (9000, 9001))
    found = toxicity.locate_sentences(docs, model).collect()
    assert sum("vile" in r.sentence_text or "grub" in r.sentence_text for r in found) > 0.95 * len(found) > 100
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, known.limit(0))).collect()} == {0.0}


def test_a_long_labelled_text_costs_only_itself(spark):
    texts, labels = toxic_corpus(60)
    rows = [(i, t) for i, t in enumerate(texts)]
    first = spark.range(1000, 1400).selectExpr("id").orderBy(F.xxhash64("id")).first().id
    assert spark.range(1).selectExpr(f"xxhash64({first}L) < (select min(xxhash64(id)) from range(60)) as least").first().least
    docs = spark.createDataFrame([*rows, (first, "long text. " * 20000)], "doc_id long, text string")
    known = spark.createDataFrame([*enumerate(labels), (first, 0)], "doc_id long, toxic int")
    without = toxicity.train(docs, known.where(F.col("doc_id") != first), min_docs=2, min_z=1.0)
    assert len(without) > 1 and toxicity.train(docs, known, max_bytes=200_000, min_docs=2, min_z=1.0) == without


def test_shards_round_trip(spark, tmp_path):
    texts = ["the cat", None, "", " a  b\n\n c ", "x" * 400, "word " * 900, "é漢 don't\x1cgo  now"] + ["the cat"] * 30
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, slot string").repartition(3)
    out = f"file://{tmp_path}/shards"
    rows = sorted(token_shards.write_shards(df, out, path, pattern, 50256, 7, length=16, per_shard=9).collect())
    encode = token_shards.WordTokens(path, pattern, 50256)
    assert [r.slot for r in rows] == list(range(len(rows)))
    back = list(token_shards.read_sequences(out))
    assert len(back) == len(rows)
    import hashlib

    for r, ids in zip(rows, back, strict=True):
        assert hashlib.sha256(ids.tobytes()).hexdigest() == r.sha256
        assert r.shard == r.slot // 9 and r.byte_offset == r.slot % 9 * 32
    tokens = {i: encode.ordinary(t or "") for i, t in enumerate(texts)}
    assert sum(r.n_tokens for r in rows) == sum(len(v) + 1 for v in tokens.values())
    inverse = {int(s): k for k, s in enumerate(token_shards.permute(np.arange(len(rows)), len(rows), 7))}
    stream = [int(x) for slot in sorted(inverse, key=inverse.get) for x in back[slot][: rows[slot].n_tokens]]
    docs, now = [], []
    for x in stream:
        if x == 50256:
            docs.append(tuple(now))
            now = []
        else:
            now.append(x)
    assert sorted(docs) == sorted(tuple(v) for v in tokens.values())
    assert {d for r in rows for d in r.doc_ids} == set(tokens)
    assert [x.tolist() for x in token_shards.read_sequences(out, 11, 5)] == [x.tolist() for x in back[11:16]]
    assert token_shards.write_shards(df.limit(0), f"file://{tmp_path}/none", path, pattern, 50256, 7).count() == 0


def test_shards_several_a_partition_nulls_and_repeats(spark, tmp_path, monkeypatch):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    monkeypatch.setattr(token_shards, "MOST_PARTS", 2)
    df = spark.createDataFrame([(None, "the cat"), (4, "a dog"), (4, "a dog"), (5, "long text " * 9000), (None, None)], "doc_id long, text string")
    out = f"file://{tmp_path}/shards"
    rows = sorted(token_shards.write_shards(df, out, path, pattern, 50256, 7, length=8, per_shard=50).collect(), key=lambda r: r.slot)
    back = list(token_shards.read_sequences(out))
    assert [r.slot for r in rows] == list(range(len(back))) and rows[-1].shard > 4
    tokens = [x for r, ids in zip(rows, back, strict=True) for x in ids[: r.n_tokens].tolist()]
    encode = token_shards.WordTokens(path, pattern, 50256).ordinary
    assert len(tokens) == sum(len(encode(t or "")) + 1 for (_, t) in df.collect())
    assert {d for r in rows for d in r.doc_ids} == {None, 4, 5}


def test_a_failed_run_leaves_no_manifest(spark, tmp_path):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 299, F.lit("some text ")).otherwise(F.raise_error(F.lit("lost"))).alias("text"))
    with pytest.raises(Exception, match="lost"):
        token_shards.write_shards(df, f"file://{tmp_path}/shards", path, pattern, 50256, 7, length=8, per_shard=5)
    assert not (tmp_path / "shards" / "manifest.json").exists()
    token_shards.write_shards(df.where("doc_id < 299"), f"file://{tmp_path}/shards", path, pattern, 50256, 7, length=8, per_shard=5)
    assert (tmp_path / "shards" / "manifest.json").exists()


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000, 4097):
        slots = token_shards.permute(np.arange(n), n, 99)
        assert sorted(slots.tolist()) == list(range(n))
    assert token_shards.permute(np.arange(1000), 1000, 1).tolist() != token_shards.permute(np.arange(1000), 1000, 2).tolist()


def test_word_tokens_equal_the_library():
    encode = token_shards.WordTokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    rng = random.Random(6)
    for _ in range(4000):
        t = "".join(rng.choice("ab  \n\té's1! \x1c漢") for _ in range(rng.randint(0, 15)))
        assert encode.encode(t) == np.array([*encode.ordinary(t), 50256], "<u2").tobytes(), repr(t)


def brute_matches(doc, items, n=5, threshold=0.8):
    """Best weighted Jaccard of every item-sized window."""
    from collections import Counter

    def bag(w):
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    out = set()
    d = doc.lower().split()
    for k, item in enumerate(items):
        w = item.lower().split()
        if len(w) < n:
            if w and any(d[a : a + len(w)] == w for a in range(len(d) - len(w) + 1)):
                out.add(k)
            continue
        size = min(len(w), len(d))
        for a in range(len(d) - size + 1):
            x, y = bag(d[a : a + size]), bag(w)
            both = sum((x & y).values())
            if x and both and both / sum((x | y).values()) >= threshold:
                out.add(k)
                break
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdef", k=3)) for _ in range(60)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 40))) for _ in range(25)] + ["ab cd", "", None, "ab cd", "x " * 30, "one two three FOUR", "lonely"]
    docs = []
    for _ in range(150):
        body = rng.choices(vocabulary, k=rng.randint(0, 120))
        if rng.random() < 0.6:
            leak = rng.choice(items[:25]).upper().split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                leak.insert(rng.randrange(len(leak)), "new")
            k = rng.randint(0, len(body))
            body[k:k] = leak
        docs.append("\n".join(body))
    docs += [None, "", "ab cd", "AB  cd", "ab cd e", "x " * 29, "w " * 20000, "zero one two three four five six seven", "one two three", "lonely " * 50, "ab", "cd", "w lonely"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, k) for i, t in enumerate(docs) for k in brute_matches(t or "", [x or "" for x in items])}
    assert len(want) > 30
    for part_bytes in (1 << 24, 400):
        rows = decontaminate.find_contamination(df, bench, part_bytes=part_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
        place = {(r.doc_id, r.item_id): (r.first_word, r.n_words) for r in rows}
        assert place[len(docs) - 6, len(items) - 2] == (1, 4) and place[len(docs) - 1, len(items) - 1] == (1, 1)
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(df, bench.limit(0)).count() == 0


def test_swapped_and_moved_passages_equal_brute_force(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 90))) for _ in range(20)]
    docs = []
    for k in range(40):
        w = items[k % 20].split()
        cut = rng.randint(1, len(w) - 1) if k % 3 else len(w) // 2
        w = w[cut:] + w[:cut]
        if k % 4 == 3:
            w[cut // 2] = "new"
        docs.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)) + w + rng.choices(vocabulary, k=rng.randint(0, 30))))
    want = {(i, k) for i, t in enumerate(docs) for k in brute_matches(t, items)}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = decontaminate.find_contamination(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 10


def test_window_prints_are_simhashes():
    found = np.random.default_rng(4).integers(0, 1 << 63, 300, dtype=np.uint64)
    found[50:90] = found[50]
    at = np.array([0, 1, 7, 48, 60, 200, 280])
    for span in (5, 1 << 13):
        want = [decontaminate.simhash(*np.unique(found[a : a + 20], return_counts=True)).tolist() for a in at]
        got = np.stack([decontaminate.window_prints(own, at, 20, span) for own in decontaminate.both(found)], axis=1)
        assert got.tolist() == want


def test_blocks_let_all_within_the_radius_through():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    for _ in range(60):
        q = prints[rng.integers(300)].copy()
        for bit in rng.choice(128, rng.integers(0, 50), replace=False):
            q[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        want = [int(p[0] ^ q[0]).bit_count() + int(p[1] ^ q[1]).bit_count() <= 40 for p in prints]
        assert decontaminate.within(prints, q, 40).tolist() == want


def test_few_unrelated_fingerprints_pass_a_block():
    prints = np.random.default_rng(2).integers(0, 1 << 64, (4000, 2), dtype=np.uint64)
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :400])
    assert (apart.min(axis=2) <= 20).mean() < 0.006  # of these, and of itself


def test_contaminated_rows_go_in_place(spark):
    leak = " ".join("q%d" % k for k in range(30))
    docs = [(1, "a b c " + leak, "x"), (None, leak + " tail", "y"), (2, "clean words only here and there", "z"), (2, "p " + leak, "w"), (None, None, "v"), (3, "", "u")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, leak, 1), (8, None, 2), (9, "", 3)], "item_id long, text string, doc_id int")
    kept = decontaminate.without_contaminated(df, items)
    assert kept.columns == df.columns and {r.item_id for r in kept.collect()} == {"z", "v", "u"}
    assert decontaminate.without_contaminated(df, items.limit(0)).count() == 6 and decontaminate.without_contaminated(df.limit(0), items).count() == 0


def test_noisy_or_against_plain_python(spark):
    """A given model's scores, counts and worst sentences, by a plain reading of the definition."""
    import math
    import re
    import string

    texts = ["Bad grub here. all fine! really vile? yes", "", None, "nothing\nat all", "grub grub grub", ". . .", "vilezu " * 500, "Fine. GRUB, (grub)! vile"]
    weights = {"grub": 3.5, "vile": 2.0, "fine": -1.0, "vilez": 1.5}
    bias = -2.0
    long_words = {w: k for w in weights for k in [len(w)]}
    raw, offsets = words.text_bytes(pa.array(list(weights)))
    starts, ends = words.word_spans(raw, offsets)
    model = {toxicity.BIAS: bias} | dict(zip(words.hash_words(raw, starts, ends).view(np.int64).tolist(), weights.values(), strict=True))
    stems = {}
    for n in toxicity.STEMS:
        longer = pa.array([w + "zz" for w in weights if long_words[w] == n])
        if len(longer):
            raw, offsets = words.text_bytes(longer)
            starts, ends = words.word_spans(raw, offsets)
            for x, w in zip(words.hash_prefixes(raw, starts, ends, n)[0].view(np.int64).tolist(), [w for w in weights if long_words[w] == n], strict=True):
                stems[x] = weights[w]
    model |= stems

    def plain(text):
        p = []
        for sentence in re.split(r"[.!?\n]", text or ""):
            found = [w for w in re.split("[" + re.escape(string.punctuation) + r"\s]+", sentence.lower()) if w]
            if found:
                features = set(found) | {("stem", w[:n]) for w in found for n in toxicity.STEMS if len(w) > n}
                score = bias + sum(weights.get(f, 0.0) if isinstance(f, str) else weights.get(f[1], 0.0) if len(f[1]) in toxicity.STEMS else 0.0 for f in features)
                p.append(1 / (1 + math.exp(-score)))
        worst = max(range(len(p)), key=lambda k: (p[k], -k)) if p else None
        return 1 - math.prod(1 - x for x in p), sum(x >= 0.5 for x in p), worst, p[worst] if p else 0.0

    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "grub", 1)], "doc_id long, text string, score int")
    for r in toxicity.score(df, model).collect():
        score, n, worst, most = plain("grub" if r.doc_id is None else texts[r.doc_id])
        assert (r.offensive_sentences, r.worst_sentence) == (n, worst), r
        assert math.isclose(r.score, score, abs_tol=1e-9) and math.isclose(r.worst_probability, most, abs_tol=1e-9)


def test_leaks_in_the_sample_are_found(spark, sf):
    assert queries.op9_decontamination(spark, sf).count() > 0


def test_repeated_passages_against_alike_items(spark):
    rng = random.Random(31)
    base = [f"w{rng.randint(0, 25)}" for _ in range(24)]
    items = []
    for _ in range(12):
        item = list(base)
        item[rng.choice([0, 1, 22, 23, 12])] = f"z{rng.randint(0, 9)}"
        items.append(" ".join(item))
    docs = [" ".join(base * 40), " ".join((base[:10] + ["a", "a", "a", "a", "a", "a"]) * 20), " ".join(["a"] * 300), " ".join(base[::-1] * 3)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate([*items, "a " * 12])), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(df, bench).collect()}
    assert got == {(i, k) for i, t in enumerate(docs) for k in brute_matches(t, [*items, "a " * 12])} and len(got) > 5
