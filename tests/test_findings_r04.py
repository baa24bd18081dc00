"""Findings of round 4."""

import random

from pyspark.sql import functions as F

from thermalis.operators import text_pipeline as tp
from thermalis.plans import text_queries


def greedy(rows, threshold=0.85):
    """{row: representative} of (row, normal form), all rows of a block compared one by one."""
    blocks, out = {}, {}
    for row, t in sorted(rows):
        w = t.split()
        blocks.setdefault((" ".join(w[:4]), len(w) // 5, len(t) // 20), []).append((row, {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    for block in blocks.values():
        reps = []
        for row, own in block:
            by = next((r for r, o in reps if (not own and not o) or len(own & o) / len(own | o) >= threshold), None)
            if by is None:
                reps.append((row, own))
            else:
                out[row] = by
    return out


def chains(many, seed):
    """Texts of one block: chains in which each differs from the one before by a word, and copies."""
    rng, texts = random.Random(seed), []
    while len(texts) < many:
        words = [f"w{rng.randint(10, 99)}" for _ in range(80)]
        for _ in range(rng.randint(1, 5)):
            texts += [" ".join(["same", "first", "four", "words", *words])] * rng.choice((1, 1, 2))
            words[rng.randint(0, 79)] = f"w{rng.randint(10, 99)}"
    rng.shuffle(texts)
    return texts


def test_greedy_query_compares_every_row_of_a_block(spark, tmp_path, sf):
    """rows past the 200th of a block were left out."""
    texts = [f"same first four words then comes {chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(210)] + ["same first four words then comes ab"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).unionByName(docs, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.row_index: r.near_duplicate_of for r in text_queries.near_dup_greedy(spark, str(tmp_path)).collect()}
    assert got == greedy(list(enumerate(texts))) == dict.fromkeys(range(210, 230), 1)


def test_greedy_in_rounds_is_greedy_row_by_row(spark):
    """blocks beyond what a task compares at a time give the same representatives."""
    texts = chains(300, 3) + ["", "", "a b", "a b", "c d"]
    expected = greedy(list(enumerate(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "row_index long, norm string")
    rows = rows.withColumn("block", tp._block(F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.split("norm", " "))))
    for leads, size in ((2048, 4 << 20), (37, 4 << 20), (2048, 8000)):
        got = {r.row_index: r.near_duplicate_of for r in tp._greedy_whole(rows, 0.85, leads, size).collect()}
        assert got == expected and len(got) > 100
