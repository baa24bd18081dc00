import hashlib

import numpy as np
import pytest

from thermalis.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds with Python integers, every part against every entry; sorted (id, code, error, label error) and the books' digest."""
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[int(np.floor(4096 * x)) for x in r[1]] for r in kept]
    width = len(vectors[0]) // parts if vectors else 0
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in vectors[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for v in vectors]
        for p in range(parts) if r < rounds else ():
            for e in range(len(books[p])):
                own = [cut(v, p) for v, c in zip(vectors, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)) for v, c in zip(vectors, codes, strict=True)] if vectors else []
    labels = {}
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((r[0] if r[0] is not None else -1, "".join(f"{x:02x}" for x in c), e, labels[r[2]], digest) for r, c, e in zip(kept, codes, errors, strict=True))


def got(df, **kw):
    out = vector_codes.with_label_errors(vector_codes.compress(df, **kw))
    return sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out.collect())


def test_query(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    out = queries.op12_vector_codes(spark, sf).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out) == plain(rows)


@pytest.mark.parametrize("seed", range(4))
def test_ties_and_clusters(spark, seed):
    rng = np.random.default_rng(seed)
    # few distinct values: equal distances, equal entries, entries that nothing uses
    values = rng.integers(-2, 3, (240, 16)) / (4096 if seed % 2 else 3) if seed < 3 else rng.normal(size=(240, 16)) + 5 * rng.integers(0, 4, (240, 1))
    rows = [(i, list(map(float, v)), int(i % 3) if i % 4 else None) for i, v in enumerate(values)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(1 + 2 * seed)) == plain(rows)


def test_few_parts_are_compared_again(spark, sf):
    codes = vector_codes.compress(queries.table(spark, sf, "embeddings"))
    n = queries.table(spark, sf, "embeddings").count() * vector_codes.PARTS
    assert codes.compared[0] == n and max(codes.compared[1:]) < n


def test_a_popped_part_is_the_only_one_compared():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-9, 10, (50, 8)), rng.integers(-9, 10, (50, 8)) + 4000])
    books = np.stack([np.stack([np.full(1, 0), np.full(1, 4000)])] * 8)
    block, _ = vector_codes.Block.first(vectors, books)
    still = np.zeros((8, 2), np.int64)
    change, popped = block.again(books, still)
    assert popped == 0 and not change.any()
    moved = books.copy()
    moved[:, 0] = 3995
    change, popped = block.again(moved, vector_codes._drifted(books, moved))
    assert 0 < popped
    assert (block.codes == [vector_codes.nearest(block.part(p), moved[p])[0] for p in range(8)]).all()


def test_edges(spark):
    base = [[0.5, -0.25, 1.0, 0.0, 2.0, -1.0, 0.125, 3.0], [0.1] * 8, [-0.7] * 8]
    rows = [(1, base[0], 1), (1, base[0], 1), (2, base[1], None), (3, base[2], None), (None, base[1], 2), (5, None, 1), (6, [], 1), (7, [float("nan")] * 8, 1), (8, [float("inf")] + [0.0] * 7, 1), (9, [None] + [0.0] * 7, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({c: df["label"] for c in ("id", "v", "code", "error", "change")})
    assert got(clash) == plain(rows)
    # other lengths cannot be cut like the first
    assert got(spark.createDataFrame([*rows, (11, [1.0] * 16, 1), (12, [1.0] * 5, 1)], SCHEMA)) == plain(rows)
    for none in (df.limit(0), df.where("vec_id = 5")):
        assert got(none) == []
    many = [(i, base[i % 3], None) for i in range(60)]
    assert got(spark.createDataFrame(many, SCHEMA)) == plain(many)


def test_components_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        got(df)
