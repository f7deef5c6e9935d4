import random

import numpy as np

from shelfspark.operators import similar

KIND = "vec_id long, embedding array<float>"


def rows(n=1500, dims=8, seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    out = [(i, [float(np.float32(c + rng.gauss(0, 0.4))) for c in rng.choice(centres)]) for i in range(n)]
    return out + [(n + i, out[3][1]) for i in range(5)]


def plain(vectors, k, every):
    ids = np.array([i for i, _ in vectors])
    units = np.array([v for _, v in vectors], np.float64)
    units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
    out = []
    for q in range(0, len(ids)):
        if ids[q] % every:
            continue
        scores = [(-round(float(s), similar.DIGITS), int(i)) for i, s in zip(ids, units @ units[q]) if i != ids[q]]
        out += [(int(ids[q]), r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def frames(spark, block=similar.BLOCK, extra=()):
    vectors = similar.usable_vectors(spark.createDataFrame([*rows(), *extra], KIND))
    return vectors.filter("id % 50 = 0"), similar.build_index(vectors, 16, block=block)


def test_exact_when_all_lists_are_probed(spark):
    bad = [(None, [1.0] * 8), (9000, None), (9050, [0.0] * 8), (9100, [float("nan")] + [1.0] * 7), (9150, [None] + [1.0] * 7)]
    for block in (similar.BLOCK, 37):
        queries, index = frames(spark, block, bad)
        found = sorted(tuple(r) for r in similar.similar(queries, index, 10).collect())
        expected = sorted(plain(rows(), 10, 50))
        assert [r[:3] for r in found] == [r[:3] for r in expected] and np.allclose([r[3] for r in found], [r[3] for r in expected], atol=1e-8)


def test_few_probes_recall(spark):
    queries, index = frames(spark)
    exact = {(q, i) for q, _, i, _ in plain(rows(), 10, 50)}
    found = {(r.query_id, r.id) for r in similar.similar(queries, index, 10, probes=4).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert len(index.sizes) == 16 and index.lists.count() == 1505


def test_empty_and_small(spark):
    vectors = similar.usable_vectors(spark.createDataFrame([], KIND))
    assert similar.similar(vectors, similar.build_index(vectors, 4), 3).collect() == []
    one = similar.usable_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], KIND))
    index = similar.build_index(one, 4)
    assert sorted((r.query_id, r.id, r.score) for r in similar.similar(one, index, 3).collect()) == [(1, 2, 0.0), (2, 1, 0.0)]
    assert similar.similar(one.limit(0), index, 3).collect() == []
