import random

import numpy as np
import pytest

from shelfspark.llm import topk


def plain(rows, k, every):
    vectors = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def fixture(n=700, dims=6):
    rng = random.Random(4)
    centres = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.3))) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, rows[40][1]) for i in range(150)]
    return rows + [(5000, None), (5020, [None] * dims), (5040, [float("nan")] * dims), (5060, [float("inf")] * dims), (None, rows[0][1])]


@pytest.mark.parametrize("shard, k", [(64, 20), (4096, 3), (200, 2000)])
def test_like_brute_force(spark, shard, k):
    rows = fixture()
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    vectors = topk.integer_vectors(table)
    queries = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = sorted(tuple(r) for r in topk.top_k(vectors, queries, k, shard).select("query_id", "rank", "vec_id", "score").collect())
    assert found == plain(rows, k, 20)


def test_empty_and_large_components(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k_embeddings(spark.createDataFrame([], kind)).collect() == []
    assert topk.top_k_embeddings(spark.createDataFrame([(0, [1.0, 2.0])], kind)).collect() == []
    rows = [(i, [float(np.float32((-1) ** i * 1e6 * i)), 1.0, float(i)]) for i in range(40)]
    found = sorted(tuple(r) for r in topk.top_k_embeddings(spark.createDataFrame(rows, kind)).select("query_id", "rank", "vec_id", "score").collect())
    assert found == plain(rows, 20, 20)


def test_tree_prunes(monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 50, (20, 8))
    vectors = (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 1, (4000, 8))).astype(np.int64)
    tree = topk.BallTree(vectors, np.arange(4000))
    seen = []
    inner = tree.products
    tree.products = lambda node, q: seen.append(node) or inner(node, q)
    tree.search(vectors[7], tree.bounds(vectors[7:8])[0], 10, topk._LOWEST, 7)
    assert len(seen) < sum(left < 0 for left in tree.left) / 2
