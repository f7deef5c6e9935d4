import itertools
import random

import numpy as np
import pytest
import xxhash

from shelfspark.llm import simhash
from shelfspark.llm.components import components


def plain_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(values, linked):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(values)), 2):
        if linked(values[i], values[j]):
            root[find(j)] = find(i)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "A b c D e", "É é Ü", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == plain_fingerprint(text, 4)


@pytest.mark.parametrize("radius, parts", [(2, 1), (4, 1), (9, 2)])
def test_every_pair_within_the_radius_collides(radius, parts):
    rng = random.Random(radius)
    masks = simhash.covering_masks(radius, parts, 1)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(flips & m == 0 for m in masks)
    assert all(0 < m.bit_count() < 64 for m in masks)


def documents(n=150):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4) for _ in range(rng.randint(1, 200))] for _ in range(20)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(["new", "word"])
        rows.append((i, " ".join(w)))
    return rows + [(900, ""), (901, None), (902, " \n"), (903, rows[0][1]), (903, rows[0][1])]


@pytest.mark.parametrize("split_above", [2048, 2])
def test_components_like_brute_force(spark, monkeypatch, split_above):
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", split_above)
    rows = documents()
    found = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [plain_fingerprint(t, 4) for _, t in rows]
    roots = plain_roots(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {}
    for (i, _), r in zip(rows, roots):
        smallest[r] = min(smallest.get(r, i), i)
    expected = sorted((i, p, smallest[r]) for (i, _), p, r in zip(rows, prints, roots))
    assert sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found) == expected


def test_keep_one(spark):
    rows = [(5, "a b c d e f g", "x", 1), (3, "A b c d e f g", "y", 2), (3, "A b c d e f g", "y", 2), (8, "other words stand in this text", "z", 3),
            (None, "quite another text is here now", None, 4), (None, "and one more text that is different", None, 5), (None, "a b c d e f g", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, row int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.row) for r in kept.collect()) == [(0, 4), (0, 5), (3, 2), (8, 3)]
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_keep_one_keeps_the_smallest_of_each_component(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = {r.component_id for r in simhash.near_components(docs).collect()}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(names)


def test_graph_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 1)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for a, b in links if None not in (a, b) and a != b for x in (a, b)})
    pairs = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    roots = plain_roots(nodes, lambda a, b: (a, b) in pairs)
    lowest = {}
    for n, r in zip(nodes, roots):
        lowest[r] = min(lowest.get(r, n), n)
    assert found == {n: lowest[r] for n, r in zip(nodes, roots)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_trees_span(spark):
    values = np.array([0, 1, 3, 7, 1 << 40, (1 << 40) | 1, 1 << 50 | 255], np.int64)
    df = spark.createDataFrame([([int(v) for v in values],)], "fps array<long>")
    links = [tuple(r) for r in df.mapInArrow(simhash._trees(1), "a long, b long").collect()]
    assert len(links) == 5 and all((a ^ b).bit_count() == 1 for a, b in links)
    assert len({x for pair in links for x in pair}) == 6
