import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import toxicity


def rows(n=400, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["grumbok", "zarnit", "Vexolt"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(1 + len(w) // 20):
                w.insert(rng.randint(0, len(w)), rng.choice(bad) + rng.choice(["", "s", "ing"]))
        docs.append((i, " ".join(w)))
        if rng.random() < 0.8:
            labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_columns(spark):
    docs, labels = rows()
    extra = docs + [(1000, None), (1001, ""), (1002, "grumbok " * 30_000), (None, "zarnit zarnit"), (5, docs[5][1])]
    d = spark.createDataFrame([(i, t, 9.0) for i, t in extra], "doc_id long, text string, score double")
    ls = spark.createDataFrame(labels + [(None, 1), (7, None), (docs[0][0], 0)], "doc_id long, toxic int")
    found = toxicity.score_documents(d, ls).collect()
    assert len(found) == len(extra)
    truth = dict(labels)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.doc_id in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in found}
    assert by[1000].score == by[1001].score < 0.5 < by[1002].score and by[None].score > 0.5
    examples = {e.doc_id for r in found for e in r.evidence}
    assert examples and all(zlib.crc32(str(i).encode()) % 5 for i in examples)
    one = [r.score for r in found if r.doc_id == 5]
    assert one[0] == one[1]


def test_nearest_is_exact():
    """Branch and bound against all cosines, ties included."""
    rng = np.random.default_rng(2)
    terms, n = 40, 150
    idf = rng.uniform(1, 4, terms)

    class Row:
        def __init__(self, i):
            self.doc_id, self.toxic = i, int(i % 3 == 0)
            self.terms = sorted(rng.choice(terms, rng.integers(1, 6), replace=False).tolist())
            self.counts = rng.integers(1, 4, len(self.terms)).tolist()

    examples = [Row(i) for i in range(n)] + [Row(n) for _ in range(1)]
    model = toxicity._index(np.arange(terms).astype(np.uint64), idf, examples, {0: 1.0, 1: 1.0})
    dense = np.zeros((len(model.ids), terms))
    blocks = model.block_max.shape[1]
    for t in range(terms):
        lo, hi = model.bounds[t * blocks], model.bounds[(t + 1) * blocks]
        dense[model.postings[lo:hi], t] = model.weights[lo:hi]
    for _ in range(200):
        term = np.sort(rng.choice(terms, rng.integers(1, 8), replace=False))
        weight = toxicity._unit(np.zeros(len(term), np.int64), term, rng.integers(1, 5, len(term)).astype(float), idf)
        query = np.zeros(terms)
        query[term] = weight
        all_ = dense @ query
        order = sorted((i for i in range(len(all_)) if all_[i] > 0), key=lambda i: (-round(all_[i], 9), i))[:15]
        best, cosine = toxicity.nearest(model, term, weight, 15)
        assert best.tolist() == order and np.allclose(cosine, all_[order])


def test_isotonic():
    x, y = np.array([1, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 0])
    xs, ys = toxicity._isotonic(x.astype(float), y.astype(float), np.ones(5))
    assert np.all(np.diff(ys) >= 0) and ys[0] == 0 and abs(np.interp(4, xs, ys) - 0.5) < 1e-9


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_few_or_no_labels(spark, labels):
    docs = spark.createDataFrame([(1, "abc def"), (2, "xyz")], "doc_id long, text string")
    found = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(found) == 2 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []


def test_keep_clean_keeps_columns(spark):
    docs, labels = rows()
    d = spark.createDataFrame([(i, t, "s", 2.0) for i, t in docs], "doc_id long, text string, evidence string, score double")
    kept = toxicity.keep_clean(d, toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert kept.columns == d.columns
    truth = dict(labels)
    left = {r.doc_id for r in kept.collect()}
    assert sum(truth[i] == 0 for i in left if i in truth) >= 0.97 * sum(v == 0 for v in truth.values())
    assert sum(truth[i] == 1 for i in left if i in truth) <= 0.1 * sum(truth.values())


def test_fit_starts_no_other_python_workers(spark, monkeypatch):
    """Chosen examples go to the executors without an RDD of pickled rows, whose workers would stay there beside the others."""
    docs, labels = rows()
    d, ls = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")

    def refused(*_, **__):
        raise AssertionError("rows were pickled")

    monkeypatch.setattr(spark.sparkContext, "parallelize", refused)
    model = toxicity.fit(d, ls)
    assert len(model.terms) and len(model.ids) == len({i for i in model.ids.tolist()}) <= len(labels)


def test_portions_bound_the_memory_of_a_batch():
    """Two MB of short texts at a time take little beside themselves, and the counts of a text do not depend on its portion."""
    texts = [f"grumbok {i} zarnit vexolt and plain words " * 4 for i in range(13_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    known = toxicity._Terms(np.array([int.from_bytes(b"grumb", "big") << 2, int.from_bytes(b"zarni", "big") << 2], np.uint64))
    tracemalloc.start()
    counts = [c for *_, data, offsets in toxicity._each([batch]) for c in known.counts(data, offsets)[2].tolist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts == [4] * 26_000 and peak < 16 << 20
