import hashlib
import random
import re

import numpy as np
import pytest

from shelfspark.llm import substring_dedup
from shelfspark.llm.fm_index import FmIndex, smallest_owners, sort_suffixes

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    """What is kept of each document, by plain comparison of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ß!", "x" * 50]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(w)))
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(2000, "a " * 400), (2001, "a " * 300), (2002, ""), (2003, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window", [3, 13])
def test_like_brute_force(spark, window):
    rows = corpus(window)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = sorted(tuple(r) for r in substring_dedup.repeat_digests(df, window).collect())
    assert found == brute(rows, window)


def test_hot_sequences_are_dealt_and_settled(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1e-9)     # every pair that occurs often enough is hot
    rows = [(i, "one two three four five " * 20 + f"own{i}") for i in range(60)] + [(99, "five one two three four five one two")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = sorted(tuple(r) for r in substring_dedup.repeat_digests(df, 4).collect())
    assert found == brute(rows, 4)


def test_empty_clashing_and_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.repeat_digests(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(20))
    rows = spark.createDataFrame([(1, text, "x", 5), (None, text, "y", 6), (2, text, None, 7), (2, text, None, 7)],
                                 "doc_id long, text string, spans string, key int")
    found = sorted((r.doc_id is not None, r.n_removed) for r in substring_dedup.repeat_digests(rows).collect())
    assert found == [(False, 0), (True, 20), (True, 20), (True, 20)]
    kept = {(r.doc_id, bytes(r.kept_text)) for r in substring_dedup.remove_repeats(rows.filter("doc_id = 2")).collect()}
    assert kept == {(2, text.encode())}


def test_texts_that_share_a_doc_id_lose_only_their_own_words(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    first, other, third = words(20), words(25), words(30)
    rows = [(1, first), (5, first), (5, other), (5, other + " " + first), (7, other), (7, third), (None, third), (None, words(9)), (9, first), (9, first)]
    rows += [(i % 7 + 20, words(3) + " " + rng.choice([first, other, third])) for i in range(60)]
    found = sorted(tuple(r) for r in substring_dedup.repeat_digests(spark.createDataFrame(rows, SCHEMA).repartition(3)).filter("doc_id is not null").collect())
    expected = brute([(-1 if i is None else i, t) for i, t in rows], 13)
    assert found == [r for r in expected if r[0] >= 0]


def test_suffixes_and_matches():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 4, 300), 0).astype(np.int32)
    order = sort_suffixes(text, 8)
    keys = [tuple(text[i:i + 8]) for i in order]
    assert keys == sorted(keys)
    owner = np.repeat(np.arange(43), 7)[:301]
    index = FmIndex(text, owner, 5)
    starts, windows = np.array([0]), np.array([296])
    found = smallest_owners(index, starts, windows, np.array([43]))
    expected = [min(owner[j] for j in range(296) if tuple(text[j:j + 5]) == tuple(text[i:i + 5])) for i in range(296)]
    assert found.tolist() == expected
