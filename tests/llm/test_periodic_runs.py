import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from shelfspark.llm import periodic_runs
from shelfspark.llm.arrays import mix


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[:-q])


def plain_runs(words, least_length=24, least_periods=3):
    """Every maximal stretch, period by period, by comparing words."""
    found, n = set(), len(words)
    for q in range(1, n // least_periods + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i + q - start >= max(least_length, least_periods * q) and smallest_period(words[start: i + q]) == q:
                    found.add((start, i + q - start, q))
                start = i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = (text or "").replace("\x0b", " ").split() if text and text.isascii() else [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best[0] if best else (None,) * 3), 1000 * best[0][1] // best[0][2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def found_runs(texts):
    """find_runs over lists of numbers that stand one after another."""
    parts, sizes = [], []
    for k, text in enumerate(texts):
        parts += [mix(np.array(text, np.uint64) + np.uint64(1)), mix(np.array([10**9 + k], np.uint64))]
        sizes.append(len(text) + 1)
    runs = periodic_runs.find_runs(np.concatenate(parts), max(sizes), np.array(sizes))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return [[(s - b, e - s, q) for s, e, q in runs.tolist() if b <= s < b + m] for b, m in zip(begins.tolist(), sizes)]


def odd_texts(seed):
    """Nested repeats, breaks near the borders of periods, few symbols."""
    rng = random.Random(seed)
    word = lambda n, k: [rng.randrange(k) for _ in range(n)]
    out = []
    for _ in range(12):
        inner = word(rng.randint(1, 6), rng.choice([1, 2, 30])) * rng.randint(1, 40)
        block = inner[: rng.randint(1, len(inner))] + word(rng.randint(0, 3), 40)
        text = word(rng.randint(0, 9), 3) + block * rng.randint(2, 7) + block[: rng.randint(0, len(block))] + word(rng.randint(0, 40), 2)
        if rng.random() < 0.3:
            text[rng.randrange(len(text))] = 99
        out.append(text[:700])
    return out + [word(300, 2), [0] * 130, [0] * 60 + [1] + [0] * 60 + [1] + [0] * 60 + [1] + [0] * 61, []]


@pytest.mark.parametrize("seed", range(12))
def test_finds_every_run(seed):
    texts = odd_texts(seed)
    assert found_runs(texts) == [plain_runs(t, 1) for t in texts]


def rows():
    rng = random.Random(5)
    vocabulary = ["a", "bé", "c,", "Ünd", "x" * 40] + [f"w{i}" for i in range(300)]
    out = []
    for i in range(260):
        n = rng.choice([0, 1, 23, 24, 60, 200, 500])
        words = [rng.choice(vocabulary) for _ in range(n)]
        if n and i % 3 == 0:
            block = words[: rng.randint(1, 30)]
            words[n // 2: n // 2] = block * rng.randint(2, 6)
        out.append((i, rng.choice([" ", "\n", "\t \r\n"]).join(words)))
    planted = [i for i in range(400, 4000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    out += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 400)))) for i in planted]
    return out + [(7, "again " * 30), (7, "again " * 30), (None, "no id " * 20), (500, None), (501, ""), (502, " \n ")]


def test_like_brute_force(spark):
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows()], "doc_id long, text string, n_runs int, start string")
    found = sorted((tuple(r) for r in periodic_runs.run_digests(table).collect()), key=repr)
    assert found == sorted((plain_digest(i, t) for i, t in rows()), key=repr)
    assert sum(r[1] > 0 for r in found) > 60


def test_collapse_keeps_texts_without_planting(spark):
    words = [f"w{i}" for i in range(10)]
    found = periodic_runs.collapse(spark.createDataFrame([(1, " ".join(["x", *words * 4, "y"])), (2, "a  b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, [tuple(x) for x in r.runs]) for r in found) == [(1, " ".join(["x", *words, "y"]), [(1, 40, 10)]), (2, "a b", [])]


def test_long_text_empty_table_and_damaged_bytes(spark):
    kind = "doc_id long, text string"
    assert periodic_runs.run_digests(spark.createDataFrame([], kind)).collect() == []
    period = [f"w{i}" for i in range(50_000)]
    text = " ".join(period * 4)
    found = periodic_runs.collapse(spark.createDataFrame([(1, text)], kind)).first()
    assert [tuple(r) for r in found.runs] == [(0, 200_000, 50_000)] and found.text == " ".join(period)
    damaged = spark.sql(r"select 1L as doc_id, cast(unhex('61FF62') as string) as text")
    assert periodic_runs.run_digests(damaged).first().collapsed_sha256 == hashlib.sha256(b"a\xffb").hexdigest()
