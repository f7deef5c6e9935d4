import math
import os
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="the tokenizer is absent")
TEXTS = ["", " ", "plain words here", "  two  blanks\n\nlines\t tab\r\n", "▁literal ▁▁ sign", "naïve Übergröße 漢字 🙂 \u0000 end", "x" * 3000, "é" * 700,
         "a\nb", "ends with blank ", "1" * 40 + " " * 40, None]


@pytest.fixture(scope="module")
def table():
    return pieces.load_pieces(MODEL)


def test_round_trip_and_repeatability(spark, table):
    docs = spark.createDataFrame([(i, t, "p", i) for i, t in enumerate(TEXTS)] + [(None, "null key", "p", 0)], "doc_id long, text string, pieces string, n int")
    coded = pieces.encode(docs, table, seed=5)
    assert coded.columns == ["doc_id", "n", "pieces"]
    back = {r.doc_id: r.text for r in pieces.decode(coded, table).collect()}
    assert back == dict(enumerate(TEXTS)) | {None: "null key"}
    one = {r.doc_id: r.pieces for r in coded.collect()}
    assert one == {r.doc_id: r.pieces for r in pieces.encode(docs.repartition(4).orderBy(F.desc("n")), table, seed=5).collect()}
    other = {r.doc_id: r.pieces for r in pieces.encode(docs, table, seed=6).collect()}
    assert one != other and one[0] == [] and one[11] is None
    assert pieces.encode(docs.limit(0), table).collect() == []


def test_draws_follow_the_lattice(table):
    """Frequencies of sampled segmentations of one word against all of them, enumerated."""
    word = b" token"
    by_bytes = {bytes(table.content[s:s + n]): i for i, (s, n) in enumerate(zip(table.starts, table.lengths))
                if n and np.isfinite(table.log_weight[i]) and i not in set(table.byte_ids.tolist())}

    def splits(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in by_bytes:
                for tail in splits(rest[n:]):
                    yield (by_bytes[rest[:n]], *tail)

    weight = {s: math.exp(sum(table.log_weight[i] for i in s)) for s in splits(word)}
    total = sum(weight.values())
    n = 20_000
    data = np.frombuffer(word * n, np.uint8)
    ids, _ = pieces._sample(data, np.array([0, len(data)]), np.array([3], np.uint64), table, pieces._Lookup(table))
    seen, at = Counter(), 0
    sizes = table.lengths[ids]
    ends = np.cumsum(sizes)
    for end in np.flatnonzero(ends % len(word) == 0):
        seen[tuple(int(i) for i in ids[at:end + 1])] += 1
        at = end + 1
    assert sum(seen.values()) == n
    for split, w in weight.items():
        p = w / total
        assert abs(seen[split] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_long_and_random_texts(table):
    rng = random.Random(1)
    lookup = pieces._Lookup(table)
    for _ in range(20):
        text = "".join(rng.choice(" \nabcdeéß漢🙂") for _ in range(rng.randint(1, 4000))).encode()
        ids, at = pieces._sample(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([1], np.uint64), table, lookup)
        assert pieces._spell(ids, table).tobytes() == text and at.tolist() == [0, len(ids)]


def test_runs_without_a_cut_are_sampled_whole(table):
    """Pieces cross every 512th byte of a long run as often as any other."""
    lookup = pieces._Lookup(table)
    text = ("nations" * 6000).encode()
    data, rows = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    crossed, elsewhere, n = 0, 0, 0
    for seed in range(6):
        ids, _ = pieces._sample(data, rows, np.array([seed], np.uint64), table, lookup)
        assert pieces._spell(ids, table).tobytes() == text
        ends = set(np.cumsum(table.lengths[ids]).tolist())
        at = range(1024, len(text) - 512, 512)
        crossed += sum(p not in ends for p in at)
        elsewhere += sum(p + 7 not in ends for p in at)
        n += len(at)
    assert crossed > 0 and abs(crossed - elsewhere) < 6 * math.sqrt(n)
    han = ("漢字漢字仮名交文章" * 700).encode()
    ids, _ = pieces._sample(np.frombuffer(han, np.uint8), np.array([0, len(han)]), np.array([1], np.uint64), table, lookup)
    assert pieces._spell(ids, table).tobytes() == han


def test_the_far_filter_equals_the_near_one(table, monkeypatch):
    """A run filtered byte by byte, in blocks, and by levels: the same shares; and parted runs join at places no piece crosses."""
    lookup = pieces._Lookup(table)
    text = np.frombuffer(("internationalisation" * 60).encode(), np.uint8)
    one = np.array([0])
    by_levels = lambda: pieces._Lattice(text, one, np.array([len(text)]), table, lookup)
    monkeypatch.setattr(pieces, "LONG", 1 << 15)
    whole = by_levels().cumulated
    monkeypatch.setattr(pieces, "LONG", 64)
    monkeypatch.setattr(pieces, "PORTION", 100)
    far = by_levels().cumulated
    assert np.abs(whole - far).max() <= 4
    mixed = np.frombuffer(("字x漢" * 300 + "q🙂zq" * 300).encode(), np.uint8)
    starts, lengths = pieces._part(mixed, one, np.array([len(mixed)]), table, lookup)
    assert starts[0] == 0 and lengths.sum() == len(mixed) and len(starts) > 100
    begin, _, size = pieces._edges(mixed, np.arange(len(mixed), 0, -1), table, lookup)
    spanned = np.zeros(len(mixed), bool)
    for b, s in zip(begin, size):
        spanned[b + 1: b + s] = True
    assert set(starts.tolist()) <= set(np.flatnonzero(~spanned).tolist())


def test_draws_do_not_depend_on_windows_or_neighbours(table, monkeypatch):
    lookup = pieces._Lookup(table)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["alpha ", "beta", "γάμμα ", "漢字", "\n", "x1 "]) for _ in range(400)).encode() for _ in range(6)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seeds = np.arange(6).astype(np.uint64)
    ids, at = pieces._sample(data, rows, seeds, table, lookup)
    for i, t in enumerate(texts):
        alone, _ = pieces._sample(np.frombuffer(t, np.uint8), np.array([0, len(t)]), seeds[i:i + 1], table, lookup)
        assert alone.tolist() == ids[at[i]: at[i + 1]].tolist()
    monkeypatch.setattr(pieces, "PORTION", 700)
    again, _ = pieces._sample(data, rows, seeds, table, lookup)
    assert again.tolist() == ids.tolist()


def test_lattices_are_bounded(table, monkeypatch):
    """Many different words: no lattice holds more than LATTICE bytes, its size decides no draw, and a window stays small in memory."""
    lookup = pieces._Lookup(table)
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 9))) for _ in range(150_000)).encode()[:1 << 20]
    data, rows, seeds = np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([9], np.uint64)
    held, build = [], pieces._Lattice
    monkeypatch.setattr(pieces, "_Lattice", lambda data, starts, lengths, *rest: held.append(int(lengths.sum())) or build(data, starts, lengths, *rest))
    tracemalloc.start()
    ids, _ = pieces._sample(data, rows, seeds, table, lookup)
    assert pieces._same(data, ids, table) and not pieces._same(data[:-1], ids, table) and not pieces._same(data, ids[::-1], table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(held) > 1 and max(held) <= pieces.LATTICE and peak < 64 << 20
    for limit in (1 << 21, 1 << 14):
        monkeypatch.setattr(pieces, "LATTICE", limit)
        assert np.array_equal(pieces._sample(data, rows, seeds, table, lookup)[0], ids)
