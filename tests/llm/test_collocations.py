import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfspark.llm import collocations

KIND = "doc_id long, text string, lang string"


def plain(rows, least=30, per_lang=2000):
    totals, counts = Counter(), {}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i: i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        scored = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            score, k = min((2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase)))
            longer = [p for p in f if len(p) > len(phrase) and f[p] >= least and any(p[i: i + len(phrase)] == phrase for i in range(len(p)))]
            if not any(100 * f[p] >= 80 * a for p in longer):
                scored.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:per_lang], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def documents():
    rng = random.Random(6)
    vocabulary = ["The", "of", "é", "É", "x-y", "日本", "a"] + [f"w{i}" for i in range(25)]
    phrases = [[rng.choice(vocabulary) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = []
        for _ in range(rng.randint(0, 30)):
            words += rng.choice(phrases) if rng.random() < 0.5 else [rng.choice(vocabulary)]
            words.append(rng.choice(["", "", "", ".", ",", "!", "\n", "\t", "\r\n;"]))
        rows.append((i, " ".join(words), rng.choice(["en", "en", "fr", None])))
    return rows + [(900, None, "en"), (901, "", None), (902, "go " * 100, "xx"), (902, "go " * 100, "xx"), (None, "The of " * 40, "und"), (903, "GO\vgo", "xx")]


@pytest.mark.parametrize("settings", [{}, {"RANKED": 8, "TILE": 4, "DENSE": 16, "CHUNK": 50, "PORTION": 300}, {"RANKED": 64, "TILE": 8, "DENSE": 1 << 30}])
def test_like_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(collocations, name, value)
    rows = documents()
    table = spark.createDataFrame([(*r, 1, "p") for r in rows], KIND + ", n int, phrase string")
    found = collocations.top_phrases(table)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows)
    assert len({r[0] for r in plain(rows)}) == 4


def test_first_rows_of_each_language(spark):
    rows = documents()
    table = spark.createDataFrame(rows, KIND)
    assert sorted(tuple(r) for r in collocations.top_phrases(table, 5).collect()) == plain(rows, per_lang=5)


def test_empty_table_and_rare_words(spark):
    assert collocations.top_phrases(spark.createDataFrame([], KIND)).collect() == []
    assert collocations.top_phrases(spark.createDataFrame([(1, "a b c", "en")], KIND)).collect() == []


def test_damaged_bytes_and_long_text(spark):
    damaged = spark.sql("select id as doc_id, cast(unhex('61FF2062') as string) as text, 'en' as lang from range(40)")
    found = collocations.top_phrases(damaged.union(spark.createDataFrame([(99, "up and down " * 100_000, "en")], KIND)))
    best = {r.a for r in found.collect()}
    assert 40 in best and found.filter("n <> 300080").count() == 0


def test_every_way_of_counting_gives_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    left = rng.integers(-3, 60, 5000)
    right = rng.integers(-2, 60, 5000)
    expected = Counter(zip(left.tolist(), right.tolist()))
    for ranked, tile, dense in ((64, 8, 1), (64, 8, 16), (64, 64, 1 << 40)):
        for name, value in (("RANKED", ranked), ("TILE", tile), ("DENSE", dense)):
            monkeypatch.setattr(collocations, name, value)
        found = [(int(a), int(b), int(n)) for part in collocations.count_pairs(left, right) for a, b, n in zip(*part)]
        assert Counter({(a, b): n for a, b, n in found}) == expected and len(found) == len(expected)
