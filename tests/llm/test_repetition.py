import random
import re
from collections import Counter

import pytest

from shelfspark.llm import repetition

KIND = "doc_id long, text string"


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [(line, sum(len(w) for w in re.split(r"[\x20\x09-\x0D]+", line))) for line in text.split("\n")]
    lines = [x for x in lines if x[1]]
    late = [n for i, (line, n) in enumerate(lines) if line in [x for x, _ in lines[:i]]]
    inside = {}
    for n in (3, *repetition.RUN_SHARES):
        runs = [tuple(words[i: i + n]) for i in range(len(words) - n + 1)]
        times = Counter(runs)
        inside[n] = {j for i, r in enumerate(runs) if times[r] > 1 for j in range(i, i + n)}
    chars = sum(map(len, words))
    run_chars = [sum(len(words[i]) for i in inside[n]) for n in repetition.RUN_SHARES]
    failed = len(words) < 50 or 100 * len(inside[3]) > 50 * len(words)
    over = 100 * sum(late) > 20 * chars or any(100 * c > s * chars for c, s in zip(run_chars, repetition.RUN_SHARES.values()))
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(late), len(inside[3]), sum(late), *run_chars, failed, not failed and not over)


def texts():
    rng = random.Random(3)
    vocabulary = ["a", "bé", "#c", "Ünd<", "|", "日本語", "x" * 30] + [f"w{i}" for i in range(60)]
    out = []
    for _ in range(150):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 20))]
        lines += [rng.choice(lines) for _ in range(rng.randint(0, 8))]
        rng.shuffle(lines)
        out.append(rng.choice(["\n", "\r\n", "\n \n", "\v"]).join(lines))
    return out + ["", None, "\n\n", "one", "one\n one\none ", "same " * 400, "a b c a b c", "# $\n# $", "end\n", "x�y"]


@pytest.mark.parametrize("portion", [1 << 20, 200])
def test_like_brute_force(spark, monkeypatch, portion):
    monkeypatch.setattr(repetition, "PORTION", portion)
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "twice"), (3, "twice")]
    table = spark.createDataFrame([(i, t, 0, True) for i, t in rows], KIND + ", n_words int, kept boolean")
    found = sorted((tuple(r) for r in repetition.judge_documents(table).collect()), key=repr)
    assert found == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert 0 < sum(r[-1] for r in found) < len(found)


def test_words_do_not_reach_over_rows(spark):
    found = repetition.measure(spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "c a b c")], KIND)).collect()
    assert [r.n_repeat_words for r in found] == [0, 0, 0] and [r.n_words for r in sorted(found)] == [3, 3, 4]


def test_empty_table_long_text_and_damaged_bytes(spark):
    assert repetition.judge_documents(spark.createDataFrame([], KIND)).collect() == []
    long = " ".join(str(i) for i in range(300_000))
    found = repetition.judge_documents(spark.createDataFrame([(1, long + "\n" + long)], KIND)).first()
    assert (found.n_words, found.n_repeat_words, found.n_dup_lines, found.kept) == (600_000, 600_000, 1, False)
    damaged = repetition.measure(spark.sql(r"select 1L as doc_id, cast(unhex('61FF20C3A9') as string) as text")).first()
    assert (damaged.n_words, damaged.word_chars) == (2, 3)


def test_keep_varied_keeps_whole_rows(spark):
    good = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good, "k"), (2, "short", "l"), (1, "a b c " * 40, "m"), (None, good + " x", "n")], KIND + ", key string")
    kept = repetition.keep_varied(docs)
    assert kept.columns == docs.columns and sorted(r.key for r in kept.collect()) == ["k", "n"]
