import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfspark.llm import language

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ne"], "bb": ["sch", "eit", "ung", "über", "ein"], "cc": ["zh", "ий", "ов", "ка", "то"]}


def rows(n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 60)))
        out.append((i, text.title() if i % 7 == 0 else text, lang))
    return out


def test_held_out_accuracy_and_defined_cases(spark):
    docs = rows() + [(900, None, "aa"), (901, "", "aa"), (902, "123 !? 4", "bb"), (903, "kalomi " * 20_000, None), (None, "schung einheit", "bb")]
    df = spark.createDataFrame([(i, t, x, 0.5) for i, t, x in docs], "doc_id long, text string, lang string, score double")
    found = {r.doc_id: r for r in language.identify_documents(df).collect()}
    assert len(found) == len(docs)
    held = [(found[i], lang) for i, _, lang in rows() if found[i].held_out]
    assert held and all(r.lang_pred == lang for r, lang in held)
    assert all(r.held_out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert {found[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert all(found[i].score == 0 and found[i].rejected for i in (900, 901, 902))
    assert found[903].lang_pred == "aa" and found[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in found.values())


def test_no_languages_and_no_rows(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify_documents(df).collect()} == {"und"}
    assert language.identify_documents(df.limit(0)).collect() == []
    single = spark.createDataFrame([(i, "abc def", "x") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify_documents(single).collect()} == {"x"}


def plain_kneser_ney(texts, order, discount):
    """Probability of a symbol after a context, by dictionaries over symbol tuples."""
    raw = Counter()
    for symbols in texts:
        for i in range(1, len(symbols)):
            raw[tuple([0] * (order - 1 - i) + list(symbols[max(0, i - order + 1): i + 1]))] += 1
    counts = {order: raw}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    followers = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            followers[k][g[:-1]].append(n)

    def p(gram):
        if not gram:
            return 1 / language.SYMBOLS
        k = len(gram)
        rest = followers[k].get(gram[:-1])
        lower = p(gram[1:])
        if not rest:
            return lower
        return max(counts[k][gram] - discount, 0) / sum(rest) + discount * len(rest) / sum(rest) * lower

    return p, raw


@pytest.mark.parametrize("order", [2, 3])
def test_model_like_plain_kneser_ney(order):
    rng = random.Random(order)
    table = language.symbol_table()
    models = []
    samples = {}
    for lang in ("x", "y"):
        texts = ["".join(rng.choice("abcd " if lang == "x" else "abé-") for _ in range(rng.randint(1, 30))) for _ in range(40)]
        data = "".join(texts).encode()
        rows_ = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        symbols, at = language._symbols(np.frombuffer(data, np.uint8), rows_, table)
        samples[lang] = [symbols[a:b].tolist() for a, b in zip(at, at[1:])]
        grams, _ = language._grams(symbols, at, order)
        keys, n = np.unique(grams, return_counts=True)
        models.append((lang, keys, n))
    model = language.build_model(models, order)
    for i, lang in enumerate(model.langs):
        p, raw = plain_kneser_ney(samples[lang], order, language.DISCOUNT)
        probes = list(raw) + [tuple(rng.choice([0, 1, 2, 5, 9]) for _ in range(order)) for _ in range(50)]
        packed = np.array([sum(s << (6 * (order - 1 - j)) for j, s in enumerate(g)) for g in probes])
        found = model.log_probability(packed)[:, i]
        assert np.allclose(found, [math.log(p(g)) for g in probes])
        context = probes[0][:-1]
        assert abs(sum(p((*context, s)) for s in range(language.SYMBOLS)) - 1) < 1e-9


def test_damaged_bytes_are_no_letters(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    damaged = spark.sql(r"select 5000L as doc_id, cast(unhex('FF6B616C6F206D697475C3') as string) as text, cast(null as string) as lang union all select 5001L, cast(unhex('FFFE') as string), null")
    found = {r.doc_id: r.lang_pred for r in language.identify_documents(df.unionByName(damaged)).collect()}
    assert found[5000] == "aa" and found[5001] == "und"
