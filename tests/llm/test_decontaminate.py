import random
import re
from collections import Counter

from shelfspark.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w):
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def plain(docs, items, threshold=0.8):
    """The best similarity over all item-sized windows."""
    out = {}
    for i, text in docs:
        w = words(text)
        for item, other in items:
            b = words(other)
            if not b or not w:
                continue
            for at in range(max(1, len(w) - len(b) + 1)):
                win = w[at:at + len(b)]
                a, c = shingles(win), shingles(b)
                m = sum((a & c).values())
                j = m / (sum(a.values()) + sum(c.values()) - m)
                if j >= threshold and j > out.get((i, item), (0,))[0]:
                    out[i, item] = (j, at, len(win))
    return out


def fixture():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(200)] + ["Éa", "x_y"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(14, 60)))) for i in range(12)]
    items += [(20, "tiny item"), (21, "one"), (22, ""), (23, None), (24, "so so so so so so so so so so so so so so"), (0, items[0][1])]
    docs = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 2:
            part = words(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 2)):
                at = rng.choice([0, 1, len(part) - 1, rng.randrange(len(part))])
                part[at] = "edited"
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(100, None), (101, ""), (102, "so " * 30), (103, "A tiny ITEM!"), (104, "one"), (105, items[2][1].upper()), (105, items[2][1].upper()),
             (None, items[3][1]), (106, " ".join(words(items[4][1])[:-1])), (107, "v " * 20_000 + items[5][1])]
    return docs, items


def test_like_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, size int, content string")
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, size string")
    found = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in decontaminate.contaminations(d, b).collect()}
    expected = plain(docs, items)
    assert len(expected) > 30 and any(v[0] < 1 for v in expected.values())
    assert found == expected
    clean = decontaminate.remove_contaminated(d, b)
    assert clean.columns == d.columns
    hit = {i for i, _ in expected}
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(i or -1 for i, _ in docs if i not in hit)


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 150)
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(d, b).collect()}
    assert found == set(plain(docs, items))
    assert decontaminate.contaminations(d, b.limit(0)).collect() == []
    assert decontaminate.contaminations(d.limit(0), b).collect() == []


def test_only_native_operations(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate._windows(decontaminate.compute_once(d, [decontaminate.words("text").alias("w")], ["doc_id"]),
                                  b.select(decontaminate.words("text").alias("iw")).selectExpr("iw", "size(iw) as size"), 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text
