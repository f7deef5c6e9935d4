import random
import re

import pytest

from shelfspark.llm import licenses


@pytest.mark.parametrize("text, postfix, ok", [
    ("MIT", ["mit"], True),
    ("GPL-3.0-only OR MIT", ["gpl-3.0-only", "mit", "or"], True),
    ("GPL-3.0-only AND MIT", ["gpl-3.0-only", "mit", "and"], False),
    ("MIT OR GPL-2.0 AND X", ["mit", "gpl-2.0", "x", "and", "or"], True),
    ("(MIT OR GPL-2.0) AND X", ["mit", "gpl-2.0", "or", "x", "and"], False),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR ISC", ["gpl-2.0", "classpath-exception-2.0", "with", "isc", "or"], True),
    ("MIT WITH something", ["mit", "something", "with"], True),
    ("MIT then more words", ["mit"], True),
    ("MIT)", ["mit"], True),
    ("Apache-2.0.", ["apache-2.0"], True),
])
def test_expressions(text, postfix, ok):
    assert licenses.parse_expression(text) == postfix
    assert licenses.permitted(postfix) is ok


@pytest.mark.parametrize("text", ["", "OR MIT", "(MIT", "MIT OR", "()", "MIT AND OR X"])
def test_malformed_expressions(text):
    assert licenses.parse_expression(text) is None


def test_identifiers_leave_out_exceptions():
    assert licenses.identifiers(licenses.parse_expression("a with b or (c and a)")) == ["a", "c"]


def plain(text):
    """Base places by a walk over the words."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_like_a_walk_over_the_words(spark):
    rng = random.Random(3)
    tokens = ["CC", "by", "cc", "General", "public", "LICENSE", "all", "rights", "reserved", "É", "x1", "ſ", "K", "@", "a-b", ".", "\n"]
    rows = [(i, " ".join(rng.choice(tokens) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "cc by cc by"), (303, "ccby CC.BY cc_by"), (304, "xcc by"), (305, "cc by " * 20_000)]
    docs = spark.createDataFrame([(i, t, "l", 1.0) for i, t in rows], "doc_id long, text string, labels string, score double")
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, text in rows:
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_labels_of_its_own(spark):
    rows = [(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nint x;"), (2, "Licensed under the Apache License, Version 2.0."),
            (3, "All rights reserved."), (4, "Licensed under CC BY-NC 4.0."), (5, "SPDX-License-Identifier: )( nothing"), (6, "nothing")]
    found = {r.doc_id: (r.labels, r.score, r.expressions) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == ("gpl-2.0-only,mit", 1.0, ["mit gpl-2.0-only or"])
    assert found[2] == ("apache-2.0,licensed", 1.0, [])
    assert found[3] == ("reserved", 0.0, [])
    assert found[4][0] == "cc-by,cc-by-nc,licensed" and found[4][1] == 0.25
    assert found[5] == ("", 0.5, []) and found[6] == ("", 0.5, [])


def test_long_expressions_are_read_whole():
    finder = licenses.automaton([*licenses.BASE, *licenses.NOTICES, licenses.TAG])
    names = [f"license-number-{i}" for i in range(200)]
    inner = " AND ".join(names)
    found = licenses.scan_text(f"SPDX-License-Identifier: MIT OR ({inner})\nrest SPDX-License-Identifier: ISC SPDX-License-Identifier: 0BSD".encode(), finder)
    assert found["expressions"] == [" ".join(["mit", *names[:2], *(x for n in names[2:] for x in ("and", n)), "and", "or"]), "isc", "0bsd"]
    assert found["labels"] == ",".join(sorted({*names, "mit", "isc", "0bsd"})) and found["score"] == 1.0


@pytest.mark.parametrize("text, postfix", [
    ("MIT and more words", ["mit"]), ("MIT or later versions", ["mit"]), ("(MIT OR Apache-2.0", ["mit", "apache-2.0", "or"]), ("MIT OR", ["mit"]),
    ("((MIT OR (GPL-2.0-only AND and", ["mit", "gpl-2.0-only", "or"]), ("proprietary", ["proprietary"]), ("see the file", None), ("(see", None),
    ("Unlicense OR CC0-1.0 as you like", ["unlicense", "cc0-1.0", "or"]), ("MIT) AND X", ["mit"]), ("", None), ("(", None), ("AND", None),
    ("GPL-2.0+ WITH Classpath-exception-2.0 AND MIT.", ["gpl-2.0+", "classpath-exception-2.0", "with", "mit", "and"]),
])
def test_expressions_end_where_prose_begins(text, postfix):
    assert licenses.read_expression(text) == postfix


def test_prose_after_a_tag_changes_no_score():
    finder = licenses.automaton([*licenses.BASE, *licenses.NOTICES, licenses.TAG])
    found = licenses.scan_text(b"SPDX-License-Identifier: MIT and more words", finder)
    assert (found["labels"], found["score"], found["expressions"]) == ("mit", 1.0, ["mit"])
