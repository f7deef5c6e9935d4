"""Licence scans: identifier tags and notice phrases by Aho-Corasick, expressions by a shunting-yard parser."""

import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels that every scan reports (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notice phrases, as words after normalisation, and the identifiers they stand for.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license version 2 0": "apache-2.0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "cc0": "cc0",
    "public domain": "public-domain",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc",
    "attribution noncommercial": "noncommercial",
    "proprietary and confidential": "proprietary",
    "may not be reproduced": "proprietary",
    "licensed under": "licensed",
}
TAG = "spdx license identifier"
# Labels under which text may be used, for the score and for expressions.
PERMITTED = frozenset({
    "mit", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0", "cc0-1.0", "public-domain", "cc-by", "cc-by-4.0",
    "cc-by-3.0", "mit-0", "0bsd", "zlib",
})
REFUSED = frozenset({"reserved", "proprietary", "noncommercial", "cc-by-nc", "cc-by-nd"})
_TAGGED = re.compile(rb"(?i)spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier[\t ]*:?[\t ]*")
_EXPRESSION = re.compile(rb"[0-9A-Za-z.+:()\t -]+")
_TOKEN = re.compile(r"\(|\)|[0-9A-Za-z.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
# A-Z lower, 0-9 a-z and all bytes of other characters as they are, everything else a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def parse_expression(text: str) -> list[str] | None:
    """A licence expression in postfix order, operators in lower case; None if it is malformed.

    `with` binds its exception first, then `and`, then `or`. Words after a complete expression end it.
    """
    out, stack, want = [], [], True
    for found in _TOKEN.finditer(text):
        token = found[0]
        low = token.lower()
        if want:
            if token == "(":
                stack.append(token)
            elif token == ")" or low in _RANK:
                return None
            else:
                out.append(low.rstrip(".") or low)
                want = False
        elif low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            want = True
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            break
    if want or "(" in stack:
        return None
    return out + stack[::-1]


def _is_identifier(token: str) -> bool:
    """Whether a word has the shape of a licence identifier: a digit, hyphen or plus, capitals only, or a name in use."""
    low = token.lower().rstrip(".+")
    return bool(re.search(r"[0-9+-]", token)) or token.isupper() or low in PERMITTED or low in REFUSED or low in BASE.values()


def read_expression(text: str) -> list[str] | None:
    """The longest complete expression that `text` begins with, as `parse_expression` gives it; None without one.

    Prose ends it: a word that is no identifier by its shape counts only where it is all that the text says. An open
    parenthesis closes where the expression ends, and an operator without a right side does not belong to it.
    """
    tokens, want = [], True
    found = _TOKEN.findall(text)
    for token in found:
        is_operator = token.lower() in _RANK
        if token == "(" and want or token == ")" and not want:
            tokens.append(token)
        elif want == is_operator or token in "()" or want and not (_is_identifier(token) or len(found) == 1):
            break
        else:
            tokens.append(token)
            want = is_operator
        if tokens.count(")") > tokens.count("("):
            break
    while tokens and (tokens[-1] == "(" or tokens[-1].lower() in _RANK):
        tokens.pop()
    return parse_expression(" ".join(tokens + [")"] * (tokens.count("(") - tokens.count(")"))))


def permitted(postfix: list[str], allowed: Iterable[str] = PERMITTED) -> bool:
    """Whether the expression can be met: `or` needs one side, `and` both, `with` looks at the licence and not at its exception."""
    allowed, stack = frozenset(allowed), []
    for token in postfix:
        if token in _RANK and len(stack) > 1:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left or right if token == "or" else left and right)
        else:
            stack.append(token in allowed or token.removesuffix("+") in allowed)
    return stack[-1]


def identifiers(postfix: list[str]) -> list[str]:
    """The licences of an expression, without operators and exceptions."""
    out, stack = set(), []
    for token in postfix:
        if token in _RANK and len(stack) > 1:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left | right)
        else:
            stack.append({token})
    for found in stack:
        out |= found
    return sorted(out)


def automaton(phrases: Iterable[str]) -> ahocorasick.Automaton:
    """Matches phrases between blanks."""
    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(raw: bytes | None, finder: ahocorasick.Automaton) -> dict:
    """Everything that the scan reports on one text."""
    words = (raw or b"").translate(_FOLD).split()
    joined = b" " + b" ".join(words) + b" "
    text = joined.decode("utf-8", "replace")
    base, labels, starts = set(), set(), []
    tagged = False
    for end, phrase in finder.iter(text):
        if phrase in BASE:
            at = end - len(phrase) - 1
            starts.append(at)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            labels.add(NOTICES[phrase])
    expressions, met = [], []
    tags = list(_TAGGED.finditer(raw)) if tagged else []
    for tag, end in zip(tags, [t.start() for t in tags[1:]] + [len(raw or b"")]):
        found = _EXPRESSION.match(raw, tag.end(), end)
        postfix = read_expression(found[0].decode()) if found else None
        if postfix:
            expressions.append(" ".join(postfix))
            labels.update(identifiers(postfix))
            met.append(permitted(postfix))
    labels |= base
    open_ = bool(labels & PERMITTED) and (not met or all(met)) or bool(met) and all(met)
    closed = bool(labels & REFUSED) or bool(met) and not all(met)
    score = 0.5 if not labels else 0.0 if closed and not open_ else 0.25 if closed else 1.0 if open_ else 0.5
    first = last = None
    if starts:
        first, last = text.count(" ", 0, min(starts)), text.count(" ", 0, max(starts))
    return {"n_words": len(words), "n_base": len(starts), "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)), "score": score, "expressions": expressions}


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                  ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string()))])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored).

    n_words, n_base (places of base phrases), first_word, last_word (word numbers of the first and last place), base_labels, labels
    (sorted, comma-joined), expressions (in postfix order) and score: 1 for a permitted licence, 0 for a refused one, 0.25 for
    both, 0.5 where nothing decides. A null text is an empty one: no words, no labels, score 0.5.
    """

    def work(batches):
        finder = automaton([*BASE, *NOTICES, TAG])
        for batch in batches:
            found = [scan_text(t.as_py(), finder) for t in batch.column("text").cast(pa.binary())]
            columns = [batch.column("doc_id")] + [pa.array([x[f.name] for x in found], f.type) for f in list(_OUT)[1:]]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                                 "score double, expressions array<string>")
