"""Repetition rules for texts: characters inside repeated lines and repeated runs of words.

Rolling hashes give the hash of every run of words of several lengths at once. A run counts as repeated if the text holds it
twice or more, and all its places count, the first included; each character counts once per length, however many runs cover it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import mix, portions, rolling_sums, text_bytes, window_hashes, word_spans

PORTION = 1 << 20
#: Of the characters in words, the largest share in percent that may lie inside repeated runs of so many words.
RUN_SHARES = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: The same for lines that repeat an earlier one.
LINE_SHARE = 20
LEAST_WORDS = 50
#: Words in repeated runs of BASE_RUN words, in percent of all words.
BASE_RUN, BASE_SHARE = 3, 50
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"run_chars_{n}" for n in RUN_SHARES]]

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_OPENS = np.ones(256, bool)
_OPENS[0x80:0xC0] = False       # a byte inside a UTF-8 sequence begins no character


def _totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a key occurs more than once, whether it occurred before)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    often, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    often[order[:-1]] = same
    return often | again, again


def measure_texts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The MEASURES of the texts that lie end to end in `data`."""
    if not len(data):
        return [np.zeros(len(offsets) - 1, np.int64)] * len(MEASURES)
    starts, ends, rows = word_spans(data, offsets)
    sums = rolling_sums(data)
    opens = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_OPENS[data], out=opens[1:])
    chars = opens[ends] - opens[starts]
    n_words = np.diff(rows)
    row = np.repeat(np.arange(len(n_words)), n_words)
    salt = mix(np.arange(1, len(n_words) + 1, dtype=np.uint64))

    words = rolling_sums(window_hashes(sums, starts, ends) ^ salt[row])
    room = rows[1:][row] - np.arange(len(starts))
    covered, at = {}, np.arange(len(starts))
    for n in sorted({BASE_RUN, *RUN_SHARES}):
        # A run can only recur where the shorter run at its start does.
        at = at[room[at] >= n]
        at = at[_repeated(window_hashes(words, at, at + n))[0]]
        depth = np.zeros(len(starts) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + n, -1)
        covered[n] = np.cumsum(depth[:-1]) > 0

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.union1d(offsets[:-1], breaks + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_ends -= (line_ends > line_starts) & (data[line_ends - 1] == 0x0A)
    place = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=place[1:])
    line_chars = place[np.searchsorted(starts, line_ends)] - place[np.searchsorted(starts, line_starts)]
    line_starts, line_ends, line_chars = (x[line_chars > 0] for x in (line_starts, line_ends, line_chars))
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    again = _repeated(mix(window_hashes(sums, line_starts, line_ends) ^ salt[line_row]))[1]
    line_rows = np.searchsorted(line_starts, offsets)

    return [n_words, _totals(chars, rows), _totals(_IS_SYMBOL[data], offsets), _totals(again, line_rows), _totals(covered[BASE_RUN], rows),
            _totals(line_chars * again, line_rows), *[_totals(chars * covered[n], rows) for n in RUN_SHARES]]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the MEASURES (longs) of every row of `docs` (doc_id, text; other columns are ignored).

    A null or empty text measures zero throughout; repeated rows and a null doc_id come out as they came in; bytes that are no
    UTF-8 count like any other. A text is measured whole, so a task holds some 60 bytes per byte of its longest text at most.
    """

    def work(batches):
        for batch in batches:
            ids, (data, offsets) = batch.column("doc_id"), text_bytes(batch.column("text"))
            for lo, hi in portions(offsets, PORTION):
                found = measure_texts(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *[pa.array(x.astype(np.int64)) for x in found]], ["doc_id", *MEASURES])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated runs of three."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_SHARE * F.col("n_words"))


def too_repetitive() -> Column:
    """Some share of characters in repeated lines or runs is above its limit."""
    limits = {"dup_line_chars": LINE_SHARE} | {f"run_chars_{n}": share for n, share in RUN_SHARES.items()}
    over = F.lit(False)
    for name, share in limits.items():
        over = over | (100 * F.col(name) > share * F.col("word_chars"))
    return over


def judge_documents(docs: DataFrame) -> DataFrame:
    """`measure` plus base_failed and kept: neither failed nor too repetitive."""
    judged = measure(docs).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & ~too_repetitive())


def keep_varied(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (all columns) that `judge_documents` keeps; rows go by doc_id and text together."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.xxhash64("doc_id", text).alias("doc_id"), text.alias("text"))
    kept = judge_documents(keyed).filter("kept").select(F.col("doc_id").alias("key")).distinct()
    return docs.join(kept, F.xxhash64(docs["doc_id"], docs["text"].cast("string")) == kept["key"], "left_semi")
