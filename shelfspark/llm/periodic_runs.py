"""Periodic runs of words by string synchronising sets, and texts with their repeats collapsed.

Periods below SMALL are found directly, by comparing every word with the one `period` places on. For a period q in
[4t, 8t), t a power of two, positions are chosen by content: i is in the set of scale t if among the windows of t words that
start in [i, i + t] the smallest hash belongs to the first or the last. Windows that lie in a run of a period of t / 3 or less
take no part, since there the same hashes recur too densely; the runs found so far tell which these are. A run of length 3q
or more holds a chosen i in its first period such that the c words from i and from i + q both lie in the run, for c = q rounded
up to a multiple of t; as c >= q, no place between them has the same c words. So every run shows up as a pair of neighbours
with equal contexts, from which it is extended by comparing words.
"""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix, portions, rolling_sums, text_bytes, window_hashes, word_spans

PORTION = 1 << 20
SMALL = 8
LEAST_LENGTH, LEAST_PERIODS = 24, 3
_NO_WINDOW = np.uint64(2**64 - 1)


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values two arrays share."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at: min(at + step, n)] != b[at: min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def _small_periods(x: np.ndarray) -> list[np.ndarray]:
    """Rows (start, end, period) of the runs with a period below SMALL."""
    out = []
    for q in range(1, min(SMALL, len(x))):
        same = np.zeros(len(x) - q + 2, np.int8)
        same[1:-1] = x[:-q] == x[q:]
        turn = np.diff(same)
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        long = last - first >= (LEAST_PERIODS - 1) * q
        out.append(np.stack([first[long], last[long] + q, np.full(long.sum(), q)], axis=1))
    return out


def _chosen(x: np.ndarray, sums: np.ndarray, scale: int, runs: np.ndarray) -> np.ndarray:
    """The synchronising set of a scale; `runs` holds all runs with a period of scale / 3 or less."""
    starts = np.arange(len(x) - scale + 1)
    hashes = np.minimum(window_hashes(sums, starts, starts + scale), _NO_WINDOW - np.uint64(1))
    dense = runs[(3 * runs[:, 2] <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
    depth = np.zeros(len(x) + 2, np.int64)
    np.add.at(depth, dense[:, 0], 1)
    np.add.at(depth, dense[:, 1] - scale + 1, -1)
    hashes[np.cumsum(depth)[: len(hashes)] > 0] = _NO_WINDOW
    low, width = hashes, 1
    while width < scale:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    low = np.minimum(low[:-1], low[1:])
    return np.flatnonzero((low != _NO_WINDOW) & ((low == hashes[: len(low)]) | (low == hashes[scale: scale + len(low)])))


def _pairs(sums: np.ndarray, chosen: np.ndarray, scale: int) -> np.ndarray:
    """Rows (first place, period, matched words) of the stretches that neighbours with equal contexts propose."""
    out = []
    for context in range(4 * scale, 8 * scale + 1, scale):
        at = chosen[chosen + context < len(sums)]
        keys = window_hashes(sums, at, at + context)
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        first = at[order[same]]
        period = at[order[same + 1]] - first
        near = (period > context - scale) & (period <= context)
        first, period = first[near], period[near]
        order = np.lexsort((first, period))
        first, period = first[order], period[order]
        # What begins inside the stretch before it, at the same period, belongs to that stretch.
        new = np.ones(len(first), bool)
        new[1:] = (period[1:] != period[:-1]) | (first[1:] > first[:-1] + context)
        out.append(np.stack([first[new], period[new], np.full(new.sum(), context)], axis=1))
    return np.concatenate(out)


def _extended(x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs around `pairs`, those of LEAST_PERIODS periods or more."""
    out, known = [], {}
    for at, period, matched in pairs.tolist():
        if known.get(period, -1) >= at:
            continue
        end = at + _equal_ahead(x[at:], x[at + period:])
        start = at - _equal_ahead(x[:at][::-1], x[: at + period][::-1])
        known[period] = end
        if end + period - start >= LEAST_PERIODS * period:
            out.append((start, end + period, period))
    return np.array(out, np.int64).reshape(-1, 3)


def find_runs(x: np.ndarray, longest: int, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), by start and period, of all runs of LEAST_PERIODS periods or more in texts that stand one after another.

    `x` holds a hash for each word and after each text one value that occurs nowhere else; `sizes` are the texts' lengths with
    that value, `longest` the largest of them. A run is kept with its smallest period.
    """
    runs = np.concatenate([np.zeros((0, 3), np.int64), *_small_periods(x)])
    places, scale = np.arange(len(x)), SMALL // 4
    while 12 * scale <= longest:
        # Only texts that can hold three periods of this scale stay.
        stay = np.repeat(sizes >= 12 * scale, sizes)
        places, x, sizes = places[stay], x[stay], sizes[sizes >= 12 * scale]
        inside = runs[np.isin(runs[:, 0], places)]
        inside[:, :2] += (np.searchsorted(places, inside[:, 0]) - inside[:, 0])[:, None]
        sums = rolling_sums(x)
        found = _extended(x, _pairs(sums, _chosen(x, sums, scale, inside), scale))
        found[:, :2] += (places[found[:, 0]] - found[:, 0])[:, None]
        runs = np.concatenate([runs, found])
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
        runs = runs[new]
        scale *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))] if len(runs) else runs


def planted_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the repeats that the contract puts into a text of n words, or None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _texts(ids: list, texts: list[bytes], data: np.ndarray, offsets: np.ndarray, planted: bool):
    """For each text: (its words, the places among them that stand one after another, its runs)."""
    starts, ends, rows = word_spans(data, offsets)
    hashes = window_hashes(rolling_sums(data), starts, ends)
    stops = mix(np.arange(1, len(ids) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    parts, order = [], []
    for k, doc_id in enumerate(ids):
        own, n = hashes[rows[k]: rows[k + 1]], int(rows[k + 1] - rows[k])
        tail = planted_tail(doc_id, n) if planted else None
        at = None
        if tail:
            at = np.arange(n)
            at[tail[0]:] = tail[0] + (at[tail[0]:] - tail[0]) % tail[1]
            own = own[at]
        order.append(at)
        parts += [own, stops[k: k + 1]]
    sizes = np.diff(rows) + 1
    runs = find_runs(np.concatenate(parts), int(sizes.max()), sizes)
    runs = runs[runs[:, 1] - runs[:, 0] >= LEAST_LENGTH]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.searchsorted(runs[:, 0], begins)
    for k, text in enumerate(texts):
        own = runs[cut[k]: cut[k + 1]]
        yield text.split(), order[k], [(s - int(begins[k]), e - s, q) for s, e, q in own.tolist()]


def collapsed(words: list[bytes], order: np.ndarray | None, runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by blanks, without those that some run covers after its first period."""
    if order is None and not runs:
        return b" ".join(words)
    n = len(words)
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:n]) == 0)
    return b" ".join([words[i] for i in (kept if order is None else order[kept]).tolist()])


def _rows(batches, planted: bool, row):
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").fill_null("").cast(pa.binary())
        data, offsets = text_bytes(batch.column("text"))
        for lo, hi in portions(offsets, PORTION):
            own = ids.slice(lo, hi - lo).to_pylist()
            found = _texts(own, texts.slice(lo, hi - lo).to_pylist(), data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], planted)
            yield [(doc_id, *row(*x)) for doc_id, x in zip(own, found)]


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, text (repeats collapsed) and runs (array of start, length, period) of every row of `docs` (doc_id, text; other columns are ignored).

    A run is a stretch of LEAST_LENGTH words and LEAST_PERIODS periods or more. A null or empty text has no runs and comes out
    empty; repeated rows and null doc_ids come out as they came in; bytes that are no UTF-8 stay as they are. A text is
    searched whole: a task holds some 100 bytes per byte of its longest text at most.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches):
        row = lambda words, order, runs: (collapsed(words, order, runs), [dict(zip(("start", "length", "period"), r)) for r in runs])
        for rows in _rows(batches, False, row):
            ids, texts, runs = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(runs, kind)], ["doc_id", "text", "runs"])

    found = _docs(docs).mapInArrow(work, "doc_id long, text binary, runs array<struct<start: long, length: long, period: long>>")
    return found.withColumn("text", F.col("text").cast("string"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent (start, length, period, exponent_milli; nulls without a run), runs_sha256, collapsed_sha256.

    First every text whose crc32 of the doc_id is divisible by 10 gets the repeats of `planted_tail` (a null doc_id none). The
    runs and the collapsed text are those of `collapse`; ties of exponents go to the smallest start, then period.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def row(words, order, runs):
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        return len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, order, runs)).hexdigest()

    def work(batches):
        for rows in _rows(batches, True, row):
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names)
    return _docs(docs).mapInArrow(work, kind)
