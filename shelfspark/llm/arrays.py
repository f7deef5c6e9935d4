"""Array work on Arrow text columns inside tasks: words, hashes, pieces of a batch."""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    """1, p, p**2, ... for an odd constant p, modulo 2**64."""
    out = np.full(max(n, 1), _ODD, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each non-empty run of `values`; the runs lie end to end."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    within = np.arange(len(values)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(mix(values) * powers(int(lengths.max()))[within], starts)
    return mix(sums ^ (lengths.astype(np.uint64) * _ODD))


_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE[_IS_GAP] = 0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string column, offsets of its rows); a null counts as an empty text."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def release() -> None:
    """Give freed memory back to the system: Python workers live on between stages, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def clean_utf8(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with replacement characters for bytes that are no UTF-8."""
    try:
        data.tobytes().decode("utf-8")
        return data, offsets
    except UnicodeDecodeError:
        rows = [data[lo:hi].tobytes().decode("utf-8", "replace").encode() for lo, hi in zip(offsets[:-1], offsets[1:])]
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def portions(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the rows in it); words are runs of anything but ASCII white space."""
    rows = offsets - offsets[0]
    data = data[offsets[0]: offsets[-1]]
    gap = _IS_GAP[data]
    before = np.empty_like(gap)
    before[1:] = gap[:-1]
    before[rows[:-1][rows[:-1] < len(data)]] = True
    first = ~gap & before
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    at = np.cumsum(first) - 1
    at = np.arange(len(data)) - starts[np.maximum(at, 0)]
    np.maximum(at, 0, out=at)
    parts = _BYTE[data]
    parts *= powers(int(at.max()) + 1)[at]
    return mix(np.add.reduceat(parts, starts)), np.searchsorted(starts, rows)


_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_ANY = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LADDER = [powers(1), powers(1)]


def _ladder(n: int) -> list[np.ndarray]:
    """The powers of a constant and of its inverse modulo 2**64, n of each at least; kept between calls."""
    if len(_LADDER[0]) < n:
        n = max(n, 2 * len(_LADDER[0]))
        back = np.full(n, _BACK, np.uint64)
        back[0] = 1
        _LADDER[:] = [powers(n), np.multiply.accumulate(back)]
    return _LADDER


def rolling_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which `window_hashes` takes the hash of any window; `values` are bytes or 64-bit values."""
    out = np.zeros(len(values) + 1, np.uint64)
    terms = _ANY[values] if values.dtype == np.uint8 else values.copy()
    terms *= _ladder(len(values) + 1)[0][: len(values)]
    np.cumsum(terms, out=out[1:])
    return out


def window_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window [start, end), the same wherever the window stands."""
    found = (sums[ends] - sums[starts]) * _ladder(len(sums))[1][starts]
    return mix(found ^ ((ends - starts).astype(np.uint64) * _ODD))


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _IS_GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends of all words, offsets of the rows in them); words are runs of bytes outside `gaps`, within a row."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(gaps[data], out=inside[:-1])
    turn = np.empty(len(data) + 1, bool)
    turn[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=turn[1:])
    first = inside & turn
    cut = offsets[:-1]
    first[cut] |= inside[cut]
    last = ~inside & turn
    cut = cut[(cut > 0) & inside[cut]]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    ends = np.union1d(ends, cut[inside[cut - 1]])
    return starts, ends, np.searchsorted(starts, offsets)
