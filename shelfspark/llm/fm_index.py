"""An FM-index over a text of integer symbols: wavelet matrix of the transform, rank by popcount.

All queries run in lockstep on arrays. Symbol 0 separates the parts of the text and never occurs in a pattern.
"""

import numpy as np


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions in the order of their first `depth` symbols or more."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    step = max(1, min(depth, 62 // bits))
    padded = np.concatenate([text.astype(np.int64), np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << bits) | padded[k: k + n]
    order = np.argsort(key)
    key = key[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    while True:
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        tied = ~first
        tied[:-1] |= tied[1:]
        places = np.flatnonzero(tied)
        if step >= depth or not len(places):
            return order
        suffixes = order[places]
        key = rank[suffixes] * (n + 2) + rank[np.minimum(suffixes + step, n)] + 1
        by = np.argsort(key)
        order[places] = suffixes[by]
        key = key[by]
        first[places[1:]] = key[1:] != key[:-1]
        step *= 2


class _Bits:
    """A bit vector with the number of ones before every word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        whole = np.packbits(bits, bitorder="little")
        packed[: len(whole)] = whole
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)
        self.zeros = n - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class FmIndex:
    """Backward search over `text`; `owner` gives the document number of each text position."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, window: int):
        order = sort_suffixes(text, window + 1)
        n, self.text, self.window = len(text), text, window
        size = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        column = text[order - 1]                        # the transform; the text is taken as a circle
        self.levels = []
        for level in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (column >> level) & 1 == 1
            self.levels.append((level, _Bits(bit)))
            column = np.concatenate([column[~bit], column[bit]])
        symbols = np.arange(size)
        self.base = self.first[:-1] - self._descend(symbols, np.zeros(size, np.int64))
        self.lowest = [owner[order].astype(np.int32)]   # lowest[k][i]: smallest owner in rows i .. i + 2**k
        while 2 ** len(self.lowest) <= n:
            half, below = 2 ** (len(self.lowest) - 1), self.lowest[-1]
            row = below.copy()
            np.minimum(below[:-half], below[half:], out=row[:-half])
            self.lowest.append(row)
        self.lowest = np.stack(self.lowest)
        self._group(order, n)

    def _group(self, order: np.ndarray, n: int) -> None:
        """For each row, the range of rows whose first `window` symbols are the same."""
        padded = np.concatenate([self.text, np.zeros(self.window, self.text.dtype)])
        same = np.arange(1, n)
        for k in range(self.window):
            same = same[padded[order[same] + k] == padded[order[same - 1] + k]]
        begins = np.ones(n, bool)
        begins[same] = False
        starts = np.flatnonzero(begins)
        self.group = np.cumsum(begins) - 1
        self.group_range = np.append(starts, n)

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> level) & 1 == 1, bits.zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Row boundary of the pattern with `symbol` put before it."""
        return self.base[symbol] + self._descend(symbol, i)

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest owner in each non-empty row range."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        return np.minimum(self.lowest[k, lo], self.lowest[k, hi - (1 << k)])

    def match_lengths(self, ends: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Length, up to the window, of the longest match ending at each text position in an owner less than `below`."""
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        symbol = self.text[ends]
        lo, hi = self.first[symbol], self.first[symbol + 1]
        for step in range(1, self.window + 1):
            found = self.smallest(lo, hi) < below[live]
            live, lo, hi = live[found], lo[found], hi[found]
            length[live] = step
            if step == self.window or not len(live):
                break
            symbol = self.text[ends[live] - step]
            both = self.extend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
            lo, hi = both[: len(live)], both[len(live):]
        return length

    def locate(self, ends: np.ndarray) -> np.ndarray:
        """First row of the windows of the text that end at `ends`."""
        lo = self.first[self.text[ends]]
        for step in range(1, self.window):
            lo = self.extend(self.text[ends - step], lo)
        return lo

    def window_owner(self, row: np.ndarray) -> np.ndarray:
        """Smallest owner of the window that starts the suffix in `row`."""
        group = self.group[row]
        return self.smallest(self.group_range[group], self.group_range[group + 1])

    def slide(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """From a row of a window to a row of the window one symbol before it."""
        return self.extend(symbol, self.group_range[self.group[row]])


def smallest_owners(index: FmIndex, starts: np.ndarray, windows: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For the windows of each part of the text, end to end: the smallest owner, or a large number where none is under `below`.

    A match that breaks off rules out every window around the break, so most parts need one short search.
    """
    size, none = index.window, np.iinfo(np.int32).max
    at = np.concatenate([[0], np.cumsum(windows)])
    out = np.full(at[-1], none, np.int32)
    skip = np.zeros(len(starts), np.int64)
    live, hit = np.arange(len(starts)), [np.zeros(0, np.int64)]
    while len(live):
        length = index.match_lengths(starts[live] + skip[live] + size - 1, below[live])
        hit.append(live[length == size])
        length, live = length[length < size], live[length < size]
        skip[live] += size - length
        live = live[skip[live] < windows[live]]
    live = np.concatenate(hit)
    if not len(live):
        return out
    last = windows[live] - 1
    row = index.locate(starts[live] + last + size - 1)
    while True:
        out[at[live] + last] = index.window_owner(row)
        more = last > skip[live]
        live, last, row = live[more], last[more] - 1, row[more]
        if not len(live):
            return out
        row = index.slide(index.text[starts[live] + last], row)
