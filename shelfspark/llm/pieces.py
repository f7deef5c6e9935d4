"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice; lossless decoding.

The lattice stands on the UTF-8 bytes of the text, with a plain blank where the model writes its blank sign. No piece of the
model crosses the start of a blank run or a line break (the loader checks it), so the lattice falls into segments; distinct
segments of a window of text are filtered once, in lattices of bounded size, and sampled for each of their places. A long segment falls apart further wherever
no piece of it crosses, which leaves the distribution as it is; what still is long is filtered whole. The model file ranks its
pieces and has no probabilities, so a piece of rank r weighs (r + 10) ** -alpha. Bytes stand in for what no piece covers.
Probabilities are rounded to 2**-31, so a draw does not depend on which texts share a window.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import mix, portions, powers, release, text_bytes

PORTION = 1 << 20
LATTICE = 1 << 17           # bytes of the distinct segments that stand in one lattice; an edge takes some 80 bytes
LONG = 512                  # bytes from which a segment is parted where no piece crosses, and from which its filter goes byte by byte
_FAR_BACK = 1 << 10         # bytes that an edge reaches back at most; pieces are shorter (the loader checks it)
_TABLE_BITS = 20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BLANK_SIGN = "▁".encode()


@dataclass(frozen=True)
class PieceTable:
    """Pieces as bytes end to end, their ids and log weights, and the ids of the 256 byte pieces."""

    content: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    log_weight: np.ndarray      # by id; -inf for pieces that the lattice does not use
    byte_ids: np.ndarray


def load_pieces(path: str, alpha: float = 1.0) -> PieceTable:
    """Read a SentencePiece model; the table is as large as its vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = np.full(256, -1, np.int64)
    contents, usable = [], np.zeros(n, bool)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            contents.append(bytes([int(piece[3:5], 16)]))
            continue
        raw = piece.encode().replace(_BLANK_SIGN, b" ")
        usable[i] = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and bool(raw)
        usable[i] &= b"\n" not in raw and b" " not in raw.lstrip(b" ")
        contents.append(raw if usable[i] else b"")
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so it cannot encode every text")
    score = np.array([model.get_score(i) for i in range(n)])
    rank = np.empty(n)
    rank[np.argsort(-score, kind="stable")] = np.arange(n)
    weight = np.where(usable, -alpha * np.log(rank + 10.0), -np.inf)
    weight[byte_ids] = weight[usable].min() - 40.0
    lengths = np.array([len(c) for c in contents])
    if lengths.max() >= _FAR_BACK:
        raise ValueError("the model has a piece of more than 1,023 bytes")
    return PieceTable(np.frombuffer(b"".join(contents), np.uint8), np.cumsum(lengths) - lengths, lengths, weight, byte_ids)


class _Lookup:
    """From the hash of a byte run to the piece that it is, in a small open table."""

    def __init__(self, table: PieceTable):
        ids = np.flatnonzero(np.isfinite(table.log_weight) & (table.lengths > 0))
        ids = ids[~np.isin(ids, table.byte_ids)]
        lengths, power = table.lengths[ids], powers(int(table.lengths.max()))
        hashes = np.zeros(len(ids), np.uint64)
        for k in range(int(lengths.max())):
            has = lengths > k
            hashes[has] += _BYTE[table.content[table.starts[ids[has]] + k]] * power[k]
        hashes = mix(hashes)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[hashes >> np.uint64(64 - _TABLE_BITS)] = True
        self.longest, self.power = int(lengths.max()), power
        self.single = np.zeros(256, bool)
        self.single[table.content[table.starts[ids[lengths == 1]]]] = True
        self.is_length = np.bincount(lengths, minlength=self.longest + 1) > 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of hashes that are pieces, their ids)."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - _TABLE_BITS)])
        slot = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        true = self.hashes[slot] == hashes[at]
        return at[true], self.ids[slot[true]]


def _segments(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the segments: a run of blanks with the run after it, or a line break."""
    blank, line = data == 0x20, data == 0x0A
    first = line.copy()
    first[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
    first[rows[:-1][rows[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    return starts, np.diff(np.append(starts, len(data)))


def _part(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: PieceTable, lookup: _Lookup) -> tuple[np.ndarray, np.ndarray]:
    """The same segments, the long ones parted wherever no piece of theirs crosses."""
    cuts = [starts]
    for start, length in zip(starts[lengths > LONG], lengths[lengths > LONG]):
        lo, end = int(start), int(start + length)
        while lo < end:                             # windows overlap by the longest piece
            hi = min(lo + PORTION, end)
            content = data[lo: min(hi + lookup.longest, end)]
            begin, _, size = _edges(content, np.arange(len(content), 0, -1), table, lookup)
            inside = np.zeros(len(content) + 1, np.int32)
            np.add.at(inside, begin + 1, 1)         # boundaries begin + 1 .. begin + size - 1 lie inside the piece
            np.add.at(inside, begin + size, -1)
            free = np.flatnonzero(np.cumsum(inside)[: hi - lo] == 0)
            # A piece that began before the window may reach over its first boundaries.
            cuts.append(lo + (free if lo == start else free[free >= lookup.longest]))
            lo = hi if hi == end else hi - lookup.longest
    starts = np.unique(np.concatenate(cuts))
    return starts, np.diff(np.append(starts, len(data)))


def _edges(content: np.ndarray, left: np.ndarray, table: PieceTable, lookup: _Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, piece, size) of all pieces in `content` that end within their segment, of which `left` bytes are left."""
    bytes_ = np.flatnonzero(~lookup.single[content]).astype(np.int32)    # bytes that are no piece by themselves
    froms, ids, sizes = [bytes_], [table.byte_ids[content[bytes_]].astype(np.int32)], [np.ones(len(bytes_), np.int32)]
    live, hashes = np.arange(len(content), dtype=np.int32), np.zeros(len(content), np.uint64)
    for k in range(lookup.longest):
        keep = left[live] > k
        live, hashes = live[keep], hashes[keep]
        if not len(live):
            break
        hashes = hashes + _BYTE[content[live + k]] * lookup.power[k]
        if lookup.is_length[k + 1]:
            at, found = lookup.find(mix(hashes))
            froms.append(live[at])
            ids.append(found.astype(np.int32))
            sizes.append(np.full(len(at), k + 1, np.int32))
    return np.concatenate(froms), np.concatenate(ids), np.concatenate(sizes)


def _distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(one place of each distinct segment, short ones first, the number of the distinct segment at each place)."""
    power, sums = powers(int(lengths.max())), np.empty(len(starts), np.uint64)
    bounds = np.append(starts, len(data))
    for lo, hi in portions(bounds, LATTICE):
        own = starts[lo:hi] - starts[lo]
        within = np.arange(bounds[hi] - bounds[lo]) - np.repeat(own, lengths[lo:hi])
        sums[lo:hi] = np.add.reduceat(_BYTE[data[bounds[lo]: bounds[hi]]] * power[within], own)
    hashes = mix(mix(sums) + lengths.astype(np.uint64))
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    order = np.argsort(lengths[one], kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return one[order], number[which]


class _Lattice:
    """All edges of the distinct segments, by the node that they enter, with cumulated backward probabilities.

    `cumulated` holds node * 2**31 plus the cumulated share of 2**31, so one sorted search finds the edge of a draw.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: PieceTable, lookup: _Lookup):
        self.first = np.cumsum(lengths) - lengths                   # node of byte i of segment s, entered after it: first[s] + i
        n = int(lengths.sum())
        left = np.repeat(self.first + lengths, lengths) - np.arange(n)      # bytes from here to the segment's end
        content = data[np.repeat(starts, lengths) + np.arange(n) - np.repeat(self.first, lengths)]
        start, piece, size = _edges(content, left, table, lookup)
        enters = start + size - 1
        order = np.argsort(enters, kind="stable")
        start, self.piece, self.size, enters = start[order], piece[order], size[order], enters[order]
        edges = np.concatenate([[0], np.cumsum(np.bincount(enters, minlength=n))])
        weight = table.log_weight[self.piece]
        # Forward filtering, one byte position of all segments at a time; far into long segments, where few are left, one by one.
        depth = np.arange(n) - np.repeat(self.first, lengths)
        near = np.flatnonzero(depth < LONG)
        by_depth = near[np.argsort(depth[near].astype(np.int16), kind="stable")]      # LONG fits; 16 bits sort by radix
        levels = np.concatenate([[0], np.cumsum(np.bincount(depth[near]))])
        total = np.empty(n)
        is_first = np.zeros(n, bool)
        is_first[self.first] = True
        shares = np.empty(len(weight))
        for lo, hi in zip(levels[:-1], levels[1:]):
            nodes = by_depth[lo:hi]
            count = edges[nodes + 1] - edges[nodes]
            begin = np.cumsum(count) - count
            own = np.repeat(edges[nodes] - begin, count) + np.arange(count.sum())
            source = start[own]
            value = weight[own] + np.where(is_first[source], 0.0, total[np.maximum(source - 1, 0)])
            top = np.maximum.reduceat(value, begin)
            share = np.exp(value - np.repeat(top, count))
            total[nodes] = top + np.log(np.add.reduceat(share, begin))
            shares[own] = share
        for s in np.flatnonzero(lengths > LONG):
            self._filter_far(int(self.first[s]), int(lengths[s]), start, weight, edges, total, shares)
        # Cumulated within each node, edge by edge, so that the sums of other nodes do not enter.
        count = np.diff(edges)
        more, ends = np.arange(n), edges[1:] - 1
        for k in range(1, int(count.max())):
            more = more[count[more] > k]
            at = edges[more] + k
            shares[at] += shares[at - 1]
        shares *= np.repeat(2.0**31 / shares[ends], count)
        self.cumulated = shares.astype(np.int64)
        self.cumulated[ends] = 1 << 31
        self.cumulated += np.repeat(np.arange(n, dtype=np.int64) << 31, count)

    @staticmethod
    def _filter_far(first: int, length: int, start, weight, edges, total, shares) -> None:
        """Totals and shares of one segment from its byte LONG on, in blocks of bounded size."""
        for lo in range(first + LONG, first + length, PORTION):
            hi = min(lo + PORTION, first + length)
            e = int(edges[lo])
            sources, weights = start[e: edges[hi]].tolist(), weight[e: edges[hi]].tolist()
            bounds = (edges[lo: hi + 1] - e).tolist()
            back = max(first, lo - _FAR_BACK)
            known = total[back: lo].tolist()
            out = []
            for begin, end in zip(bounds[:-1], bounds[1:]):
                value = [weights[i] + (known[sources[i] - 1 - back] if sources[i] > first else 0.0) for i in range(begin, end)]
                top = max(value)
                share = [math.exp(v - top) for v in value]
                known.append(top + math.log(sum(share)))
                out += share
            total[lo:hi] = known[lo - back:]
            shares[e: edges[hi]] = out


def _uniform(seeds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A whole number below 2**31 for each seed and place, the same on every run."""
    return (mix(seeds + mix(at.astype(np.uint64) + np.uint64(1))) >> np.uint64(33)).astype(np.int64)


def _sample(data: np.ndarray, rows: np.ndarray, seeds: np.ndarray, table: PieceTable, lookup: _Lookup):
    """(ids of all pieces, offsets of the rows in them)."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
    starts, lengths = _segments(data, rows)
    if lengths.max() > LONG:
        starts, lengths = _part(data, starts, lengths, table, lookup)
    ids = np.full(len(data), -1, np.int32)
    bounds = np.append(starts, len(data))
    for lo, hi in portions(bounds, PORTION):            # a window of whole segments at a time
        _sample_window(data, bounds[lo:hi], lengths[lo:hi], rows, seeds, table, lookup, ids)
    taken = np.flatnonzero(ids >= 0)
    return ids[taken], np.searchsorted(taken, rows)


def _sample_window(data, starts, lengths, rows, seeds, table: PieceTable, lookup: _Lookup, ids: np.ndarray) -> None:
    """Sample the given segments, which lie end to end, into `ids`."""
    lo, hi = int(starts[0]), int(starts[-1] + lengths[-1])
    one, which = _distinct(data[lo:hi], starts - lo, lengths)
    order = np.argsort(which, kind="stable")            # places of one segment together: their edges are in the cache
    which = which[order]
    for first, last in portions(np.concatenate([[0], np.cumsum(lengths[one])]), LATTICE):
        lattice = _Lattice(data, starts[one[first:last]], lengths[one[first:last]], table, lookup)
        a, b = np.searchsorted(which, [first, last])
        _draw(lattice, which[a:b] - first, starts[order[a:b]], lengths[order[a:b]], rows, seeds, ids)


def _draw(lattice: _Lattice, which, starts, lengths, rows, seeds, ids: np.ndarray) -> None:
    """Sample the segments at `starts`, which are number `which` of the lattice, into `ids`."""
    row = np.searchsorted(rows, starts, "right") - 1
    seed, shift = seeds[row], rows[row]
    node = lattice.first[which] + lengths - 1
    end = starts + lengths
    while len(end):
        draw = (node << 31) + _uniform(seed, end - shift)
        edge = np.searchsorted(lattice.cumulated, draw, "right")
        ids[end - 1] = lattice.piece[edge]
        size = lattice.size[edge]
        end, node = end - size, node - size
        more = end > starts
        end, node, seed, shift, starts = end[more], node[more], seed[more], shift[more], starts[more]


def _same(data: np.ndarray, ids: np.ndarray, table: PieceTable) -> bool:
    """Whether the pieces spell exactly these bytes."""
    ends = np.concatenate([[0], np.cumsum(table.lengths[ids])])
    return ends[-1] == len(data) and all(np.array_equal(_spell(ids[lo:hi], table), data[ends[lo]: ends[hi]]) for lo, hi in portions(ends, LATTICE))


def _spell(ids: np.ndarray, table: PieceTable) -> np.ndarray:
    lengths = table.lengths[ids]
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return table.content[np.repeat(table.starts[ids], lengths) + within]


def encode(docs: DataFrame, table: PieceTable, key: str = "doc_id", text: str = "text", out: str = "pieces", seed: int = 0) -> DataFrame:
    """All columns of `docs` but `text`, plus `out`: array<int> of sampled piece ids.

    The draw depends on the seed, the row's key and the place in its text only. A null text gives null, an empty one an empty
    array, a null key draws like the key 0, and equal rows get equal pieces. An existing column `out` is replaced. A text of any
    length is encoded whole, in windows of whole segments of about PORTION bytes; only a run without a blank in which pieces
    overlap everywhere is a window of its own, however long. Raises if a text does not decode to itself.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, out)]
    schema = T.StructType(kept + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in kept] + [out]

    def work(batches):
        lookup = _Lookup(table)
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            keys = batch.column("__key").fill_null(0).to_numpy(zero_copy_only=False)
            seeds = mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF))
            for lo, hi in portions(offsets, PORTION):
                rows = offsets[lo: hi + 1] - offsets[lo]
                part = data[offsets[lo]: offsets[hi]]
                ids, at = _sample(part, rows, seeds[lo:hi], table, lookup)
                if not _same(part, ids, table):
                    raise AssertionError("pieces do not spell the text")
                missing = batch.column(text).slice(lo, hi - lo).is_null()
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=missing)
                yield pa.RecordBatch.from_arrays([batch.column(n).slice(lo, hi - lo) for n in names[:-1]] + [lists], names)
            batch = data = offsets = part = ids = at = lists = None
            release()

    keyed = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).cast("string").alias(text),
                        (F.col(key).cast("long") if key in docs.columns else F.lit(None).cast("long")).alias("__key"))
    return keyed.mapInArrow(work, schema)


def decode(encoded: DataFrame, table: PieceTable, pieces: str = "pieces", out: str = "text") -> DataFrame:
    """All columns of `encoded` but `pieces`, plus `out`: the texts that the pieces spell. Null gives null."""
    kept = [f for f in encoded.schema.fields if f.name not in (pieces, out)]
    schema = T.StructType(kept + [T.StructField(out, T.BinaryType())])
    names = [f.name for f in kept] + [out]

    def work(batches):
        for batch in batches:
            lists = batch.column(pieces)
            ids, count = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(count)
            texts = pa.array([_spell(ids[end - n: end], table).tobytes() for end, n in zip(ends, count)], pa.binary(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names[:-1]] + [texts], names)
            batch = lists = ids = texts = None
            release()

    spelt = encoded.select(*[F.col(f"`{f.name}`") for f in kept], F.col(pieces)).mapInArrow(work, schema)
    return spelt.withColumn(out, F.col(f"`{out}`").cast("string"))
