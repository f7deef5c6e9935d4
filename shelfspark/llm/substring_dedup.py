"""Word sequences that already occur in an earlier document, found with one FM-index per shard.

Every window of words goes to the shard that its smallest word-pair hash names, so equal windows meet in one shard and no document
is held against all shards. A shard indexes its word runs and streams the same runs through backward search; runs of
matches with an earlier document come out as intervals. Pairs that hold more than a fixed share of all routed words
are never used for routing. Windows that hold nothing else are routed by their own hash, dealt over several
shards, and settled by their smallest document in each.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize, materialize_counted
from .arrays import mix, portions, run_hashes, text_bytes, word_hashes
from .fm_index import FmIndex, smallest_owners

GRAM = 2
WORD_MASK = np.uint64(2**48 - 1)    # words stand as 48 bits of their hash
COMMON = 1 << 15            # common words get two-byte codes on the way to the shards
_RARE = np.uint16(0xFFFF)
BUCKETS = 1 << 16
HOT_SHARE = 2e-4            # of all routed words; so at most 5,000 buckets are hot, whatever the input
SHARD_WORDS = 1_000_000
SALTS = 32
RUN_WINDOWS = 32
PORTION = 4 << 20
NO_ID = -(1 << 63)          # stands for a null doc_id, which so counts as the smallest
_MOST = np.uint64(2**64 - 1)
_OCCURRENCE = np.dtype([("run", "<i4"), ("at", "<i4"), ("doc", "<i8"), ("row", "<i8")])
_WEIGHTS = mix(np.arange(1, GRAM + 1, dtype=np.uint64))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _runs(words: np.ndarray, rows: np.ndarray, window: int, hot: np.ndarray | None):
    """(first word, windows, route, routed by the window itself?) of each run of windows with one route."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    gram = min(GRAM, window)
    grams = sum(words[k: len(words) - gram + 1 + k] * _WEIGHTS[k] for k in range(gram))
    grams = mix(grams)
    if hot is not None:
        grams = np.where(hot[grams & np.uint64(BUCKETS - 1)], _MOST, grams)
    route = _lowest(grams, window - gram + 1)
    ends = np.repeat(rows[1:], np.diff(rows))[:n]
    starts = np.flatnonzero(np.arange(n) + window <= ends)
    route = route[starts]
    own = route == _MOST
    if own.any():
        at = starts[own]
        total = np.zeros(len(at), np.uint64)
        for k in range(window):
            total = mix(total + words[at + k])
        route[own] = total
    new = own.copy()                                    # such a window is a run alone
    new[:1] = True
    new[1:] |= (starts[1:] != starts[:-1] + 1) | (route[1:] != route[:-1])
    begins = np.flatnonzero(new)
    within = np.arange(len(starts)) - np.repeat(begins, np.diff(np.append(begins, len(starts))))
    begins = np.flatnonzero(within % RUN_WINDOWS == 0)
    windows = np.diff(np.append(begins, len(starts)))
    return starts[begins], windows, route[begins], own[begins]


def _portions(batches, window: int, hot):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        texts = batch.column("row").to_numpy(zero_copy_only=False)
        for lo, hi in portions(offsets, PORTION):
            words, rows = word_hashes(data, offsets[lo: hi + 1])
            yield words, rows, (ids[lo:hi], texts[lo:hi]), _runs(words, rows, window, hot)


def _load(window: int):
    """Routed words of each bucket, and the counts of a task's most frequent words, which pick the short codes only."""

    def count(batches):
        total, known, often = np.zeros(BUCKETS, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for words, *_, (_, windows, route, _) in _portions(batches, window, None):
            total += np.bincount((route & np.uint64(BUCKETS - 1)).astype(np.int64), windows + window - 1, BUCKETS).astype(np.int64)
            new, n = np.unique(words & WORD_MASK, return_counts=True)
            if len(new) > COMMON:
                top = np.sort(np.argpartition(n, -COMMON)[-COMMON:])
                new, n = new[top], n[top]
            both, which = np.unique(np.concatenate([known, new]), return_inverse=True)
            n = np.bincount(which, np.concatenate([often, n]), len(both)).astype(np.int64)
            top = np.sort(np.argpartition(n, -2 * COMMON)[-2 * COMMON:]) if len(both) > 2 * COMMON else slice(None)
            known, often = both[top], n[top]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([False, True], [len(used), len(known)])), pa.array(np.concatenate([used, known.view(np.int64)])),
             pa.array(np.concatenate([total[used], often]))], ["is_word", "key", "n"])

    return count


class _Codes:
    """Words as two bytes where they are common, else as an escape and six bytes; packed by zstd."""

    def __init__(self, common: np.ndarray):
        self.common = np.sort(common)

    def codes(self, words: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(words), _RARE)
        slot = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
        return np.where(self.common[slot] == words, slot.astype(np.uint16), _RARE)

    @staticmethod
    def pack(compress, codes: np.ndarray, words: np.ndarray) -> tuple[bytes, bytes]:
        rare = words[codes == _RARE].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        return compress(codes.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()), compress(rare.tobytes())

    def unpack(self, decompress, codes: bytes, rare: bytes) -> np.ndarray:
        codes = np.ascontiguousarray(np.frombuffer(decompress(codes), np.uint8).reshape(2, -1).T).view("<u2").ravel()
        six = np.frombuffer(decompress(rare), np.uint8).reshape(-1, 6)
        eight = np.zeros((len(six), 8), np.uint8)
        eight[:, :6] = six
        out = self.common[np.minimum(codes, len(self.common) - 1)] if len(self.common) else np.zeros(len(codes), np.uint64)
        out[codes == _RARE] = eight.view("<u8").ravel()
        return out


def _spread(lengths: np.ndarray) -> np.ndarray:
    """0 .. length-1 for each length, end to end."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _route(window: int, hot: np.ndarray, shards: int, coder: _Codes):
    def route_runs(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for number, (words, rows, (ids, texts), (starts, windows, route, own)) in enumerate(_portions(batches, window, hot)):
            if not len(starts):
                continue
            words = words & WORD_MASK
            codes = coder.codes(words)
            lengths = windows + window - 1
            content = words[np.repeat(starts, lengths) + _spread(lengths)]
            hashes = run_hashes(content, np.cumsum(lengths) - lengths, lengths)
            hashes, one, which = np.unique(hashes, return_index=True, return_inverse=True)
            salted = route[one] + own[one] * mix(np.array([ids[0] & 0xFFFFFFFF, number], np.uint64)).sum() % np.uint64(SALTS)
            shard = (mix(salted) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            one, shard = one[by], shard[by]
            kept = lengths[one]
            place_of = np.repeat(starts[one], kept) + _spread(kept)
            content, codes = words[place_of], codes[place_of]
            ends = np.cumsum(kept)
            doc = np.searchsorted(rows, starts, "right") - 1
            seen = np.empty(len(starts), _OCCURRENCE)
            seen["run"], seen["at"], seen["doc"], seen["row"] = place[which], starts - rows[doc], ids[doc], texts[doc]
            seen = seen[np.argsort(seen["run"], kind="stable")]
            first = np.flatnonzero(np.diff(shard, prepend=-1))
            out = {name: [] for name in _ROUTED.names}
            for lo, hi in zip(first, np.append(first[1:], len(shard))):
                part = seen[np.searchsorted(seen["run"], lo): np.searchsorted(seen["run"], hi)].copy()
                part["run"] -= lo
                out["shard"].append(int(shard[lo]))
                own_words = slice(ends[lo] - kept[lo], ends[hi - 1])
                common, rare = coder.pack(pack, codes[own_words], content[own_words])
                out["words"].append(common)
                out["rare"].append(rare)
                out["lengths"].append(pack(kept[lo:hi].astype("<i4").tobytes()))
                out["own"].append(pack(own[one[lo:hi]].tobytes()))
                out["seen"].append(pack(part.tobytes()))
            yield pa.RecordBatch.from_pydict(out, _ROUTED)

    return route_runs


_ROUTED = pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in ("words", "rare", "lengths", "own", "seen")]])
_ROUTED_SQL = "shard long, words binary, rare binary, lengths binary, own binary, seen binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("window", pa.int64())])
_FOUND_SQL = "doc_id long, row long, start long, end long, window long"


def _search(window: int, coder: _Codes):
    def search_shard(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        read = lambda name, kind: [np.frombuffer(unpack(x), kind) for x in table.column(name).to_pylist()]
        lengths, seen = read("lengths", "<i4"), read("seen", _OCCURRENCE)
        runs_before = np.cumsum([0] + [len(x) for x in lengths[:-1]])
        run = np.concatenate([x["run"].astype(np.int64) + b for x, b in zip(seen, runs_before)])
        docs, at, texts = (np.concatenate([x[c] for x in seen]) for c in ("doc", "at", "row"))
        words = [coder.unpack(unpack, c, r) for c, r in zip(table.column("words").to_pylist(), table.column("rare").to_pylist())]
        words, lengths = np.concatenate(words), np.concatenate(lengths).astype(np.int64)
        own = np.concatenate(read("own", bool))
        # Equal runs become one part of the text, owned by their smallest document.
        begins = np.cumsum(lengths) - lengths
        hashes, one, which = np.unique(run_hashes(words, begins, lengths), return_index=True, return_inverse=True)
        known, number = np.unique(docs, return_inverse=True)
        run = which[run]
        lowest, highest = np.full(len(one), len(known), np.int64), np.full(len(one), -1, np.int64)
        np.minimum.at(lowest, run, number)
        np.maximum.at(highest, run, number)
        kept = lengths[one]
        symbols, codes = np.unique(words[np.repeat(begins[one], kept) + _spread(kept)], return_inverse=True)
        starts = np.cumsum(kept + 1) - kept - 1
        text = np.zeros(int((kept + 1).sum()), np.int32)
        text[np.repeat(starts, kept) + _spread(kept)] = codes + 1
        del words, symbols, codes
        owner = np.repeat(lowest, kept + 1)
        windows = kept - window + 1
        smallest = smallest_owners(FmIndex(text, owner, window), starts, windows, highest)
        # Back to the places of the runs: windows whose smallest document is an earlier one.
        before = np.cumsum(windows) - windows
        any_hit = np.minimum.reduceat(smallest, before) < number.max() + 1 if len(before) else np.zeros(0, bool)
        hit = np.flatnonzero(any_hit[run])
        count = windows[run[hit]]
        place = np.repeat(hit, count)
        step = _spread(count)
        removed = smallest[before[run[place]] + step] < number[place]
        place, step = place[removed], step[removed]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (step[1:] != step[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1 if len(first) else first
        # Places of windows with a route of their own that no document in this shard precedes.
        open_ = np.flatnonzero(own[one][run] & (lowest[run] == number))
        return pa.table([
            np.concatenate([docs[place[first]], docs[open_]]),
            np.concatenate([texts[place[first]], texts[open_]]),
            np.concatenate([at[place[first]] + step[first], at[open_]]).astype(np.int64),
            np.concatenate([at[place[last]] + step[last] + window, at[open_] + window]).astype(np.int64),
            pa.array(np.concatenate([np.zeros(len(first), np.int64), hashes[run[open_]].view(np.int64)]),
                     mask=np.arange(len(first) + len(open_)) < len(first)),
        ], schema=_FOUND)

    return search_shard


def with_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, row: the hash of the text for a doc_id that stands with several texts, else 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.xxhash64("text")
    several = docs.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("several")).agg(F.min(text).alias("low"), F.max(text).alias("high"))
    several, n = materialize_counted(several.filter("low <> high").select("several"), "several")
    if not n:
        return docs.withColumn("row", F.lit(0).cast("long"))
    joined = docs.join(several, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("several"), "left")
    return joined.select("doc_id", "text", F.when(F.col("several").isNull(), F.lit(0).cast("long")).otherwise(text).alias("row"))


def repeated_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, row, start, end: word intervals covered by windows that also start in a document with a smaller doc_id.

    Intervals of one document may overlap. `docs` needs doc_id, text and what `with_rows` adds; a null text has no words, a
    null doc_id counts as the smallest (and comes back as NO_ID). Texts of one doc_id count as one document, and `row` tells
    in which of them an interval lies.
    """
    docs = docs.select("doc_id", "row", "text")
    loads = docs.mapInArrow(_load(window), "is_word boolean, key long, n long").groupBy("is_word", "key").agg(F.sum("n").alias("n"))
    loads = materialize(loads, "loads")
    buckets = loads.filter("not is_word").collect()     # one row for each of the fixed buckets
    common = loads.filter("is_word").orderBy(F.desc("n"), "key").limit(COMMON).collect()
    total = sum(r.n for r in buckets)
    hot = np.zeros(BUCKETS, bool)
    hot[[r.key for r in buckets if r.n > max(HOT_SHARE * total, 64 * window)]] = True
    coder = _Codes(np.array([r.key for r in common], np.int64).view(np.uint64))
    shards = max(1, -(-total // SHARD_WORDS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = docs.mapInArrow(_route(window, hot, shards, coder), _ROUTED_SQL).groupBy("shard").applyInArrow(_search(window, coder), _FOUND_SQL)
    return found


def _settled(found: DataFrame) -> DataFrame:
    """Decide the windows that were dealt over several shards, each with its smallest document there."""
    dealt = found.filter("window is not null")
    smallest = dealt.groupBy("window").agg(F.min("doc_id").alias("earliest"))
    late = dealt.join(smallest, "window").filter("doc_id > earliest").select("doc_id", "row", "start", "end")
    return found.filter("window is null").select("doc_id", "row", "start", "end").unionByName(late)


def _strip(batches):
    for batch in batches:
        out = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept_text": []}
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            words = (text or b"").split()
            kept, done, removed = [], 0, 0
            for span in sorted(spans or (), key=lambda s: (s["start"], s["end"])):
                lo, hi = max(span["start"], done), min(span["end"], len(words))
                if lo < hi:
                    kept += words[done:lo]
                    removed += hi - lo
                    done = hi
            kept += words[done:]
            out["n_words"].append(len(words))
            out["n_removed"].append(removed)
            out["kept_text"].append(b" ".join(kept))
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary())]))


def _digest(batches):
    for whole in _strip(batches):
        digests = [hashlib.sha256(x).hexdigest() for x in whole.column("kept_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*whole.columns[:3], pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    docs = with_rows(docs)
    found = materialize(repeated_spans(docs, window), "repeats")
    spans = _settled(found).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("key"), F.col("row").alias("of"), "spans")
    return docs.join(spans, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("key")) & (F.col("row") == F.col("of")), "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (binary, words joined by one space) for every row of `docs`.

    Takes any frame with doc_id and text; other columns are ignored. Null and empty texts have no words; words shorter runs
    than a window are never removed; repeated rows come out as often as they came in. Several texts of one doc_id are one document:
    none makes another one's words go, and each loses its own.
    """
    return _with_spans(docs, window).mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_text binary")


def repeat_digests(docs: DataFrame, window: int = 13) -> DataFrame:
    """As `remove_repeats`, with the SHA-256 of the kept words in place of the words."""
    return _with_spans(docs, window).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
