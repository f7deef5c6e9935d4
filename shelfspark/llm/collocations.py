"""Phrase collocations: exact counts of word runs by direct-address tiles, scored by their weakest cut.

Counting goes up one word at a time. The most frequent words get ranks; a pair of ranks is a cell of a square, which is cut
into tiles. In each chunk of text a tile with many pairs is counted in a dense array (`bincount`), the pairs of all other tiles
and of words without a rank as sorted coordinates. Spark adds the chunks up. The frequent pairs are ranked in turn, and two of
them that overlap make a run of three words, and so on: a run can only be frequent if both runs of one word less are.
Ranks only decide how a pair is counted; words and runs beyond them stand as 63 bits of a hash, and nothing is left out.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .arrays import mix, portions, rolling_sums, text_bytes, window_hashes, word_spans

PORTION = 1 << 20
#: Pairs counted at once in a task.
CHUNK = 1 << 21
#: Most words, pairs, ... with a rank, and the side of a tile; a tile is dense from one pair in DENSE cells.
RANKED, TILE, DENSE = 1 << 16, 1 << 10, 16
#: Bits of the filter that tells which words or runs can be frequent (it never misses one); the log2 of their number.
SIEVE = 25
LEAST, LONGEST, PER_LANG, CONTAINED = 30, 4, 2000, 80

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True


@dataclass(frozen=True)
class Units:
    """The frequent words, or runs of one length: hashes of the ranked ones in order with their ranks, and the sieve of all."""

    hashes: np.ndarray
    ranks: np.ndarray
    sieve: np.ndarray

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks where there are, else negative values made of the hash."""
        out = (hashes | np.uint64(1 << 63)).view(np.int64)
        if len(self.hashes):
            slot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[slot] == hashes, self.ranks[slot], out)
        return out

    def possible(self, hashes: np.ndarray) -> np.ndarray:
        return (self.sieve[(hashes >> np.uint64(64 - SIEVE + 6)).astype(np.int64)] >> ((hashes >> np.uint64(64 - SIEVE)) & np.uint64(63)) & np.uint64(1)).astype(bool)


def run_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a run from the ids of its two parts of one word less."""
    return mix(mix(left.view(np.uint64)) * np.uint64(3) ^ right.view(np.uint64))


def _language_keys(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, 1) for x in langs], np.uint64)


def _words(batch: pa.RecordBatch):
    """For each portion of a batch: (lower-cased bytes, word starts, ends, hash, language of each row, row of each word, whether the next word follows in the same piece)."""
    data, offsets = text_bytes(batch.column("text"))
    langs = batch.column("lang").dictionary_encode()
    keys, lang = _language_keys(langs.dictionary.to_pylist()), langs.indices.to_numpy()
    for lo, hi in portions(offsets, PORTION):
        own, at = _LOWER[data[offsets[lo]: offsets[hi]]], offsets[lo: hi + 1] - offsets[lo]
        starts, ends, rows = word_spans(own, at, _GAP)
        row = np.repeat(np.arange(lo, hi), np.diff(rows))
        hashes = mix(window_hashes(rolling_sums(own), starts, ends) ^ keys[lang[row]])
        breaks = np.zeros(len(own) + 1, np.int64)
        np.cumsum(_BREAK[own], out=breaks[1:])
        follows = np.zeros(len(starts), bool)
        follows[:-1] = (breaks[starts[1:]] == breaks[ends[:-1]]) & (row[1:] == row[:-1])
        yield own, starts, ends, hashes, langs.dictionary.take(pa.array(lang[row])), follows


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a binary column."""
    sizes = ends - starts
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    from_ = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(data[from_])])


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word (bytes), n of all words of (lang, text)."""

    def work(batches):
        for batch in batches:
            for data, starts, ends, hashes, langs, _ in _words(batch):
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(first)), _gathered(data, starts[first], ends[first]), pa.array(n)], ["lang", "word", "n"])

    return texts.mapInArrow(work, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashed_words(words: DataFrame) -> DataFrame:
    """The rows of `word_counts` with `hash`, as `_words` computes it."""

    def work(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("word"))
            langs = batch.column("lang").dictionary_encode()
            keys = _language_keys(langs.dictionary.to_pylist())
            found = mix(window_hashes(rolling_sums(data), offsets[:-1], offsets[1:]) ^ keys[langs.indices.to_numpy()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, "hash"])

    return words.mapInArrow(work, "lang string, word binary, n long, hash long")


def _hashed_runs(runs: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            found = run_hash(batch.column("left").to_numpy(), batch.column("right").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, "hash"])

    return runs.mapInArrow(work, "left long, right long, n long, hash long")


def _units(counted: DataFrame) -> Units:
    """Ranks and sieve of a stored table (hash, n). The driver gets RANKED rows and 2**SIEVE bits at most."""
    steps = counted.groupBy(F.floor(8 * F.log2("n")).alias("step")).count().orderBy(F.desc("step")).collect()      # some 500 at most
    total, least = 0, 1 << 62
    for step in steps:
        total += step["count"]
        if total > RANKED:
            break
        least = step["step"]
    top = counted.filter(F.floor(8 * F.log2("n")) >= least).select("hash", "n").toArrow()
    hashes, n = top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.lexsort((hashes, -n))
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    by = np.argsort(hashes)
    slot, bit = f"shiftrightunsigned(hash, {64 - SIEVE + 6})", f"cast(shiftrightunsigned(hash, {64 - SIEVE}) & 63L as int)"
    bits = counted.groupBy(F.expr(slot).cast("int").alias("slot")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits")).toArrow()
    sieve = np.zeros(1 << (SIEVE - 6), np.uint64)
    sieve[bits.column("slot").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return Units(hashes[by], ranks[by], sieve)


def count_pairs(left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left ids, right ids, counts) of the distinct pairs among two columns of ids."""
    out = []
    ranked = (left >= 0) & (right >= 0)
    a, b = left[ranked], right[ranked]
    per_side = RANKED // TILE
    tile = a // TILE * per_side + b // TILE
    dense = np.bincount(tile, minlength=per_side * per_side) * DENSE >= TILE * TILE
    for t in np.flatnonzero(dense):
        own = tile == t
        n = np.bincount(a[own] % TILE * TILE + b[own] % TILE, minlength=TILE * TILE)
        cell = np.flatnonzero(n)
        out.append((t // per_side * TILE + cell // TILE, t % per_side * TILE + cell % TILE, n[cell]))
    rest = ~dense[tile]
    cell, n = np.unique((a[rest] * RANKED + b[rest]).astype(np.uint32), return_counts=True)
    cell = cell.astype(np.int64)
    out.append((cell // RANKED, cell % RANKED, n))
    a, b = left[~ranked], right[~ranked]
    _, first, n = np.unique(run_hash(a, b), return_index=True, return_counts=True)
    out.append((a[first], b[first], n))
    return out


def run_counts(texts: DataFrame, units: list[Units]) -> DataFrame:
    """left, right, n of the runs of len(units) + 1 words in (lang, text) that may be frequent; left and right are the ids of their parts."""

    def work(batches):
        lefts, rights, held = [], [], 0

        def counted():
            for a, b, n in count_pairs(np.concatenate(lefts), np.concatenate(rights)):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, n)], ["left", "right", "n"])

        for batch in batches:
            for _, _, _, hashes, _, follows in _words(batch):
                # ids[i] names the run at `at[i]`; those that cannot be frequent are dropped on the way up.
                at = np.flatnonzero(units[0].possible(hashes))
                ids = units[0].ids(hashes[at])
                for size, level in enumerate([*units[1:], None]):
                    next_ = np.flatnonzero((at[1:] == at[:-1] + 1) & follows[at[:-1] + size])
                    left, right, at = ids[next_], ids[next_ + 1], at[next_]
                    if level is not None:
                        found = run_hash(left, right)
                        may = level.possible(found)
                        at, ids = at[may], level.ids(found[may])
                lefts.append(left)
                rights.append(right)
                held += len(left)
                if held >= CHUNK:
                    yield from counted()
                    lefts, rights, held = [], [], 0
        if held:
            yield from counted()

    return texts.mapInArrow(work, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def _with_ids(table: DataFrame, units: Units) -> DataFrame:
    """`hash` becomes `id`."""
    kind = ", ".join(f"{'id' if f.name == 'hash' else f.name} {f.dataType.simpleString()}" for f in table.schema.fields)

    def work(batches):
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(units.ids(hashes))], [*batch.schema.names[:-1], "id"])

    return table.mapInArrow(work, kind)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals) of `docs` (lang, text; other columns are ignored).

    phrases: size (words), lang, phrase (bytes), n, heads and tails (how often its first and last 1, 2, ... words occur), and
    longer, the largest n of a phrase that is one word longer and holds it; for all phrases of up to `longest` words that occur
    `least` times or more within pieces. totals: lang and the number of all its words.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counted = materialize(word_counts(texts), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    table = materialize(_hashed_words(counted.filter(F.col("n") >= least)), "units")
    units, levels = [], []
    for size in range(1, longest + 1):
        if size > 1:
            table = materialize(_hashed_runs(run_counts(texts, units).filter(F.col("n") >= least)), "units")
        units.append(_units(table))
        found = _with_ids(table, units[-1])
        if size == 1:
            found = found.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", F.array("n").alias("heads"), F.array("n").alias("tails"))
        else:
            a = levels[-1].select(F.col("id").alias("left"), "lang", "phrase", "heads")
            b = levels[-1].select(F.col("id").alias("right"), "last", "tails")
            found = found.join(a, "left").join(b, "right").select(
                "id", "lang", F.concat("phrase", F.lit(b" "), "last").alias("phrase"), "last", "n",
                F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails"), "left", "right")
        levels.append(materialize(found, "phrases"))
    out = None
    for size, level in enumerate(levels, 1):
        level = level.withColumn("size", F.lit(size))
        if size < len(levels):
            parts = levels[size].select(F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("longer"))
            level = level.join(parts.groupBy("id").agg(F.max("longer").alias("longer")), "id", "left")
        else:
            level = level.withColumn("longer", F.lit(None).cast("long"))
        level = level.select("size", "lang", "phrase", "n", "heads", "tails", "longer")
        out = level if out is None else out.unionByName(level)
    return out, totals


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase (string), a, l, r, score of the phrases of two words or more; the cut with the lowest score counts, the first of several.

    Products are decimals of 38 digits, so they cannot overflow.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        F.floor(wide("n") * F.lit(2_000_000).cast("decimal(7,0)") / (F.get("heads", k - 1).cast("decimal(20,0)") + F.get("tails", F.col("size") - k - 1))).cast("long").alias("score"),
        k.alias("k"), F.get("heads", k - 1).alias("l"), F.get("tails", F.col("size") - k - 1).alias("r")))
    cut = phrases.filter("size > 1").withColumn("cut", F.array_min(cuts))
    return cut.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score", "longer")


def _first_of_each(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first `n` rows of each `by` with their `rank`: sorted over all partitions, then counted off, so no task holds one value's rows."""
    spark = SparkSession.active()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, by, *order).withColumn("part", F.spark_partition_id()), "sorted")
    sizes = dealt.groupBy(by, "part").agg(F.count(F.lit(1)).alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = sizes.select(by, "part", ahead.alias("ahead")).filter(F.col("ahead") < n)
    ranked = dealt.join(needed, [by, "part"]).withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy(by, "part").orderBy(*order)))
    return ranked.filter(F.col("rank") <= n).drop("part", "ahead")


def top_phrases(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best collocations; ties go to the larger a, then to the smaller phrase by bytes.

    Left out are phrases held by one longer phrase that occurs CONTAINED percent as often or more. A null language is `und`, a
    null text empty; repeated rows count as often as they come; an empty table gives an empty result. Texts are read in
    portions, of which one holds a whole text at least.
    """
    phrases, totals = frequent_phrases(docs)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    own = scored(phrases).filter(F.coalesce(wide("longer") * 100 < wide("a") * CONTAINED, F.lit(True))).drop("longer")
    best = _first_of_each(own, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], per_lang)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
