"""SimHash fingerprints of word shingles, linked within a Hamming radius by covering locality-sensitive hashing.

Every bit position has a code of (radius + 1) bits, and each non-zero vector of that length gives a mask: the positions whose
code has an odd product with it. Some vector is orthogonal to the codes of any `radius` positions, so every pair within the
radius agrees on a mask and meets in its table. With several parts the bits are split first: a pair within the radius is
within radius // parts in one of them.
"""

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .arrays import release
from .components import components
from .frames import free_names

BITS = 64
SEED = 42
#: A bucket with more fingerprints is split by a second covering, which loses no pair either.
SPLIT_ABOVE = 2048


def shingle_hashes(text: str | bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every run of `shingle` words, as bytes in rows of 8; of all words where there are fewer, none without words."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_digest
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    return np.frombuffer(b"".join([digest(whole[a:b], SEED) for a, b in zip(starts, last)]), np.uint8).reshape(-1, 8)


def fingerprint(text: str | bytes | None, shingle: int = 4) -> int:
    """Majority of the bits of the shingles' XXH64; zero without words."""
    each = shingle_hashes(text, shingle)
    count = len(each)
    if not count:
        return 0
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, count, 4096):
        ones += np.unpackbits(each[lo: lo + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, row (hash of the text), fp (the 64 bits as a signed long) of every row of `docs`; a null text counts as empty, its fingerprint is zero."""

    def work(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found.view(np.int64))], ["doc_id", "row", "fp"])
            del batch, texts
            release()

    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    return docs.mapInArrow(work, "doc_id long, row long, fp long")


def covering_masks(radius: int, parts: int = 1, seed: int = 0) -> list[int]:
    """Masks over the 64 bits such that any two values within `radius` agree on one of them."""
    draw = random.Random(seed)
    places = list(range(BITS))
    draw.shuffle(places)
    masks = []
    for part in range(parts):
        own = places[part::parts]
        within = radius // parts
        codes = [1 + i % (2 ** (within + 1) - 1) for i in range(len(own))]
        draw.shuffle(codes)
        for vector in range(1, 2 ** (within + 1)):
            masks.append(sum(1 << p for p, code in zip(own, codes) if (code & vector).bit_count() % 2))
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _tables(masks: list[int], value: str = "fp"):
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(value).bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))


def _trees(radius: int):
    def link(values: np.ndarray, out: list) -> None:
        rest = values
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                one = queue.pop()
                near = np.bitwise_count(rest ^ one) <= radius
                if near.any():
                    found, rest = rest[near], rest[~near]
                    out.append(np.stack([np.full(len(found), one), found]))
                    queue += list(found)

    def work(batches):
        for batch in batches:
            lists = batch.column("fps")
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.diff(offsets)
            pairs = offsets[:-1][size == 2]
            pairs = np.stack([values[pairs], values[pairs + 1]])
            out = [pairs[:, np.bitwise_count(pairs[0] ^ pairs[1]) <= radius]]
            for at, n in zip(offsets[:-1][size > 2], size[size > 2]):
                link(values[at: at + n], out)
            both = np.concatenate(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return work


def near_links(fps: DataFrame, radius: int = 4, parts: int = 1) -> DataFrame:
    """Distinct values in column `fp` -> (a, b): links that connect all pairs within `radius`.

    Of each bucket a spanning forest of its true pairs comes out, not every pair. Buckets above SPLIT_ABOVE values are dealt
    out again by a second covering with codes of its own, so none is gathered in one task.
    """
    keyed = fps.select("fp", _tables(covering_masks(radius, parts, 1)).alias("t")).select("fp", "t.i", "t.key")
    sized = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("i", "key"))).filter("n > 1")
    sized = materialize(sized, "buckets")
    small = sized.filter(F.col("n") <= SPLIT_ABOVE).groupBy("i", "key").agg(F.collect_list("fp").alias("fps"))
    large = sized.filter(F.col("n") > SPLIT_ABOVE).select("i", "key", "fp", _tables(covering_masks(radius, parts, 2)).alias("t"))
    large = large.groupBy("i", "key", "t").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    groups = small.select("fps").unionByName(large.select("fps"))
    return groups.mapInArrow(_trees(radius), "a long, b long")


def _grouped(docs: DataFrame, shingle: int, radius: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, fp of every row of `docs`; fp, first, root of every distinct fingerprint, first being its smallest doc_id), both stored."""
    found = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(near_links(classes, radius, parts)).withColumnRenamed("node", "fp")
    return found, materialize(classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")


def near_components(docs: DataFrame, shingle: int = 4, radius: int = 4, parts: int = 1) -> DataFrame:
    """doc_id, fp, component_id of every row of `docs` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that links reach, the row's own included. Texts without words share fingerprint
    zero and link like any other; repeated rows come out as often as they came in; a null doc_id never names a component
    unless all its members have none.
    """
    found, classes = _grouped(docs, shingle, radius, parts)
    named = classes.join(classes.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, parts: int = 1) -> DataFrame:
    """One row of each component of `near_components`, all columns: the smallest doc_id (a null one last), and of its texts that with the smallest hash.

    Repeated rows of the chosen doc_id and text count as one. No similarity of words is asked for beside the bit distance. Any
    column names may stand beside doc_id and text. An empty table stays empty.
    """
    found, classes = _grouped(docs, shingle, radius, parts)
    # Copies are thinned to one per fingerprint before anything is gathered by component.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = found.groupBy("fp").agg(F.min(rank).alias("best")).join(classes, "fp")
    best = firsts.groupBy("root").agg(F.min("best").alias("best")).select(F.xxhash64("best.none", "best.doc_id", "best.row").alias("key"))
    name, = free_names(docs, "key")
    of_row = F.xxhash64(F.col("doc_id").cast("long").isNull(), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    kept = docs.withColumn(name, of_row).join(materialize(best, "kept").withColumnRenamed("key", name), name, "left_semi")
    return kept.dropDuplicates([name]).select(*docs.columns)
