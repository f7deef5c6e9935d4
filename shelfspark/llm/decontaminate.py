"""Benchmark decontamination with SimHash windows of each item's size, in DataFrame operations only.

A window of a document is a run of as many words as an item has. Windows that share no shingle with an item of their size have
similarity 0 and are not built. The others get a SimHash fingerprint; fingerprints are cut into radius + 1 blocks, so two
within the radius agree on a block and meet in an equi-join. The exact similarity decides: shingles weighted by how often
they occur, the sum of smaller weights over the sum of larger ones. Equal windows are fingerprinted and verified once.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.products import compute_once
from ..plans.scratch import materialize

SHINGLE = 5
THRESHOLD = 0.8
#: At similarity 0.8 fingerprints differ in about 10 of 64 bits, with a deviation of about 3.
RADIUS = 20
BITS = 64
#: Largest benchmark (rows of its block index) that is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words of the items whose shingles are one constant of a plan.
BLOCK_SHINGLES = 100_000


def words(text: str) -> Column:
    """Lower-case runs of letters and digits; none for a null text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _shingle_hashes(column: str, k: int) -> Column:
    """Hashes of the k-word shingles of an array of words; none if it is shorter."""
    items = ", ".join(f"{column}[i + {j}]" for j in range(k))
    return F.expr(f"if(size({column}) < {k}, cast(array() as array<bigint>), transform(sequence(0, size({column}) - {k}), i -> xxhash64({items})))")


def _all_hashes(column: str) -> Column:
    """Hashes of 5-word shingles; the whole sequence where there are fewer words."""
    return F.when(F.size(column) < SHINGLE, F.array(F.xxhash64(column))).otherwise(_shingle_hashes(column, SHINGLE))


def _shingles(column: str) -> Column:
    return F.expr(f"if(size({column}) < {SHINGLE}, array(array_join({column}, ' ')), "
                  f"transform(sequence(1, size({column}) - {SHINGLE - 1}), i -> array_join(slice({column}, i, {SHINGLE}), ' ')))")


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two arrays, each element weighted by how often it occurs."""
    counted = (f"aggregate(array_distinct({a}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))")
    # Without a repeated element in `b`, each shared element weighs one.
    shared = F.expr(f"if(size(array_distinct({b})) = size({b}), size(array_intersect({a}, {b})), {counted})")
    return shared / (F.size(a) + F.size(b) - shared)


def fingerprints(table: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, fp: the majority of the bits of the shingle hashes, repeated shingles counted as often as they occur."""
    each = table.select(*keys, F.explode(_all_hashes(column)).alias("h"))
    ones = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(1)).alias(f"b{i}") for i in range(BITS)]
    counted = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *ones)
    return counted.select(*keys, F.expr(" | ".join(f"if(2 * b{i} > m, shiftleft(1L, {i}), 0L)" for i in range(BITS))).alias("fp"))


def _blocks(radius: int) -> Column:
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND(2 ** (hi - lo) - 1).alias("value"))
             for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    return F.inline(F.array(*parts))


def _literal(values: list, kind: str) -> Column:
    """A nested list as one constant of a plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _windows(base: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """doc_id, size, start, win: every window of an item's size that shares a k-word shingle with such an item.

    The shingles of a block of items are a constant in the plan, filed by their low bits, so a document finds its own without a
    join and its text is never shuffled.
    """
    known = items.select("size", F.explode(_shingle_hashes("iw", k)).alias("h")).groupBy("h").agg(F.collect_set("size").alias("sizes")).collect()
    slots = 1 << max(1, len(known) - 1).bit_length()
    hashes, sizes = [[] for _ in range(slots)], [[] for _ in range(slots)]
    for r in known:
        hashes[r.h & (slots - 1)].append(r.h)
        sizes[r.h & (slots - 1)].append(sorted(r.sizes))
    hashes, sizes = _literal(hashes, "array<array<bigint>>"), _literal(sizes, "array<array<array<int>>>")
    slot = lambda h: (h.bitwiseAND(slots - 1) + 1).cast("int")
    place = lambda i: F.array_position(F.element_at(hashes, slot(F.col("hs")[i])), F.col("hs")[i])
    hashed = compute_once(base, [_shingle_hashes("w", k).alias("hs")], ["doc_id", "w"])
    every = F.when(F.size("hs") > 0, F.sequence(F.lit(0), F.size("hs") - 1)).otherwise(F.array().cast("array<int>"))
    found = compute_once(hashed, [F.filter(every, lambda i: place(i) > 0).alias("ats")], ["doc_id", "w", "hs"]).filter("size(ats) > 0")

    def starts(i, size):
        """Size and start of the windows around a shingle, packed into one number; a short text is one window."""
        first = F.greatest(F.lit(0), i + k - size)
        return F.transform(F.sequence(first, F.greatest(first, F.least(i, F.size("w") - size))), lambda at: F.shiftleft(size.cast("long"), 32) + at)

    around = F.transform("ats", lambda i: F.flatten(F.transform(
        F.element_at(F.element_at(sizes, slot(F.col("hs")[i])), place(i).cast("int")), lambda size: starts(i, size))))
    packed = compute_once(found, [F.array_distinct(F.flatten(around)).alias("packed")], ["doc_id", "w"])
    cut = ("inline(transform(packed, c -> named_struct('size', int(shiftright(c, 32)), 'start', int(c & 4294967295L), "
           "'win', slice(w, int(c & 4294967295L) + 1, int(shiftright(c, 32))))))")
    return packed.select("doc_id", F.expr(cut))


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity, distance: the best window of each document for each item it holds.

    `docs` needs doc_id and text, `benchmark` item_id and text; other columns are ignored. Null and empty texts hold nothing;
    items without words match nothing. A text shorter than an item is one window. Items of fewer than five words count as one
    shingle. Equal similarities go to the first window; repeated rows give one result; rows with one doc_id and different texts
    give the best window among them; a null doc_id is an id like any other. A benchmark of more than BLOCK_SHINGLES is
    taken in blocks, each with a pass over the documents.
    """
    items = benchmark.select("item_id", words("text").alias("iw")).filter("size(iw) > 0").distinct().withColumn("size", F.size("iw"))
    items = materialize(items, "items")
    facts = items.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).first()
    shared = F.broadcast if facts.n * (radius + 1) <= BROADCAST_ROWS else (lambda table: table)
    short = [r.k for r in items.filter(f"size < {SHINGLE}").select(F.col("size").alias("k")).distinct().collect()]     # 4 values at most
    # Without compute_once later steps would copy the split into every shingle.
    base = compute_once(docs, [words("text").alias("w")], ["doc_id"])
    blocks = max(1, -(-(facts.shingles or 0) // BLOCK_SHINGLES))
    windows = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "iw"), F.lit(blocks)) == block)
        for k, part in [(SHINGLE, own.filter(f"size >= {SHINGLE}")), *[(k, own.filter(f"size = {k}")) for k in short]]:
            found = _windows(base, part, k)
            windows = found if windows is None else windows.unionByName(found)
    windows = materialize(windows.withColumn("content", F.md5(F.array_join("win", " ").cast("binary"))), "windows")
    contents = materialize(windows.groupBy("size", "content").agg(F.any_value("win").alias("win")), "contents")
    marked = fingerprints(contents, ["size", "content"], "win")
    index = fingerprints(items, ["item_id", "size", "iw"], "iw").withColumnRenamed("fp", "ifp")
    index = index.withColumn("fp", F.col("ifp")).select("item_id", "size", "ifp", _blocks(radius))
    near = marked.select("size", "content", "fp", _blocks(radius)).join(shared(index), ["size", "block", "value"])
    near = near.withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))).filter(F.col("distance") <= radius)
    near = near.groupBy("size", "content", "item_id").agg(F.min("distance").alias("distance"))
    checked = near.join(contents, ["size", "content"]).join(shared(items.select("item_id", "size", "iw")), ["item_id", "size"])
    checked = compute_once(checked, [_shingles("win").alias("a"), _shingles("iw").alias("b")], ["size", "content", "item_id", "distance"])
    checked = compute_once(checked, [similarity("a", "b").alias("similarity")], ["size", "content", "item_id", "distance"])
    true = checked.filter(F.col("similarity") >= threshold).groupBy("size", "content", "item_id").agg(
        F.max("similarity").alias("similarity"), F.min("distance").alias("distance"))
    hits = windows.join(true, ["size", "content"]).withColumn("best", F.struct("similarity", (-F.col("start")).alias("s"), "distance", F.size("win").alias("n_words")))
    return hits.groupBy("doc_id", "item_id").agg(F.max("best").alias("best")).select(
        "doc_id", "item_id", (-F.col("best.s")).cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"),
        F.col("best.similarity").alias("similarity"), F.col("best.distance").cast("int").alias("distance"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs`, all columns, that hold no benchmark item; a null doc_id is compared like any value."""
    hits = materialize(contaminations(docs, benchmark, threshold).select(F.col("doc_id").alias("__doc")).distinct(), "hits")
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["__doc"]), "left_anti")
