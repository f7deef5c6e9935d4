"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt over shards of a bounded size. Every query first meets one shard, which gives it a k-th score; that
score goes along to all other shards, where nodes are taken in the order of their upper bound (the product with the
centre plus radius times length) until no bound reaches the k-th score. Queries travel in blocks.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 16384
LEAF = 512               # large enough that one product pays for the step; vectors without clusters are pruned little anyway
QUERY_BLOCK = 8192
_LOWEST = np.iinfo(np.int64).min


class BallTree:
    """Balls over the rows of an integer matrix; children of a node split it at the median along its widest direction."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        points = vectors.astype(np.float64)
        self.lo, self.hi, self.left, self.right, centres, radii = [], [], [], [], [], []
        stack = [(0, len(ids), -1, False)]
        while stack:
            lo, hi, parent, is_right = stack.pop()
            own = points[order[lo:hi]]
            centre = own.mean(axis=0)
            node = len(self.lo)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            distance = np.sqrt(((own - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(distance.max())
            for column, value in ((self.lo, lo), (self.hi, hi), (self.left, -1), (self.right, -1)):
                column.append(value)
            if hi - lo > LEAF and radii[-1] > 0:
                along = own @ (own[distance.argmax()] - centre)
                order[lo:hi] = order[lo:hi][np.argsort(along, kind="stable")]
                middle = (lo + hi) // 2
                stack += [(lo, middle, node, False), (middle, hi, node, True)]
        self.vectors, self.ids, self.points = vectors[order], ids[order], points[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.largest = float(np.abs(points).max(initial=0.0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """queries x nodes: an upper bound of the products with a node's vectors, rounding included."""
        q = queries.astype(np.float64)
        length = np.sqrt((q**2).sum(axis=1))[:, None]
        bound = q @ self.centres.T + length * self.radii
        return bound + 1e-9 * (np.abs(bound) + self.largest * length + 1)

    def products(self, node: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of a node."""
        own = slice(self.lo[node], self.hi[node])
        most = self.largest * float(np.abs(query).max(initial=0)) * len(query)
        if most < 2**53:
            return self.ids[own], (self.points[own] @ query.astype(np.float64)).astype(np.int64)
        if most < 2**62:
            return self.ids[own], self.vectors[own] @ query
        exact = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in self.vectors[own]]
        return self.ids[own], np.array([min(max(x, _LOWEST), -_LOWEST - 1) for x in exact], np.int64)

    def search(self, query: np.ndarray, bound: np.ndarray, k: int, floor: int, own_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best that reach `floor`, best bound first; ties to the smaller id; `own_id` takes no part."""
        ids, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), floor
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            if self.left[node] < 0:
                found, value = self.products(node, query)
                keep = (value >= least) & (found != own_id)
                ids, scores = np.concatenate([ids, found[keep]]), np.concatenate([scores, value[keep]])
                if len(ids) > k:
                    by = np.lexsort((ids, ~scores))[:k]
                    ids, scores = ids[by], scores[by]
                if len(ids) == k:
                    least = max(least, int(scores.min()))
            else:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (-bound[child], child))
        return ids, scores


def integer_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (array<long>): floor(scale * x) of each component; vectors null or with null or non-finite components are left out."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return vectors.filter(usable & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks()
    if len(np.unique(np.diff(lists.offsets.to_numpy()))) > 1:
        raise ValueError("vectors differ in length")
    return lists.flatten().to_numpy().astype(np.int64).reshape(len(lists), -1)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searcher(k: int):
    def search(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        tree = BallTree(_matrix(vectors.column("v")), vectors.column("vec_id").to_numpy())
        asked, out = _matrix(queries.column("q")), []
        bounds = tree.bounds(asked)
        for q, bound, query_id, floor in zip(asked, bounds, queries.column("query_id").to_pylist(), queries.column("floor").to_pylist()):
            ids, scores = tree.search(q, bound, k, _LOWEST if floor is None else floor, query_id)
            out.append((np.full(len(ids), query_id), ids, scores))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=_FOUND)

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors with the largest integer inner product for each query.

    `vectors` (vec_id, v) and `queries` (query_id, v) hold integer vectors of one length; other columns are ignored, and vectors of
    another length than the most common one are an error. A query's own vec_id is no candidate; ties go to the smaller
    vec_id; fewer than k vectors give fewer rows; repeated vec_ids count as often as they occur. Scores beyond 64 bits are
    held at the limit.
    """
    vectors, queries = vectors.select("vec_id", "v"), queries.select(F.col("query_id").alias("query_id"), F.col("v").alias("q"))
    n = vectors.count()
    shards = max(1, -(-n // shard))
    blocks = max(1, -(-n // (20 * QUERY_BLOCK)))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = queries.withColumn("home", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("floor", F.lit(None).cast("long"))
    search = _searcher(k)

    def pairs(side: DataFrame) -> DataFrame:
        return dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block").cogroup(
            side.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).groupBy("shard", "block")
        ).applyInArrow(search, "query_id long, vec_id long, score long")

    home = pairs(asked.withColumn("shard", F.col("home")))
    from ..plans.scratch import materialize

    home = materialize(home, "home")
    floors = home.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    floors = floors.filter(F.col("n") >= k).select("query_id", F.col("low").alias("floor"))
    others = asked.drop("floor").join(floors, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
    found = home.unionByName(pairs(others))
    # Each shard gave k rows of a query at most, so a query's rows are few.
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def top_k_embeddings(table: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """`top_k` of the rows whose vec_id is divisible by `every`, against all rows of a table (vec_id, embedding)."""
    vectors = integer_vectors(table)
    return top_k(vectors, vectors.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), k)
