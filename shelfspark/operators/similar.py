"""Similar products for a whole table of queries: an inverted file over trained centroids, exact scores within the lists that are probed.

Vectors are filed under their nearest centroid. A query looks into the lists of its nearest centroids only, and scores every
vector there by cosine. Probing all lists is the exact answer. Long lists are dealt over several tasks.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors that centroids are trained on at most, and vectors of a list that one task scores.
SAMPLE, BLOCK = 100_000, 20_000
#: Digits in which scores are compared, so that the order of additions decides nothing.
DIGITS = 9


@dataclass(frozen=True)
class Index:
    """lists: id, vector, list, block of every vector, stored; sizes: blocks of each list; centres: one row per list, of length one."""

    lists: DataFrame
    sizes: dict[int, int]
    centres: np.ndarray


def _units(column: pa.Array) -> np.ndarray:
    """A list column of vectors as rows of length one."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(rows):
        return np.zeros((0, 0))
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def usable_vectors(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector of the rows that can be compared: an id, no null or infinite component, not all zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_).cast("long").alias("id"), v.alias("vector")).filter(
        F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def build_index(vectors: DataFrame, lists: int, seed: int = 1, sample: int = SAMPLE, block: int = BLOCK) -> Index:
    """File (id, vector) under `lists` centroids, which k-means finds on `sample` vectors at most, those with the smallest hash.

    All vectors need one length. Every vector is filed; without any the index is empty.
    """
    taken = vectors.orderBy(F.xxhash64("id"), "id").limit(sample)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    units = taken.select(array_to_vector(F.transform("vector", lambda x: x / length)).alias("features"))
    units = materialize(units, "sample")
    if units.isEmpty():
        shape = "id long, vector array<double>, list int, block int"
        return Index(vectors.sparkSession.createDataFrame([], shape), {}, np.zeros((0, 0)))
    found = KMeans(k=lists, seed=seed, maxIter=10, featuresCol="features").fit(units).clusterCenters()
    centres = np.array(found, np.float64)
    centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-300)

    def file(batches):
        for batch in batches:
            nearest = (_units(batch.column("vector")) @ centres.T).argmax(axis=1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], ["id", "vector", "list"])

    filed = materialize(vectors.select("id", "vector").mapInArrow(file, "id long, vector array<double>, list int"), "filed")
    sizes = {r.list: -(-r.n // block) for r in filed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}      # one row per list
    blocks = F.get(F.array(*[F.lit(sizes.get(i, 1)) for i in range(len(centres))]), F.col("list"))
    return Index(filed.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")), sizes, centres)


def similar(queries: DataFrame, index: Index, k: int, probes: int | None = None) -> DataFrame:
    """query_id, rank, id, score: the `k` vectors most alike to each of `queries` (id, vector) by cosine, the query's own id left out.

    `probes` lists are looked into per query; None looks into all, which is exact. Scores are rounded to DIGITS, ties go to the
    smaller id. A query whose lists hold fewer vectors has fewer rows.
    """
    centres, sizes = index.centres, index.sizes
    shape = "query_id long, rank int, id long, score double"
    if not len(centres):
        return queries.sparkSession.createDataFrame([], shape)
    filled = np.array(sorted(sizes))

    def probe(batches):
        for batch in batches:
            near = np.argsort(-(_units(batch.column("vector")) @ centres[filled].T), axis=1, kind="stable")[:, :probes] if len(batch) else np.zeros((0, 1), int)
            rows = [(i, int(b)) for i, own in enumerate(filled[near]) for b in own]
            rows = [(i, b, part) for i, b in rows for part in range(sizes[b])]
            at, lists, parts = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), batch.column("vector").take(pa.array(at)), pa.array(lists.astype(np.int32)), pa.array(parts.astype(np.int32))],
                ["id", "vector", "list", "block"])

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [[], [], []]
        if asked.num_rows and held.num_rows:
            ids, members = held.column("id").to_numpy(), _units(held.column("vector"))
            for lo in range(0, asked.num_rows, 256):
                some = asked.slice(lo, 256)
                scores = np.round(_units(some.column("vector")) @ members.T, DIGITS)
                for q, row in zip(some.column("id").to_numpy(), scores):
                    others = np.flatnonzero(ids != q)
                    if len(others) > k:
                        least = np.partition(row[others], -k)[-k]
                        others = others[row[others] >= least]
                    best = others[np.lexsort((ids[others], -row[others]))][:k]
                    for column, values in zip(out, (np.full(len(best), q), ids[best], row[best])):
                        column.append(values)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([columns[0].astype(np.int64), columns[1].astype(np.int64), columns[2].astype(np.float64)], names=["query_id", "id", "score"])

    asked = queries.select("id", "vector").mapInArrow(probe, "id long, vector array<double>, list int, block int")
    parts = asked.groupBy("list", "block").cogroup(index.lists.groupBy("list", "block")).applyInArrow(score, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
