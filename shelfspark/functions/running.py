"""Ranks and running totals over all rows without gathering them: counts per page first, then totals over pages."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rows_before(counts: DataFrame, by: list[str], outer: str, inner: str) -> DataFrame:
    """`counts` (by, outer, inner, n) plus `before`: the rows ahead of each count in (outer, inner) order within `by`.

    One total per `outer` value comes first, so no window holds more than one value's inner rows or all outer totals.
    """
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy(*by, outer).agg(F.sum("n").alias("n"))
    totals = totals.select(*by, outer, ahead(Window.partitionBy(*by).orderBy(outer)).alias("_ahead"))
    same = [counts[c].eqNullSafe(totals[c]) for c in [*by, outer]]
    within = ahead(Window.partitionBy(*[counts[c] for c in [*by, outer]]).orderBy(counts[inner]))
    return counts.join(totals, same).select(*[counts[c] for c in counts.columns], (F.col("_ahead") + within).alias("before"))


def first_in_order(keys: DataFrame, by: list[str], n: int) -> DataFrame:
    """Of each `by` the first `n` rows by (_outer, _inner, _order), all columns plus `rank` where it was needed, else null.

    Pages that fit whole are taken as they are; only rows of the page in which the n-th falls are ranked.
    """
    page = [*by, "_outer", "_inner"]
    counts = keys.groupBy(*page).agg(F.count(F.lit(1)).alias("n"))
    placed = rows_before(counts, by, "_outer", "_inner").filter(F.col("before") < n)
    joined = keys.join(placed.select(*page, (F.lit(n) - F.col("before")).alias("_room"), F.col("n").alias("_size")), page)
    whole = joined.filter("_size <= _room").withColumn("rank", F.lit(None).cast("int"))
    rank = F.row_number().over(Window.partitionBy(*page).orderBy("_order"))
    cut = joined.filter("_size > _room").withColumn("rank", rank).filter("rank <= _room")
    return whole.unionByName(cut).drop("_room", "_size")


def nth_in_order(keys: DataFrame, by: list[str], n: int) -> DataFrame:
    """Of each `by` the n-th row by (_outer, _inner, _order); none where there are fewer."""
    page = [*by, "_outer", "_inner"]
    counts = keys.groupBy(*page).agg(F.count(F.lit(1)).alias("n"))
    placed = rows_before(counts, by, "_outer", "_inner").filter((F.col("before") < n) & (F.col("before") + F.col("n") >= n))
    joined = keys.join(placed.select(*page, (F.lit(n) - F.col("before")).alias("_nth")), page)
    rank = F.row_number().over(Window.partitionBy(*page).orderBy("_order"))
    return joined.withColumn("_rank", rank).filter("_rank = _nth").drop("_rank", "_nth")
