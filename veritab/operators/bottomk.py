"""The k smallest hashes of each group, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Width of the zone around the expected k-th hash, in standard deviations.
SIGMAS = 8.0


def unit_hash(*columns: Column) -> Column:
    """A hash in [0, 1) with 53 bits."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11)).cast("double") / F.lit(float(1 << 53))


def bottom_k(rows: DataFrame, groups: list[str], k: str, size: str, hashed: str, tie: str) -> DataFrame:
    """Of each group keep exactly its ``k`` rows of smallest ``hashed`` (ties by ``tie``).

    ``k`` and ``size`` are columns with the wanted and the present number of rows
    of the row's group, ``hashed`` a uniform hash in [0, 1).  Rows well below the
    expected k-th hash are taken as they stand and only counted; only the zone of
    about 16 * sqrt(k) rows around it is ranked, so no task sorts a whole group.
    Where chance puts the k-th row outside the zone the group is ranked whole
    (below one in 10^14 for 8 standard deviations), so the result is always exact.
    A null ``k`` counts as 0; a group smaller than ``k`` is kept whole; groups may
    be null; an empty input gives an empty result.
    """
    wanted = F.least(F.coalesce(F.col(k), F.lit(0)), F.col(size)).cast("double")
    # margin for the count of hashes under a threshold; 10 more for small groups
    margin = F.lit(SIGMAS) * F.sqrt(wanted + 1) + F.lit(10.0)
    low, high = (wanted - margin) / F.col(size), (wanted + margin) / F.col(size)
    zoned = rows.where(wanted > 0).withColumn(
        "_bk_zone", F.when(F.col(hashed) < low, 0).when(F.col(hashed) <= high, 1).otherwise(2)
    )
    counts = zoned.groupBy(*groups).agg(
        F.sum((F.col("_bk_zone") == 0).cast("long")).alias("_bk_sure"),
        F.sum((F.col("_bk_zone") == 1).cast("long")).alias("_bk_near"),
        F.max(wanted).cast("long").alias("_bk_k"),
    )
    counts = counts.withColumn("_bk_whole", (F.col("_bk_sure") > F.col("_bk_k")) | (F.col("_bk_sure") + F.col("_bk_near") < F.col("_bk_k")))
    counts = counts.select(*[F.col(g).alias(f"_bk_g{i}") for i, g in enumerate(groups)], "_bk_sure", "_bk_k", "_bk_whole")
    same = None
    for i, g in enumerate(groups):
        one = zoned[g].eqNullSafe(counts[f"_bk_g{i}"])
        same = one if same is None else same & one
    joined = zoned.join(counts, same)
    sure = joined.where(~F.col("_bk_whole") & (F.col("_bk_zone") == 0)).select(*rows.columns)
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(hashed, tie))
    ranked = (
        joined.where(F.col("_bk_whole") | (F.col("_bk_zone") == 1))
        .withColumn("_bk_rank", rank)
        .where(F.col("_bk_rank") <= F.when(F.col("_bk_whole"), F.col("_bk_k")).otherwise(F.col("_bk_k") - F.col("_bk_sure")))
        .select(*rows.columns)
    )
    return sure.unionByName(ranked)
