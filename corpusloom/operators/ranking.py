"""Row numbers in groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.constants import ROW

#: Row numbers that share a slice of a manifest.
SLICE = 500_000


def with_position(df: DataFrame, position: str = "_position", order: str = ROW, slice_rows: int = SLICE) -> DataFrame:
    """``df`` with the place from 0 of each row in manifest order, as if the manifest were read anew.

    ``order`` keeps the numbers of the manifest a row first came from, so filters leave gaps in it. One
    pass tells whether there are any; without gaps the numbers are the places already. Otherwise
    the rows are ranked in slices of numbers, shifted by the sizes of the slices before, of which
    there are the greatest number / ``slice_rows`` at most. The numbers have to be unique and not null.
    """
    n, least, most = df.agg(F.count(F.lit(1)), F.min(order), F.max(order)).first()
    if not n or most - least == n - 1:
        return df.withColumn(position, F.col(order) - F.lit(least or 0))
    sliced = df.withColumn("_slice", F.floor(F.col(order) / slice_rows).cast("bigint"))
    before, shifts = 0, []
    for r in sorted(sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()):
        shifts.append((r["_slice"], before))
        before += r["n"]
    table = df.sparkSession.createDataFrame(shifts, "_slice bigint, _shift bigint")
    within = Window.partitionBy("_slice").orderBy(order)
    return sliced.withColumn("_rn", F.row_number().over(within)).join(table, "_slice").withColumn(position, F.col("_shift") + F.col("_rn") - 1).drop("_slice", "_rn", "_shift")


def with_rank(df: DataFrame, keys: list[str], unit: str, buckets: str, ties: list[str], rank: str = "rank") -> DataFrame:
    """``df`` with the row number from 0 of each row among the rows of its ``keys``, by ``unit``.

    ``unit`` is a column in [0, 1), ``buckets`` a column with the number of slices in which a
    group is ranked (the same in all rows of a group). A slice is ranked by itself and shifted by
    the sizes of the slices before it, so that no group has to fit into one task. Ties of
    ``unit`` go by ``ties``.
    """
    sliced = df.withColumn("_slice", F.least(F.floor(F.col(unit) * F.col(buckets)), F.col(buckets) - 1).cast("bigint"))
    within = Window.partitionBy(*keys, "_slice").orderBy(unit, *ties)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        sliced.filter(F.col(buckets) > 1)
        .groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    # null keys are groups like others
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        sliced.withColumn("_rn", F.row_number().over(within) - 1)
        .join(shift, same, "left")
        .withColumn(rank, F.col("_rn") + F.coalesce("_shift", F.lit(0)))
        .drop("_rn", "_shift", "_slice", "_s", *[f"_k{i}" for i in range(len(keys))])
    )
