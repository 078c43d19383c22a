"""Counts, quantiles and moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import tokenize

QUANTILES = (0.001, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999)


def group_counts(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Rows by key, most frequent first, then by key."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def file_type_counts(paths: DataFrame, column: str = "path") -> DataFrame:
    """Files by what follows the last dot; the whole name where there is none."""
    return group_counts(paths, F.substring_index(column, ".", -1), "file_type")


def distribution(df: DataFrame, value: Column, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """One row: n, mean, population deviation, and exact quantiles with linear interpolation."""
    # value counts come first, so that the exact quantiles work on distinct values only
    counted = df.select(value.cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("v", F.array(*map(F.lit, quantiles)), F.col("n"))
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("v") * F.col("v") * F.col("n")) / F.sum("n")
    out = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("deviation"), q.alias("q"))
    return out.select("n", "mean", "deviation", *[F.get("q", F.lit(i)).alias(f"q{str(p)[2:]}") for i, p in enumerate(quantiles)])


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """(bin, n) over [min, max] in equal bins from 0; the maximum belongs to the last one; empty bins are left out."""
    rows = df.select(value.cast("double").alias("v")).filter("v is not null")
    ends = rows.agg(F.min("v").alias("least"), F.max("v").alias("most"))
    width = (F.col("most") - F.col("least")) / bins
    at = F.when(F.col("most") > F.col("least"), F.least(F.floor((F.col("v") - F.col("least")) / width), F.lit(bins - 1))).otherwise(0)
    return rows.join(F.broadcast(ends)).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def token_count(text: Column) -> Column:
    return F.size(tokenize(text))


def moments(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, mean_i, mean_j, covariance): population covariance of the vectors' dimensions.

    Each task adds up one outer-product matrix, and d x d sums are shuffled, not n x d x d products.
    Null vectors are left out; vectors of another length than the first of a task raise.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, None, None
        for batch in batches:
            column = batch.column(0).drop_null()
            if not len(column):
                continue
            x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)
            n, total, outer = n + len(x), (0 if total is None else total) + x.sum(0), (0 if outer is None else outer) + x.T @ x
        if n:
            d = len(total)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": np.full(d * d, n), "a": total[i], "b": total[j], "c": outer.ravel()})

    sums = df.select(F.col(vector)).mapInArrow(partial, "i int, j int, n bigint, a double, b double, c double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nabc"])
    return sums.select("i", "j", (F.col("a") / F.col("n")).alias("mean_i"), (F.col("b") / F.col("n")).alias("mean_j"), (F.col("c") / F.col("n") - F.col("a") / F.col("n") * F.col("b") / F.col("n")).alias("covariance"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def distinct_ratios(one: DataFrame, two: DataFrame, key: str, samples: str, labels: str) -> DataFrame:
    """(ratio): the distinct numbers of samples for one label."""
    return one.select(key, samples).join(two.select(key, labels), key).select((F.col(samples) / F.size(labels)).alias("ratio")).distinct()
