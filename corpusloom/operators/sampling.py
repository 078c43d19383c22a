"""Samples, shards and blocks in manifest order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import ROW, SEED
from corpusloom.operators.ranking import with_position, with_rank

#: Rows of a stratum that are ranked together.
SLICE = 500_000


def parse_size(text: str) -> int | float:
    """A sample size as given on a command line: a whole number or a fraction."""
    try:
        return int(text)
    except ValueError:
        return float(text)


def sample_size(size: int | float, n: int) -> int:
    """``size`` itself, or that fraction of ``n`` rounded down."""
    if isinstance(size, bool) or not isinstance(size, (int, float)):
        raise TypeError("the sample size is a whole number or a fraction")
    return size if isinstance(size, int) else int(size * n)


def stratified_sample(df: DataFrame, stratum: str, size: int | float, shuffle: bool = False, seed: int = SEED) -> DataFrame:
    """``size`` rows, as even over the strata as their sizes allow.

    Small strata are taken whole; the others share the rest, the larger ones (by size, then name)
    getting the odd rows. A stratum gives its first rows in manifest order, or with ``shuffle``
    those with the least hashes. Only the counts of counts come to the driver, at most the square
    root of twice the rows. Null is a stratum like others. The size has to be below the rows.
    """
    name = F.col(stratum)
    strata = df.groupBy(name.alias("_s")).agg(F.count(F.lit(1)).alias("_cnt"))
    levels = sorted((r["_cnt"], r["k"]) for r in strata.groupBy("_cnt").agg(F.count(F.lit(1)).alias("k")).collect())
    total, number = sum(c * k for c, k in levels), sum(k for _, k in levels)
    left = sample_size(size, total)
    if left >= total:
        raise ValueError("the sample has to be smaller than the data")
    # whole strata, from the smallest, while each finds its size in an even share of what is left
    whole, done = 0, 0
    for count, k in levels:
        if count * (number - done) > left:
            break
        whole, left, done = count, left - count * k, done + k
    share, odd = divmod(left, number - done) if number > done else (0, 0)
    # the largest `odd` strata get one more: all above a count, and the last by name at that count
    edge, among = None, odd
    for count, k in reversed(levels):
        if among <= k:
            edge = count
            break
        among -= k
    take = F.when(F.col("_cnt") <= whole, F.col("_cnt")).otherwise(F.lit(share))
    if odd:
        last = strata.filter(F.col("_cnt") == edge).orderBy(F.desc_nulls_last("_s")).limit(among).select(F.col("_s").alias("_e"), F.lit(1).alias("_extra"))
        strata = strata.join(last, F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e")
        take = take + F.when(F.col("_cnt") > whole, F.when(F.col("_cnt") > edge, 1).otherwise(F.coalesce("_extra", F.lit(0)))).otherwise(0)
    quota = strata.select("_s", take.alias("_take"), F.greatest(F.lit(1), F.floor(F.col("_cnt") / SLICE)).cast("bigint").alias("_buckets")).filter("_take > 0")
    joined = df.join(quota, name.eqNullSafe(F.col("_s"))).drop("_s")
    if shuffle:
        unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), ROW), 11) / F.lit(float(1 << 53))
    else:
        unit = F.col(ROW) / (df.agg(F.max(ROW)).first()[0] + 1)
    ranked = with_rank(joined.withColumn("_unit", unit), [stratum], "_unit", "_buckets", [ROW])
    return ranked.filter("rank < _take").select(*df.columns)


def round_half_even(x: Column) -> Column:
    return F.bround(x).cast("bigint")


def shard_range(total: int, shards: int, rank: int) -> tuple[int, int]:
    """[start, end) of a shard, bounds rounded half to even; an empty range raises."""
    if not 0 <= rank < shards:
        raise ValueError(f"shard {rank} is not in 0..{shards - 1}")
    start, end = round(total / shards * rank), round(total / shards * (rank + 1))
    if start >= end:
        raise ValueError(f"shard {rank} of {shards} is empty")
    return start, end


def in_shard(df: DataFrame, total: int, shards: int, rank: int) -> DataFrame:
    """The rows of a shard by their places in the manifest, of which there are ``total``."""
    start, end = shard_range(total, shards, rank)
    placed = with_position(df)
    return placed.filter((F.col("_position") >= start) & (F.col("_position") < end)).drop("_position")


def shard_bounds(df: DataFrame, shards: int) -> DataFrame:
    """(rank, first, until) of all shards of a table."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    bound = lambda r: round_half_even(F.col("n") / shards * r)
    return total.select("n", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("rank")).select("rank", bound(F.col("rank")).alias("first"), bound(F.col("rank") + 1).alias("until"))


def shard_number(df: DataFrame, size: int | None = None, shards: int | None = None) -> DataFrame:
    """``df`` with ``shard``: contiguous pieces of ``size`` rows, or of the size that makes at most ``shards``."""
    if (size is None) == (shards is None):
        raise ValueError("give either the size or the number of shards")
    if size is None:
        size = max(1, math.ceil(df.count() / shards))
    return with_position(df).withColumn("shard", F.floor(F.col("_position") / size).cast("int")).drop("_position")


def block_number(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with the number of its output block, by the places of the rows in the manifest."""
    return with_position(df).withColumn("block", F.floor(F.col("_position") / rows).cast("int")).drop("_position")


def subsample(df: DataFrame, share: float, shard: str, key: str, seed: int = SEED) -> DataFrame:
    """Of each shard the ceil(share x n) rows with the least hashes; all for a negative share."""
    if share > 1:
        raise ValueError("the share is at most 1")
    if share < 0:
        return df
    sizes = df.groupBy(F.col(shard).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_s", F.ceil(F.col("_n") * share).alias("_take"), F.greatest(F.lit(1), F.floor(F.col("_n") / SLICE)).cast("bigint").alias("_buckets"))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))
    joined = df.join(sizes, F.col(shard).eqNullSafe(F.col("_s"))).drop("_s").withColumn("_unit", unit)
    return with_rank(joined, [shard], "_unit", "_buckets", [key]).filter("rank < _take").select(*df.columns)
