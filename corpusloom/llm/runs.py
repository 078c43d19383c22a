"""Problem 3: runs of equal or nearly equal consecutive speech units.

Only boundaries are kept: the frames that neither equal nor nearly equal their predecessor. Each
start is then led by the next one; the difference of positions is the run's number of frames, and
the end of the previous frame before the next start its duration. Rows keep their frames
together, so there is no shuffle; a batch of rows is one vectorized pass over its flat units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.lists import as_lists, differs, run_starts

#: Two units are nearly equal if their vectors are less than this apart.
NEAR = 0.25
#: Seconds of a frame.
FRAME_S = 0.02
#: The shortest stretch that counts as a case.
MIN_FRAMES = 5
#: Pairs of nearly equal units beyond this number are not sent to the workers (16 bytes each).
MAX_PAIRS = 5_000_000
#: Coordinates whose cells bring units together.
CELL_AXES = 3


def near_units(centroids: DataFrame, near: float = NEAR, axes: int = CELL_AXES) -> DataFrame:
    """(a, b), a < b, of the units whose vectors are less than ``near`` apart.

    Candidates meet in cells of the first coordinates (own and next cells), so that no cross
    join is needed. Null vectors are near nothing; of repeated clusters each vector counts.
    """
    cell = [F.floor(F.coalesce(F.get("vec", F.lit(i)), F.lit(0.0)) / near).alias(f"x{i}") for i in range(axes)]
    cells = centroids.filter("cluster is not null and vec is not null").select(F.col("cluster").alias("c"), "vec", *cell)
    other = cells.select(F.col("c").alias("d"), F.col("vec").alias("w"), *[F.col(f"x{i}") for i in range(axes)])
    for i in range(axes):
        other = other.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"x{i}", F.col(f"x{i}") + F.col("step")).drop("step")
    gap = F.aggregate(F.zip_with("vec", "w", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda a, x: a + x)
    meet = cells.join(other, [f"x{i}" for i in range(axes)]).filter(F.col("c") < F.col("d"))
    return meet.filter(F.sqrt(gap) < near).select(F.col("c").alias("a"), F.col("d").alias("b")).distinct()


def _pairs(centroids: DataFrame, near: float) -> np.ndarray:
    """The pairs of nearly equal units as sorted numbers, a in the upper and b in the lower half."""
    rows = near_units(centroids, near).limit(MAX_PAIRS + 1).toArrow()
    if rows.num_rows > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of nearly equal units")
    a, b = (rows.column(c).to_numpy().astype(np.int64) for c in "ab")
    return np.sort(a << 32 | b)


def _runs(lists: pa.Array, pairs: np.ndarray) -> tuple[pa.Array, tuple[np.ndarray, ...]]:
    """The flat units, and ``run_starts`` of the frames that neither equal nor nearly equal the one before."""
    units = lists.flatten()
    begins = differs(units)
    if len(pairs) and len(units) > 1:
        at = np.flatnonzero(begins[1:]) + 1
        here, last = (pc.fill_null(units.take(pa.array(x)), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (at, at - 1))
        low, high = np.minimum(here, last), np.maximum(here, last)
        key = low << 32 | high
        near = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key
        begins[at[near & (low >= 0)]] = False
    return units, run_starts(lists, begins)


def _mapped(aligned: DataFrame, centroids: DataFrame, near: float, made: Callable, schema: str) -> DataFrame:
    pairs = _pairs(centroids, near)
    rows = aligned.select("_row_idx", F.col("speech_tokens").cast("array<int>").alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield made(batch.column(0), *_runs(batch.column(1), pairs))

    return rows.mapInArrow(run, f"_row_idx {rows.schema['_row_idx'].dataType.simpleString()}, {schema}")


def found(aligned: DataFrame, centroids: DataFrame, near: float = NEAR, min_frames: int = MIN_FRAMES) -> DataFrame:
    """(_row_idx, first_frame, last_frame) of the stretches of at least ``min_frames``; both ends belong to them.

    Null and empty token lists have no stretch. A null unit equals a null unit and is near none;
    units without a vector are near none.
    """

    def long(ids: pa.Array, units: pa.Array, runs: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        number, _, first, last = runs
        kept = last - first + 1 >= min_frames
        row = np.repeat(np.arange(len(ids)), number)[kept]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(first[kept], pa.int32()), pa.array(last[kept], pa.int32())], names=["_row_idx", "first_frame", "last_frame"])

    return _mapped(aligned, centroids, near, long, "first_frame int, last_frame int")


def collapse(aligned: DataFrame, centroids: DataFrame, near: float = NEAR, frame_s: float = FRAME_S) -> DataFrame:
    """(_row_idx, units, frames, start_s, duration_s): each run as its first unit, with count, start and duration.

    One row for every input row; the arrays are empty for null or empty token lists.
    """

    def runs_of(ids: pa.Array, units: pa.Array, runs: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        number, starts, first, last = runs
        columns = [units.take(pa.array(starts)), pa.array(last - first + 1, pa.int32()), pa.array(np.round(first * frame_s, 6)), pa.array(np.round((last + 1) * frame_s - first * frame_s, 6))]
        return pa.RecordBatch.from_arrays([ids, *[as_lists(number, c) for c in columns]], names=["_row_idx", "units", "frames", "start_s", "duration_s"])

    return _mapped(aligned, centroids, near, runs_of, "units array<int>, frames array<int>, start_s array<double>, duration_s array<double>")
