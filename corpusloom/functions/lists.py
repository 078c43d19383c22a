"""Steps on whole Arrow batches of lists, on their flat values.

Where a step needs the neighbour of an element or running sums, Spark's higher-order functions take
positions one by one; here a batch is one vectorized pass. No value becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import SEED, SPAN_SHARE, SPAN_TOKENS


def sizes(lists: pa.Array) -> np.ndarray:
    """The length of each list; 0 for null."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Where each list begins in the flat values, and where the last one ends."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def as_lists(lengths: np.ndarray, values: pa.Array, valid: pa.Array | None = None) -> pa.Array:
    """Lists of these lengths over flat values; null where not ``valid``."""
    mask = None if valid is None or pc.all(valid).as_py() in (True, None) else pc.invert(valid)
    return pa.ListArray.from_arrays(pa.array(offsets(lengths), pa.int32()), values, mask=mask)


def each_distinct(lists: pa.Array, change: Callable[[str], str | None]) -> pa.Array:
    """Lists of strings with every string changed, each different one once; nulls stay."""
    found = lists.flatten().dictionary_encode()
    new = pa.array([None if x is None else change(x) for x in found.dictionary.to_pylist()], pa.string())
    return as_lists(sizes(lists), new.take(found.indices), lists.is_valid())


def differs(values: pa.Array) -> np.ndarray:
    """For each flat value whether it differs from the one before; null equals null, and the first one differs."""
    out = np.ones(len(values), dtype=bool)
    if len(values) > 1:
        here, last = values.slice(1), values.slice(0, len(values) - 1)
        if values.null_count:
            same = pc.or_(pc.fill_null(pc.equal(here, last), False), pc.and_(here.is_null(), last.is_null()))
        else:
            same = pc.equal(here, last)
        out[1:] = ~same.to_numpy(zero_copy_only=False)
    return out


def run_starts(lists: pa.Array, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of lists, given which flat values begin one (the first of a list always does).

    (runs of each list, flat position of each run's start, and first and last position in its list)
    """
    lengths = sizes(lists)
    at = offsets(lengths)
    begins = begins.copy()
    begins[at[:-1][lengths > 0]] = True
    starts = np.flatnonzero(begins)
    row = np.searchsorted(at, starts, side="right") - 1
    until = np.append(starts[1:], at[-1])
    return np.bincount(row, minlength=len(lengths)), starts, starts - at[row], until - 1 - at[row]


def merge_repeats(path: Column) -> Column:
    """Runs of equal labels of an array as (label, start, end) with inclusive ends; null stays null."""

    @F.arrow_udf("array<struct<label:string,start:int,end:int>>")
    def run(lists: pa.Array) -> pa.Array:
        values = lists.flatten()
        number, starts, first, last = run_starts(lists, differs(values))
        label = values.take(pa.array(starts)).cast(pa.string())
        made = pa.StructArray.from_arrays([label, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["label", "start", "end"])
        return as_lists(number, made, lists.is_valid())

    return run(path)


def unflatten(values: Column, lengths: Column) -> Column:
    """``values`` cut into pieces of ``lengths``; lengths that don't add up raise, null stays null.

    The element type has to be int, as of units and labels.
    """

    @F.arrow_udf("array<array<int>>")
    def run(lists: pa.Array, parts: pa.Array) -> pa.Array:
        valid = pc.and_(lists.is_valid(), parts.is_valid())
        lists, parts = pc.if_else(valid, lists, None), pc.if_else(valid, parts, None)
        pieces = parts.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = offsets(sizes(parts))
        ends = offsets(pieces)
        if (pieces < 0).any() or (ends[at[1:]] - ends[at[:-1]] != sizes(lists)).any():
            raise ValueError("the lengths don't add up")
        return as_lists(sizes(parts), as_lists(pieces, lists.flatten()), valid)

    return run(values, lengths)


@cache
def _drawn(power: int, n: int, p: float, seed: int) -> np.ndarray:
    return np.maximum(np.random.default_rng(seed).binomial(n, p, size=1 << power), 1).cumsum()


def boundaries(below: int, n: int = SPAN_TOKENS, p: float = SPAN_SHARE, seed: int = SEED) -> np.ndarray:
    """The inner boundaries of spans below a length. Every row draws the same sequence, so one serves all."""
    if below <= 0:
        return np.zeros(0, dtype=np.int64)
    drawn = _drawn(max(10, int(below - 1).bit_length()), n, p, seed)
    return drawn[: int(np.searchsorted(drawn, below))]


def span_boundaries(length: Column, seed: int = SEED) -> Column:
    """0, the inner boundaries below ``length``, ``length``; null stays null, and a negative length is one of null."""

    @F.arrow_udf("array<int>")
    def run(lengths: pa.Array) -> pa.Array:
        valid = pc.fill_null(pc.greater_equal(lengths, 0), False)
        n = pc.if_else(valid, lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        inner = boundaries(int(n.max(initial=0)), seed=seed)
        within = np.searchsorted(inner, n)  # boundaries below each length
        number = np.where(valid.to_numpy(zero_copy_only=False), within + 2, 0)
        at = offsets(number)
        place = np.arange(at[-1]) - np.repeat(at[:-1], number)
        flat = np.concatenate([[0], inner, [0]])[np.minimum(place, len(inner))]
        flat[at[1:][number > 0] - 1] = n[number > 0]
        return as_lists(number, pa.array(flat, pa.int32()), valid)

    return run(length)
