"""CTC paths, segments, token spans and forced alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.constants import BLANK
from corpusloom.functions.lists import merge_repeats

SEGMENT = "struct<label:string,start:int,end:int>"
#: Rows aligned together, and frames x states of them that are held; a row beyond that is aligned alone.
ROWS_AT_ONCE, STATES_AT_ONCE = 64, 40_000_000


def merge_repeats_long(frames: DataFrame, key: str, position: str, label: str, slice_rows: int = 100_000) -> DataFrame:
    """``merge_repeats`` for a frame table (key, position, label): one row (key, label, start, end) for each run.

    A key's frames are compared in slices of positions, and a small table with one row for each
    slice carries the last label, the last position and the next start over the slices' edges; so a
    key of any size spreads over tasks. Positions are whole numbers and need not be dense.
    """
    f = frames.select(F.col(key).alias("k"), F.col(position).alias("p"), F.col(label).alias("l"), F.floor(F.col(position) / slice_rows).alias("s"))
    inside, along = Window.partitionBy("k", "s").orderBy("p"), Window.partitionBy("k").orderBy("s")
    slices = f.groupBy("k", "s").agg(F.max_by(F.struct("l"), "p").alias("last"), F.max("p").alias("most"))
    edges = slices.select("k", "s", F.lag("last").over(along).alias("before"), F.lag("most").over(along).alias("before_p"), F.max("most").over(Window.partitionBy("k")).alias("final"))
    told = f.withColumn("prev", F.lag(F.struct("l")).over(inside)).withColumn("prev_p", F.lag("p").over(inside))
    told = told.alias("t").join(edges.alias("e"), F.expr("t.k <=> e.k and t.s = e.s")).select("t.*", "before", "before_p", "final")
    told = told.withColumn("prev", F.coalesce("prev", "before")).withColumn("prev_p", F.coalesce("prev_p", "before_p"))
    starts = told.filter(F.col("prev").isNull() | ~F.col("prev.l").eqNullSafe(F.col("l")))
    firsts = starts.groupBy("k", "s").agg(F.min_by("prev_p", "p").alias("first_prev"))
    later = Window.partitionBy("k").orderBy("s").rowsBetween(1, Window.unboundedFollowing)
    nexts = slices.alias("a").join(firsts.alias("b"), F.expr("a.k <=> b.k and a.s = b.s"), "left").select("a.k", "a.s", "first_prev")
    nexts = nexts.select("k", "s", F.first("first_prev", ignorenulls=True).over(later).alias("next_prev"))
    led = starts.withColumn("until", F.lead("prev_p").over(inside))
    out = led.alias("a").join(nexts.alias("b"), F.expr("a.k <=> b.k and a.s = b.s"))
    return out.select(F.col("a.k").alias(key), F.col("l").alias(label), F.col("p").alias("start"), F.coalesce("until", "next_prev", "final").alias("end"))


def with_token_spans(df: DataFrame, tokens: str, segments: str) -> DataFrame:
    """``df`` with ``spans`` and ``error``.

    ``tokens`` are spelled with spaces, ``segments`` the runs of the path. A token spans from its
    first to its last letter's segment; an empty token stands at the last segment of the token
    before. A blank before or after is shared with the neighbour token at its middle (rounded
    down), the outer blanks go to the first and last token whole. A span is (start, end) in frames.
    Rows whose letters and segments don't match, or whose first token is empty, get an ``error``
    and null spans. Explode the spans with ``posexplode_outer``: for a plain ``posexplode`` the
    optimizer derives a filter on their number and evaluates the steps below again for each element.
    """
    token, segment = F.col(tokens), F.col(segments)
    spelled = F.transform(token, lambda t: F.filter(F.split(t, " "), lambda c: c != ""))
    counts = F.transform("_spelled", lambda s: F.size(s))
    sung = F.filter(F.transform(segment, lambda s, i: F.struct(i.alias("i"), s["label"].alias("label"))), lambda s: s["label"] != BLANK)
    step1 = df.withColumn("_spelled", spelled).withColumn("_counts", counts).withColumn("_sung", sung)
    ends = F.transform("_counts", lambda c, i: F.aggregate(F.slice("_counts", 1, i + 1), F.lit(0), lambda a, x: a + x))
    step2 = step1.withColumn("_until", ends)
    at = lambda k: F.get("_sung", k)["i"]
    intervals = F.transform("_until", lambda u, i: F.struct(
        F.when(F.get("_counts", i) > 0, at(u - F.get("_counts", i))).otherwise(at(u - 1)).alias("first"), at(u - 1).alias("last")))
    step3 = step2.withColumn("_intervals", intervals)

    def span(interval: Column, i: Column) -> Column:
        first, last = F.get(segments, interval["first"]), F.get(segments, interval["last"])
        before, after = F.get(segments, interval["first"] - 1), F.get(segments, interval["last"] + 1)
        middle = lambda b: F.floor((b["start"] + b["end"]) / 2).cast("int")
        start = F.when((interval["first"] > 0) & (before["label"] == BLANK), F.when(i == 0, before["start"]).otherwise(middle(before))).otherwise(first["start"])
        end = F.when(after["label"] == BLANK, F.when(i == F.size("_intervals") - 1, after["end"]).otherwise(middle(after))).otherwise(last["end"])
        return F.struct(start.alias("start"), end.alias("end"))

    letters = F.flatten("_spelled")
    error = (
        F.when(token.isNull() | segment.isNull() | (F.size(token) == 0), "no tokens")
        .when(F.get("_counts", F.lit(0)) == 0, "first token is empty")
        .when(~letters.eqNullSafe(F.transform("_sung", lambda s: s["label"])), "letters and segments differ")
    )
    out = step3.withColumn("error", error).withColumn("spans", F.when(F.col("error").isNull(), F.transform("_intervals", span)))
    return out.drop("_spelled", "_counts", "_sung", "_until", "_intervals")


def span_times(spans: Column, stride_ms: Column) -> Column:
    """(start_s, end_s) of spans in frames."""
    return F.transform(spans, lambda s: F.struct((s["start"] * stride_ms / 1000).alias("start_s"), (s["end"] * stride_ms / 1000).alias("end_s")))


def viterbi(emissions: np.ndarray, targets: list[int], blank: int = 0) -> list[int]:
    """The best label for each frame that spells ``targets`` with blanks between; ties prefer to stay.

    The states are blank, y1, blank, y2, ..., blank; a blank between different labels may be passed over.
    """
    _require_feasible(emissions, targets)
    return _paths([emissions], [targets], blank)[0].tolist()


def _require_feasible(emissions: np.ndarray, targets: list[int]) -> None:
    frames = len(emissions)
    if not frames or frames < len(targets) + sum(a == b for a, b in zip(targets, targets[1:])):
        raise ValueError("more targets than frames")
    if targets and not 0 <= min(targets) <= max(targets) < emissions.shape[1]:
        raise IndexError("a target is no label of the emissions")


def _paths(emissions: list[np.ndarray], targets: list[list[int]], blank: int) -> list[np.ndarray]:
    """The best paths of several rows, one frame of all of them at a time.

    Blank k (state 2k) and letter k (state 2k + 1) are kept apart, since only letters may be reached
    by passing over a blank. Rows stand longest first, so that those with a frame t are the first
    ones; at each frame only states that can be reached, and from which an end can be, are looked at.
    """
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    frames, letters = np.array([len(emissions[i]) for i in order]), np.array([len(targets[i]) for i in order])
    most, rows, n, width = int(frames[0]), len(order), int(letters.max()), max(e.shape[1] for e in emissions)
    told, y = np.zeros((most, rows, width)), np.full((rows, n), blank)
    for r, i in enumerate(order):
        told[: frames[r], r, : emissions[i].shape[1]] = emissions[i]
        y[r, : letters[r]] = targets[i]
    place = y + width * np.arange(rows)[:, None]
    skip = np.full((rows, n), -np.inf)
    skip[:, 1:][y[:, 1:] != y[:, :-1]] = 0
    blanks, sung = np.full((rows, n + 1), -np.inf), np.full((rows, n + 1), -np.inf)  # letter k is at k + 1 of sung
    blanks[:, 0] = told[0, :, blank]
    if n:
        sung[:, 1] = told[0].ravel()[place[:, 0]]
    came = np.zeros((most, rows, 2 * n + 1), dtype=np.int8)
    moved = came.view(bool)
    active = np.searchsorted(-frames, -np.arange(most))
    least = np.minimum.accumulate(2 * letters + 1 - 2 * frames)
    for t in range(1, most):
        m = active[t]
        lo, hi, end = max(0, int(least[m - 1]) + 2 * t) // 2, min(n, t + 1), min(n + 1, t + 1)
        before, here = sung[:m, lo:end], blanks[:m, lo:end]
        stay, step = sung[:m, lo + 1 : hi + 1], blanks[:m, lo:hi]
        over = sung[:m, lo:hi] + skip[:m, lo:hi]
        stepped, best = step > stay, np.maximum(stay, step)
        skipped = over > best  # the first of equal ones
        np.maximum(best, over, out=best)
        np.maximum(stepped.view(np.int8), skipped.view(np.int8) * np.int8(2), out=came[t, :m, 2 * lo + 1 : 2 * hi : 2])
        np.greater(before, here, out=moved[t, :m, 2 * lo : 2 * end - 1 : 2])
        np.maximum(here, before, out=here)
        here += told[t, :m, blank, None]
        np.add(best, told[t].ravel().take(place[:m, lo:hi]), out=stay)
    each = np.arange(rows)
    state = 2 * letters - (blanks[each, letters] < sung[each, letters])
    states, first = np.zeros((most, rows), dtype=np.int64), each * (2 * n + 1)
    for t in range(most - 1, -1, -1):
        s = state[: active[t]]
        states[t, : len(s)] = s
        s -= came[t].ravel().take(first[: len(s)] + s)
    names = np.full((rows, 2 * n + 1), blank, dtype=np.int32)
    names[:, 1::2] = y
    labels = names[each, states]
    out: list[np.ndarray] = [labels[:0, 0]] * rows
    for r, i in enumerate(order):
        out[i] = labels[: frames[r], r]
    return out


def _matrix(row: pa.Scalar) -> np.ndarray | None:
    """Frames x labels of a nested list; None if null or empty."""
    if not row.is_valid or not len(row.values):
        return None
    inner = row.values
    widths = inner.value_lengths().to_numpy(zero_copy_only=False)
    if (widths != widths[0]).any():
        raise ValueError("frames with different labels")
    return inner.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(inner), -1)


def align(df: DataFrame, key: str, emissions: str, targets: str, blank: int = 0, emit: Callable[[object, object], np.ndarray | None] | None = None, scores: bool = False) -> DataFrame:
    """(key, path, error): the best path of each row; rows that cannot be aligned have an error and no path.

    ``scores`` adds the probability of each label of the path in its frame.

    With ``emit``, the worker makes a row's emissions (frames x labels) from the key and the column
    ``emissions``, so that they never pass through the plan.
    """
    rows = df.select(key, emissions, targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, errors, sure = [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            spelled = batch.column(2)
            held: list[tuple[int, np.ndarray, list[int]]] = []
            frames = letters = 0

            def settle() -> None:
                for (i, e, _), path in zip(held, _paths([e for _, e, _ in held], [y for _, _, y in held], blank) if held else ()):
                    paths[i] = path
                    sure[i] = np.exp(e[np.arange(len(e)), path]) if scores else None
                held.clear()

            # rows of about as many letters together
            for i in np.argsort(spelled.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), kind="stable").tolist():
                try:
                    y = spelled[i].as_py()
                    if not y:
                        raise ValueError("no tokens")
                    e = _matrix(batch.column(1)[i]) if emit is None else emit(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                    if e is None or not len(e):
                        raise ValueError("no emissions")
                    _require_feasible(e, y)
                except ValueError as x:
                    errors[i] = str(x)
                    continue
                frames, letters = (max(frames, len(e)), max(letters, len(y))) if held else (len(e), len(y))
                if held and (len(held) >= ROWS_AT_ONCE or (len(held) + 1) * frames * (2 * letters + 1) > STATES_AT_ONCE):
                    settle()
                    frames, letters = len(e), len(y)
                held.append((i, e, y))
            settle()
            columns = {key: batch.column(0), "path": pa.array(paths, pa.list_(pa.int32())), "error": pa.array(errors, pa.string())}
            if scores:
                columns["scores"] = pa.array(sure, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, path array<int>, error string" + (", scores array<double>" if scores else ""))


__all__ = ["SEGMENT", "align", "merge_repeats", "merge_repeats_long", "span_times", "viterbi", "with_token_spans"]
