"""Emissions of long audio, window by window, and the scores of alignments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import EMISSION_CONTEXT_S, EMISSION_WINDOW_S, FRAMES_PER_SECOND, SAMPLE_RATE, STAR
from corpusloom.functions.lists import as_lists, differs, offsets, run_starts, sizes
from corpusloom.sources.files import read_lines

#: Tokens of an aligner's dictionary, which is held on the driver.
MAX_TOKENS = 100_000


def windows(samples: Column, rate: int = SAMPLE_RATE, window_s: int = EMISSION_WINDOW_S, context_s: int = EMISSION_CONTEXT_S) -> Column:
    """The windows in which audio of so many samples goes through a model, in order; null or no samples have none.

    Each is (first_sample, until_sample) of the model's input, which has the context on both sides, and
    (first_frame, until_frame) of the frames that are kept of its output, so that the kept frames of all
    windows are those of the audio, each once. ``until_frame`` may lie beyond the output.
    """
    step, margin = window_s * rate, context_s * rate
    starts = F.sequence(F.lit(0).cast("bigint"), F.floor((samples - 1) / step).cast("bigint"))

    def window(i: Column) -> Column:
        first = F.greatest(i * step - margin, F.lit(0))
        until = F.least((i + 1) * step + margin, samples)
        skipped = F.floor(first / rate * FRAMES_PER_SECOND)
        return F.struct(first.alias("first_sample"), until.cast("bigint").alias("until_sample"), (i * window_s * FRAMES_PER_SECOND - skipped).cast("int").alias("first_frame"), ((i + 1) * window_s * FRAMES_PER_SECOND - skipped).cast("int").alias("until_frame"))

    return F.when(samples > 0, F.transform(starts, window)).otherwise(F.array().cast("array<struct<first_sample:bigint,until_sample:bigint,first_frame:int,until_frame:int>>"))


def emitted(waveform: np.ndarray, model: Callable[[np.ndarray], np.ndarray], star: bool = False, rate: int = SAMPLE_RATE, window_s: int = EMISSION_WINDOW_S, context_s: int = EMISSION_CONTEXT_S) -> np.ndarray:
    """Log-probabilities (frames x labels) of a waveform, put together from the windows' kept frames.

    ``star`` adds a label of log-probability 0, which any sound may take.
    """
    step, margin, parts = window_s * rate, context_s * rate, []
    for at in range(0, len(waveform), step):
        first = max(at - margin, 0)
        skipped = first * FRAMES_PER_SECOND // rate
        frames = model(waveform[first : at + step + margin])
        parts.append(frames[at * FRAMES_PER_SECOND // rate - skipped : (at + step) * FRAMES_PER_SECOND // rate - skipped])
    told = np.concatenate(parts).astype(float)
    told -= told.max(1, keepdims=True)
    told -= np.log(np.exp(told).sum(1, keepdims=True))
    return np.hstack([told, np.zeros((len(told), 1))]) if star else told


def emissions(audio: DataFrame, key: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], star: bool = False, rate: int = SAMPLE_RATE) -> DataFrame:
    """(key, emissions, stride_ms, error) of audio rows with ``samples``.

    ``load`` makes the model in a worker, once for a task; a model maps samples to frames x labels. Rows
    without samples, and those the model raises on, have an error and no emissions.
    """
    rows = audio.select(key, F.col("samples").cast("array<float>").alias("samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            for i in range(batch.num_rows):  # a row's emissions may be large, so each is a batch
                samples, told, error = batch.column(1)[i], None, None
                if not samples.is_valid or not len(samples.values):
                    error = "no samples"
                else:
                    try:
                        told = emitted(samples.values.to_numpy(zero_copy_only=False), model, star, rate)
                    except (ValueError, RuntimeError) as x:
                        error = str(x) or type(x).__name__
                frames = None if told is None else as_lists(np.full(len(told), told.shape[1]), pa.array(told.ravel()))
                column = pa.array([None], pa.list_(pa.list_(pa.float64()))) if frames is None else as_lists(np.array([len(frames)]), frames)
                stride = None if told is None or not len(told) else len(samples.values) * 1000 / len(told) / rate
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), column, pa.array([stride], pa.float64()), pa.array([error], pa.string())], names=[key, "emissions", "stride_ms", "error"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, emissions array<array<double>>, stride_ms double, error string")


def read_dictionary(spark: SparkSession, path: str, star: bool = False) -> dict[str, int]:
    """The labels of an aligner by token: one token a line, its number from 0; ``star`` adds the star token behind them."""
    rows = read_lines(spark, path).orderBy("_row_idx").limit(MAX_TOKENS + 1).collect()
    if len(rows) > MAX_TOKENS:
        raise ValueError(f"more than {MAX_TOKENS} tokens")
    out = {r["value"].strip(): r["_row_idx"] for r in rows}
    return out | {STAR: len(rows)} if star else out


def scored_spans(path: Column, scores: Column, blank: int = 0) -> Column:
    """(label, start, end, score) of the runs of a path that are no blank: ``end`` is the frame after the last, the score the mean of the run's frames.

    Null paths stay null; the scores have to be as many as the labels.
    """

    @F.arrow_udf("array<struct<label:int,start:int,end:int,score:double>>")
    def run(paths: pa.Array, values: pa.Array) -> pa.Array:
        labels = paths.flatten()
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
        if len(flat) != len(labels):
            raise ValueError("as many scores as labels are needed")
        number, starts, first, last = run_starts(paths, differs(labels))
        name = labels.take(pa.array(starts)).to_numpy(zero_copy_only=False)
        mean = np.add.reduceat(flat, starts) / (last - first + 1) if len(starts) else flat
        kept = name != blank
        row = np.repeat(np.arange(len(number)), number)[kept]
        made = pa.StructArray.from_arrays([pa.array(name[kept], pa.int32()), pa.array(first[kept], pa.int32()), pa.array(last[kept] + 1, pa.int32()), pa.array(mean[kept])], names=["label", "start", "end", "score"])
        return as_lists(np.bincount(row, minlength=len(number)), made, paths.is_valid())

    return run(path, scores)


def word_spans(spans: Column, letters: Column) -> Column:
    """(start, end, score) of words from their letters' spans: ``letters`` tells how many each word has.

    The score is the mean of the letters' scores weighted by their frames. Numbers that don't add up
    raise, a word without letters has a null in every field.
    """

    @F.arrow_udf("array<struct<start:int,end:int,score:double>>")
    def run(lists: pa.Array, counts: pa.Array) -> pa.Array:
        flat, n = lists.flatten(), counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = offsets(n), offsets(sizes(counts))
        if (ends[at[1:]] - ends[at[:-1]] != sizes(lists)).any():
            raise ValueError("the letters don't add up")
        start, end, score = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        held = n > 0
        first, last = np.where(held, ends[:-1], 0), np.where(held, ends[1:] - 1, 0)
        weight = np.concatenate([[0.0], np.cumsum(end - start)])
        total = np.concatenate([[0.0], np.cumsum((end - start) * score)])
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = (total[ends[1:]] - total[ends[:-1]]) / (weight[ends[1:]] - weight[ends[:-1]])
        pick = lambda x, i: x[i] if len(x) else np.zeros(len(i), np.int32)
        made = pa.StructArray.from_arrays([pa.array(pick(start, first), pa.int32(), mask=~held), pa.array(pick(end, last), pa.int32(), mask=~held), pa.array(mean, mask=~held)], names=["start", "end", "score"])
        return as_lists(sizes(counts), made, counts.is_valid())

    return run(spans, letters)


__all__ = ["emissions", "emitted", "read_dictionary", "scored_spans", "windows", "word_spans"]
