"""Feature shards and waveforms."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import SAMPLE_RATE

#: Bytes of a feature file that one row of the loader holds at a time.
CHUNK = 16 << 20


def feature_frames(lengths: list[int], features: np.ndarray, names: list[str] | None = None) -> pd.DataFrame:
    """(utt_id, frame_idx, vec) of a stacked matrix and the frames of each utterance; their sum has to fit."""
    if sum(lengths) != len(features):
        raise ValueError(f"{sum(lengths)} frames by lengths, {len(features)} in the matrix")
    utt = np.repeat(np.arange(len(lengths)), lengths)
    offsets = np.cumsum([0, *lengths[:-1]]) if lengths else np.zeros(0, int)
    frame = np.arange(len(features)) - np.repeat(offsets, lengths)
    ids = [names[i] if names else str(i) for i in utt]
    return pd.DataFrame({"utt_id": ids, "frame_idx": frame.astype("int32"), "vec": list(np.asarray(features, dtype="float32"))})


def read_feature_shards(spark: SparkSession, folder: str, split: str, nshard: int | None = None, rank: int | None = None) -> DataFrame:
    """(shard, utt_id, frame_idx, vec) of ``split_<rank>_<nshard>.npy`` matrices and their ``.len`` lengths in a folder.

    All shards, or those of one division, or one of them; the folder has to be there on every worker.

    A task maps one shard and reads it in pieces, so a shard need not fit in memory.
    """
    shards = spark.read.format("binaryFile").option("pathGlobFilter", f"{split}_{'*' if rank is None else rank}_{'*' if nshard is None else nshard}.len").load(folder).select(F.regexp_replace("path", r"^file:/*", "/").alias("path"))

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                with open(path) as f:
                    lengths = [int(x) for x in f.read().split()]
                matrix = np.load(path.removesuffix(".len") + ".npy", mmap_mode="r")
                if sum(lengths) != len(matrix):
                    raise ValueError(f"{path}: {sum(lengths)} frames by lengths, {len(matrix)} in the matrix")
                at = 0
                for i, n in enumerate(lengths):
                    yield pd.DataFrame({"shard": path, "utt_id": str(i), "frame_idx": np.arange(n, dtype="int32"), "vec": list(np.array(matrix[at : at + n], dtype="float32"))})
                    at += n

    return shards.mapInPandas(load, "shard string, utt_id string, frame_idx int, vec array<float>")


def write_feature_shards(frames: DataFrame, folder: str, split: str, nshard: int, order: str = "utt") -> DataFrame:
    """Writes ``split_<rank>_<nshard>.npy`` and ``.len`` files; gives (rank, utterances, frames) of each.

    ``frames`` holds (``order``, frame_idx, vec), where ``order`` numbers the utterances; shard ``rank`` takes
    those with this number modulo ``nshard``, in order. A shard is streamed by one task to a file beside
    its place and moved there when whole, so a task may run again; files that are there already
    raise. The folder has to be there on every worker.
    """
    stem = lambda rank: Path(folder) / f"{split}_{rank}_{nshard}"
    if found := [str(stem(r)) for r in range(nshard) if stem(r).with_suffix(".npy").exists()]:
        raise FileExistsError(f"features exist: {found[0]}.npy")
    Path(folder).mkdir(parents=True, exist_ok=True)
    told = frames.select(F.pmod(F.col(order), F.lit(nshard)).cast("int").alias("rank"), F.col(order).cast("bigint").alias("utt"), F.col("frame_idx").cast("int").alias("frame_idx"), F.col("vec").cast("array<float>").alias("vec"))
    total = {r["rank"]: (r["n"], r["width"]) for r in told.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).collect()}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, files, length, last = None, (), 0, None

        def ended() -> pa.RecordBatch:
            files[1].write(f"{length}\n")
            utterances = files[2] + 1
            for f in files[:2]:
                f.close()
            for f, suffix in zip(files, (".npy", ".len")):
                os.replace(f.name, stem(rank).with_suffix(suffix))
            return pa.RecordBatch.from_pydict({"rank": pa.array([rank], pa.int32()), "utterances": pa.array([utterances]), "frames": pa.array([total[rank][0]])})

        for batch in batches:
            ranks, utts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(ranks) | np.diff(utts)) + 1
            for a, b in zip([0, *edges], [*edges, len(ranks)]):
                if rank != ranks[a]:
                    if rank is not None:
                        yield ended()
                    rank, last, length = int(ranks[a]), None, 0
                    mark = f".{os.getpid()}.part"
                    files = (open(f"{stem(rank)}.npy{mark}", "wb"), open(f"{stem(rank)}.len{mark}", "w"), 0)
                    np.lib.format.write_array_header_1_0(files[0], {"descr": "<f4", "fortran_order": False, "shape": total[rank]})
                if last is not None and utts[a] != last:
                    files[1].write(f"{length}\n")
                    files, length = (*files[:2], files[2] + 1), 0
                last, length = utts[a], length + b - a
                width = total[rank][1]
                if (b - a) * width != len(part := vectors[a * width : b * width]):
                    raise ValueError(f"vectors of different lengths in shard {rank}")
                files[0].write(part.astype("<f4").tobytes())
        if rank is not None:
            yield ended()

    return told.repartition(nshard, "rank").sortWithinPartitions("rank", "utt", "frame_idx").mapInArrow(write, "rank int, utterances bigint, frames bigint")


def write_audio(audio: DataFrame, folder: str) -> DataFrame:
    """Writes each row's ``samples`` at its ``sample_rate`` as 16-bit WAV, under the name of its ``path``; gives (path, written).

    Rows without samples are left out; a file that is there already raises. The folder has to be there
    on every worker.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for frame in frames:
            done = []
            for path, samples, rate in zip(frame["path"], frame["samples"], frame["sample_rate"]):
                target = Path(folder) / Path(path).with_suffix(".wav").name
                if target.exists():
                    raise FileExistsError(str(target))
                part = target.with_suffix(f".{os.getpid()}.part")
                part.write_bytes(encode_wav(np.asarray(samples, float), int(rate)))
                os.replace(part, target)
                done.append((path, str(target)))
            yield pd.DataFrame(done, columns=["path", "written"])

    return audio.filter("samples is not null").select("path", "samples", "sample_rate").mapInPandas(write, "path string, written string")


def frame_counts(frames: DataFrame) -> DataFrame:
    """(utt_id, n_frames) of a frame table."""
    return frames.groupBy("utt_id").agg(F.count(F.lit(1)).cast("int").alias("n_frames"))


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Channels x samples in [-1, 1), and the sample rate, of PCM WAV bytes."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(float) / (1 << (8 * width - 1))
    else:
        raise ValueError(f"{8 * width} bits a sample are not read")
    return x.reshape(-1, channels).T, rate


def resample(samples: np.ndarray, rate: int, to: int = SAMPLE_RATE) -> np.ndarray:
    """Samples at another rate, by a windowed-sinc low-pass and linear interpolation."""
    if rate == to:
        return samples
    if to < rate:
        half = 16 * rate // to
        t = np.arange(-half, half + 1)
        kernel = np.sinc(t * to / rate) * np.hamming(2 * half + 1)
        samples = np.convolve(samples, kernel / kernel.sum(), mode="same")
    n = round(len(samples) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(samples)), samples)


def read_audio(spark: SparkSession, folder: str, channels: str = "mean", rate: int = SAMPLE_RATE, max_s: float | None = None) -> DataFrame:
    """(path, samples, sample_rate, num_samples, duration, error) of the WAV files below a folder.

    ``channels`` is 'mean' or 'first'; files that can't be read have an ``error``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(folder).select("path", "content")

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    x, own = decode_wav(content)
                    one = resample(x.mean(0) if channels == "mean" else x[0], own, rate)
                    one = one[: int(max_s * rate)] if max_s else one
                    row = (path, one.astype("float32"), rate, len(one), len(one) / rate, None)
                except (ValueError, wave.Error, EOFError) as e:
                    row = (path, None, None, None, None, str(e) or type(e).__name__)
                yield pd.DataFrame([row], columns=["path", "samples", "sample_rate", "num_samples", "duration", "error"])

    return files.mapInPandas(load, "path string, samples array<float>, sample_rate int, num_samples bigint, duration double, error string")


def encode_wav(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    """16-bit PCM WAV bytes of one channel."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1 - 2**-15) * 32768).astype("<i2").tobytes())
    return out.getvalue()


def cut_segments(audio: DataFrame, spans: DataFrame, key: str = "path") -> DataFrame:
    """(key, segment, wav): the audio of each span (key, segment, start_s, end_s) as WAV bytes."""
    joined = audio.filter("samples is not null").join(spans, key)
    first = F.greatest((F.col("start_s") * F.col("sample_rate")).cast("int"), F.lit(0))
    until = (F.col("end_s") * F.col("sample_rate")).cast("int")
    part = joined.select(key, "segment", "sample_rate", F.slice("samples", first + 1, F.greatest(until - first, F.lit(0))).alias("part"))

    @F.pandas_udf("binary")
    def encode(samples: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([encode_wav(np.asarray(s, float), int(r)) for s, r in zip(samples, rates)])

    return part.select(key, "segment", encode("part", "sample_rate").alias("wav"))
