import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import align, emissions, ranking, sampling
from corpusloom.operators.filters import head
from corpusloom.plans import interleave
from corpusloom.sources import features, files


def blocks(samples):
    """A stand-in for a model: three labels by the sum and peak of each frame's 320 samples."""
    x = samples[: len(samples) // 320 * 320].reshape(-1, 320)
    return np.stack([x.sum(1), x.max(1), np.ones(len(x))], 1)


@pytest.mark.parametrize("seconds", [0.5, 29.9, 30, 31, 61.3, 95])
def test_windows_give_the_frames_of_the_whole(seconds):
    samples = np.random.default_rng(1).random(int(seconds * 16_000)).astype("float32")
    whole = blocks(samples).astype(float)
    whole -= np.log(np.exp(whole).sum(1, keepdims=True))
    got = emissions.emitted(samples, blocks, star=True)
    assert np.allclose(got[:, :3], whole) and (got[:, 3] == 0).all()


def test_emissions_of_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(0, [float(x) for x in rng.random(3200)]), (1, None), (2, []), (3, [float(x) for x in rng.random(700)])]
    df = spark.createDataFrame([(k, x, "x") for k, x in rows], "k bigint, samples array<double>, emissions string")

    def model(samples):
        x = samples[: len(samples) // 320 * 320].reshape(-1, 320)
        return np.stack([x.sum(1), x.max(1), np.ones(len(x))], 1)

    got = {r["k"]: r for r in emissions.emissions(df, "k", lambda: model).collect()}
    assert [len(got[0]["emissions"]), got[0]["stride_ms"]] == [10, 20.0] and len(got[3]["emissions"]) == 2
    assert got[1]["error"] == got[2]["error"] == "no samples" and got[1]["emissions"] is None
    assert abs(sum(map(math.exp, got[0]["emissions"][4])) - 1) < 1e-9


def test_scores_of_paths_and_words(spark):
    rng = random.Random(3)
    e = [[math.log(p / 10) for p in rng.choice([(7, 2, 1), (1, 8, 1), (2, 2, 6)])] for _ in range(12)]
    df = spark.createDataFrame([(0, e, [1, 2, 2]), (1, None, [1])], "k bigint, e array<array<double>>, y array<int>")
    rows = align.align(df, "k", "e", "y", scores=True)
    got = {r["k"]: r for r in rows.select("*", emissions.scored_spans(F.col("path"), F.col("scores")).alias("s")).collect()}
    path, scores = got[0]["path"], got[0]["scores"]
    assert np.allclose(scores, [math.exp(e[t][c]) for t, c in enumerate(path)]) and got[1]["s"] is None
    spans = [(s["label"], s["start"], s["end"]) for s in got[0]["s"]]
    assert [s[0] for s in spans] == [1, 2, 2]
    assert all(abs(s["score"] - np.mean(scores[s["start"] : s["end"]])) < 1e-9 for s in got[0]["s"])
    words = rows.filter("k = 0").select(emissions.word_spans(emissions.scored_spans(F.col("path"), F.col("scores")), F.array(F.lit(2), F.lit(0), F.lit(1))).alias("w")).first()["w"]
    two = got[0]["s"][:2]
    weighted = sum(s["score"] * (s["end"] - s["start"]) for s in two) / sum(s["end"] - s["start"] for s in two)
    assert (words[0]["start"], words[0]["end"]) == (spans[0][1], spans[1][2]) and abs(words[0]["score"] - weighted) < 1e-9
    assert words[1]["start"] is None and (words[2]["start"], words[2]["end"]) == spans[2][1:]


def test_dictionary_with_star(spark, tmp_path):
    (tmp_path / "d.txt").write_text("<blank>\na\nb\n")
    assert emissions.read_dictionary(spark, str(tmp_path / "d.txt"), star=True) == {"<blank>": 0, "a": 1, "b": 2, "<star>": 3}


def test_feature_shards_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    lengths = [5, 1, 8, 3, 4, 2, 9]
    data = [(u, f, [float(x) for x in rng.random(3).astype("float32")]) for u, n in enumerate(lengths) for f in range(n)]
    random.Random(4).shuffle(data)
    frames = spark.createDataFrame([(int(u), int(f), v) for u, f, v in data], "utt bigint, frame_idx int, vec array<double>")
    done = {tuple(r) for r in features.write_feature_shards(frames, str(tmp_path / "f"), "train", 2).collect()}
    assert done == {(0, 4, 26), (1, 3, 6)}
    got = features.read_feature_shards(spark, str(tmp_path / "f"), "train", nshard=2).collect()
    wanted = sorted((u % 2, u // 2, f, tuple(v)) for u, f, v in data)
    assert sorted((0 if "_0_2" in r["shard"] else 1, int(r["utt_id"]), r["frame_idx"], tuple(r["vec"])) for r in got) == wanted
    assert {r["frame_idx"] for r in features.read_feature_shards(spark, str(tmp_path / "f"), "train", 2, 1).collect()} == {0, 1, 2}
    with pytest.raises(FileExistsError):
        features.write_feature_shards(frames, str(tmp_path / "f"), "train", 2)


def test_audio_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.flac", [0.0, 0.5, -0.25], 8000), ("b/y.wav", None, 8000)], "path string, samples array<float>, sample_rate int")
    assert [r["path"] for r in features.write_audio(rows, str(tmp_path / "w")).collect()] == ["a/x.flac"]
    back = features.read_audio(spark, str(tmp_path / "w"), rate=8000).collect()
    assert len(back) == 1 and np.allclose(back[0]["samples"], [0.0, 0.5, -0.25])


def test_lines_of_several_files_are_numbered_in_order(spark, tmp_path):
    expected = []
    for name, n in (("a", 3), ("b", 400), ("c", 1), ("d", 0)):
        lines = [f"{name}{k}" for k in range(n)]
        expected += lines
        (tmp_path / f"{name}.txt").write_text("".join(x + "\n" for x in lines))
    got = files.read_lines(spark, f"{tmp_path}/*.txt").orderBy("_row_idx").collect()
    assert [r["value"] for r in got] == expected and [r["_row_idx"] for r in got] == list(range(len(expected)))
    keyed = files.with_row_index(spark.createDataFrame([(k * 7 % 50, "x") for k in range(50)], "v int, w string"), ["v"]).collect()
    assert all(r["v"] == r["_row_idx"] for r in keyed) and len(keyed) == 50


def test_counting_lines(spark, tmp_path):
    (tmp_path / "good.txt").write_bytes("a\r\nü\n\n".encode())
    (tmp_path / "mark.txt").write_bytes(b"\xef\xbb\xbfa\nb\n")
    (tmp_path / "open.txt").write_bytes(b"a\nb")
    (tmp_path / "empty.txt").write_bytes(b"")
    assert files.count_lines(spark, str(tmp_path / "good.txt")) == 3
    assert files.count_lines(spark, str(tmp_path / "mark.txt")) == 2
    for name in ("open", "empty"):
        with pytest.raises(ValueError):
            files.count_lines(spark, str(tmp_path / f"{name}.txt"))


def test_places_after_filters(spark):
    df = spark.range(100).withColumnRenamed("id", "_row_idx")
    kept = df.filter("_row_idx % 3 = 1")
    for rows in (kept, kept.repartition(5)):
        got = {r["_row_idx"]: r["p"] for r in ranking.with_position(rows, "p", slice_rows=10).collect()}
        assert got == {k: i for i, k in enumerate(range(1, 100, 3))}
    assert {r["p"] for r in ranking.with_position(df.filter("_row_idx >= 40"), "p").collect()} == set(range(60))
    assert ranking.with_position(df.limit(0), "p").count() == 0
    half = df.filter("_row_idx % 2 = 1")
    assert {r["shard"] for r in sampling.shard_number(half, shards=5).collect()} == set(range(5))
    assert [r["_row_idx"] for r in head(half, 3).orderBy("_row_idx").collect()] == [1, 3, 5]
    assert sampling.in_shard(half, 50, 5, 4).count() == 10


def test_interleaving_goes_by_places(spark):
    rows = [(k, ["a", "b"], [1, 2], [0.0, 0.02], [0.02, 0.04]) for k in range(6)]
    df = spark.createDataFrame(rows, "_row_idx bigint, tokenized array<string>, speech_tokens array<int>, aligned_token_start_time array<double>, aligned_token_end_time array<double>")
    text = lambda x: {r["_row_idx"]: r["text"][0] for r in interleave.interleave(x).collect()}
    whole, odd = text(df), text(df.filter("_row_idx % 2 = 1"))
    assert whole[0] == whole[2] != whole[1] and odd[1] == whole[0] and odd[3] == whole[1] and odd[5] == whole[0]
