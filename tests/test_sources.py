import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.sources import corpora, features, files, sinks
from corpusloom.streaming import manifests


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_lines_keep_their_order(spark, tmp_path):
    path = write(tmp_path / "a.txt", "".join(f"line {i}\n" for i in range(1000)))
    assert all(r["value"] == f"line {r['_row_idx']}" for r in files.read_lines(spark, path).collect())
    assert files.count_lines(spark, path) == 1000
    with pytest.raises(ValueError):
        files.count_lines(spark, write(tmp_path / "b.txt", "a\nb"))
    with pytest.raises(ValueError):
        files.count_lines(spark, write(tmp_path / "c.txt", ""))


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1_2_3", "é\U000f0001", None, None, None)], schemas.MLS)
    sinks.write_jsonl(df, str(tmp_path / "out"))
    back = files.read_jsonl(spark, str(tmp_path / "out"), schemas.MLS, numbered=True).collect()
    assert [tuple(r) for r in back] == [("1_2_3", "é\U000f0001", None, None, None, 0)]
    with pytest.raises(Exception, match="exist"):
        sinks.write_jsonl(df, str(tmp_path / "out"))
    sinks.write_ascii_jsonl(df, str(tmp_path / "ascii"))
    line = "".join(p.read_text() for p in (tmp_path / "ascii").glob("part-*"))
    assert line.isascii() and "\\udb80\\udc01" in line and json.loads(line)["duration"] is None
    with pytest.raises(Exception):
        files.read_jsonl(spark, write(tmp_path / "bad.jsonl", "{]\n"), "a int").collect()


def test_corpora(spark, tmp_path):
    path = write(tmp_path / "t.txt", "1_2_3\thello\nbad line\n1_2_4\tworld \n")
    assert [(r["ID"], r["transcript"]) for r in corpora.read_mls(spark, path).orderBy("_row_idx").collect()] == [("1_2_3", "hello"), ("1_2_4", "world")]
    audio = spark.createDataFrame([("1_2_3", 1.0, 16000.0, 16000)], "ID string, duration double, sample_rate double, num_samples bigint")
    assert {r["ID"]: r["duration"] for r in corpora.read_mls(spark, path, audio).collect()} == {"1_2_3": 1.0, "1_2_4": None}
    write(tmp_path / "ls/84/12/84-12.trans.txt", "84-12-0000 GO DO\n84-12-0001 YOU\n")
    rows = corpora.read_librispeech(spark, str(tmp_path / "ls")).orderBy("id").collect()
    assert [(r["id"], r["speaker_id"], r["chapter_id"], r["text"]) for r in rows] == [("84-12-0000", 84, 12, "GO DO"), ("84-12-0001", 84, 12, "YOU")]
    assert rows[0]["path"].endswith("ls/84/12/84-12-0000.flac")
    write(tmp_path / "ls/84/12/84-12-0001.flac", b"xyz")
    assert [r["id"] for r in corpora.read_librispeech_audio(spark, str(tmp_path / "ls")).collect()] == ["84-12-0001"]
    with pytest.raises(Exception, match="three fields"):
        corpora.parse_ljspeech(files.read_lines(spark, write(tmp_path / "lj.csv", "a|b\n"))).collect()
    tsv = files.read_lines(spark, write(tmp_path / "f.tsv", "/root\na.wav\t10\nb.wav\t20\nc.wav\n"))
    assert [tuple(r) for r in corpora.parse_fairseq(tsv, 2, 1).collect()] == [("/root/c.wav", None, 2)]


def test_raw_segments(spark, tmp_path):
    audio = {"path": "au/POD1.opus", "aid": "POD1", "sample_rate": 16000, "segments": [{"sid": "POD1_S0", "begin_time": 0.0, "end_time": 0.00015625, "text_tn": "A"}]}
    raw = spark.read.schema(schemas.GIGASPEECH_RAW).option("multiLine", "true").json(write(tmp_path / "g.json", json.dumps({"audios": [audio, audio]}, indent=1)))
    rows = corpora.explode_gigaspeech(raw, n=1).collect()
    assert [(r["path"], r["first_sample"], r["until_sample"]) for r in rows] == [("au/POD1/S0.opus", 0, 2)]


def test_features_and_audio(spark, tmp_path):
    np.save(tmp_path / "train_0_1.npy", np.arange(10, dtype="float32").reshape(5, 2))
    write(tmp_path / "train_0_1.len", "2\n3\n")
    rows = features.read_feature_shards(spark, str(tmp_path), "train").orderBy("utt_id", "frame_idx").collect()
    assert [(r["utt_id"], r["frame_idx"], r["vec"][0]) for r in rows] == [("0", 0, 0.0), ("0", 1, 2.0), ("1", 0, 4.0), ("1", 1, 6.0), ("1", 2, 8.0)]
    with pytest.raises(ValueError):
        features.feature_frames([1], np.zeros((2, 2)))
    tone = np.sin(np.arange(8000) / 8000 * 2 * np.pi * 100) * 0.5
    write(tmp_path / "wavs/a.wav", features.encode_wav(tone, 8000))
    write(tmp_path / "wavs/b.wav", b"not a wave")
    out = {r["path"].rsplit("/", 1)[1]: r for r in features.read_audio(spark, str(tmp_path / "wavs")).collect()}
    assert out["a.wav"]["num_samples"] == 16000 and max(out["a.wav"]["samples"]) == pytest.approx(0.5, abs=0.01) and out["b.wav"]["error"]
    audio = features.read_audio(spark, str(tmp_path / "wavs"))
    spans = audio.filter("error is null").select("path", F.lit(0).alias("segment"), F.lit(0.25).alias("start_s"), F.lit(0.5).alias("end_s"))
    x, rate = features.decode_wav(features.cut_segments(audio, spans).first()["wav"])
    assert rate == 16000 and x.shape == (1, 4000)


def test_shards_blocks_and_lists(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("_row_idx"), F.concat(F.lit("1_2_"), "id").alias("ID"))
    sinks.write_blocks(df, str(tmp_path / "blocks"), 4)
    assert sorted(p.name for p in (tmp_path / "blocks").glob("block=*")) == ["block=0", "block=1", "block=2"]
    sinks.write_shards(df, str(tmp_path / "shards"), shards=3)
    assert len(list((tmp_path / "shards").glob("shard=*"))) == 3
    sinks.write_fairseq(df, str(tmp_path / "tsv"), "/r", F.concat("ID", F.lit(".wav")))
    text = "".join(p.read_text() for p in sorted((tmp_path / "tsv").glob("part-*")))
    assert text.startswith("/r\n1_2_0.wav\n") and text.count("\n") == 11
    sinks.publish(df, str(tmp_path / "pub"))
    assert spark.read.parquet(str(tmp_path / "pub/data")).count() == 10


def test_stream(spark, tmp_path):
    write(tmp_path / "in/a.jsonl", '{"transcript": "Hello  World"}\n')
    rows = manifests.tokenized_stream(manifests.stream_jsonl(spark, str(tmp_path / "in"), "transcript string"))
    manifests.write_parquet_stream(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("tokenized", "uroman").collect()] == [(["Hello", "World"], ["hello", "world"])]
    seen = []
    manifests.for_each_batch(manifests.stream_jsonl(spark, str(tmp_path / "in"), "transcript string"), lambda df, _: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination(60)
    assert sum(seen) == 1


def test_truecase(spark):
    df = spark.createDataFrame([(0, "the Paris show"), (1, "see Paris now"), (2, "in paris THE"), (3, None)], "_row_idx bigint, text string")
    out = {r["_row_idx"]: r["text"] for r in corpora.truecase(df, "text", corpora.truecase_model(df, "text")).collect()}
    assert out[2].split()[1] == "Paris" and out[3] is None


def test_registry_is_whole():
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert "interleave" in entry.queries()
