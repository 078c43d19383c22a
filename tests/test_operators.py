import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import units
from corpusloom.operators import align, cluster, filters, joins, projections, sampling, sequences, stats
from corpusloom.plans import interleave, pipeline, vocabulary


def runs(path):
    return [(str(k), g[0], g[-1]) for k, idx in itertools.groupby(range(len(path)), key=lambda i: path[i]) for g in [list(idx)]]


def test_merge_repeats(spark):
    rng = random.Random(1)
    paths = [[], [0, 0, 1, 1, 1, 2], [5]] + [[rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(paths)), "k int, p array<int>")
    got = {r["k"]: [tuple(x) for x in r["m"]] for r in df.select("k", align.merge_repeats(F.col("p")).alias("m")).collect()}
    assert got == {k: runs(p) for k, p in enumerate(paths)}
    long = align.merge_repeats_long(df.select("k", F.posexplode("p").alias("i", "label")), "k", "i", "label")
    assert {(r["k"], str(r["label"]), r["start"], r["end"]) for r in long.collect()} == {(k, *x) for k, p in enumerate(paths) for x in runs(p)}
    # slices of three frames, gaps between positions, and a null key and label
    gaps = [(None if k == 3 else k, 2 * i, None if x == 2 else x) for k, p in enumerate(paths) for i, x in enumerate(p)]
    cut = align.merge_repeats_long(spark.createDataFrame(gaps, "k int, i int, label int"), "k", "i", "label", slice_rows=6)
    expected = {(None if k == 3 else k, None if x == "2" else int(x), 2 * a, 2 * b) for k, p in enumerate(paths) for x, a, b in runs(p)}
    assert {tuple(r) for r in cut.select("k", "label", "start", "end").collect()} == expected


def spans_of(tokens, segments):
    """One segment after another: where each token's letters begin and end, then shared blanks."""
    blank, heard = "<blank>", [i for i, s in enumerate(segments) if s[0] != "<blank>"]
    at, places = 0, []
    for t in tokens:
        n = len(t.split(" ")) if t else 0
        places.append((heard[at], heard[at + n - 1]) if n else (heard[at - 1],) * 2)
        at += n
    out = []
    for i, (a, b) in enumerate(places):
        start, end = segments[a][1], segments[b][2]
        if a and segments[a - 1][0] == blank:
            start = segments[a - 1][1] if i == 0 else (segments[a - 1][1] + segments[a - 1][2]) // 2
        if b + 1 < len(segments) and segments[b + 1][0] == blank:
            end = segments[b + 1][2] if i == len(places) - 1 else (segments[b + 1][1] + segments[b + 1][2]) // 2
        out.append((start, end))
    return out


def test_token_spans(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        tokens = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(5))]
        segments, t, last = [], 0, ""
        for c in " ".join(x for x in tokens if x).split(" "):
            if c == last or rng.random() < 0.4:
                n = rng.randrange(1, 6)
                segments.append(("<blank>", t, t + n - 1))
                t += n
            n = rng.randrange(1, 4)
            segments.append((c, t, t + n - 1))
            t, last = t + n, c
        if rng.random() < 0.5:
            segments.append(("<blank>", t, t + 3))
        rows.append((k, tokens, segments))
    df = spark.createDataFrame(rows, f"k int, tokens array<string>, segments array<{align.SEGMENT}>")
    for r in align.with_token_spans(df, "tokens", "segments").collect():
        assert r["error"] is None and [tuple(s) for s in r["spans"]] == spans_of(r["tokens"], [tuple(s) for s in r["segments"]])


def test_token_span_errors(spark):
    rows = [(1, ["", "a"], [("a", 0, 1)]), (2, [], []), (3, ["a"], [("b", 0, 1)]), (4, None, None), (5, ["a b"], [("a", 0, 1)])]
    out = align.with_token_spans(spark.createDataFrame(rows, f"k int, tokens array<string>, segments array<{align.SEGMENT}>"), "tokens", "segments")
    assert {r["k"]: r["error"] for r in out.collect()} == {1: "first token is empty", 2: "no tokens", 3: "letters and segments differ", 4: "no tokens", 5: "letters and segments differ"}


def collapse(path, blank=0):
    return [k for k, _ in itertools.groupby(path) if k != blank]


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(40):
        frames, labels = int(rng.integers(1, 6)), 3
        e = rng.normal(size=(frames, labels))
        y = rng.integers(1, labels, size=int(rng.integers(0, 4))).tolist()
        paths = [p for p in itertools.product(range(labels), repeat=frames) if collapse(p) == y]
        if not paths:
            with pytest.raises(ValueError):
                align.viterbi(e, y)
            continue
        score = lambda p: sum(e[t, x] for t, x in enumerate(p))
        got = align.viterbi(e, y)
        assert collapse(got) == y and score(got) == pytest.approx(max(map(score, paths)))


def test_align_quarantines(spark):
    rows = [(1, [[0.0, -1.0]] * 3, [1]), (2, [[0.0, -1.0]], [1, 1]), (3, [[0.0]], []), (4, None, [1])]
    out = {r["k"]: (r["path"], r["error"]) for r in align.align(spark.createDataFrame(rows, "k int, e array<array<double>>, y array<int>"), "k", "e", "y").collect()}
    assert out[1][1] is None and sum(out[1][0]) == 1
    assert out[2][1] == "more targets than frames" and out[3][1] == "no tokens" and out[4][1] == "no emissions"


def greedy(counts, k):
    taken, left = {}, k
    order = sorted(counts, key=lambda s: (counts[s], s))
    for i, s in enumerate(order):
        taken[s] = min(counts[s], left // (len(order) - i))
        left -= taken[s]
    return taken


def test_stratified_sample(spark):
    rng = random.Random(4)
    for trial in range(6):
        counts = {f"s{j:02}": rng.choice([1, 2, 2, 3, 5, 8, 40]) for j in range(rng.randrange(2, 12))}
        rows = [s for s, n in counts.items() for _ in range(n)]
        rng.shuffle(rows)
        df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "_row_idx bigint, s string")
        k = rng.randrange(1, len(rows))
        got = [(r["s"], r["_row_idx"]) for r in sampling.stratified_sample(df, "s", k, shuffle=trial == 5).collect()]
        assert len(got) == k
        expected = greedy(counts, k)
        assert {s: sum(1 for t, _ in got if t == s) for s in counts} == expected
        if trial < 5:
            assert all(sorted(i for t, i in got if t == s) == [i for i, t in enumerate(rows) if t == s][: expected[s]] for s in counts)
    with pytest.raises(ValueError):
        sampling.stratified_sample(df, "s", len(rows))


def test_sizes_shards_and_ranges(spark):
    assert (sampling.sample_size(10, 100), sampling.sample_size(0.5, 100), sampling.sample_size(0.25, 10_808_037)) == (10, 50, 2_702_009)
    with pytest.raises(TypeError):
        sampling.sample_size("10", 100)
    df = spark.range(5).withColumnRenamed("id", "_row_idx")
    assert [r["shard"] for r in sampling.shard_number(df, shards=4).orderBy("_row_idx").collect()] == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        sampling.shard_number(df)
    assert [sampling.shard_range(10, 4, r) for r in range(4)] == [(0, 2), (2, 5), (5, 8), (8, 10)]
    with pytest.raises(ValueError):
        sampling.shard_range(1, 4, 0)
    assert sampling.subsample(spark.range(100).withColumn("sh", F.lit(1)), 0.07, "sh", "id").count() == math.ceil(100 * 0.07)


def test_span_boundaries(spark):
    assert tuple(interleave.boundaries(60)) == (4, 11, 16, 21, 25, 28, 31, 37, 47, 53, 58, 59)
    b = spark.range(1).select(interleave.span_boundaries(F.lit(10)).alias("b"), interleave.span_boundaries(F.lit(1)).alias("c")).first()
    assert b["b"] == [0, 4, 10] and b["c"] == [0, 1]


def test_interleave_by_hand(spark):
    rows = [(0, ["a", "b", "c", "d", "e"], [7, 7, 8] * 10, [0.0, 0.1, 0.2, 0.3, 0.4], [0.1, 0.2, 0.3, 0.4, 0.5]), (1, [], [1], [], []), (2, [], [1], [], []), (3, ["a"], None, [0.0], [0.1]), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "_row_idx bigint, tokenized array<string>, speech_tokens array<int>, aligned_token_start_time array<double>, aligned_token_end_time array<double>")
    out = {r["_row_idx"]: r for r in interleave.interleave(df).collect()}
    u = lambda *x: "".join(chr(983_040 + i) for i in x)
    assert out[0]["text"] == " a b c d  " + u(8, 7, 8, 7)
    assert out[1]["error"] == "no tokens" and out[2]["text"] == " " and out[3]["error"] == "no speech tokens" and out[4]["error"] == "no tokens"
    assert interleave.interleave(df, marks=False, dedup=False).filter("_row_idx = 0").first()["text"] == "a b c d " + u(8, 7, 7, 8, 7)


def test_filters_and_joins(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "b", "<NOISE> y"), (2, None, None)], "_row_idx bigint, path string, text string")
    files = spark.createDataFrame([("a",), ("c",)], "path string")
    assert [r["path"] for r in filters.existing(df, files, n=5).collect()] == ["a"]
    assert {r["_row_idx"] for r in filters.missing(df, files).collect()} == {1, 2}
    assert {r["_row_idx"] for r in filters.without_garbage(df, "text").collect()} == {0, 2}
    assert [r["m"] for r in spark.createDataFrame([(2.0, 0.0, 1.0), (1.0, 0.0, 1.5), (1.005, 0.0, 1.0), (None, 0.0, 1.0)], "d double, a double, b double").select(filters.duration_mismatch(F.col("d"), F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="bad"):
        filters.require(df, F.col("_row_idx") < 2, "bad").collect()
    codec = spark.createDataFrame([("1", *[[k] for k in range(8)])], "ID string, " + ", ".join(f"L{k} array<int>" for k in range(8)))
    aligned = spark.createDataFrame([("1", [9], "t"), ("2", [8], "t")], "ID string, speech_tokens array<int>, L3 string")
    assert [tuple(r) for r in joins.join_codec(aligned, codec, "L", 3).collect()] == [("1", "t", [3])]
    with pytest.raises(ValueError):
        projections.select_codec_layer(codec, "L", 8)
    with pytest.raises(Exception, match="not an utterance id"):
        df.select(projections.id_to_path(F.col("text"), "/x")).collect()
    assert projections.type_mapping(aligned.schema) == {"ID": "string", "speech_tokens": ["int"], "L3": "string"}


def test_sequences(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 0, 3])], "a array<int>, n array<int>")
    assert df.select(sequences.unflatten(F.col("a"), F.col("n")).alias("x")).first()["x"] == [[1], [], [2, 3, 4]]
    with pytest.raises(Exception, match="add up"):
        df.select(sequences.unflatten(F.col("a"), F.array(F.lit(1)))).collect()
    assert df.select(sequences.truncated(F.col("a"), 0.5, 4).alias("x")).first()["x"] == [1, 2]


def test_moments_and_clusters(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "k int, v array<double>")
    got = {(r["i"], r["j"]): r["covariance"] for r in stats.moments(df, "v").collect()}
    assert all(got[i, j] == pytest.approx(np.cov(x.T, bias=True)[i, j]) for i in range(3) for j in range(3))
    centroids = spark.createDataFrame([(3, [0.0] * 3), (1, [0.0] * 3), (2, [9.0] * 3)], "cluster int, vec array<double>")
    out = {r["k"]: r for r in cluster.assign(df, "k", "v", centroids).collect()}
    assert out[0]["cluster"] == 1 and out[99]["cluster"] is None
    blobs = spark.createDataFrame([(i, [float(i % 2) * 10 + i * 0.001]) for i in range(40)], "k int, v array<double>")
    assert sorted(round(r["vec"][0]) for r in cluster.fit(blobs, "v", 2, runs=2).collect()) == [0, 10]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, v array<double>, s string, _row_idx bigint")
    assert stats.moments(empty, "v").count() == 0
    assert stats.distribution(empty, F.col("k")).first()["n"] == 0
    assert stats.histogram(empty, F.col("k")).count() == 0
    assert stats.group_counts(empty, F.col("s")).count() == 0


def test_pipeline(spark):
    df = spark.createDataFrame([(0, "Да 12 ok")], "_row_idx bigint, text string")
    done = pipeline.uromanize(df, "text").first()
    assert done["tokenized"] == ["Да", "12", "ok"] and done["normalized"] == ["да", "12", "ok"] and done["uroman"] == ["d a", "", "o k"]
    with pytest.raises(ValueError):
        pipeline.uromanize(pipeline.uromanize(df, "text"), "text")
    with pytest.raises(pipeline.MissingModel):
        pipeline.acoustic(df, None, "x int")


def test_align_and_encode(spark):
    df = spark.createDataFrame([(0, ["a b", "a"]), (1, ["a"]), (2, ["", "a"])], "_row_idx bigint, uroman array<string>")
    hot = lambda k: [0.0 if i == k else -9.0 for i in range(3)]
    emissions = spark.createDataFrame([(0, [hot(k) for k in (0, 1, 1, 2, 0, 0, 1)]), (2, [hot(1)])], "_row_idx bigint, emissions array<array<double>>")
    features = spark.createDataFrame([(0, t, [float(t % 2)]) for t in range(7)], "_row_idx bigint, frame_idx int, vec array<double>")
    centroids = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "cluster int, vec array<double>")
    good, bad = pipeline.align_and_encode(df, emissions, features, centroids, {"<blank>": 0, "a": 1, "b": 2})
    row = good.first()
    assert row["speech_tokens"] == [0, 1, 0, 1, 0, 1, 0] and row["aligned_token_start_time"] == [0.0, 0.08] and row["aligned_token_end_time"] == [0.08, 0.12]
    assert {r["_row_idx"]: r["error"] for r in bad.collect()} == {1: "no emissions", 2: "first token is empty"}


def test_sentencepiece(spark, tmp_path):
    pieces = vocabulary.read_sentencepiece(spark, "/opt/tokenizers/piece_bpe_32k.model")
    assert pieces.count() == 32_000 and pieces.filter("id = 0").first()["piece"] == "<unk>"
    vocabulary.write_vocabulary(pieces.filter("id < 3"), str(tmp_path / "v"))
    assert "".join(p.read_text() for p in (tmp_path / "v").glob("part-*")).startswith("<unk>\t0.0\n<s>\t")


def test_vocabulary(spark):
    base = spark.createDataFrame([(0, "<unk>", 0.0), (1, "a", -1.0)], "id bigint, piece string, score double")
    out = [tuple(r) for r in vocabulary.extend(base, 2).orderBy("id").collect()]
    assert out[2:] == [(2, chr(983_040), -2.0), (3, chr(983_041), -3.0), (4, "", -4.0), (5, "", -5.0)]
    assert (vocabulary.padding_rows(128), vocabulary.padding_rows(129)) == (0, 127)
    assert vocabulary.embedding_rows(np.zeros(2), np.eye(2), 3).shape == (3, 2)


def test_split_join_of_hot_keys_equals_a_plain_join(spark):
    many = spark.createDataFrame([(k % 3 if k % 5 else None, k % 2, k) for k in range(200)], "a int, b int, v int")
    few = spark.createDataFrame([(a, b, f"{a}{b}") for a in (0, 1) for b in (0, 1)] + [(0, 0, "again"), (7, 0, "none")], "a int, b int, w string")
    sizes = many.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"))
    for how in ("inner", "left"):
        plain = sorted(map(str, many.join(few, ["a", "b"], how).collect()))
        for extra in ({}, {"sizes": sizes}, {"most": 1000}, {"most": 5}):
            assert sorted(map(str, joins.split_join(many, few, ["a", "b"], ["v"], how, key_rows=7, **extra).collect())) == plain
    empty = many.limit(0)
    assert joins.split_join(empty, few, ["a", "b"], ["v"], key_rows=7).count() == 0


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from corpusloom.session import checkpointed

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="shared|share"):
        checkpointed(SimpleNamespace(sparkSession=session))


def test_boundaries_of_rows_of_any_length(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 4, 5, 60, None, 100_000)], "n int").select("n", interleave.span_boundaries(F.col("n")).alias("b")).collect()
    for n, b in got:
        assert b is None if n is None else b == [0, *[int(x) for x in interleave.boundaries(n)], n]


def test_units_outside_the_private_range_raise(spark):
    df = lambda x: spark.createDataFrame([(x,)], "u array<int>").select(units.units_to_pua(F.col("u")).alias("p"))
    assert df([0, 65_533, None, 7]).first()["p"] == chr(983_040) + chr(1_048_573) + chr(983_047) and df(None).first()["p"] is None and df([]).first()["p"] == ""
    for wrong in (65_534, -1, -5, 2**31 - 1):
        with pytest.raises(Exception, match="no private-use character"):
            df([1, wrong]).collect()


def test_runs_of_nulls_and_strings(spark):
    df = spark.createDataFrame([(0, ["a", None, None, "a", "a"]), (1, []), (2, None), (3, ["a"])], "k int, p array<string>")
    got = {r["k"]: r["m"] and [tuple(x) for x in r["m"]] for r in df.select("k", align.merge_repeats(F.col("p")).alias("m")).collect()}
    assert got == {0: [("a", 0, 0), (None, 1, 2), ("a", 3, 4)], 1: [], 2: None, 3: [("a", 0, 0)]}


def test_minibatch_fit_finds_separate_clusters(spark):
    rng = np.random.default_rng(5)
    middles = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0], [10.0, 10.0]])
    points = np.repeat(middles, 150, 0) + rng.normal(0, 0.3, (600, 2))
    df = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(points)] + [(999, None)], "k int, v array<double>")
    for pool in (10_000, 300):
        got = np.array(sorted(r["vec"] for r in cluster.fit_minibatch(df, "v", 4, batch=100, n_init=5, pool=pool).collect()))
        assert np.abs(got.round() - np.array(sorted(middles.tolist()))).max() == 0
    with pytest.raises(ValueError):
        cluster.fit_minibatch(df.limit(2), "v", 4)


def test_frames_in_spans_are_those_of_a_range_join(spark):
    frames = spark.createDataFrame([(1, [10, 11, None, 13]), (2, []), (3, None), (None, [9])], "k int, units array<int>")
    spans = [(1, "a", -2, 2), (1, "b", 1, 9), (1, "c", 2, 2), (1, "d", 4, 6), (1, "e", -3, 0), (1, "f", None, 2), (2, "g", 0, 1), (3, "h", 0, 1), (None, "i", 0, 1), (1, "j", 0, 2**31 - 1)]
    got = joins.frames_in_spans(frames, spark.createDataFrame(spans, "k int, name string, first int, until int"), "k").select("name", "frame_idx", "unit", "first")
    units_of = {0: 10, 1: 11, 2: None, 3: 13}
    expected = {(name, i, u, a) for k, name, a, b in spans if k == 1 and a is not None for i, u in units_of.items() if a <= i < b}
    assert {tuple(r) for r in got.collect()} == expected
