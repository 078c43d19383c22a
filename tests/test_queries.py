import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import queries
from corpusloom.operators import align


def spellings(y, frames):
    """Every path of labels over the frames that spells y: each state after the one before, a blank passed over between different labels."""
    states = [0]
    for c in y:
        states += [c, 0]

    def go(at, left):
        if not left:
            if at >= len(states) - 2:
                yield ()
            return
        for to in range(at, min(at + 3, len(states))):
            if to < at + 2 or states[to] and states[to] != states[at]:
                for rest in go(to, left - 1):
                    yield (states[to], *rest)

    for first in (0, 1):
        for rest in go(first, frames - 1):
            yield (states[first], *rest)


def test_ctc_align_takes_all_letters_and_frames(spark, tmp_path):
    rows = [(0, ["a b c d e f g", "h i j k l m n o"], 18), (1, ["a a b"], 5), (2, ["x"], 3), (3, ["a b c d e f g h i j k l m n"], 13), (4, ["a a"], 2), (5, ["a"], 0), (6, ["a"], None), (7, [""], 4), (2**40, ["z y", "", "x x"], 9)]
    data = [(k, u, None if n is None else list(range(n))) for k, u, n in rows]
    spark.createDataFrame(data, "_row_idx bigint, uroman array<string>, speech_tokens array<int>").write.parquet(str(tmp_path / "mls_aligned.parquet"))
    got = {r["_row_idx"]: (r["path"], r["error"]) for r in queries.ctc_align(spark, str(tmp_path)).collect()}
    frames = spark.createDataFrame([(k, t) for k, _, n in rows for t in range(1, (n or 0) + 1)], "k bigint, t int")
    frame = F.transform(F.sequence(F.lit(0), F.lit(26)), lambda c: -F.pmod(F.xxhash64("k", "t", c), F.lit(1000)) / F.lit(100.0))
    told = {(r["k"], r["t"]): r["e"] for r in frames.select("k", "t", frame.alias("e")).collect()}
    for k, u, n in rows:
        y = [ord(c) - 96 for c in " ".join(u).split()]
        if not y or not n:
            assert got[k] == (None, "no emissions" if y else "no tokens")
            continue
        e = [told[k, t] for t in range(1, n + 1)]
        score = lambda p: sum(e[t][c] for t, c in enumerate(p))  # noqa: B023, E731
        ways = set(spellings(y, n))
        if not ways:
            assert got[k] == (None, "more targets than frames")
            continue
        assert got[k][1] is None and len(got[k][0]) == n and tuple(got[k][0]) in ways
        assert abs(score(got[k][0]) - max(map(score, ways))) < 1e-9


def one_by_one(emissions, targets, blank=0):
    """Frame after frame over all states of one row."""
    labels = [blank]
    for c in targets:
        labels += [c, blank]
    score, came = [emissions[0][c] if s < 2 else -np.inf for s, c in enumerate(labels)], []
    for e in emissions[1:]:
        options = [[score[s], score[s - 1] if s else -np.inf, score[s - 2] if s > 1 and labels[s] != blank and labels[s] != labels[s - 2] else -np.inf] for s in range(len(labels))]
        came.append([int(np.argmax(o)) for o in options])
        score = [o[c] + e[x] for o, c, x in zip(options, came[-1], labels)]
    state = len(labels) - 1 if len(labels) == 1 or score[-1] >= score[-2] else len(labels) - 2
    path = [labels[state]]
    for c in reversed(came):
        state -= c[state]
        path.append(labels[state])
    return path[::-1]


def test_paths_of_many_rows_are_those_of_each():
    rng = np.random.default_rng(6)
    for _ in range(20):
        targets = [rng.integers(1, 4, size=int(rng.integers(0, 12))).tolist() for _ in range(9)]
        need = [len(y) + sum(a == b for a, b in zip(y, y[1:])) for y in targets]
        emissions = [-rng.integers(0, 4, size=(max(1, n) + int(rng.integers(0, 8)), 4)).astype(float) for n in need]
        got = align._paths(emissions, targets, 0)
        assert [p.tolist() for p in got] == [one_by_one(e, y) for e, y in zip(emissions, targets)]


def test_kmeans_fit_has_the_operators_defaults(spark, tmp_path, monkeypatch):
    spark.createDataFrame([([1.0],)], "embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    seen = []

    class Fitted(Exception):
        pass

    class Counted:
        def __init__(self, **given):
            seen.append(given)

        def fit(self, data):
            if len(seen) == 20:
                raise Fitted
            return self

        summary = type("", (), {"trainingCost": 1.0})

    monkeypatch.setattr(queries.cluster, "KMeans", Counted)
    with pytest.raises(Fitted):
        queries.kmeans_fit(spark, str(tmp_path))
    assert {(x["maxIter"], x["tol"]) for x in seen} == {(100, 0.0)} and len({x["seed"] for x in seen}) == 20


def test_frame_range_join_keeps_frames_from_the_driver(spark, tmp_path):
    """long rows beside odd ones give what SQL gives, under a limit of broadcasts that 200,000 frames exceed."""
    unit = lambda k, n: [None if (k + i) % 97 == 0 else (k * 31 + i * 7) % 5000 for i in range(n)]
    even = lambda n, of: ([i * of for i in range(n)], [(i + 1) * of for i in range(n)])
    tokens = lambda n: ["t"] * n
    rows = [(k, tokens(400), unit(k, 20_000), *even(400, 1.003)) for k in range(10)]
    rows += [
        (20, tokens(3), unit(20, 50), *even(3, 0.32)), (20, tokens(4), unit(21, 70), *even(4, 0.17)),  # one key twice
        (None, tokens(2), unit(22, 40), *even(2, 0.3)), (23, tokens(2), None, *even(2, 0.3)), (24, tokens(2), [], *even(2, 0.3)),
        (25, tokens(2), [None] * 40, *even(2, 0.3)), (26, None, unit(26, 40), *even(2, 0.3)), (27, [], unit(27, 40), *even(2, 0.3)),
        (28, tokens(1), unit(28, 90), *even(4, 0.3)), (29, tokens(5), unit(29, 90), *even(3, 0.3)), (30, tokens(3), unit(30, 90), [0.0, 0.3, 0.6], [0.3]),
        (31, tokens(4), unit(31, 60), [0.5, None, 0.2, 9.0], [0.1, 0.4, None, 9.5]), (32, tokens(4), unit(32, 60), [-0.5, -0.9, 0.0, 1.1], [0.4, -0.2, 99.0, 1.3]),
        (33, tokens(2), unit(33, 60), None, [0.3, 0.6]), (34, tokens(3), unit(34, 60), [0.0, 0.1, 0.1], [0.5, 0.6, 0.1]), (2**40, tokens(1), [7], [0.0], [0.02]),
    ]
    schema = "_row_idx bigint, tokenized array<string>, speech_tokens array<int>, aligned_token_start_time array<double>, aligned_token_end_time array<double>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "mls_aligned.parquet"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        got = sorted(tuple(r) for r in queries.frame_range_join(spark, str(tmp_path)).select("_row_idx", "position", "n", "total").collect())
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW mls_aligned AS SELECT * FROM '{tmp_path}/mls_aligned.parquet/*.parquet'")
        told = sorted(db.sql(f"SELECT _row_idx, position, n, total FROM ({queries.SQL['frame_range_join']})").fetchall())
    assert got == told and len(got) > 4000 and {r[0] for r in got} >= {20, 25, 28, 29, 30, 32, 34, 2**40}
