import random

from corpusloom.llm import lookalikes, runs


def aligned(spark, lists):
    return spark.createDataFrame([(k, x, 0) for k, x in enumerate(lists)], "_row_idx bigint, speech_tokens array<int>, starts int")


def book(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "cluster int, vec array<double>")


def test_runs_equal_brute_force(spark):
    rng = random.Random(3)
    vectors = [[rng.random() * 0.6 for _ in range(3)] for _ in range(12)]
    near = lambda a, b: a == b or (a is not None and b is not None and a < 12 and b < 12 and sum((p - q) ** 2 for p, q in zip(vectors[a], vectors[b])) ** 0.5 < 0.25)
    lists = [[rng.choice([*range(12), 50]) if rng.random() < 0.6 else None for _ in range(rng.randrange(60))] for _ in range(40)] + [None, [], [4] * 9]
    expected = set()
    for k, x in enumerate(lists):
        start = 0
        for i in range(1, len(x or []) + 1):
            if i == len(x) or not near(x[i], x[i - 1]):
                if i - start >= 5:
                    expected.add((k, start, i - 1))
                start = i
    assert {tuple(r) for r in runs.found(aligned(spark, lists), book(spark, vectors)).collect()} == expected


def test_collapse_keeps_rows_and_frames(spark):
    lists = [[1, 1, 2, 2, 2, 1], None, [], [0]]
    out = {r["_row_idx"]: r for r in runs.collapse(aligned(spark, lists), book(spark, [[0.0], [5.0], [9.0]])).collect()}
    assert out[0]["units"] == [1, 2, 1] and out[0]["frames"] == [2, 3, 1] and out[0]["duration_s"] == [0.04, 0.06, 0.02] and out[0]["start_s"] == [0.0, 0.04, 0.1]
    assert out[1]["units"] == [] and out[2]["frames"] == [] and out[3]["frames"] == [1]
    assert runs.found(aligned(spark, []), book(spark, [])).count() == 0


def tables(spark, texts, other=()):
    mls = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "_row_idx bigint, transcript string, look string")
    vox = spark.createDataFrame([(k, t) for k, t in enumerate(other)], "_row_idx bigint, raw_text string")
    return {"mls_transcripts": mls, "voxpopuli": vox}


BASE = ["the café is open and the sailor was near", "every copper gathered near the wharf", "море и небо", "сорока"]


def test_looks_are_found_and_differences_kept(spark):
    texts = [
        *BASE,
        "the café is open and the sailor was near",
        "thе café іs оpen and the sаilor was near",
        "ｔｈｅ　ｃａｆé ｉｓ open and the sai​lor was near﻿",
        "the cafe is open and the sailor was near",
        "The café is open and the sailor was near",
        "the café is open, and the sailor was near",
        None,
        "",
        "the café is open and the sailor was near",
    ]
    got = {tuple(r) for r in lookalikes.found(tables(spark, texts)).collect()}
    same = [0, 4, 5, 6, 12]
    expected = {("transcript", a, b) for a in same for b in same if a < b} - {("transcript", 0, 12)}
    assert got == expected


def test_forms_stay_in_one_script(spark):
    out = {r["_row_idx"]: r["text"] for r in lookalikes.consistent(tables(spark, [*BASE, "мope", "ѕаilοr ﬁne x²", None, ""])).collect() if r["field"] == "transcript"}
    assert [out[k] for k in range(4)] == BASE
    assert out[4] == "море" and out[5] == "sailor fine x²" and out[6] is None and out[7] == ""


def test_long_and_empty(spark):
    long = "а" * 5000 + " " + "b " * 3000
    out = lookalikes.consistent(tables(spark, [long, long], ["x"])).collect()
    assert {len(r["text"]) for r in out if r["field"] == "transcript"} == {len(long)}
    assert lookalikes.found(tables(spark, [])).count() == 0


def test_classes_hold_the_links_of_the_pairs(spark):
    rng = random.Random(9)
    words = ["copper", "соpper", "cоppеr", "море", "мope", "ᏟᎪᎢ", "CAT", "ꓚꓮꓔ", "x0", "xO", None, ""]
    texts = [rng.choice(words) for _ in range(80)]
    links = {}
    for _, a, b in lookalikes.found(tables(spark, texts)).collect():
        links[a] = links.get(a, 0) + 1
        links[b] = links.get(b, 0) + 1
    rows = {r["_row_idx"]: r for r in lookalikes.classes(tables(spark, texts)).collect() if r["field"] == "transcript"}
    assert len(rows) == 80 and all(rows[k]["n_links"] == links.get(k, 0) for k in rows)
    for k, r in rows.items():
        same = [j for j in rows if texts[k] is not None and rows[j]["look_class"] == r["look_class"]]
        assert r["n_rows"] == len(same) and r["look_class"] == (min(same) if same else None)
    # digits and letters differ visibly; capitals of other scripts don't
    by_text = {t: rows[k]["look_class"] for k, t in enumerate(texts)}
    assert by_text["x0"] != by_text["xO"] and by_text["ᏟᎪᎢ"] == by_text["CAT"] == by_text["ꓚꓮꓔ"]
