import random
from collections import Counter

from corpusloom.llm import sampling, splits

MLS = "ID string, transcript string, duration double, sample_rate double, num_samples bigint, speaker_id string, _row_idx bigint"


def rows(spark, pairs):
    return spark.createDataFrame([(i, "t", 1.0, 16000.0, 1, s, k) for k, (i, s) in enumerate(pairs)], MLS)


def brute_groups(pairs):
    import re

    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in pairs:
        nodes = []
        if i and "_" in i:
            nodes.append(int(i.split("_")[0]))
            if len(i.split("_")) >= 3:
                nodes.append("b" + i.split("_")[1])
        if m := re.search(r"\d+", s or ""):
            nodes.append(int(m[0]))
        for a, b in zip(nodes, nodes[1:]):
            parent[find(a)] = find(b)
        for n in nodes:
            find(n)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return groups


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    pairs = [(f"{rng.randrange(40)}_{rng.randrange(60)}_{k:06}", rng.choice([None, "", "nan", f"spk_{rng.randrange(40):05}", f" {rng.randrange(40)}\xa0", f"{rng.randrange(40)}.0"]) if rng.random() < 0.1 else None) for k in range(120)]
    expected = set()
    for members in brute_groups(pairs).values():
        speakers = sorted(m for m in members if isinstance(m, int))
        expected |= {(speakers[0], s) for s in speakers[1:]}
    got = {tuple(r) for r in splits.found(rows(spark, pairs)).collect()}
    assert got == expected


def test_chain_of_books_is_one_group(spark):
    pairs = [(f"{k}_{b}_0", None) for k in range(1, 60) for b in (k, k + 1)]
    got = {tuple(r) for r in splits.found(rows(spark, pairs)).collect()}
    assert got == {(1, k) for k in range(2, 60)}


def test_splits_keep_groups_and_quotas(spark):
    rng = random.Random(2)
    pairs = [(f"{s}_{s * 10 + rng.randrange(3)}_{k}", str(s)) for s in range(200) for k in range(rng.randrange(1, 9))]
    pairs += [(None, None), (None, "７"), ("nounderscore", "x")]
    table = rows(spark, pairs)
    done = splits.split_related(table).collect()
    assert sorted(r["_row_idx"] for r in done) == list(range(len(pairs)))
    by_group = {}
    for r in done:
        by_group.setdefault(r["group_key"], set()).add(r["split"])
    assert all(len(x) == 1 for x in by_group.values())
    share = Counter(r["split"] for r in done)
    assert abs(share["train"] / len(pairs) - 0.8) < 0.02 and abs(share["test"] / len(pairs) - 0.1) < 0.02
    assert {(r["_row_idx"], r["split"]) for r in splits.split_related(table).collect()} == {(r["_row_idx"], r["split"]) for r in done}


def test_splits_of_nothing_and_clashing_names(spark):
    assert splits.split_related(rows(spark, []).limit(0)).count() == 0
    assert splits.found(rows(spark, [])).count() == 0
    odd = rows(spark, [("1_2_3", "1"), ("4_2_5", "4")]).selectExpr("*", "1 as a", "2 as group_key", "3 as rank", "4 as u")
    assert {r["group_key"] for r in splits.split_related(odd).collect()} == {"s1"}


def test_allotment_uses_every_group():
    bundles = [("a", 7, {"x": 10}), ("b", 1, {"y": 500}), ("c", 100, {"x": 1})]
    cuts = dict(splits.allot(bundles, [0.8, 0.1, 0.1]))
    assert {k: sum(v) for k, v in cuts.items()} == {"a": 7, "b": 1, "c": 100}
    assert cuts["b"][0] == 1


def targets(spark, data):
    return spark.createDataFrame(data, "plan_id bigint, sample_rows bigint, speaker bigint, target_share double, min_rows bigint")


def test_sample_counts_are_exact(spark):
    pairs = [(f"1_1_{k}", "1") for k in range(30_000)] + [(f"2_1_{k}", None) for k in range(50)] + [("2_1_3", None), ("3_1_1", "S-3")]
    table = rows(spark, pairs)
    plan = targets(spark, [(p, 1000, 1, 0.9, 0) for p in range(6)] + [(0, 1000, 2, 0.1, 0), (1, 1000, 2, 0.02, 40), (2, 1000, 3, 0.001, 5), (2, 1000, 4, 0.0, 0)])
    drawn = sampling.sample(table, plan).collect()
    counts = Counter((r["plan_id"], r["speaker"]) for r in drawn)
    assert all(counts[p, 1] == 900 for p in range(6))
    assert (counts[0, 2], counts[1, 2], counts[2, 3], counts[2, 4]) == (50, 40, 1, 0)
    assert len({(r["plan_id"], r["ID"]) for r in drawn}) == len(drawn)
    found = {tuple(r) for r in sampling.found(table, plan).collect()}
    assert found == {(0, 2), (2, 3)}
    report = {(r["plan_id"], r["speaker"]): r["deficit"] for r in sampling.report(table, plan).collect()}
    assert report[0, 2] == 50 and report[2, 3] == 4 and report[0, 1] == 0


def test_unrounded_target_counts(spark):
    table = rows(spark, [("5_1_1", None), ("5_1_2", None), (None, "5"), ("5_1_1", None)])
    plan = targets(spark, [(1, 23, 5, 0.1, 0), (2, 20, 5, 0.1, 0), (3, None, 5, None, None)])
    assert {tuple(r) for r in sampling.found(table, plan).collect()} == {(1, 5)}


def test_sample_of_nothing(spark):
    assert sampling.sample(rows(spark, []), targets(spark, [])).count() == 0
    assert {tuple(r) for r in sampling.found(rows(spark, []), targets(spark, [(1, 10, 1, 1.0, 0)])).collect()} == {(1, 1)}


def test_allotment_keeps_every_label_in_proportion():
    rng = random.Random(8)
    bundles = {}
    for _ in range(400):
        profile = {"a": rng.randrange(1, 60), "b": rng.randrange(0, 30), "c": rng.choice([0, 0, 0, 2])} | {f"rare{rng.randrange(9)}": 1}
        profile = {x: n for x, n in profile.items() if n}
        bundles[str(sorted(profile.items()))] = (str(sorted(profile.items())), rng.randrange(1, 5), profile)
    cuts = dict(splits.allot(list(bundles.values()), [0.8, 0.1, 0.1]))
    total, got = Counter(), [Counter(), Counter(), Counter()]
    for name, groups, profile in bundles.values():
        assert sum(cuts[name]) == groups and min(cuts[name]) >= 0
        for x, n in profile.items():
            total[x] += n * groups
            for j in range(3):
                got[j][x] += n * cuts[name][j]
    for j, share in enumerate((0.8, 0.1, 0.1)):
        assert all(abs(got[j][x] - share * total[x]) <= 5 for x in total)


def test_allotment_around_a_giant_group():
    bundles = [("giant", 1, {"a": 300_000, "b": 10_000})] + [(f"s{n}", 40, {"a": n}) for n in range(1, 50)] + [("t", 5000, {"b": 3})]
    cuts = dict(splits.allot(bundles, [0.8, 0.1, 0.1]))
    rows = [sum(cuts[name][j] * sum(p.values()) for name, _, p in bundles) for j in range(3)]
    # the giant is more than train's share of label a; test and validation get all else of it
    assert cuts["giant"] == [1, 0, 0] and abs(rows[1] - rows[2]) <= 100


def test_flow_sends_all_rows_and_respects_needs():
    import numpy as np

    rows = splits.flow(np.array([10.0, 4.0]), np.array([[6.0, 3.0], [2.0, 1.0], [2.0, 0.0]]), np.array([9.0, 3.0, 2.0]))
    assert np.allclose(rows, [[6, 3], [2, 1], [2, 0]])
    # nothing needs label 1 any more: its rows go where the split still has room
    assert np.allclose(splits.flow(np.array([0.0, 3.0]), np.zeros((2, 2)), np.array([3.0, 0.0])), [[0, 3], [0, 0]])


def test_found_reads_the_placement(spark):
    plan = splits.found(rows(spark, [("1_2_3", "4"), ("4_5_6", None)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "cuts" in plan


def test_checks_of_splits(spark):
    pairs = [(f"{k % 23}_{k % 31}_{k}", str(k % 29) if k % 7 == 0 else None) for k in range(300)] + [(None, None), ("x", "12")]
    got = splits.checked(rows(spark, pairs)).first().asDict()
    assert got["torn_speakers"] == got["torn_books"] == 0 and got["n_rows"] == got["distinct_rows"] == 302 and got["speakers"] == 29 and got["books"] == 31
    none = splits.checked(rows(spark, [])).first().asDict()
    assert none["n_rows"] == 0 and none["near_quotas"]


def test_checks_of_samples(spark):
    table = rows(spark, [(f"{k % 5}_1_{k}", None) for k in range(200)] + [("1_1_1", None)])
    plan = targets(spark, [(1, 60, s, 0.2, 0) for s in range(5)] + [(1, 60, 9, 0.0, 2)])
    assert {tuple(r) for r in sampling.checked(table, plan).collect()} == {(1, s, 12, 12, 12) for s in range(5)}
