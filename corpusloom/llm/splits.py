"""Problem 1: train, validation and test splits that keep related utterances together.

Utterances are related through a speaker number (in ``ID`` or ``speaker_id``) or a book (in
``ID``). Related groups are the connected components of the speaker graph, found with
alternating star contractions on distinct edges. Components of one size and label profile form a
bundle. From the largest sizes down, a min-cost flow spreads the rows that are left, label by label,
over the splits with costs for deviating from the quotas; the bundles of a size take their part of
it, rounded to whole components, and a hash decides which members of a bundle go where.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import first_number, id_book, id_speaker, unit_hash
from corpusloom.operators.joins import split_join
from corpusloom.operators.ranking import with_rank
from corpusloom.session import checkpointed

#: Names and shares of the splits.
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Distinct (size, label profile) bundles that the driver plans with, and labels; more raise.
MAX_BUNDLES, MAX_LABELS = 2_000_000, 1_000
#: Cost of a row beyond a split's quota, where a row beyond its quota of one label costs 1.
SPLIT_COST = 4.0
#: Best single moves of a group that are made after rounding, at most.
MOVES = 500


def ties(transcripts: DataFrame) -> DataFrame:
    """Distinct (a, b, book, label) of the rows, the speakers of ``ID`` and field, with their number ``n``."""
    return (
        transcripts.select(
            id_speaker(F.col("ID")).alias("a"), first_number(F.col("speaker_id")).alias("b"), id_book(F.col("ID")).alias("book"), _label(transcripts).alias("label")
        )
        .groupBy("a", "b", "book", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _label(df: DataFrame) -> Column:
    """What the splits are balanced by: the sample rate, '' where the audio is missing."""
    return F.coalesce(df["sample_rate"].cast("string"), F.lit("")) if "sample_rate" in df.columns else F.lit("")


def _edges(tied: DataFrame, n: int) -> DataFrame:
    """Of ``n`` ties the speaker pairs (u > v): the two numbers of a row, and each speaker of a book with its smallest."""
    own = tied.filter("a is not null and b is not null and a <> b").select("a", "b")
    in_book = (
        tied.filter("book is not null")
        .select("book", F.explode(F.array("a", "b")).alias("a"))
        .filter("a is not null")
        .distinct()
    )
    least = in_book.groupBy("book").agg(F.min("a").alias("b"))
    via_book = split_join(in_book, least, ["book"], ["a"], most=2 * n).filter("a <> b").select("a", "b")
    return own.union(via_book).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, least): the smallest node of each node's component, for nodes with an edge, ``least`` < ``node``.

    Alternating large-star and small-star contractions: both need only the minimum of a node's
    neighbours, so a hub is pre-aggregated, and the edges of a very large hub are dealt to several
    tasks. Each round is checkpointed.
    """
    edges = checkpointed(edges)
    state = _fingerprint(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = edges.union(edges.select("v", "u"))
        # large star: neighbours larger than u move to the least of u's neighbourhood
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = split_join(both.filter("v > u"), least, ["u"], ["v"], most=state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, low, ["u"], ["v"], most=state[0]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = checkpointed(small)
        new = _fingerprint(edges)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def found(transcripts: DataFrame, shares: dict[str, float] = SPLITS, seed: int = 1) -> DataFrame:
    """(group_speaker, speaker) of each speaker number that is not the smallest of its group, read from the splits.

    A speaker's group is the one its ties were assigned with; a speaker whose ties lie in more than
    one split would be left out, as the splits had then torn it.
    """
    assigned = _assigned(transcripts, shares, seed)
    speakers = assigned.select("group_key", "split", F.explode(F.array_distinct(F.array("a", "b"))).alias("speaker")).filter("speaker is not null")
    each = speakers.groupBy("speaker").agg(F.min("group_key").alias("group_key"), F.min("split").alias("one"), F.max("split").alias("other")).filter("one = other")
    head = F.substring("group_key", 2, 20).cast("bigint")
    return each.select(head.alias("group_speaker"), "speaker").filter("group_speaker < speaker")


def split_related(transcripts: DataFrame, shares: dict[str, float] = SPLITS, seed: int = 1) -> DataFrame:
    """(_row_idx, group_key, split) for every row.

    ``group_key`` is ``s<number>`` of the group's smallest speaker, ``b<book>`` for a book without
    any speaker and ``r<_row_idx>`` for a row without either; rows with null ``ID`` and no number
    in ``speaker_id`` are groups of their own. The result depends only on the rows and ``seed``.
    Empty input gives an empty result. Other columns are ignored.
    """
    keyed, placed, n, rows_ = _place(transcripts, shares, seed)
    tie = lambda a, b, book: F.concat_ws("_", F.coalesce(a.cast("string"), F.lit("-")), F.coalesce(b.cast("string"), F.lit("-")), F.concat(F.lit("b"), book))
    named = keyed.filter("group_key is not null").withColumn("tie", tie(F.col("a"), F.col("b"), F.col("book")))
    by_tie = split_join(named.select("tie", "group_key").distinct(), placed, ["group_key"], ["tie"], most=n)
    speaker, field, book = id_speaker(F.col("ID")), first_number(F.col("speaker_id")), id_book(F.col("ID"))
    rows = transcripts.filter(speaker.isNotNull() | field.isNotNull() | book.isNotNull()).select("_row_idx", tie(speaker, field, book).alias("tie"))
    tied_rows = split_join(rows, by_tie, ["tie"], ["_row_idx"], most=rows_)
    lone_rows = _lone(transcripts).select("_row_idx", "group_key").join(placed, "group_key")
    return tied_rows.select("_row_idx", "group_key", "split").union(lone_rows.select("_row_idx", "group_key", "split"))


def _assigned(transcripts: DataFrame, shares: dict[str, float], seed: int) -> DataFrame:
    """(a, b, book, group_key, split) of the distinct ties."""
    keyed, placed, n, _ = _place(transcripts, shares, seed)
    return split_join(keyed.filter("group_key is not null").select("a", "b", "book", "group_key").distinct(), placed, ["group_key"], ["a", "b", "book"], most=n)


def _lone(transcripts: DataFrame) -> DataFrame:
    """The rows without speaker and book; each is a group."""
    alone = transcripts.select("_row_idx", "ID", "speaker_id", _label(transcripts).alias("label"))
    none = id_speaker(F.col("ID")).isNull() & first_number(F.col("speaker_id")).isNull() & id_book(F.col("ID")).isNull()
    return alone.filter(none).select("_row_idx", F.concat(F.lit("r"), F.col("_row_idx").cast("string")).alias("group_key"), "label")


def _place(transcripts: DataFrame, shares: dict[str, float], seed: int) -> tuple[DataFrame, DataFrame, int, int]:
    """The distinct ties with their group, (group_key, split) of all groups, and the numbers of ties and rows."""
    tied = checkpointed(ties(transcripts))
    n, rows_ = tied.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    links = components(_edges(tied, n))
    keyed = checkpointed(_group_keys(tied, links, n))  # (a, b, book, label, n, group_key): distinct ties only
    lone = _lone(transcripts).select("group_key", "label", F.lit(1).cast("bigint").alias("n"))
    sized = keyed.filter("group_key is not null").select("group_key", "label", "n").union(lone)
    by_label = sized.groupBy("group_key", "label").agg(F.sum("n").alias("n"))
    # the labels of a group with their numbers of rows; the size is their sum
    profile = F.array_sort(F.collect_list(F.struct("label", "n")))
    groups = checkpointed(by_label.groupBy("group_key").agg(profile.alias("profile")).withColumn("bundle", F.to_json("profile")))

    bundles = groups.groupBy("bundle").agg(F.count(F.lit(1)).alias("groups"), F.first("profile").alias("profile"))
    rows = bundles.limit(MAX_BUNDLES + 1).collect()
    if len(rows) > MAX_BUNDLES:
        raise ValueError(f"more than {MAX_BUNDLES} different sizes and label profiles")
    cuts = allot([(r["bundle"], r["groups"], {p["label"]: p["n"] for p in r["profile"]}) for r in rows], list(shares.values()))
    plan = transcripts.sparkSession.createDataFrame(
        [(b, int(sum(n)), max(1, int(sum(n)) // 100_000), [int(x) for x in np.cumsum(n)]) for b, n in cuts] or [("", 0, 1, [0])],
        "bundle string, members bigint, buckets bigint, cuts array<bigint>",
    )
    unit = groups.select("group_key", "bundle", unit_hash("group_key", seed=seed).alias("unit"))
    largest = max((r["groups"] for r in rows), default=0)
    placed = with_rank(split_join(unit, plan, ["bundle"], ["group_key"], most=largest), ["bundle"], "unit", "buckets", ["group_key"])
    split = F.element_at(F.array(*map(F.lit, shares)), F.size(F.filter("cuts", lambda c: c <= F.col("rank"))) + 1)
    return keyed, placed.select("group_key", split.alias("split")), n, rows_


def _group_keys(tied: DataFrame, links: DataFrame, n: int) -> DataFrame:
    one = tied.withColumn("node", F.coalesce("a", "b"))
    by_speaker = split_join(one, links, ["node"], ["a", "b", "book", "label"], "left", most=n)
    direct = by_speaker.filter("node is not null").select("a", "b", "book", "label", "n", F.concat(F.lit("s"), F.coalesce("least", "node").cast("string")).alias("group_key"))
    book_only = one.filter("node is null").select("a", "b", "book", "label", "n")
    via = direct.filter("book is not null").groupBy("book").agg(F.min("group_key").alias("k"))
    rest = book_only.join(via, "book", "left").select(
        "a", "b", "book", "label", "n", F.when(F.col("book").isNotNull(), F.coalesce("k", F.concat(F.lit("b"), "book"))).alias("group_key")
    )
    return direct.union(rest)


def report(transcripts: DataFrame, shares: dict[str, float] = SPLITS, seed: int = 1) -> DataFrame:
    """(split, n_rows, n_groups, share, target) of the splits, one row for each split that has rows."""
    done = split_related(transcripts, shares, seed)
    target = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    per_group = done.groupBy("split", "group_key").agg(F.count(F.lit(1)).alias("n"))
    out = per_group.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))
    total = out.agg(F.sum("n_rows").alias("total"))
    return out.join(F.broadcast(total)).select("split", "n_rows", "n_groups", (F.col("n_rows") / F.col("total")).alias("share"), target[F.col("split")].alias("target"))


def checked(transcripts: DataFrame, shares: dict[str, float] = SPLITS, seed: int = 1) -> DataFrame:
    """One row that tells whether the splits hold: what is torn, what was counted, and whether the sizes are right.

    ``torn_speakers`` and ``torn_books`` are numbers and books with rows in more than one split, ``speakers``
    and ``books`` how many were looked at, ``n_rows`` and ``distinct_rows`` the assigned rows, and
    ``near_quotas`` whether each split is within the largest group of its quota.
    """
    done = checkpointed(split_related(transcripts, shares, seed))
    rows = transcripts.select("_row_idx", F.array_distinct(F.array(id_speaker(F.col("ID")), first_number(F.col("speaker_id")))).alias("speakers"), id_book(F.col("ID")).alias("book")).join(done, "_row_idx")

    def torn(keys: DataFrame, name: str) -> DataFrame:
        each = keys.filter("key is not null").groupBy("key").agg(F.min("split").alias("one"), F.max("split").alias("other"))
        return each.agg(F.count_if(F.col("one") != F.col("other")).alias(f"torn_{name}"), F.count(F.lit(1)).alias(name))

    speakers = torn(rows.select(F.explode("speakers").alias("key"), "split"), "speakers")
    books = torn(rows.select(F.col("book").alias("key"), "split"), "books")
    # of each group and split one count, so the row ids are the only thing that is counted one by one
    groups = done.groupBy("split", "group_key").agg(F.count(F.lit(1)).alias("n"))
    largest = groups.agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    target = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    sizes = groups.groupBy("split").agg(F.sum("n").alias("n"))
    far = sizes.join(F.broadcast(largest)).agg(F.coalesce(F.max(F.abs(F.col("n") - target[F.col("split")] * F.col("total")) - F.col("largest")), F.lit(0.0)).alias("far"))
    counted = done.groupBy("_row_idx").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("distinct_rows"))
    whole = speakers.join(F.broadcast(books)).join(F.broadcast(counted)).join(F.broadcast(far))
    return whole.select("torn_speakers", "speakers", "torn_books", "books", "n_rows", "distinct_rows", (F.col("far") <= 0).alias("near_quotas"))


def flow(supply: np.ndarray, need: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Rows of each label for each split (splits x labels): a min-cost flow by successive shortest paths.

    The network: source to label (its rows, ``supply``), label to split, split to sink. An edge to a
    split takes what the split still needs of the label in four parts of rising small cost, so that
    a lack is shared, and beyond that rows at cost 1; an edge to the sink likewise takes the room the
    split has left, and rows beyond it at ``SPLIT_COST``.
    """
    k, n = need.shape
    source, sink = 0, n + k + 1
    head: list[int] = []
    cap: list[float] = []
    cost: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + k + 2)]

    def edge(u: int, v: int, c: float, price: float) -> None:
        for a, b, room_, p in ((u, v, c, price), (v, u, 0.0, -price)):
            out[a].append(len(head))
            head.append(b)
            cap.append(room_)
            cost.append(p)

    def parts(u: int, v: int, free: float, beyond: float) -> None:
        for i in range(4):
            edge(u, v, max(free, 0.0) / 4, i * 0.05)
        edge(u, v, float("inf"), beyond)

    for label in range(n):
        edge(source, 1 + label, float(supply[label]), 0.0)
        for j in range(k):
            parts(1 + label, 1 + n + j, float(need[j, label]), 1.0)
    for j in range(k):
        parts(1 + n + j, sink, float(room[j]), SPLIT_COST)
    least = 1e-9 * max(1.0, float(supply.sum()))
    while True:
        dist, via = [float("inf")] * len(out), [-1] * len(out)
        dist[source], queue = 0.0, [source]
        while queue:
            nodes, queue = queue, []
            for u in nodes:
                for e in out[u]:
                    if cap[e] > least and dist[u] + cost[e] < dist[head[e]] - 1e-12:
                        dist[head[e]], via[head[e]] = dist[u] + cost[e], e
                        queue.append(head[e])
        if via[sink] < 0:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = head[via[v] ^ 1]
        send = min(cap[e] for e in path)
        for e in path:
            cap[e] -= send
            cap[e ^ 1] += send
    rows = np.zeros((k, n))
    for label in range(n):
        for e in out[1 + label]:
            if not e & 1 and head[e] > n:
                rows[head[e] - n - 1, label] += cap[e ^ 1]
    return rows


def allot(bundles: list[tuple[str, int, dict[str, int]]], shares: list[float]) -> list[tuple[str, list[int]]]:
    """Whole groups for each split: [(bundle, [groups in split 0, 1, ...])].

    ``bundles`` holds (name, groups, rows of one group by label). From the largest sizes (by power of
    two) down, the flow of all rows that are left gives each bundle of the size its groups in each
    split. The whole ones are taken; each odd group goes where it leaves the least squared
    deviation from the flow over all labels and sizes. Whatever a size is off by, the flow of the next
    smaller one makes up. In the end, single groups of any bundle move along negative edges of
    the residual network, as long as that lowers the deviation from the quotas.
    """
    if not bundles:
        return []
    bundles = sorted(bundles)
    labels = {x: i for i, x in enumerate(sorted({x for b in bundles for x in b[2]}))}
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    k, share = len(shares), np.array(shares) / sum(shares)
    number = np.array([b[1] for b in bundles])
    held = np.zeros((len(bundles), len(labels)))
    for i, (_, _, counts) in enumerate(bundles):
        for x, n in counts.items():
            held[i, labels[x]] = n
    size = held.sum(1)
    total = (held * number[:, None]).sum(0)
    target, quota = share[:, None] * total, share * total.sum()
    weight, wide = 1 / np.maximum(target, 1), SPLIT_COST / np.maximum(quota, 1)
    placed, whole = np.zeros((k, len(labels))), np.zeros((len(bundles), k), dtype=np.int64)
    tier = np.floor(np.log2(size)).astype(int)
    left = total.copy()
    for t in np.unique(tier)[::-1]:
        mine = np.flatnonzero(tier == t)
        mine = mine[np.argsort(-size[mine], kind="stable")]
        rows = flow(left, target - placed, quota - placed.sum(1))
        part = (rows / np.maximum(rows.sum(0), 1e-9)).T  # labels x splits
        wanted = number[mine, None] * (held[mine] @ part) / size[mine, None]
        took = np.floor(wanted + 1e-9).astype(np.int64)
        owed = np.zeros_like(placed)
        for i, b in enumerate(mine):
            owed += (wanted[i] - took[i])[:, None] * held[b]
            for _ in range(int(number[b] - took[i].sum())):
                gain = (weight * (held[b] ** 2 - 2 * owed * held[b])).sum(1) + wide * (size[b] ** 2 - 2 * owed.sum(1) * size[b])
                j = int(np.argmin(gain))
                took[i, j] += 1
                owed[j] -= held[b]
        whole[mine] = took
        placed += took.T @ held[mine]
        left -= number[mine] @ held[mine]
    _improve(whole, held, size, placed, target, quota, weight, wide)
    return [(bundles[b][0], whole[b].tolist()) for b in range(len(bundles))]


def _improve(whole: np.ndarray, held: np.ndarray, size: np.ndarray, placed: np.ndarray, target: np.ndarray, quota: np.ndarray, weight: np.ndarray, wide: np.ndarray) -> None:
    """Moves the one group whose move lowers the squared deviation most, from any bundle, until none does."""
    k = len(quota)
    square, squares = held**2, size**2
    for _ in range(MOVES):
        off, wide_off = placed - target, placed.sum(1) - quota
        best, move = -1e-9, None
        for i in range(k):
            has = np.flatnonzero(whole[:, i] > 0)
            if not len(has):
                continue
            away = square[has] @ weight[i] - 2 * held[has] @ (weight[i] * off[i]) + wide[i] * (squares[has] - 2 * size[has] * wide_off[i])
            for j in range(k):
                if i != j:
                    gain = away + square[has] @ weight[j] + 2 * held[has] @ (weight[j] * off[j]) + wide[j] * (squares[has] + 2 * size[has] * wide_off[j])
                    at = int(np.argmin(gain))
                    if gain[at] < best:
                        best, move = gain[at], (int(has[at]), i, j)
        if move is None:
            return
        b, i, j = move
        whole[b, i] -= 1
        whole[b, j] += 1
        placed[i] -= held[b]
        placed[j] += held[b]
