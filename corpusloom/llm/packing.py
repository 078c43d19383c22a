"""Problem 6: documents packed into training sequences of fixed capacity.

Only the histogram of lengths (at most capacity + 1 numbers) comes to the driver. There, patterns of
lengths are made: the longest open length first, then single, pair or triple lengths that fill
the gap exactly, looked up by their sum under the counts still available, else the best-fitting
length. A pattern is used as often as its lengths last. The documents of a length are ranked by a
hash, and the ranks tell each document its sequence.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import FOLDER, VOCABULARY, count_tokens
from corpusloom.llm.shared import unit_hash
from corpusloom.operators.ranking import with_rank
from corpusloom.session import checkpointed

#: Tokens of a training sequence.
CAPACITY = 2048


class Gaps:
    """Available lengths, and the sums of two of them, indexed by the sum."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.cap = len(counts) - 1
        self.pairs = np.zeros(self.cap + 1, dtype=np.int64)
        self.open = self.left > 0
        for a in np.flatnonzero(self.open):
            self._count_pairs(int(a), self.open & (np.arange(self.cap + 1) >= a), 1)

    def _count_pairs(self, a: int, others: np.ndarray, sign: int) -> None:
        b = np.flatnonzero(others)
        sums = b + a
        self.pairs[sums[sums <= self.cap]] += sign

    def take(self, lengths: Counter, times: int) -> None:
        for x, k in lengths.items():
            self.left[x] -= k * times
            if not self.left[x]:
                self._count_pairs(x, self.open, -1)
                self.open[x] = False

    def exact(self, gap: int, used: Counter) -> list[int] | None:
        """One, two or three available lengths with the sum ``gap``, the largest first."""
        spare = lambda x, k=1: self.left[x] - used[x] >= k
        if spare(gap):
            return [gap]
        if self.pairs[gap] > 0 and (pair := self._pair(gap, used, Counter())):
            return pair
        firsts = np.flatnonzero(self.open[1:gap] & (self.pairs[gap - 1 : 0 : -1] > 0))[::-1] + 1
        for a in firsts:
            if 3 * a < gap:
                break
            if spare(a) and (pair := self._pair(gap - int(a), used, Counter([int(a)]))):
                return [int(a), *pair]
        return None

    def _pair(self, total: int, used: Counter, extra: Counter) -> list[int] | None:
        half = total // 2
        # the smaller ones from half downwards: even pairs leave both long and short lengths for later
        smaller = np.flatnonzero(self.open[1 : half + 1] & self.open[total - 1 : total - half - 1 : -1] if half else [])[::-1] + 1
        for b in smaller:
            need = Counter([int(b), total - int(b)]) + extra
            if all(self.left[x] - used[x] >= k for x, k in need.items()):
                return [total - int(b), int(b)]
        return None

    def best_fit(self, gap: int, used: Counter) -> int:
        for x in np.flatnonzero(self.open[: gap + 1])[::-1]:
            if self.left[x] - used[int(x)] > 0:
                return int(x)
        return 0


def patterns(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, number of such sequences)] that use up ``counts`` (index: length).

    Each use leaves one of its lengths with fewer items than the pattern needs, so their number is
    at most the sum of capacity / length over the lengths, whatever the size of the corpus.
    """
    gaps, out = Gaps(counts), []
    top = gaps.cap
    while top > 0:
        if not gaps.left[top]:
            top -= 1
            continue
        made, gap = [top], gaps.cap - top
        used = Counter(made)
        while gap > 0:
            more = gaps.exact(gap, used) or [gaps.best_fit(gap, used)]
            if not more[0]:
                break
            made += more
            used.update(more)
            gap -= sum(more)
        times = int(min(gaps.left[x] // k for x, k in used.items()))
        gaps.take(used, times)
        out.append((made, times))
    return out


def slots(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the items of each length go: rows of (length, first rank, times, first sequence, offset), sorted."""
    rows, rank, sequence = [], Counter(), 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            rows.append((x, rank[x], times, sequence, offset))
            rank[x] += times
            offset += x
        sequence += times
    table = np.array(sorted(rows) or [(0, 0, 0, 0, 0)], dtype=np.int64)
    return {name: table[:, i] for i, name in enumerate(("length", "rank", "times", "sequence", "offset"))} | {"total": np.int64(sequence)}


def pack(documents: DataFrame, capacity: int = CAPACITY, seed: int = 6, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, sequence, offset): where each document's tokens go.

    A text of more than ``capacity`` tokens is cut into full pieces and a rest; every other
    text is one piece. Empty and null texts are one piece of 0 tokens, spread over the sequences by
    rank at offset 0. Rows with the same doc_id are packed each on its own. No rows give none.
    """
    counted = checkpointed(count_tokens(documents, folder, vocabulary))
    last = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("bigint") - 1
    pieces = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens")
    )
    histogram = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + 1 rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in histogram:
        counts[r["n_tokens"]] = r["n"]
    placed = slots(patterns(counts))
    total = max(int(placed["total"]), 1)

    @F.pandas_udf("sequence bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(placed["length"] * (1 << 44) + placed["rank"], length.to_numpy() * (1 << 44) + rank.to_numpy(), side="right") - 1
        at = np.maximum(at, 0)
        empty = length.to_numpy() == 0
        return pd.DataFrame({
            "sequence": np.where(empty, rank.to_numpy() % total, placed["sequence"][at] + rank.to_numpy() - placed["rank"][at]),
            "offset": np.where(empty, 0, placed["offset"][at]),
        })

    spark = documents.sparkSession
    sizes = spark.createDataFrame([(int(i), max(1, int(n) // 100_000)) for i, n in enumerate(counts)], "n_tokens bigint, buckets bigint")
    # repeated doc_ids share a hash; their order then makes no difference, as the rows are equal
    ranked = with_rank(pieces.withColumn("unit", unit_hash("doc_id", "piece", seed=seed)).join(F.broadcast(sizes), "n_tokens"), ["n_tokens"], "unit", "buckets", ["doc_id", "piece"])
    return ranked.withColumn("at", place("n_tokens", "rank")).select("doc_id", "piece", "first_token", "n_tokens", "at.sequence", "at.offset")


def found(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id) of the documents that alone exceed a sequence: those whose placed pieces lie in two sequences or more."""
    pieces = pack(documents, capacity)
    # a document with a second piece fills its first sequence, so the pieces' sequences always differ
    spread = pieces.groupBy("doc_id").agg(F.max("piece").alias("last"), F.min("sequence").alias("one"), F.max("sequence").alias("other"))
    return spread.filter("last > 0 and one <> other").select("doc_id")


def report(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequences, tokens, unused, fill) of the packing, over all sequences that hold tokens."""
    used = pack(documents, capacity).filter("n_tokens > 0").groupBy("sequence").agg(F.sum("n_tokens").alias("n"))
    return used.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.lit(capacity) - F.col("n")).alias("unused"), (F.sum("n") / F.count(F.lit(1)) / capacity).alias("fill"))


def checked(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row that tells whether the packing holds.

    ``documents`` and ``pieces_of_none`` count the documents placed and those without a piece,
    ``broken`` the documents that fit a sequence but were cut, or whose pieces don't follow each other
    without a gap, ``overfull`` the sequences whose pieces overlap or exceed the capacity, and ``full``
    tells whether 99 % of the room is used, wherever there are 1,000 sequences or more.
    """
    pieces = checkpointed(pack(documents, capacity))
    order = F.array_sort(F.collect_list(F.struct("first_token", "n_tokens", "piece")))
    by_doc = pieces.groupBy("doc_id").agg(order.alias("p"), F.sum("n_tokens").alias("n"))
    follows = F.forall(F.transform("p", lambda x, i: (i == 0) & (x["first_token"] == 0) | (x["first_token"] == F.get("p", i - 1)["first_token"] + F.get("p", i - 1)["n_tokens"])), lambda ok: ok)
    docs = by_doc.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~follows | (F.col("n") <= capacity) & (F.size("p") > 1)).alias("broken"))
    inside = F.array_sort(F.collect_list(F.struct("offset", "n_tokens")))
    by_sequence = pieces.filter("n_tokens > 0").groupBy("sequence").agg(inside.alias("p"), F.sum("n_tokens").alias("n"))
    end = lambda x: x["offset"] + x["n_tokens"]
    apart = F.forall(F.transform("p", lambda x, i: (end(x) <= capacity) & ((i == 0) | (x["offset"] >= end(F.get("p", i - 1))))), lambda ok: ok)
    sequences = by_sequence.agg(
        F.count_if(~apart | (F.col("n") > capacity)).alias("overfull"), ((F.count(F.lit(1)) < 1000) | (F.sum("n") >= 0.99 * capacity * F.count(F.lit(1)))).alias("full")
    )
    ids = documents.select("doc_id").distinct().join(by_doc.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("pieces_of_none"))
    return docs.join(F.broadcast(sequences)).join(F.broadcast(ids)).select("documents", "pieces_of_none", "broken", "overfull", "full")
