"""Problem 2: a sample of utterances for each plan, with target shares by speaker.

Each (plan, speaker) gets an acceptance probability from wanted to available utterances, slightly
raised; an utterance is taken where its hash falls into the plan's stretch of [0, 1). The surplus
is then cut exactly, by the order of the hashes, and speakers that can't give what is wanted are
reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import first_number, id_speaker, unit_hash
from corpusloom.operators.joins import split_join
from corpusloom.operators.ranking import with_rank
from corpusloom.session import checkpointed

#: Utterances of one speaker that share a slice of hash space on average.
SLICE = 4096


def utterances(transcripts: DataFrame) -> DataFrame:
    """Distinct (speaker, ID, _row_idx): the first row of each ID among the rows of its speaker.

    The speaker is the number in ``speaker_id`` or, without one, the number that heads ``ID``.
    Rows without ``ID`` or without a speaker are no utterances.
    """
    speaker = F.coalesce(first_number(F.col("speaker_id")), id_speaker(F.col("ID")))
    return (
        transcripts.select(speaker.alias("speaker"), "ID", "_row_idx")
        .filter("speaker is not null and ID is not null")
        .groupBy("speaker", "ID")
        .agg(F.min("_row_idx").alias("_row_idx"))
    )


def quotas(targets: DataFrame, available: DataFrame) -> DataFrame:
    """The target rows with ``available``, ``wanted`` and ``taken`` utterances.

    ``wanted`` rounds target_share x sample_rows by largest remainders within the plan, so that the
    wanted numbers add up to the rounded sum, and is at least ``min_rows``. Null shares, sizes and minimums count as 0; repeated (plan, speaker) rows are taken once, the largest target.
    """
    clean = targets.filter("plan_id is not null and speaker is not null").groupBy("plan_id", "speaker").agg(
        F.max(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("sample_rows", F.lit(0))).alias("target"),
        F.max(F.coalesce("min_rows", F.lit(0))).alias("min_rows"),
    )
    # a plan's speakers are ranked in slices, so that it may have any number of them
    sums = clean.groupBy("plan_id").agg(F.round(F.sum("target") - F.sum(F.floor("target"))).alias("spare"), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 100_000)).cast("bigint").alias("buckets"))
    parted = split_join(clean, sums, ["plan_id"], ["speaker"]).withColumn("unit", 1 - (F.col("target") - F.floor("target")))
    ranked = with_rank(parted, ["plan_id"], "unit", "buckets", ["speaker"])
    rounded = F.floor("target") + (F.col("rank") < F.col("spare")).cast("int")
    sized = ranked.withColumn("wanted", F.greatest(rounded, F.col("min_rows")).cast("bigint"))
    out = sized.join(available, "speaker", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    return out.select(
        "plan_id", "speaker", "target", "min_rows", "wanted", "available", F.least("wanted", "available").alias("taken")
    )


def _plans(transcripts: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    single = utterances(transcripts)
    available = single.groupBy("speaker").agg(F.count(F.lit(1)).alias("available"))
    return single, quotas(targets, available)


def found(transcripts: DataFrame, targets: DataFrame, seed: int = 2) -> DataFrame:
    """(plan_id, speaker) of the targets that the sample reports as not met."""
    return report(transcripts, targets, seed).filter("short").select("plan_id", "speaker")


def report(transcripts: DataFrame, targets: DataFrame, seed: int = 2) -> DataFrame:
    """Every target with the utterances drawn into the sample, the ``deficit`` and whether it is ``short``.

    A target is short where the sample could not draw the wanted number, or where it drew all
    utterances of the speaker and they are fewer than the unrounded target.
    """
    plans, drawn = _draw(transcripts, targets, seed)
    counts = drawn.groupBy("plan_id", "speaker").agg(F.count(F.lit(1)).alias("n"))
    out = plans.join(counts, ["plan_id", "speaker"], "left").withColumn("drawn", F.coalesce("n", F.lit(0)).cast("bigint"))
    spent = (F.col("drawn") == F.col("available")) & (F.col("drawn") < F.col("target"))
    deficit = F.col("wanted") - F.col("drawn")
    return out.select("plan_id", "speaker", "target", "min_rows", "wanted", "available", "drawn", deficit.alias("deficit"), ((deficit > 0) | spent).alias("short"))


def sample(transcripts: DataFrame, targets: DataFrame, seed: int = 2) -> DataFrame:
    """(plan_id, speaker, ID, _row_idx) of the samples: for each (plan, speaker) exactly ``taken`` utterances.

    A speaker's utterances lie in hash slices of about ``SLICE``; a plan's stretch names the slices
    it touches, so the join yields little more than what is accepted and a hot speaker spreads over
    many keys. Where a stretch accepts too few, the rest of that speaker's utterances is searched.
    Empty tables give an empty result; columns besides the named ones are ignored.
    """
    return _draw(transcripts, targets, seed)[1]


def _draw(transcripts: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The plans' quotas and the sample."""
    single, quota = _plans(transcripts, targets)
    quota = checkpointed(quota)
    plans = quota.filter("taken > 0")
    slices = F.greatest(F.lit(1), F.floor(F.col("available") / SLICE)).cast("bigint")
    start = unit_hash("plan_id", "speaker", seed=seed + 1)
    accept = F.least(F.lit(1.0), (F.col("taken") + 6 * F.sqrt("taken") + 12) / F.col("available"))
    plans = plans.select("plan_id", "speaker", "taken", slices.alias("slices"), start.alias("start"), accept.alias("accept"))
    sizes = plans.select("speaker", "slices").distinct()
    held = quota.filter("taken > 0").groupBy("speaker").agg(F.max("available").alias("_n"))
    placed = (
        split_join(single.withColumn("unit", unit_hash("ID", "speaker", seed=seed)), sizes, ["speaker"], ["ID"], sizes=held)
        .withColumn("slice", F.least(F.floor(F.col("unit") * F.col("slices")), F.col("slices") - 1).cast("bigint"))
        .select("speaker", "slice", "unit", "ID", "_row_idx")
    )
    placed = checkpointed(placed)
    first = _accepted(placed, plans)
    got = first.groupBy("plan_id", "speaker").agg(F.count(F.lit(1)).alias("got"))
    missing = plans.join(got, ["plan_id", "speaker"], "left").filter("coalesce(got, 0) < taken and accept < 1").drop("got")
    keyed = first.join(missing.select("plan_id", "speaker"), ["plan_id", "speaker"], "left_anti")
    chosen = keyed.unionByName(_accepted(placed, missing.withColumn("accept", F.lit(1.0))))
    # ranks are taken in the order of the distance from the plan's start
    ranked = with_rank(chosen, ["plan_id", "speaker"], "way", "buckets", ["ID"])
    return quota, ranked.filter("rank < taken").select("plan_id", "speaker", "ID", "_row_idx")


def _accepted(placed: DataFrame, plans: DataFrame) -> DataFrame:
    first = F.floor(F.col("start") * F.col("slices"))
    span = F.least(F.floor((F.col("start") + F.col("accept")) * F.col("slices")), first + F.col("slices") - 1)
    touched = plans.withColumn("turn", F.explode(F.sequence(first, span))).withColumn("slice", F.pmod("turn", "slices")).drop("turn")
    way = F.pmod(F.col("unit") - F.col("start") + 1.0, F.lit(1.0))
    buckets = F.greatest(F.lit(1), F.floor(F.col("taken") / 100_000)).cast("bigint")
    joined = placed.join(touched, ["speaker", "slice"]).withColumn("way", way).filter("way < accept or accept >= 1")
    return joined.select("plan_id", "speaker", "ID", "_row_idx", "taken", "way", buckets.alias("buckets"))


def checked(transcripts: DataFrame, targets: DataFrame, seed: int = 2) -> DataFrame:
    """(plan_id, speaker, drawn, ids, own): the sample counted by target.

    ``drawn`` are the rows drawn, ``ids`` their different IDs, and ``own`` those of them that are rows of
    this speaker with this ID in ``transcripts``; all three are equal in a right sample.
    """
    drawn = sample(transcripts, targets, seed)
    speaker = F.coalesce(first_number(F.col("speaker_id")), id_speaker(F.col("ID")))
    given = transcripts.select("_row_idx", F.col("ID").alias("given_id"), speaker.alias("given_speaker"))
    told = drawn.join(given, "_row_idx")
    # each ID of a target is counted once first, so that the distinct count needs no set of them
    each = told.groupBy("plan_id", "speaker", "ID").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("ID") == F.col("given_id")) & (F.col("speaker") == F.col("given_speaker"))).alias("own"))
    return each.groupBy("plan_id", "speaker").agg(F.sum("n").alias("drawn"), F.count(F.lit(1)).alias("ids"), F.sum("own").alias("own"))
