"""Vocabularies with speech units and modality marks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import SEED, SPEECH_MARK, TEXT_MARK, VOCABULARY_MULTIPLE
from corpusloom.functions.units import padded_vocabulary, unit_to_pua


def read_sentencepiece(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, score) of a SentencePiece model; their number is its vocabulary size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return spark.createDataFrame([(i, model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())], "id bigint, piece string, score double")


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """piece and score between tabs, in the order of ids."""
    lines = vocabulary.select(F.concat_ws("\t", "piece", F.col("score").cast("string")).alias("value"), "id")
    lines.repartitionByRange(1, "id").sortWithinPartitions("id").select("value").write.mode("errorifexists").text(path)


def extend(vocabulary: DataFrame, units: int, marks: bool = True) -> DataFrame:
    """(id, piece, score): the vocabulary, then one piece for each unit, then the text and speech marks.

    New scores go on downwards from the last one.
    """
    spark = vocabulary.sparkSession
    base = vocabulary.agg((F.max("id") + 1).alias("n"), F.min("score").alias("least"))
    new = spark.range(units).select(F.col("id").alias("k"), unit_to_pua(F.col("id").cast("int")).alias("piece"))
    if marks:
        new = new.union(spark.createDataFrame([(units, TEXT_MARK), (units + 1, SPEECH_MARK)], "k bigint, piece string"))
    added = new.join(F.broadcast(base)).select((F.col("n") + F.col("k")).alias("id"), "piece", (F.col("least") - 1 - F.col("k")).alias("score"))
    return vocabulary.select("id", "piece", "score").union(added)


def padding_rows(size: int, multiple: int = VOCABULARY_MULTIPLE) -> int:
    """Rows that fill a vocabulary up to a multiple; 0 where it is one."""
    return -size % multiple


def embedding_rows(mean: np.ndarray, covariance: np.ndarray, rows: int, scale: float = 1e-5, seed: int = SEED) -> np.ndarray:
    """Rows for new pieces, drawn around the mean of the old ones."""
    return np.random.default_rng(seed).multivariate_normal(mean, covariance * scale, size=rows)


__all__ = ["embedding_rows", "extend", "padded_vocabulary", "padding_rows", "read_sentencepiece", "write_vocabulary"]
