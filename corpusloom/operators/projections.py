"""Column-wise reshaping of manifests."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.constants import ALIGNMENT, CODEC_LAYERS, ENDS, NORMALIZED, ROW, SPEECH_TOKENS, STARTS, TOKENIZED, UROMAN


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without ``columns``; absent names are ignored."""
    return df.drop(*columns)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def select_codec_layer(df: DataFrame, prefix: str, layer: int, layers: int = CODEC_LAYERS) -> DataFrame:
    """Of ``prefix``0.. only one layer, named as speech tokens; a wrong layer raises."""
    if not 0 <= layer < layers:
        raise ValueError(f"layer {layer} is not in 0..{layers - 1}")
    rest = [f"{prefix}{i}" for i in range(layers) if i != layer]
    return df.drop(*rest).withColumnRenamed(f"{prefix}{layer}", SPEECH_TOKENS)


def merge_fields(df: DataFrame, **fields: Column) -> DataFrame:
    """``df`` with fields added or overwritten."""
    return df.withColumns(fields)


def convert_legacy(df: DataFrame) -> DataFrame:
    """Rows whose ``alignment`` holds [token, "[start,end]"] pairs, as three parallel arrays."""
    times = lambda p: F.from_json(F.get(p, F.lit(1)), "array<double>")
    return df.withColumns({
        TOKENIZED: F.transform(ALIGNMENT, lambda p: F.get(p, F.lit(0))),
        STARTS: F.transform(ALIGNMENT, lambda p: F.get(times(p), F.lit(0))),
        ENDS: F.transform(ALIGNMENT, lambda p: F.get(times(p), F.lit(1))),
    }).select(*[c for c in (TOKENIZED, NORMALIZED, UROMAN, SPEECH_TOKENS, STARTS, ENDS, ROW) if c in {*df.columns, TOKENIZED, STARTS, ENDS}])


def id_to_path(identifier: Column, folder: str, suffix: str = ".flac") -> Column:
    """folder/speaker/book/id.suffix; a suffix on the id goes first, an id without three parts raises."""
    stem = F.regexp_replace(identifier, r"\.[^._/]+$", "")
    parts = F.split(stem, "_")
    path = F.concat_ws("/", F.lit(folder.rstrip("/")), F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.concat(stem, F.lit(suffix)))
    return F.when(identifier.isNull(), F.lit(None).cast("string")).when(F.size(parts) == 3, path).otherwise(F.raise_error(F.concat(F.lit("not an utterance id: "), identifier)).cast("string"))


def flat_path(identifier: Column, folder: str, suffix: str = ".wav") -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), identifier, F.lit(suffix))


def speaker_of(identifier: Column) -> Column:
    """The number before the first underscore; null where that is no number."""
    return F.substring_index(identifier, "_", 1).try_cast("int")


def type_mapping(schema: T.DataType) -> Any:
    """Names of types, nested as the schema is."""
    if isinstance(schema, T.StructType):
        return {f.name: type_mapping(f.dataType) for f in schema.fields}
    if isinstance(schema, T.ArrayType):
        return [type_mapping(schema.elementType)]
    return schema.simpleString()
