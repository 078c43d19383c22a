"""Writers. A target that exists raises, unless said otherwise."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import ROW
from corpusloom.operators.projections import id_to_path
from corpusloom.operators.sampling import block_number, shard_number


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines in UTF-8; nulls stay."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def ascii_json(row: Column) -> Column:
    """A struct as JSON in ASCII: other characters as \\u escapes, in pairs beyond the first plane."""

    @F.pandas_udf("string")
    def escape(values):
        return values.map(lambda v: None if v is None else json.dumps(json.loads(v)))

    return escape(F.to_json(row, {"ignoreNullFields": "false"}))


def write_ascii_jsonl(df: DataFrame, path: str) -> None:
    df.select(ascii_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("compression", "snappy").parquet(path)


def write_blocks(df: DataFrame, path: str, rows: int) -> None:
    """Parquet in blocks of so many rows in manifest order, one folder for each."""
    block_number(df, rows).repartition("block").sortWithinPartitions(ROW).write.mode("errorifexists").partitionBy("block").parquet(path)


def write_shards(df: DataFrame, path: str, size: int | None = None, shards: int | None = None) -> None:
    """JSON lines in contiguous shards, one folder for each."""
    shard_number(df, size, shards).repartition("shard").sortWithinPartitions(ROW).drop(ROW).write.mode("errorifexists").option("ignoreNullFields", "false").partitionBy("shard").json(path)


def fairseq_lines(df: DataFrame, root: str, name: Column) -> DataFrame:
    """(value, _row_idx): the root, then one line for each row."""
    spark = df.sparkSession
    head = spark.createDataFrame([(root, -1)], f"value string, {ROW} bigint")
    return head.union(df.select(name.alias("value"), ROW))


def write_fairseq(df: DataFrame, path: str, root: str, name: Column) -> None:
    """The lines as text, in order; a file list is small against its corpus, so it is one file."""
    fairseq_lines(df, root, name).repartitionByRange(1, ROW).sortWithinPartitions(ROW).select("value").write.mode("errorifexists").text(path)


def tar_list(df: DataFrame, folder: str, suffix: str = ".flac") -> DataFrame:
    """(value, _row_idx): one path for each row, for an archiver's list of files."""
    return df.select(id_to_path(F.col("ID"), folder, suffix).alias("value"), ROW)


def label_lines(labels: DataFrame, key: str, frame: str, cluster: str) -> DataFrame:
    """(key, value): the labels of each utterance between spaces, in the order of frames."""
    listed = labels.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(frame, cluster))).alias("l"))
    return listed.select(key, F.concat_ws(" ", F.transform("l", lambda x: x[cluster].cast("string"))).alias("value"))


def segment_manifest(df: DataFrame, spans: str, text: str, normalized: str, uroman: str, folder: str) -> DataFrame:
    """One row for each span: start, file, duration and the tokens it covers."""
    zipped = F.arrays_zip(F.col(spans).alias("s"), F.col(text).alias("t"), F.col(normalized).alias("n"), F.col(uroman).alias("u"))
    each = df.select(ROW, F.posexplode_outer(zipped).alias("i", "z")).filter("z is not null")
    file = F.concat(F.lit(folder.rstrip("/") + "/"), F.col(ROW).cast("string"), F.lit("/segment"), F.col("i").cast("string"), F.lit(".flac"))
    return each.select(
        ROW, F.col("i").alias("segment"), F.col("z.s.start_s").alias("audio_start_sec"), file.alias("audio_filepath"), (F.col("z.s.end_s") - F.col("z.s.start_s")).alias("duration"),
        F.col("z.t").alias("text"), F.col("z.n").alias("normalized_text"), F.col("z.u").alias("uroman_tokens"),
    )


def publish(df: DataFrame, path: str) -> None:
    """Parquet, and the schema as JSON beside it; uploading is left to other tools."""
    to_parquet(df, f"{path}/data")
    df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/schema")
