"""Manifests in files, with their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.constants import ROW
from corpusloom.session import checkpointed


def with_row_index(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``_row_idx`` from 0 in the order of the ``key`` columns.

    Range partitions are sorted and kept by a checkpoint, counted, and numbered from where the one
    before ends; no row leaves the JVM.
    """
    ordered = checkpointed(rows.repartitionByRange(*key).sortWithinPartitions(*key))
    # the upper bits of the id are the partition, the lower ones the place in it
    told = ordered.withColumn("_id", F.monotonically_increasing_id())
    return _shifted(told, told.groupBy(F.shiftright("_id", 33).alias("_block")).agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")), F.shiftright("_id", 33), ["_block"])


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(value, _row_idx) of a table read from text files: from 0, in the order of paths and of lines in a file.

    One pass counts the lines of each block of a file, one numbers them; no shuffle and no row outside
    the JVM. There are as many blocks as tasks that read, or files.
    """
    told = lines.select("value", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at")).alias("_block"), F.monotonically_increasing_id().alias("_id"))
    return _shifted(told, told.groupBy("_block").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")), F.col("_block"), ["_block"])


def _shifted(told: DataFrame, blocks: DataFrame, block: Column, order: list[str]) -> DataFrame:
    """Row numbers from ids that rise by one within each block, and the blocks' sizes and first ids."""
    before, shifts = 0, []
    for r in sorted(blocks.collect(), key=lambda r: r["_block"]):
        shifts.append((r["_block"], before - r["first"]))
        before += r["n"]
    kind = blocks.schema["_block"].dataType
    table = told.sparkSession.createDataFrame(shifts, T.StructType([T.StructField("_b", kind), T.StructField("_shift", T.LongType())]))
    return told.join(table, block == F.col("_b")).withColumn(ROW, F.col("_id") + F.col("_shift")).drop("_b", "_shift", "_id", *order)


def read_lines(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """(value, _row_idx) of text files."""
    lines = spark.read.text(path)
    return numbered_lines(lines) if numbered else lines


def read_jsonl(spark: SparkSession, path: str, schema: str, numbered: bool = False) -> DataFrame:
    """JSON lines under a declared schema; a bad line raises."""
    if not numbered:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    parsed = read_lines(spark, path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j"), ROW)
    return parsed.select("j.*", ROW)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of the text files; an empty file, or one whose last line isn't ended, raises.

    One pass over the lines: in a file that ends its last line, the lines with an end each make up its
    size, and one byte less otherwise (three bytes of a byte order mark may be missing besides).
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    each = lines.groupBy("path", "size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    open_ended = (F.col("bytes") - F.col("size")).isin(1, -2)
    n, files, bad = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.min(F.when(open_ended, F.col("path")))).first()
    if bad:
        raise ValueError(f"without an end of line: {bad}")
    empty = list_files(spark, path).filter("length = 0").select("path").limit(1).collect()
    if not n or empty:
        raise ValueError(f"empty: {empty[0]['path'] if empty else path}")
    return n


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
