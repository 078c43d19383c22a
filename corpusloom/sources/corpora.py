"""Corpora as they are delivered, as manifests.

Parsers work on a table of lines (``value``, ``_row_idx``), so that files, tables and streams are
parsed alike; ``read_*`` apply them to files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.constants import MLS_SPLIT_SIZES, ROW, SAMPLE_RATE
from corpusloom.functions.text import is_garbage, substitute_punctuation_tags
from corpusloom.functions.text import trimmed
from corpusloom.operators.filters import head
from corpusloom.operators.joins import split_join
from corpusloom.operators.ranking import with_position
from corpusloom.operators.sampling import shard_range
from corpusloom.session import checkpointed
from corpusloom.sources.files import list_files, numbered_lines, read_lines


def parse_mls(lines: DataFrame, delimiter: str = "\t") -> DataFrame:
    """(ID, transcript, _row_idx) of lines with exactly two fields; other lines are dropped."""
    parts = F.split(trimmed(F.col("value")), f"\\Q{delimiter}\\E")
    return lines.select(parts.alias("p"), ROW).filter(F.size("p") == 2).select(F.get("p", F.lit(0)).alias("ID"), F.get("p", F.lit(1)).alias("transcript"), ROW)


def read_mls(spark: SparkSession, path: str, audio: DataFrame | None = None, n: int = -1) -> DataFrame:
    """Transcripts, with (ID, duration, sample_rate, num_samples) of ``audio`` where it has the id."""
    lines = read_lines(spark, path)
    rows = parse_mls(lines.filter(F.col(ROW) < n) if n > 0 else lines)
    if audio is None:
        return rows.withColumns({"duration": F.lit(None).cast("double"), "sample_rate": F.lit(None).cast("double"), "num_samples": F.lit(None).cast("bigint")})
    return rows.join(audio.select("ID", "duration", "sample_rate", "num_samples"), "ID", "left")


def parse_ljspeech(lines: DataFrame, language: str | None = None) -> DataFrame:
    """(ID, transcript, normalized_transcription[, lang]) of lines with three fields between bars; others raise."""
    parts = F.split("value", r"\|")
    checked = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), F.col("value"))).cast("array<string>"))
    out = lines.select(checked.alias("p"), ROW).select(F.get("p", F.lit(0)).alias("ID"), F.get("p", F.lit(1)).alias("transcript"), F.get("p", F.lit(2)).alias("normalized_transcription"), ROW)
    return out.withColumn("lang", F.lit(language)) if language else out


def parse_librispeech(lines: DataFrame, folder: str = "") -> DataFrame:
    """(id, language, speaker_id, chapter_id, file, path, text) of "id text" lines; an id has three numbers."""
    parts = F.split("value", " ", 2)
    rows = lines.filter(trimmed(F.col("value")) != "").select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("text"), ROW)
    number = lambda i: F.get(F.split("id", "-"), F.lit(i)).cast("int")
    file = F.concat("id", F.lit(".flac"))
    path = F.concat_ws("/", F.lit(folder.rstrip("/")), number(0).cast("string"), number(1).cast("string"), file)
    return rows.select("id", F.lit("en").alias("language"), number(0).alias("speaker_id"), number(1).alias("chapter_id"), file.alias("file"), path.alias("path"), "text", ROW)


def read_librispeech(spark: SparkSession, folder: str) -> DataFrame:
    """All transcripts of a split's tree."""
    lines = numbered_lines(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.trans.txt").text(folder))
    return parse_librispeech(lines, folder)


def read_librispeech_audio(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts with the bytes of their audio, joined by id."""
    audio = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.flac").load(folder)
    audio = audio.select(F.regexp_extract("path", r"([^/]+)\.flac$", 1).alias("id"), F.col("content").alias("audio"))
    return read_librispeech(spark, folder).join(audio, "id")


def voxpopuli(rows: DataFrame, n: int = -1, rate: int = SAMPLE_RATE) -> DataFrame:
    """The nine manifest fields, and ``array`` where the rows have it; another sample rate than ``rate`` raises."""
    rows = head(rows, n)
    if "sample_rate" in rows.columns:
        rows = rows.filter(F.assert_true(F.col("sample_rate") == rate, "another sample rate").isNull())
    fields = [f.split(" ")[0] for f in schemas.VOXPOPULI.split(", ")]
    return rows.select(*fields, *[c for c in ("array", ROW) if c in rows.columns])


def gigaspeech(rows: DataFrame, keep_garbage: bool = False, n: int = -1, rate: int = SAMPLE_RATE, model: DataFrame | None = None) -> DataFrame:
    """Manifest rows of the published segments: without garbage, punctuation tags as characters.

    ``n`` > 0 keeps the first of the kept rows. With a truecase ``model`` the words of ``text_processed`` are
    spelled by it, otherwise they stay as they are.
    """
    if not keep_garbage:
        rows = rows.filter(~F.coalesce(is_garbage(F.col("text")), F.lit(False)))
    rows = head(rows, n)
    rows = rows.filter(F.assert_true(F.col("sample_rate") == rate, "another sample rate").isNull())
    fields = [f.split(" ")[0] for f in schemas.GIGASPEECH.split(", ")][:-1]
    out = rows.select(*fields, substitute_punctuation_tags(F.col("text")).alias("text_processed"), ROW)
    if model is None:
        return out
    cased = truecase(out.select(ROW, "text_processed"), "text_processed", model).withColumnRenamed("text", "_cased")
    return out.join(cased, ROW).withColumn("text_processed", F.col("_cased")).select(out.columns)


def explode_gigaspeech(raw: DataFrame, n: int = -1, suffix: str | None = None) -> DataFrame:
    """Segments of nested audio records, with their paths and sample ranges; ``n`` > 0 takes the first audios.

    A segment id that doesn't begin with its audio's id raises. Sample numbers are rounded half to even.
    """
    audios = F.slice("audios", 1, n) if n > 0 else F.col("audios")
    each = raw.select(F.explode(audios).alias("a")).select("a", F.explode("a.segments").alias("s"))
    each = each.filter(F.assert_true(F.startswith("s.sid", "a.aid"), "the segment is of another audio").isNull())
    dot = F.regexp_extract("a.path", r"(\.[^./]+)$", 1)
    stem = F.regexp_replace("a.path", r"\.[^./]+$", "")
    segment = F.element_at(F.split("s.sid", "_"), -1)
    path = F.concat(stem, F.lit("/"), segment, F.lit(suffix) if suffix else dot)
    sample = lambda c: F.bround(F.col(c) * F.col("a.sample_rate")).cast("bigint")
    return each.select(
        path.alias("path"), F.col("s.sid").alias("sid"), F.col("s.speaker").alias("speaker"), F.col("s.begin_time").alias("begin_time"), F.col("s.end_time").alias("end_time"), F.col("s.text_raw").alias("text_raw"),
        F.col("s.text_tn").alias("text_tn"), F.col("s.subsets").alias("subsets"), sample("s.begin_time").alias("first_sample"), sample("s.end_time").alias("until_sample"),
    )


def parse_mls_segments(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(ID, _row_idx): the first field of each line; with ``strict`` the number of rows is that of a known split."""
    rows = lines.select(F.get(F.split(trimmed(F.col("value")), r"(?U)\s+"), F.lit(0)).alias("ID"), ROW)
    if strict and (n := lines.count()) not in MLS_SPLIT_SIZES.values():
        raise ValueError(f"{n} rows are no known split")
    return rows


def parse_fairseq(lines: DataFrame, shards: int = 1, rank: int = 0) -> DataFrame:
    """(path, samples, _row_idx) of a shard: the first line is the root, then sub-path and optional sample count."""
    first = lines.filter(F.col(ROW) == 0).select(F.rtrim("value").alias("root"))
    start, end = shard_range(lines.count() - 1, shards, rank)
    rows = lines.filter((F.col(ROW) > start) & (F.col(ROW) <= end))
    parts = F.split(trimmed(F.col("value")), "\t")
    return rows.join(F.broadcast(first)).select(F.concat_ws("/", "root", F.get(parts, F.lit(0))).alias("path"), F.get(parts, F.lit(1)).cast("bigint").alias("samples"), (F.col(ROW) - 1).alias(ROW))


def mls_paths(rows: DataFrame, path: Column, total: int, shards: int = 1, rank: int = 0) -> DataFrame:
    """(path, samples, _row_idx) of a shard of a manifest; the samples under either of their names."""
    start, end = shard_range(total, shards, rank)
    samples = F.coalesce(*[F.col(c) for c in ("n_samples", "num_samples") if c in rows.columns], F.lit(None).cast("bigint"))
    placed = with_position(rows).filter((F.col("_position") >= start) & (F.col("_position") < end))
    return placed.select(path.alias("path"), samples.alias("samples"), ROW)


#: Words of a truecase model that is sent to all tasks.
MAX_SENT = 500_000


def truecase_model(texts: DataFrame, column: str) -> DataFrame:
    """(word, spelling): the most frequent spelling of each word inside a text; ties go to the first in order."""
    words = texts.select(F.posexplode(F.split(column, r"(?U)\s+")).alias("i", "spelling")).filter("i > 0 and spelling <> ''")
    counts = words.groupBy(F.lower("spelling").alias("word"), "spelling").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("word").agg(F.min_by("spelling", F.struct(-F.col("n"), "spelling")).alias("spelling"))


def truecase(texts: DataFrame, column: str, model: DataFrame, key: str = ROW) -> DataFrame:
    """(key, text): words in their most frequent spelling, unknown ones capitalized; deterministic."""
    words = texts.select(key, F.posexplode(F.split(F.lower(column), r"(?U)\s+")).alias("i", "word"))
    model = checkpointed(model.select("word", "spelling"))
    # a small model is sent to the words; otherwise the very frequent words are dealt to several tasks
    small = model.limit(MAX_SENT + 1).count() <= MAX_SENT
    joined = words.join(F.broadcast(model), "word", "left") if small else split_join(words, model, ["word"], [key, "i"], "left")
    spelled = joined.select(key, F.struct("i", F.coalesce("spelling", F.initcap("word")).alias("w")).alias("p"))
    joined = spelled.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["w"]), " ").alias("text"))
    return texts.select(key).join(joined, key, "left")


__all__ = [n for n in dir() if n.startswith(("parse_", "read_", "explode_"))] + ["gigaspeech", "list_files", "mls_paths", "truecase", "truecase_model", "voxpopuli"]
