"""Query spectra from text and MGF files: one spectrum a file, lines in order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import encode as E
from ..functions.peaks import PEAK, classify_peak_line, once, parse_peak_line, peak_fields
from ..shared import new_folder


#: Kind of a line whose numbers are well written but beyond what is stored.
OUT_OF_RANGE = "out_of_range"


def classified(line: Column | str) -> Column:
    """struct<kind, milli_mz, intensity> of a line: an encoded peak, or why it is none; kinds are those of functions.peaks, and out_of_range."""

    def stored(x: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), E.encode_mz(x["mz"], False).alias("milli_mz"), E.encode_intensity(x["intensity"], False).alias("intensity"))

    def known(x: Column) -> Column:
        lost = (x["kind"] == PEAK) & (x["milli_mz"].isNull() | x["intensity"].isNull())
        return F.struct(F.when(lost, OUT_OF_RANGE).otherwise(x["kind"]).alias("kind"), F.when(~lost, x["milli_mz"]).alias("milli_mz"), F.when(~lost, x["intensity"]).alias("intensity"))

    return once(once(classify_peak_line(peak_fields(line)), stored), known)


def classified_files(files: DataFrame, content: str = "content") -> DataFrame:
    """Every line of files (any columns, content) as a row: the other columns, line_no from 0, kind, milli_mz and intensity. Peaks and faults come
    from one pass, and together they are all lines; a null content is one blank line. No row needs another, so that streams may use it too."""
    lines = F.split(F.coalesce(F.col(content), F.lit("")), "\r?\n")
    rest = [F.col(f"`{c}`") for c in files.columns if c != content]
    rows = files.select(*rest, F.posexplode(F.transform(lines, classified)).alias("line_no", "_line"))
    return rows.select(*rest, F.col("line_no").cast("long").alias("line_no"), "_line.*")


def parse_lines(lines: DataFrame, files: DataFrame, split_mgf: bool = False, permissive: bool = False) -> DataFrame:
    """lines (query_id, query_file, block, row, line) of files (query_id, query_file) to queries (query_id, query_file, ord, milli_mz, intensity).

    A line's place in its file is (block, row): blocks in order, rows in order within one; a file has as many blocks as it takes, and is numbered
    block by block. A file without a peak is an error, and so are numbers out of range; with permissive, such peaks, and files without any, are left
    out. With split_mgf, each BEGIN IONS block of lines is a spectrum of its own: query_id becomes query_id * 2^20 + its number.
    """
    peak = F.explode(F.array_compact(F.array(parse_peak_line("line")))).alias("peak")
    keys, at = ["query_id"], ["query_id", "block"]
    if split_mgf:
        begins = F.when(F.upper(F.trim("line")) == "BEGIN IONS", 1).otherwise(0)
        lines = _summed(lines.withColumn("_spectrum", begins.cast("long")), at, "_spectrum", 0).withColumn("query_id", F.col("query_id") * (1 << 20) + F.col("_spectrum"))
    parsed = lines.select("query_id", "query_file", "block", "row", peak)
    peaks = parsed.select("query_id", "query_file", "block", "row", E.encode_mz("peak.mz", not permissive).alias("milli_mz"), E.encode_intensity("peak.intensity", not permissive).alias("intensity"))
    if permissive:
        peaks = peaks.where("milli_mz is not null and intensity is not null")
    numbered = _summed(peaks.withColumn("ord", F.lit(1).cast("long")), [*keys, "block"], "ord", -1)
    out = numbered.select("query_id", "query_file", "ord", "milli_mz", "intensity")
    if permissive or split_mgf:
        return out
    empty = files.select("query_id", "query_file").join(out.select("query_id").distinct(), "query_id", "left_anti")
    fault = F.raise_error(F.concat(F.lit("no peaks in "), "query_file"))
    return out.unionByName(empty.select("query_id", "query_file", fault.cast("long").alias("ord"), F.lit(None).cast("long").alias("milli_mz"), F.lit(None).cast("float").alias("intensity")))


def _summed(rows: DataFrame, at: list[str], value: str, more: int) -> DataFrame:
    """rows with value as its sum up to each row of its file, plus more; at: the file's key and its block. A window runs over the rows of one block,
    and one over the blocks of a file."""
    key = at[:-1]
    sums = rows.groupBy(*at).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy(at[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*at, (F.coalesce(F.sum("_sum").over(earlier), F.lit(0)) + more).alias("_before"))
    within = Window.partitionBy(*at).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.sum(value).over(within)).join(before, at).withColumn(value, F.col(value) + F.col("_before")).drop("_before")


def parse_files(files: DataFrame, split_mgf: bool = False, permissive: bool = False) -> DataFrame:
    """files (query_id, query_file, content), whole texts in rows, to queries; see parse_lines()."""
    lines = files.select("query_id", "query_file", F.lit(0).cast("long").alias("block"), F.posexplode(F.split("content", "\r?\n")).alias("row", "line"))
    return parse_lines(lines, files, split_mgf, permissive)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(query_id, query_file, path): query_id is the path's place in the list, path as the files' metadata have it."""
    if not paths:
        raise ValueError("no query files")
    rows = [(i, p.rstrip("/").rpartition("/")[2] or p, re.sub("^file:/*", "/", p)) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "query_id long, query_file string, path string")


def text_lines(files: DataFrame, *more: str) -> DataFrame:
    """The lines of a read of text files (value, with their metadata): more columns, path, block, row, line. Spark splits large files by itself: a
    split is a block, and its rows are in order."""
    path = F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    return files.select(*more, path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(line_no, line) of text_lines() of one text in parts: places from 0, in order of files and splits. The lines are stored once, compressed, so that
    splits and rows are the same when they are counted and when they are numbered; they are neither sorted nor shuffled. The window runs over a row
    for each split."""
    path = new_folder(lines.sparkSession, "lumispec-lines")
    lines.select("path", "block", "row", "line").write.parquet(path)
    stored = lines.sparkSession.read.schema("path string, block long, row long, line string").parquet(path)
    splits = stored.groupBy("path", "block").agg(F.min("row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"))
    return stored.join(F.broadcast(starts), ["path", "block"]).select((F.col("_start") + F.col("row")).alias("line_no"), "line")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(query_id, query_file, block, row, line) of query files: a file of any size is read by as many tasks as it has splits."""
    lines = text_lines(spark.read.option("lineSep", "\n").text(paths))
    return lines.join(F.broadcast(read_files(spark, paths)), "path").drop("path")  # the list of paths is the caller's


def read_queries(spark: SparkSession, paths: list[str], split_mgf: bool = False, permissive: bool = False) -> DataFrame:
    return parse_lines(read_lines(spark, paths), read_files(spark, paths), split_mgf, permissive)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query_file, content) of the .mgf and .txt files of a folder; query_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mgf,txt}").load(path)
    return files.select(F.xxhash64("path").alias("query_id"), E.basename("path").alias("query_file"), F.decode("content", "UTF-8").alias("content"))
