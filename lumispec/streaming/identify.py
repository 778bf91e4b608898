"""Identification of query files batch by batch: as they arrive, or as a run over a folder that shows its progress and can be stopped and resumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import encode as E
from ..operators.search import identify
from ..schemas import BIN_WIDTH, COARSE_LIMIT, PPM, TOP_RESULTS
from ..sources.spectra import parse_lines

#: Rows of a run's results and of its files.
RESULTS = "query_id long, query_file string, genome_id long, score float, matched_ribosomal long, matched_total long, rank long, batch long"
FILES = "query_id long, query_file string, peaks long, batch long"


def _lines(spark: SparkSession, folder: str, every: int | None) -> DataFrame:
    """A stream of the lines of a folder's .mgf and .txt files with their files' metadata; the lines of one file are in one batch."""
    reader = spark.readStream.schema("value string").option("lineSep", "\n").option("pathGlobFilter", "*.{mgf,txt}")
    if every:
        reader = reader.option("maxFilesPerTrigger", every)
    files = reader.format("text").load(folder)
    return files.select(F.xxhash64("_metadata.file_path").alias("query_id"), E.basename("_metadata.file_path").alias("query_file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _peaks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files and the peaks of a batch of lines."""
    lines = rows.withColumn("row", F.monotonically_increasing_id())
    files = rows.select("query_id", "query_file").distinct()
    return files, parse_lines(lines, files, permissive=True)


def identify_stream(spark: SparkSession, folder: str, library: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, coarse_limit: int = COARSE_LIMIT, ppm: int = PPM, bin_width: int = BIN_WIDTH, available_now: bool = False) -> StreamingQuery:
    """Each micro-batch of new .mgf and .txt files goes through the batch plan as a whole; sink gets its results and the batch's number. A batch
    is given again after a failure, so the sink should replace what it has of that number."""

    def batch(rows: DataFrame, number: int) -> None:
        files, queries = _peaks(rows)
        sink(identify(library, queries, coarse_limit, ppm, bin_width).join(files, "query_id"), number)

    writer = _lines(spark, folder, None).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def identify_folder(
    spark: SparkSession, folder: str, library: DataFrame, out: str, checkpoint: str, every: int = 64, coarse_limit: int = COARSE_LIMIT, ppm: int = PPM, bin_width: int = BIN_WIDTH,
    top: int = TOP_RESULTS, on_progress: Callable[[int, int], None] = lambda processed, total: None, cancelled: Callable[[], bool] = lambda: False,
) -> bool:
    """Identifies the files of a folder, `every` at a time, into out/results and out/files, a partition for each batch. True if all are done.

    on_progress(processed, total) comes first with what earlier runs have done, then after each batch, so that it never falls and ends at the total.
    cancelled() is asked again and again: once it is true, the batch at hand is given up with its jobs, all batches before it stay, and the next call
    with the same checkpoint goes on with the files that are left. A batch replaces its own partitions, so that one that comes again after a failure
    is there once. Files without a peak are in out/files, with peaks 0, and have no results.
    """
    total = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mgf,txt}").load(folder).select("path").count()
    done = _batches(spark, out)
    state = {"processed": done["files"]}
    on_progress(state["processed"], total)

    def replace(df: DataFrame, name: str, schema: str) -> None:
        columns = [c.split()[0] for c in schema.split(", ")]
        df.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")

    def batch(rows: DataFrame, number: int) -> None:
        mark = F.lit(number).cast("long").alias("batch")
        files, queries = _peaks(rows.persist())
        found = identify(library, queries, coarse_limit, ppm, bin_width, top).join(files, "query_id")
        replace(found.select("*", mark), "results", RESULTS)
        sizes = queries.groupBy("query_id").agg(F.count("*").alias("peaks"))
        replace(files.join(sizes, "query_id", "left").select("query_id", "query_file", F.coalesce("peaks", F.lit(0)).alias("peaks"), mark), "files", FILES)
        rows.unpersist()
        if number not in done["numbers"]:
            state["processed"] += spark.read.schema(FILES).parquet(f"{out}/files").where(F.col("batch") == number).count()
        on_progress(state["processed"], total)

    query = _lines(spark, folder, every).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while query.isActive and not query.awaitTermination(0.2):
        if cancelled():
            query.stop()  # ends the jobs of the batch at hand
            return False
    if query.exception():
        raise query.exception()
    return True


def _batches(spark: SparkSession, out: str) -> dict:
    """The batches that a folder of results holds, and how many files they had."""
    try:
        files = spark.read.schema(FILES).parquet(f"{out}/files")
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {"numbers": set(), "files": 0}
    rows = files.groupBy("batch").count().collect()  # a row for each batch
    return {"numbers": {r["batch"] for r in rows}, "files": sum(r["count"] for r in rows)}
