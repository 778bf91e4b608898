"""Intake of query texts: which lines of newly arrived files are peaks, and why the others aren't.

An identification run refuses a batch for one bad file, so that texts are sorted out before. Files are rows of `documents` (whole texts) and of
`orders` (one peak line each). Each run takes what is new in their folders: a file stream with availableNow, whose checkpoint knows the files that
were read, into Spark's file sink, which counts the files of a finished batch only. Run again without new files, it changes nothing; ended midway,
the next run goes on where the checkpoint is. Input files are expected to be added, never changed.

    python -m jobs.text_intake --tables DIR --out DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispec.plans import adapter as A
from lumispec.shared import new_folder
from lumispec.sources.spectra import classified_files

CONFIG = Path(__file__).with_suffix(".json")
SCHEMA = "source string, id long, line_no long, kind string, milli_mz long, intensity float"
log = logging.getLogger("jobs.text_intake")


def arriving(spark: SparkSession, tables: str, name: str, max_files: int) -> DataFrame:
    """A table's files as a stream. The path is a pattern that matches it alone: a table may be one file or a folder of files."""
    path = f"{tables.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{path[:-1]}[{path[-1]}]")


def texts(documents: DataFrame, orders: DataFrame) -> DataFrame:
    """(source, id, content) of both tables."""
    whole = documents.select(F.lit("documents").alias("source"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("content"))
    lines = orders.select(F.lit("orders").alias("source"), F.col("o_orderkey").cast("long").alias("id"), A.peak_line().alias("content"))
    return whole.union(lines)


def run(spark: SparkSession, tables: str, out: str, checkpoint: str, config: dict) -> list[dict]:
    """Sorts the lines of all files that are new since the checkpoint into `out`, in a folder for each source and kind. Gives, for each batch, its
    number, the rows read of each stream, and the lines of each kind that it wrote."""
    files = texts(*(arriving(spark, tables, name, config["max_files_per_trigger"]) for name in ("documents", "orders")))
    lines = classified_files(files).select(*(c.split()[0] for c in SCHEMA.split(", ")))
    kinds = ("peak", "blank", "comment", "title", "no_mz", "no_intensity", "out_of_range")
    seen = lines.observe("lines", *(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds))
    writer = seen.writeStream.format("parquet").partitionBy("source", "kind").option("path", out).option("checkpointLocation", checkpoint).option("compression", config["codec"])
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    batches = []
    for p in query.recentProgress:
        metrics = p["observedMetrics"].get("lines")
        if p["numInputRows"]:
            batches.append({"batch": p["batchId"], "read": {s["description"]: s["numInputRows"] for s in p["sources"]}, "wrote": metrics.asDict() if hasattr(metrics, "asDict") else metrics})
            log.info("batch %d: read %s; wrote %s to %s", p["batchId"], batches[-1]["read"], batches[-1]["wrote"], out)
    if not batches:
        log.info("nothing new below %s", tables)
    return batches


def read(spark: SparkSession, out: str) -> DataFrame:
    """The whole output: source, id, line_no, kind, milli_mz, intensity."""
    return spark.read.schema(SCHEMA).parquet(out).select(*(c.split()[0] for c in SCHEMA.split(", ")))


def job2_text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the whole tables into one new folder, of which the second finds nothing new."""
    folder, config = new_folder(spark, "lumispec-job2"), json.loads(CONFIG.read_text())
    for _ in range(2):
        run(spark, sf_dir, f"{folder}/lines", f"{folder}/checkpoint", config)
    return read(spark, f"{folder}/lines")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.text_intake")
    for name in ("tables", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("text_intake").getOrCreate()
    try:
        run(spark, args.tables, args.out, args.checkpoint, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
