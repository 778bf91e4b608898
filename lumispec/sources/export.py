"""Text exports: CSV lines of genomes and results, and sample query files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encode as E

GENOMES_HEADER = "genome_id,display_name,taxonomy,total_peaks,gene_count"
RESULTS_HEADER = "query_file,genome_id,score,matched_ribosomal,matched_total"


def genome_lines(genomes: DataFrame) -> DataFrame:
    """(genome_id, line); missing metadata is an error."""
    fields = [F.col("genome_id").cast("string"), E.csv_escape("display_name"), E.csv_escape("taxonomy"), F.col("total_peaks").cast("string"), F.col("gene_count").cast("string")]
    lost = F.raise_error(F.concat(F.lit("missing metadata of genome "), F.col("genome_id").cast("string"))).cast("string")
    some = F.col("display_name").isNull() | F.col("taxonomy").isNull() | F.col("total_peaks").isNull() | F.col("gene_count").isNull()
    return genomes.select("genome_id", F.when(some, lost).otherwise(F.concat_ws(",", *fields)).alias("line"))


def result_lines(results: DataFrame) -> DataFrame:
    """(query_id, rank, line) of results with a query_file."""
    fields = [E.csv_escape("query_file"), F.col("genome_id").cast("string"), F.format_string("%.6f", F.col("score").cast("double")), F.col("matched_ribosomal").cast("string"), F.col("matched_total").cast("string")]
    return results.select("query_id", "rank", F.concat_ws(",", *fields).alias("line"))


def write_lines(lines: DataFrame, header: str, order: list[str], path: str) -> None:
    """One CSV text in parts: the header once, then all lines in order; the parts' bytes, one after another by name, are the text. Spark shows the
    parts when all of them are written, so that a run that fails leaves none."""
    head = lines.sparkSession.createDataFrame([(header,)], "line string").select(F.lit(0).alias("_part"), *(F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order), "line")
    rows = head.union(lines.select(F.lit(1), *order, "line")).orderBy("_part", *order)
    rows.select(F.col("line").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def sample_queries(source: DataFrame, count: int) -> DataFrame:
    """(name, content) of the first `count` genomes of source (ordinal, accession, peaks): text files, and an MGF file for the last."""
    if count <= 0:
        raise ValueError("count must be positive")
    first = source.orderBy("ordinal").limit(count).withColumn("_n", F.row_number().over(_by_ordinal()))
    last = F.col("_n") == F.max("_n").over(_all())
    stem = F.concat(F.format_string("%02d", F.col("_n")), F.lit("-"), E.sanitize_filename("accession"))
    rows = F.array_join(F.transform("peaks", lambda p: F.format_string("%.4f 1.0", p)), "\n")
    title = F.concat(F.lit("COM="), F.col("accession"), F.lit("\n"))
    text = F.concat(title, F.lit("# generated from all.db\n"), rows, F.lit("\n"))
    mgf = F.concat(F.lit("BEGIN IONS\nTITLE="), F.col("accession"), F.lit("\n"), title, rows, F.lit("\nEND IONS\n"))
    return first.select(F.concat(stem, F.when(last, ".mgf").otherwise(".txt")).alias("name"), F.when(last, mgf).otherwise(text).alias("content"))


def _by_ordinal():
    from pyspark.sql.window import Window

    return Window.orderBy("ordinal")  # over `count` rows


def _all():
    from pyspark.sql.window import Window

    return Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over `count` rows
