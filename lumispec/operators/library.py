"""Library building: peaks, postings, offsets, dictionaries, metadata and the manifest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode as E
from ..schemas import BIN_WIDTH, GENOMES, PEAKS, POSTINGS, SCHEMA_VERSION, SHARDS
from ..shared import shared_dir
from . import layout
from .ordered import exclusive_sum, number_by, sorted_number


def numbered(source: DataFrame, order: str = "source") -> DataFrame:
    """source (ordinal, accession, peaks; ordinals distinct) to (genome_id, accession, peaks): ids by source order or by accession, equal ones by
    source order. Only accessions and ordinals are sorted; the peaks meet their ids by ordinal."""
    if order != "accession":
        return source.select(F.col("ordinal").alias("genome_id"), "accession", "peaks")
    return source.join(genome_ids(source.select("accession", "ordinal"), order).select("ordinal", "genome_id"), "ordinal").select("genome_id", "accession", "peaks")


def genome_ids(genomes: DataFrame, order: str = "source") -> DataFrame:
    """genomes (ordinal, accession and more) with genome_id, as numbered() has it."""
    return sorted_number(genomes, ["accession", "ordinal"], "genome_id") if order == "accession" else genomes.withColumn("genome_id", F.col("ordinal"))


def listed(ids: DataFrame) -> DataFrame:
    """numbered() lists to (genome_id, accession, local_peak_idx, milli_mz), a row for each peak."""
    rows = ids.select("genome_id", "accession", F.posexplode("peaks").alias("local_peak_idx", "mz"))
    return rows.select("genome_id", "accession", F.col("local_peak_idx").cast("long").alias("local_peak_idx"), E.encode_mz("mz").alias("milli_mz"))


def peaks_of(source: DataFrame, order: str = "source") -> DataFrame:
    """source (ordinal, accession, peaks) to (genome_id, accession, local_peak_idx, milli_mz), numbered in that order."""
    return listed(numbered(source, order))


def postings(peaks: DataFrame, bin_width: int = BIN_WIDTH) -> DataFrame:
    """(bin_id, genome_id, local_peak_idx), dealt by ranges of bins and sorted within them: each peak once."""
    rows = peaks.select(E.bin_id("milli_mz", bin_width).alias("bin_id"), "genome_id", "local_peak_idx")
    return rows.repartitionByRange("bin_id", "genome_id").sortWithinPartitions("bin_id", "genome_id", "local_peak_idx")


def bin_histogram(peaks: DataFrame, bin_width: int = BIN_WIDTH) -> DataFrame:
    return peaks.groupBy(E.bin_id("milli_mz", bin_width).alias("bin_id")).agg(F.count("*").alias("peak_count"))


def bin_offsets(peaks: DataFrame, bin_width: int = BIN_WIDTH) -> DataFrame:
    """(bin_id, offset) for each bin from 0 to the last, empty ones included, and one more: the first posting of the bin."""
    return offsets_of_bins(bin_histogram(peaks, bin_width))


def offsets_of_bins(counts: DataFrame) -> DataFrame:
    """bin_offsets() of a histogram (bin_id, peak_count)."""
    last = counts.agg(F.max("bin_id")).first()[0]
    dense = counts.sparkSession.range((last if last is not None else 0) + 2).withColumnRenamed("id", "bin_id")
    filled = dense.join(counts, "bin_id", "left").select("bin_id", F.coalesce("peak_count", F.lit(0)).cast("long").alias("peak_count"))
    return exclusive_sum(filled, "bin_id", "peak_count", "offset").select("bin_id", "offset")


def genome_offsets(peaks: DataFrame, genomes: DataFrame) -> DataFrame:
    """(genome_id, total_peaks, start_offset, end_offset) for each of genomes (genome_id)."""
    counts = genomes.select("genome_id").join(peaks.groupBy("genome_id").agg(F.count("*").alias("n")), "genome_id", "left").select("genome_id", F.coalesce("n", F.lit(0)).cast("long").alias("total_peaks"))
    return offsets_of_genomes(counts)


def offsets_of_genomes(counts: DataFrame) -> DataFrame:
    """genome_offsets() of sizes (genome_id, total_peaks)."""
    out = exclusive_sum(counts, "genome_id", "total_peaks", "start_offset")
    return out.select("genome_id", "total_peaks", "start_offset", (F.col("start_offset") + F.col("total_peaks")).alias("end_offset"))


def dictionary(values: DataFrame, value: str, order: str) -> DataFrame:
    """(dict_id, value): distinct values numbered by first occurrence; 0 is the empty string."""
    firsts = values.where(F.col(value) != "").groupBy(F.col(value).alias("value")).agg(F.min(order).alias("_first"))
    # one row may bring several values at its place, so that places aren't distinct: number by place, then by value
    ranked = number_by(firsts.groupBy("_first").agg(F.array_sort(F.collect_set("value")).alias("values")), "_first", "_place")
    wide = exclusive_sum(ranked.withColumn("_n", F.size("values").cast("long")), "_first", "_n", "_start")
    rows = wide.select("_start", F.posexplode("values").alias("_k", "value")).select((F.col("_start") + F.col("_k") + 1).cast("long").alias("dict_id"), "value")
    return rows.union(values.sparkSession.createDataFrame([(0, "")], "dict_id long, value string"))


def enrich(genomes: DataFrame, genes: DataFrame, names: DataFrame, taxonomy: DataFrame, strict: bool = False) -> DataFrame:
    """genomes (genome_id, accession) with display_name, taxonomy_id, taxonomy and gene_count.

    genes (accession, gene_count), names (accession, name), taxonomy (accession, taxonomy_id, taxonomy). What is missing has its default: the
    accession, 0 and empty, 0; with strict, genomes that any of the three lacks make an error.
    """
    out = genomes.join(genes, "accession", "left").join(names, "accession", "left").join(taxonomy, "accession", "left")
    if strict:
        lack = F.col("gene_count").isNull() | F.col("name").isNull() | (F.col("taxonomy_id").isNull() & F.col("taxonomy").isNull())
        out = out.withColumn("accession", F.when(lack, F.raise_error(F.concat(F.lit("missing metadata: "), F.col("accession"))).cast("string")).otherwise(F.col("accession")))
    tax = E.normalise_taxonomy(F.col("taxonomy_id"), F.col("taxonomy"))
    gene_count = E.clamp_gene_count(F.coalesce("gene_count", F.lit(0)))
    return out.select("genome_id", "accession", F.coalesce("name", "accession").alias("display_name"), tax["id"].alias("taxonomy_id"), tax["text"].alias("taxonomy"), gene_count.alias("gene_count"))


def missing_metadata(genomes: DataFrame, genes: DataFrame, names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(genome_id, accession, lacks): what strict enrichment refuses, a row for each genome and kind of metadata that it lacks."""
    parts = [genomes.join(df.select("accession"), "accession", "left_anti").select("genome_id", "accession", F.lit(kind).alias("lacks")) for df, kind in ((genes, "genes"), (names, "name"), (taxonomy, "taxonomy"))]
    return parts[0].union(parts[1]).union(parts[2])


def build_report(peaks: DataFrame, genomes: DataFrame, bin_width: int = BIN_WIDTH) -> DataFrame:
    """One row: genome_count, total_peak_count, bin_count (1 for an empty library)."""
    own = peaks.agg(F.count("*").alias("total_peak_count"), F.coalesce(F.max(E.bin_id("milli_mz", bin_width)) + 1, F.lit(1)).cast("long").alias("bin_count"))
    return genomes.agg(F.count("*").alias("genome_count")).crossJoin(own)  # one row each


def lookup_postings(rows: DataFrame, milli_mz: int, bin_width: int) -> DataFrame:
    """Postings of the peak's bin. Nothing for a bin width of 0."""
    return rows.where(F.col("bin_id") == milli_mz // bin_width) if bin_width > 0 else rows.limit(0)


def lookup_peaks(peaks: DataFrame, genome_id: int) -> DataFrame:
    return peaks.where(F.col("genome_id") == genome_id).select("local_peak_idx", "milli_mz")


class Library:
    """A built library: Parquet tables and a manifest.

    postings, bin_offsets: folders for bands of band_width bins each; peaks, genomes, genome_offsets: folders for shards of shard_width genomes each.
    Rows are in order within a folder, so that a lookup lists one folder and reads the row groups that can hold its key. names, taxa: dictionaries
    of what genomes name by name_id and taxon_id.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.text(f"{self.path}/manifest", wholetext=True).collect()
        self.manifest = json.loads(rows[0][0]) if rows else {}
        if self.manifest.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"schema version {self.manifest.get('schema_version')!r} isn't {SCHEMA_VERSION}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}")

    peaks = property(lambda self: self.table("peaks").drop("shard"))
    postings = property(lambda self: self.table("postings").drop("band"))
    genomes = property(lambda self: self.table("genomes").drop("shard"))
    bin_offsets = property(lambda self: self.table("bin_offsets").drop("band"))
    genome_offsets = property(lambda self: self.table("genome_offsets").drop("shard"))
    names = property(lambda self: self.table("names"))
    taxa = property(lambda self: self.table("taxa"))

    def postings_for(self, milli_mz: int) -> DataFrame:
        """Postings of the bin of one peak; nothing beyond the last bin."""
        width = self.manifest["bin_width"]
        band = milli_mz // width // self.manifest["band_width"] if width > 0 else 0
        return lookup_postings(self.table("postings").where(F.col("band") == band), milli_mz, width).drop("band")

    def _of_genome(self, name: str, genome_id: int) -> DataFrame:
        return self.table(name).where((F.col("shard") == genome_id // self.manifest["shard_width"]) & (F.col("genome_id") == genome_id))

    def genome_peaks(self, genome_id: int) -> DataFrame:
        return self._of_genome("peaks", genome_id).select("local_peak_idx", "milli_mz")

    def genome_metadata(self, genome_id: int) -> DataFrame:
        return self._of_genome("genomes", genome_id).drop("shard")

    def postings_of(self, wanted: DataFrame) -> DataFrame:
        """The postings of the bins of many peaks, wanted (milli_mz): (milli_mz, bin_id, genome_id, local_peak_idx), each distinct peak once. Bands
        that nothing asks for aren't read where Spark's dynamic pruning finds the join's other side small."""
        width, band = self.manifest["bin_width"], self.manifest["band_width"]
        asked = wanted.select(F.col("milli_mz").cast("long").alias("milli_mz")).distinct().withColumn("bin_id", E.bin_id("milli_mz", width)).withColumn("band", F.expr(f"bin_id div {band}L"))
        return asked.join(self.table("postings"), ["band", "bin_id"]).select("milli_mz", "bin_id", "genome_id", "local_peak_idx")


_SCHEMAS = {
    "peaks": f"{PEAKS}, shard long", "postings": f"{POSTINGS}, band long", "genomes": f"{GENOMES}, name_id long, taxon_id long, shard long",
    "bin_offsets": "bin_id long, offset long, band long", "genome_offsets": "genome_id long, total_peaks long, start_offset long, end_offset long, shard long",
    "names": "dict_id long, value string", "taxa": "dict_id long, value string",
}


def _stored(df: DataFrame, path: str, part: str, width: int, keys: list[str], mode: str) -> DataFrame:
    """Writes df sorted by keys, dealt by ranges of them, in a folder for each `width` values of the first key. Rows of one value may fill many
    ranges, so that no task holds a hot one."""
    rows = df.withColumn(part, F.expr(f"`{keys[0]}` div {width}L"))
    rows.repartitionByRange(*keys).sortWithinPartitions(part, *keys).write.mode(mode).partitionBy(part).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_library(
    source: DataFrame, genes: DataFrame, names: DataFrame, taxonomy: DataFrame, path: str, bin_width: int = BIN_WIDTH, order: str = "source", strict: bool = False,
    shards: int = SHARDS, mode: str = "error", on_event: Callable[[dict], None] | None = None,
) -> Library:
    """Writes a library to path from a source (ordinal, accession, peaks) and its metadata. shards: folders of each partitioned table, about. mode:
    Spark's, for all tables; with overwrite a build may be run again over what an earlier one left. on_event gets a dict for each stage that
    begins, with the counts that are known by then: genome (all peaks are written, in one job), indexStart, metaStart, finalizeStart.

    The source is read for its genomes' sizes and for its peaks alone, the stored peaks for the histogram of bins and the postings: all else comes
    from checkpoints of the sizes, the histogram and the metadata, a row for each genome or bin."""
    if bin_width <= 0 or shards <= 0:
        raise ValueError("bin width and shards must be positive")
    spark, path = source.sparkSession, path.rstrip("/")
    tell = on_event or (lambda event: None)
    shared_dir(spark)
    sizes = genome_ids(source.select("ordinal", "accession", F.greatest(F.size("peaks"), F.lit(0)).cast("long").alias("total_peaks")).checkpoint(), order)
    lists = numbered(source, "source") if order != "accession" else source.join(sizes.select("ordinal", "genome_id"), "ordinal")
    n = sizes.agg(F.max("genome_id")).first()[0]
    shard_width = max(1, -(-((n if n is not None else 0) + 1) // shards))
    peaks = _stored(listed(lists).select("genome_id", "local_peak_idx", "milli_mz"), f"{path}/peaks", "shard", shard_width, ["genome_id", "local_peak_idx"], mode)
    histogram = bin_histogram(peaks, bin_width).checkpoint()
    counts = histogram.agg(F.coalesce(F.sum("peak_count"), F.lit(0)).alias("total_peak_count"), F.coalesce(F.max("bin_id") + 1, F.lit(1)).cast("long").alias("bin_count"))
    report = {"genome_count": sizes.count(), **counts.first().asDict()}
    tell({"stage": "genome", **report})
    tell({"stage": "indexStart", **report})
    band_width = max(1, -(-report["bin_count"] // shards))
    _stored(postings(peaks, bin_width), f"{path}/postings", "band", band_width, ["bin_id", "genome_id", "local_peak_idx"], mode)
    _stored(offsets_of_bins(histogram), f"{path}/bin_offsets", "band", band_width, ["bin_id"], mode)
    tell({"stage": "metaStart", **report})
    _stored(offsets_of_genomes(sizes.select("genome_id", "total_peaks")), f"{path}/genome_offsets", "shard", shard_width, ["genome_id"], mode)
    rows = enrich(sizes.select("genome_id", "accession"), genes, names, taxonomy, strict).join(sizes.select("genome_id", "total_peaks"), "genome_id").checkpoint()
    for column, name, id_ in (("display_name", "names", "name_id"), ("taxonomy", "taxa", "taxon_id")):
        dictionary(rows.select("genome_id", column), column, "genome_id").orderBy("dict_id").write.mode(mode).parquet(f"{path}/{name}")
        entries = spark.read.schema(_SCHEMAS[name]).parquet(f"{path}/{name}").select(F.col("dict_id").alias(id_), F.col("value").alias(column))
        rows = rows.join(entries, column)
    order_of = [c.split()[0] for c in f"{GENOMES}, name_id long, taxon_id long".split(", ")]
    _stored(rows.select(*order_of), f"{path}/genomes", "shard", shard_width, ["genome_id"], mode)
    tell({"stage": "finalizeStart", **report})
    sums = {f"crc_{name}": layout.checksum(spark, f"{path}/{name}", *STORED[name]).first()["crc"] for name in STORED}
    manifest = json.dumps({"schema_version": SCHEMA_VERSION, "bin_width": bin_width, "band_width": band_width, "shard_width": shard_width, **report, **sums})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")
    return Library(spark, path)


#: The order of rows of stored tables, and the columns that their checksums cover.
STORED = {
    "peaks": (["genome_id", "local_peak_idx"], ["milli_mz"]),
    "postings": (["bin_id", "genome_id", "local_peak_idx"], ["genome_id", "local_peak_idx"]),
}
