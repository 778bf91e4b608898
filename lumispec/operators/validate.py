"""Data-quality rules of a library: each gives the number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encode as E
from . import layout
from .library import STORED
from .ordered import with_next


def _count(df: DataFrame, rule: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def genome_bound(postings: DataFrame, genomes: DataFrame) -> DataFrame:
    """Postings of genomes that aren't there."""
    return _count(postings.join(genomes.select("genome_id"), "genome_id", "left_anti"), "genome_bound")


def local_index_bound(postings: DataFrame, peaks: DataFrame) -> DataFrame:
    """Postings whose local index is negative or not below their genome's number of peaks."""
    sizes = peaks.groupBy("genome_id").agg(F.count("*").alias("_n"))
    bad = (F.col("local_peak_idx") < 0) | (F.col("local_peak_idx") >= F.col("_n"))
    return _count(postings.join(sizes, "genome_id").where(bad), "local_index_bound")


def global_index_bound(postings: DataFrame, offsets: DataFrame, total: int) -> DataFrame:
    """Postings whose place in the flat peak list lies beyond it. offsets: (genome_id, start_offset)."""
    at = F.col("start_offset") + F.col("local_peak_idx")
    return _count(postings.join(offsets.select("genome_id", "start_offset"), "genome_id").where((at < 0) | (at >= total)), "global_index_bound")


def bin_consistency(postings: DataFrame, peaks: DataFrame, bin_width: int) -> DataFrame:
    """Postings in another bin than their peak's."""
    own = peaks.select("genome_id", "local_peak_idx", E.bin_id("milli_mz", bin_width).alias("_bin"))
    return _count(postings.join(own, ["genome_id", "local_peak_idx"]).where("bin_id != _bin"), "bin_consistency")


def coverage(postings: DataFrame, peaks: DataFrame) -> DataFrame:
    """Peaks without a posting, or with several, and postings without a peak."""
    rows = peaks.select("genome_id", "local_peak_idx", F.lit(1).alias("_p"), F.lit(0).alias("_n")).union(postings.select("genome_id", "local_peak_idx", F.lit(0), F.lit(1)))
    both = rows.groupBy("genome_id", "local_peak_idx").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return both.agg(F.coalesce(F.sum(_uncovered()), F.lit(0)).cast("long").alias("violations")).select(F.lit("coverage").alias("rule"), "violations")


def _uncovered() -> Column:
    """coverage()'s violations of one place, of _p peaks and _n postings."""
    lone = F.col("_p") + (F.col("_n") > 0).cast("long")  # nulls are equal to nothing
    return F.when(F.col("genome_id").isNull() | F.col("local_peak_idx").isNull(), lone).when((F.col("_p") == 0) | (F.col("_n") != 1), F.greatest("_p", F.lit(1))).otherwise(0)


def places(postings: DataFrame, peaks: DataFrame, bin_width: int) -> DataFrame:
    """bin_consistency() and coverage(), from one shuffle of both tables."""
    at = ["genome_id", "local_peak_idx"]
    own = peaks.select(*at, E.bin_id("milli_mz", bin_width).alias("_bin"), F.lit(1).alias("_p"))
    rows = own.union(postings.select(*at, "bin_id", F.lit(0))).repartition(*at)
    bins = rows.groupBy(*at, "_bin").agg(F.sum("_p").alias("_p"), F.sum(1 - F.col("_p")).alias("_n"))
    of_bin = lambda x: F.sum(F.when(F.col("_bin").isNotNull(), x).otherwise(0))
    both = bins.groupBy(*at).agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), of_bin(F.col("_p")).alias("_bp"), of_bin(F.col("_n")).alias("_bn"), of_bin(F.col("_p") * F.col("_n")).alias("_same"))
    apart = F.when(F.col("genome_id").isNotNull() & F.col("local_peak_idx").isNotNull(), F.col("_bp") * F.col("_bn") - F.col("_same"))
    sums = both.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name) for name, x in (("apart", apart), ("lone", _uncovered()))))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(name).alias("violations")) for rule, name in (("bin_consistency", "apart"), ("coverage", "lone"))))))


def monotonic(offsets: DataFrame, order: str, offset: str, rule: str) -> DataFrame:
    """Offsets below the one before them."""
    return _count(with_next(offsets.select(order, offset), order, [offset]).where(F.col(f"next_{offset}") < F.col(offset)), rule)


def offset_edges(offsets: DataFrame, order: str, offset: str, total: int, rule: str) -> DataFrame:
    """Four rules of offsets (order, offset), one for each id from 0 on: the first is 0, the last is total, no id is left out or comes twice, and none
    lies below the one before. No offsets at all break the first two."""
    ends = offsets.agg(F.min_by(offset, order).alias("first"), F.max_by(offset, order).alias("last"), F.min(order).alias("low"))
    rows = with_next(offsets.select(order, offset).groupBy(order).agg(F.min(offset).alias(offset), F.count("*").alias("_n")), order, [offset])
    steps = rows.agg(
        F.coalesce(F.sum(F.when(F.col(f"next_{order}") != F.col(order) + 1, 1).otherwise(0) + F.col("_n") - 1), F.lit(0)).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col(f"next_{offset}") < F.col(offset), 1)), F.lit(0)).alias("falls"),
    )
    one = lambda bad: F.when(F.coalesce(bad, F.lit(True)), 1).otherwise(0)
    rules = {"first": one((F.col("first") != 0) | (F.col("low") != 0)), "last": one(F.col("last") != total), "gap": F.col("gaps"), "fall": F.col("falls")}
    both = ends.join(F.broadcast(steps), F.lit(True))  # one row each
    return both.select(F.inline(F.array(*(F.struct(F.lit(f"{rule}_{k}").alias("rule"), v.cast("long").alias("violations")) for k, v in rules.items()))))


def offsets_agree(offsets: DataFrame, order: str, offset: str, counts: DataFrame, count: str, rule: str) -> DataFrame:
    """Ids whose rows (counts: order, count) aren't as many as from their offset to the next."""
    own = with_next(offsets.select(order, offset), order, [offset]).where(F.col(f"next_{offset}").isNotNull())
    both = own.join(counts.select(order, F.col(count).alias("_n")), order, "full")
    return _count(both.where(F.coalesce(F.col(f"next_{offset}") - F.col(offset), F.lit(0)) != F.coalesce("_n", F.lit(0))), rule)


def dictionary_ids(used: DataFrame, id_: str, dictionary: DataFrame, rule: str) -> DataFrame:
    """Ids used that the dictionary lacks; and a first entry that isn't empty."""
    lost = used.select(F.col(id_).alias("dict_id")).join(dictionary, "dict_id", "left_anti").select("dict_id")
    return _count(lost.union(dictionary.where("dict_id = 0 and value != ''").select("dict_id")), rule)


def strings(df: DataFrame, column: str, rule: str) -> DataFrame:
    return _count(df.where(~F.is_valid_utf8(column)), rule)


def manifest_rules(manifest: dict, peaks: DataFrame, postings: DataFrame, genomes: DataFrame) -> DataFrame:
    """The manifest against the tables, as one row for each rule."""
    width = manifest.get("bin_width", 0)
    bins = F.coalesce(F.floor(F.max("milli_mz") / width) + 1, F.lit(1)) if width > 0 else F.lit(None).cast("long")
    counts = peaks.agg(F.count("*").alias("peaks"), bins.alias("bins"))
    for name, df in (("postings", postings), ("genomes", genomes)):
        counts = counts.join(F.broadcast(df.agg(F.count("*").alias(name))), F.lit(True))  # one row each
    number = lambda key: F.lit(manifest.get(key)).cast("long")
    rules = {
        "schema_version": number("schema_version") != 1, "bin_width": number("bin_width") <= 0, "bin_count": number("bin_count") != F.col("bins"),
        "posting_count": F.col("postings") != F.col("peaks"), "total_peak_count": number("total_peak_count") != F.col("peaks"), "genome_count": number("genome_count") != F.col("genomes"),
    }
    bad = lambda rule: F.when(F.coalesce(rule, F.lit(True)), 1).otherwise(0).cast("long")
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), bad(v).alias("violations")) for k, v in rules.items()))))


def stored_rules(library) -> DataFrame:
    """Places where a stored table isn't in order, and stored tables whose bytes, in order, haven't the manifest's checksum. Each table is read once."""
    parts = []
    for name, (keys, stored) in STORED.items():
        found = layout.runs(library.spark, f"{library.path}/{name}", keys, stored)
        parts.append(layout.order_of_runs(found).select(F.lit(f"order_{name}").alias("rule"), "violations"))
        own = layout.checksum_of_runs(found, len(stored))
        parts.append(own.select(F.lit(f"crc_{name}").alias("rule"), F.when(F.col("crc") == F.lit(library.manifest.get(f"crc_{name}")).cast("long"), 0).otherwise(1).cast("long").alias("violations")))
    return reduce(DataFrame.union, parts)


def validate(library) -> DataFrame:
    """All rules of a built library: (rule, violations)."""
    peaks, postings, genomes, manifest = library.peaks, library.postings, library.genomes, library.manifest
    width, total = manifest["bin_width"], manifest["total_peak_count"]
    offsets, bins = library.genome_offsets, library.bin_offsets
    # one offset more than genomes, as for bins
    ends = offsets.select("genome_id", "start_offset").union(offsets.agg((F.coalesce(F.max("genome_id"), F.lit(-1)) + 1).cast("long"), F.coalesce(F.max_by("end_offset", "genome_id"), F.lit(0)).cast("long")))
    parts = [
        manifest_rules(manifest, peaks, postings, genomes),
        genome_bound(postings, genomes),
        local_index_bound(postings, peaks),
        global_index_bound(postings, offsets, total),
        places(postings, peaks, width),
        offset_edges(bins, "bin_id", "offset", total, "bin_offsets"),
        offset_edges(ends, "genome_id", "start_offset", total, "genome_offsets"),
        offsets_agree(bins, "bin_id", "offset", postings.groupBy("bin_id").agg(F.count("*").alias("n")), "n", "bin_offsets_agree"),
        offsets_agree(ends, "genome_id", "start_offset", peaks.groupBy("genome_id").agg(F.count("*").alias("n")), "n", "genome_offsets_agree"),
        dictionary_ids(genomes, "name_id", library.names, "name_ids"),
        dictionary_ids(genomes, "taxon_id", library.taxa, "taxon_ids"),
        strings(genomes, "display_name", "name_utf8"),
        strings(genomes, "taxonomy", "taxonomy_utf8"),
        stored_rules(library),
    ]
    return reduce(DataFrame.union, parts)
