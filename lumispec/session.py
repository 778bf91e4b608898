"""One object for a working session: build or open a library, identify query files, export."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.library import Library, build_library
from .operators.search import identify
from .operators.validate import validate
from .schemas import BIN_WIDTH, COARSE_LIMIT, PPM, SHARDS, TOP_RESULTS
from .shared import shared_dir
from .ship import ship
from .sources import export, pickle_source
from .sources.discovery import discover
from .sources.spectra import read_files, read_queries
from .streaming.identify import identify_folder

GROUP = "lumispec-identify"


class Session:
    def __init__(self, spark: SparkSession) -> None:
        ship(spark)
        self.spark = spark
        self.library: Library | None = None

    def open(self, path: str) -> Library:
        self.library = Library(self.spark, path)
        return self.library

    def build(self, source: str, path: str, bin_width: int = BIN_WIDTH, order: str = "source", strict: bool = False, shards: int = SHARDS, on_event: Callable[[dict], None] | None = None, genes: str | None = None, names: str | None = None, taxonomy: str | None = None) -> Library:
        """Builds a library from pickle files and opens it. on_event gets start, indexStart, metaStart, finalizeStart and done, with elapsed_ms and the
        counts that are known by then. The peaks' pickle is one stream and is decoded once, by one task, into a checkpoint."""
        began = time.monotonic()
        tell = lambda stage, **x: on_event({"stage": stage, **x, "elapsed_ms": int((time.monotonic() - began) * 1000)}) if on_event else None
        found = discover(source, genes, names, taxonomy)
        tell("start", all_db=str(found.peaks))
        shared_dir(self.spark)
        peaks = pickle_source.read_peaks(self.spark, str(found.peaks), strict).checkpoint()
        paths = [str(x) if x else None for x in (found.genes, found.names, found.taxonomy)]
        meta = [read(self.spark, x) for read, x in zip((pickle_source.read_genes, pickle_source.read_names, pickle_source.read_taxonomy), paths, strict=True)]
        library = build_library(peaks, *meta, path, bin_width, order, strict, shards, on_event=lambda event: tell(**event))
        self.library = library
        tell("done", **{k: library.manifest[k] for k in ("genome_count", "total_peak_count", "bin_count")})
        return library

    def _open(self) -> Library:
        if self.library is None:
            raise RuntimeError("database not loaded")
        return self.library

    def identify(self, paths: list[str], coarse_limit: int = COARSE_LIMIT, ppm: int = PPM, top: int = TOP_RESULTS, permissive: bool = False, split_mgf: bool = False) -> DataFrame:
        """Results of query files with query_file, in the order of files, then rank. The files are read and parsed once, when this is called: their
        peaks are a checkpoint, which the search packs, also when this is called. The rest is one lazy plan: what is run on it within running() is what
        cancel() ends."""
        library = self._open()
        shared_dir(self.spark)
        queries = read_queries(self.spark, paths, split_mgf, permissive).checkpoint()
        found = identify(library.peaks, queries, coarse_limit, ppm, library.manifest["bin_width"], top)
        names = queries.select("query_id", "query_file").distinct() if split_mgf else F.broadcast(read_files(self.spark, paths).drop("path"))
        return found.join(names, "query_id").orderBy("query_id", "rank")

    def identify_in_blocks(self, paths: list[str], every: int = 64, cancelled: Callable[[], bool] = lambda: False, **options: object) -> Iterator[tuple[int, int, DataFrame | None]]:
        """(processed, total, results) block by block of `every` files, first (0, total, None): for a progress display. The files of a block are one
        plan. Once cancelled() is true, no further block begins."""
        every, total = max(every, 1), len(paths)
        if not total:
            raise ValueError("no query files")
        yield 0, total, None
        for at in range(0, total, every):
            if cancelled():
                return
            block = paths[at : at + every]
            found = self.identify(block, **options).withColumn("query_id", F.col("query_id") + at)
            yield at + len(block), total, found

    def identify_folder(self, folder: str, out: str, checkpoint: str, every: int = 64, coarse_limit: int = COARSE_LIMIT, ppm: int = PPM, top: int = TOP_RESULTS, on_progress: Callable[[int, int], None] = lambda processed, total: None, cancelled: Callable[[], bool] = lambda: False) -> bool:
        """Identifies the query files of a folder, `every` at a time, into out; what is done stays when it is cancelled or fails, and the next call with
        the same checkpoint goes on. See streaming.identify.identify_folder()."""
        library = self._open()
        return identify_folder(self.spark, folder, library.peaks, out, checkpoint, every, coarse_limit, ppm, library.manifest["bin_width"], top, on_progress, cancelled)

    @contextmanager
    def running(self) -> Iterator[None]:
        """Jobs that this thread starts within are of one group, which cancel() ends; those after are not."""
        context = self.spark.sparkContext
        context.setJobGroup(GROUP, "identification", interruptOnCancel=True)
        try:
            yield
        finally:
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(key, None)

    def cancel(self) -> None:
        """Ends the jobs that run within running()."""
        self.spark.sparkContext.cancelJobGroup(GROUP)

    def validate(self) -> DataFrame:
        return validate(self._open())

    def export_genomes(self, path: str) -> None:
        export.write_lines(export.genome_lines(self._open().genomes), export.GENOMES_HEADER, ["genome_id"], path)

    def export_results(self, results: DataFrame, path: str) -> None:
        with self.running():
            export.write_lines(export.result_lines(results), export.RESULTS_HEADER, ["query_id", "rank"], path)
