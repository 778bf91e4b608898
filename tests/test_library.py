import datetime as dt
import io
import pickle
import pickletools
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from lumispec.operators import layout
from lumispec.operators import library as L
from lumispec.operators import progress as P
from lumispec.operators import validate as V
from lumispec.operators.ordered import exclusive_sum, number_by
from lumispec.session import Session
from lumispec.sources import binary, export, pickle_source
from lumispec.sources.discovery import discover
from lumispec.sources.spectra import read_queries
from lumispec.streaming.identify import identify_folder, identify_stream

SOURCE = {"g0": [1000.0, 1200.0], "g1": [1001.0, 1400.0]}


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "source"
    folder.mkdir()
    tax = {"id": 101, "text": "d__Bacteria;p__Shared"}
    for name, value in (("all", SOURCE), ("genes", {"g0": 900, "g1": 1100}), ("names", {"g0": "Genome Zero", "g1": "Genome One"}), ("taxonomy", {"g0": tax, "g1": tax})):
        (folder / f"{name}.db").write_bytes(pickle.dumps(value, protocol=pickle.HIGHEST_PROTOCOL))
    return folder


@pytest.fixture
def queries(tmp_path):
    (tmp_path / "query-a.mgf").write_text("BEGIN IONS\nTITLE=a\nPEPMASS=1000.0\n1000.0 0.5\n1200.0 0.3\n1001.0 0.2\nEND IONS\n")
    (tmp_path / "query-b.txt").write_text("1001.0 0.6\n1400.0 0.4\n")
    return [str(tmp_path / "query-a.mgf"), str(tmp_path / "query-b.txt")]


def test_session(spark, source, queries, tmp_path):
    events = []
    session = Session(spark)
    with pytest.raises(RuntimeError, match="not loaded"):
        session.identify(queries)
    library = session.build(str(source), str(tmp_path / "library"), on_event=events.append)
    assert [e["stage"] for e in events] == ["start", "genome", "indexStart", "metaStart", "finalizeStart", "done"]
    assert (events[-1]["genome_count"], events[-1]["total_peak_count"], events[-1]["bin_count"]) == (2, 4, 14001)
    assert [tuple(r) for r in library.postings.orderBy("bin_id", "genome_id").collect()] == [(10000, 0, 0), (10010, 1, 0), (12000, 0, 1), (14000, 1, 1)]
    assert [tuple(r) for r in library.postings_for(1000050).collect()] == [(10000, 0, 0)]
    assert library.genome_peaks(1).count() == 2
    assert library.genome_metadata(0).first().display_name == "Genome Zero"
    got = session.identify(queries).collect()
    assert [(r.query_file, r.genome_id, round(r.score, 6), r.matched_ribosomal, r.matched_total) for r in got] == [("query-a.mgf", 0, 0.8, 2, 2), ("query-a.mgf", 1, 0.2, 1, 1), ("query-b.txt", 1, 1.0, 2, 2)]
    assert all(r.violations == 0 for r in session.validate().collect())
    session.export_genomes(str(tmp_path / "genomes"))
    session.export_results(session.identify(queries), str(tmp_path / "results"))
    assert "0,Genome Zero,d__Bacteria;p__Shared,2,900" in [r[0] for r in spark.read.text(str(tmp_path / "genomes")).collect()]
    parts = sorted((tmp_path / "results").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == (export.RESULTS_HEADER + "\nquery-a.mgf,0,0.800000,2,2\nquery-a.mgf,1,0.200000,1,1\nquery-b.txt,1,1.000000,2,2\n").encode()
    assert Session(spark).open(str(tmp_path / "library")).manifest == library.manifest
    steps = [(n, total, df and df.count()) for n, total, df in session.identify_in_blocks(queries, every=1)]
    assert steps == [(0, 2, None), (1, 2, 2), (2, 2, 1)]
    assert [n for n, *_ in session.identify_in_blocks(queries, every=1, cancelled=lambda: True)] == [0]
    session.cancel()
    told = []
    (tmp_path / "files").mkdir()
    for q in queries:
        shutil.copy(q, tmp_path / "files")
    assert session.identify_folder(str(tmp_path / "files"), str(tmp_path / "whole"), str(tmp_path / "mark"), every=1, on_progress=lambda *x: told.append(x))
    assert told == [(0, 2), (1, 2), (2, 2)] and spark.read.parquet(str(tmp_path / "whole/results")).count() == 3
    out = tmp_path / "binary"
    assert binary.from_library(library, out) == {"genome_count": 2, "total_peak_count": 4, "bin_count": 14001}
    assert binary.validate(out) == (True, [])


def test_stream(spark, source, queries, tmp_path, tmp_path_factory):
    session = Session(spark)
    library = session.build(str(source), str(tmp_path_factory.mktemp("library") / "library"))
    found = []
    query = identify_stream(spark, str(tmp_path), library.peaks, lambda df, n: found.extend(tuple(r) for r in df.select("query_file", "genome_id", "rank").collect()), str(tmp_path / "checkpoint"), available_now=True)
    query.awaitTermination()
    assert sorted(found) == [("query-a.mgf", 0, 1), ("query-a.mgf", 1, 2), ("query-b.txt", 1, 1)]


def test_accession_order(spark):
    source = spark.createDataFrame([(0, "b", [2.0]), (1, "a", [1.0, 3.0]), (2, "c", [])], "ordinal long, accession string, peaks array<double>")
    got = L.peaks_of(source, "accession").orderBy("genome_id", "local_peak_idx").collect()
    assert [tuple(r) for r in got] == [(0, "a", 0, 1000), (0, "a", 1, 3000), (1, "b", 0, 2000)]


def test_enrich_defaults(spark):
    genomes = spark.createDataFrame([(0, "a"), (1, "b")], "genome_id long, accession string")
    genes = spark.createDataFrame([("a", -5)], "accession string, gene_count long")
    names = spark.createDataFrame([("a", "A")], "accession string, name string")
    taxa = spark.createDataFrame([("a", -1, None)], "accession string, taxonomy_id long, taxonomy string")
    got = {r.genome_id: tuple(r)[2:] for r in L.enrich(genomes, genes, names, taxa).collect()}
    assert got == {0: ("A", 0, "", 0), 1: ("b", 0, "", 0)}
    with pytest.raises(Exception, match="missing metadata"):
        L.enrich(genomes, genes, names, taxa, strict=True).collect()


def test_dictionary_and_offsets(spark):
    values = spark.createDataFrame([(5, "x"), (1, "y"), (9000, "x"), (2, ""), (7000, "z"), (5, "w")], "g long, v string")
    got = sorted(tuple(r) for r in L.dictionary(values, "v", "g").collect())
    assert got == [(0, ""), (1, "y"), (2, "w"), (3, "x"), (4, "z")]
    peaks = spark.createDataFrame([(10, 2050), (20, 0), (11, 2099), (30, 5000)], "genome_id long, milli_mz long")
    assert [r.offset for r in L.bin_offsets(peaks, 1000).orderBy("bin_id").collect()] == [0, 1, 1, 3, 3, 3, 4]
    assert [r.offset for r in L.bin_offsets(peaks.limit(0)).orderBy("bin_id").collect()] == [0, 0]
    assert L.build_report(peaks.limit(0), peaks.limit(0)).first().bin_count == 1
    ids = spark.range(0, 20_000, 3).withColumnRenamed("id", "k")
    assert [r.n for r in number_by(ids, "k", "n", 1).orderBy("k").collect()] == list(range(1, 6668))
    assert exclusive_sum(ids.selectExpr("k", "k as v"), "k", "v", "s").orderBy("k").collect()[-1].s == sum(range(0, 19_996, 3))


def test_rules(spark):
    peaks = spark.createDataFrame([(0, 0, 100), (0, 1, 250)], "genome_id long, local_peak_idx long, milli_mz long")
    genomes = spark.createDataFrame([(0,)], "genome_id long")
    good = L.postings(peaks)
    bad = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 0, 1), (0, 7, 0), (0, 0, 9)], "bin_id long, genome_id long, local_peak_idx long")
    count = lambda df: df.first().violations
    assert [count(V.genome_bound(x, genomes)) for x in (good, bad)] == [0, 1]
    assert [count(V.local_index_bound(x, peaks)) for x in (good, bad)] == [0, 1]
    assert [count(V.bin_consistency(x, peaks, 100)) for x in (good, bad)] == [0, 1]
    assert [count(V.coverage(x, peaks)) for x in (good, bad)] == [0, 3]
    offsets = spark.createDataFrame([(0, 0), (1, 5), (2, 4)], "k long, o long")
    assert count(V.monotonic(offsets, "k", "o", "r")) == 1
    names = spark.createDataFrame([(0, "x"), (1, "y")], "dict_id long, value string")
    assert count(V.dictionary_ids(spark.createDataFrame([(1,), (2,)], "i long"), "i", names, "r")) == 2


def test_progress(spark):
    t = dt.datetime(2024, 1, 1)
    seconds = [(0, "start"), (1, "genome"), (20, "genome"), (61, "genome"), (62, "genome"), (130, "indexStart"), (140, "metaStart"), (150, "done")]
    rows = [(run, i, t + dt.timedelta(seconds=s), stage, i * 10, i * 100) for run in (1, 2) for i, (s, stage) in enumerate(seconds)]
    events = spark.createDataFrame(rows, "run_id long, seq long, ts timestamp, stage string, genomes long, peaks long")
    got = sorted((r.run_id, r.seq) for r in P.throttle(events, 60_000_000).collect())
    assert got == [(run, i) for run in (1, 2) for i in (0, 1, 3, 5, 6, 7)]
    assert P.throttle(events, 0).count() == 16
    status = {r.seq: (r.genomes_processed, r.peaks_processed) for r in P.reduce_status(events).where("run_id = 1").collect()}
    assert status == {0: (0, 0), 1: (10, 100), 2: (20, 200), 3: (30, 300), 4: (40, 400), 5: (40, 400), 6: (40, 400), 7: (70, 700)}
    assert tuple(P.stage_durations(events).where("run_id = 1").first())[1:] == (130_000_000, 10_000_000, 150_000_000)


def test_throttled_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i, t + dt.timedelta(seconds=s), stage, 0, 0) for i, (s, stage) in enumerate([(0, "start"), (1, "genome"), (20, "genome"), (61, "genome"), (62, "done")])]
    schema = "run_id long, seq long, ts timestamp, stage string, genomes long, peaks long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = P.throttle_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 60_000_000)
    query = stream.writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.seq for r in spark.table("throttled").collect()) == [0, 1, 3, 4]


def test_pickles(spark, tmp_path):
    big = {f"k{i}" * (1 + 200 * (i == 3)): [float(j) for j in range(i % 5)] for i in range(2500)} | {"long": [0.5] * 3000}
    path = tmp_path / "all.db"
    path.write_bytes(pickle.dumps(big, protocol=5))
    got = [(r.accession, r.peaks) for r in pickle_source.read_peaks(spark, str(path)).orderBy("ordinal").collect()]
    assert got == list(big.items())
    path.write_bytes(pickle.dumps(SOURCE, protocol=4))
    assert dict(pickle_source.peak_lists(io.BytesIO(path.read_bytes()), strict=True)) == SOURCE
    with pytest.raises(pickle_source.DecodeError, match="0x4e at offset 2"):
        list(pickle_source.walk(io.BytesIO(b"\x80\x04N."), strict=True))
    with pytest.raises(pickle_source.DecodeError):
        list(pickle_source.peak_lists(io.BytesIO(pickle.dumps({"a": print}))))  # nothing is ever called
    with pytest.raises(pickle_source.DecodeError, match="protocol"):
        list(pickle_source.walk(io.BytesIO(pickle.dumps({}, protocol=0)), strict=True))
    chunked = pickletools.optimize(b"\x80\x04}\x94(\x8c\x02g0\x94]\x94(G?\xf0\x00\x00\x00\x00\x00\x00G@\x00\x00\x00\x00\x00\x00\x00e(G@\x08\x00\x00\x00\x00\x00\x00eu.")
    assert list(pickle_source.peak_lists(io.BytesIO(chunked), strict=True)) == [("g0", [1.0, 2.0, 3.0])]
    seen = []
    with pytest.raises(ZeroDivisionError):
        pickle_source.for_each_entry(str(path), lambda k, p: seen.append(k) or 1 / 0)
    assert seen == ["g0"]


def test_discovery(source, tmp_path):
    inner = source / "deep" / "er"
    inner.mkdir(parents=True)
    found = discover(inner)
    assert (found.peaks, found.genes) == (source / "all.db", source / "genes.db")
    assert discover(source / "names.db").taxonomy == source / "taxonomy.db"
    (source / "mass").mkdir()
    (source / "mass" / "all_genes.db").write_bytes(b"")
    assert discover(source).genes == source / "mass" / "all_genes.db"
    assert str(discover(source, genes="/x").genes) == "/x"
    with pytest.raises(FileNotFoundError, match="missing required"):
        discover("/proc")


def test_binary_faults(spark, tmp_path):
    binary.write([[1000000, 1200000], [1001000, 1400000]], [("A", 1, "t", 9), ("B", 1, "t", 8)], tmp_path)
    x = binary.read(tmp_path)
    assert (x["names"], x["taxonomy"], x["genome_offsets"].tolist()) == (["A", "B"], ["t", "t"], [0, 2, 4])
    assert x["postings"].tolist() == [[0, 0], [1, 0], [0, 1], [1, 1]]
    frames = binary.to_frames(spark, tmp_path)
    assert frames["postings"].count() == 4
    raw = (tmp_path / "meta.bin").read_bytes()
    (tmp_path / "meta.bin").write_bytes(raw[:-1] + b"!")
    assert binary.validate(tmp_path) == (False, ["checksum:meta.bin"])
    (tmp_path / "header.bin").write_bytes(b"x")
    assert binary.validate(tmp_path) == (False, ["header_size"])
    (tmp_path / "meta.bin").unlink()
    assert binary.validate(tmp_path) == (False, ["file:meta.bin"])
    assert binary.write([], [], tmp_path / "empty")["bin_count"] == 1
    assert binary.validate(tmp_path / "empty") == (True, [])


def test_samples(spark):
    source = spark.createDataFrame([(0, "a/b", [1.0]), (1, "c", [2.0, 3.0]), (2, "d", [4.0])], "ordinal long, accession string, peaks array<double>")
    got = {r.name: r.content for r in export.sample_queries(source, 2).collect()}
    assert got == {"01-a_b.txt": "COM=a/b\n# generated from all.db\n1.0000 1.0\n", "02-c.mgf": "BEGIN IONS\nTITLE=c\nCOM=c\n2.0000 1.0\n3.0000 1.0\nEND IONS\n"}
    with pytest.raises(ValueError):
        export.sample_queries(source, 0)


@pytest.mark.parametrize("order", ["source", "accession"])
def test_genomes_without_peaks_stay(spark, tmp_path, order):
    source = spark.createDataFrame([(0, "c", [2.0]), (1, "b", []), (2, "a", [1.0, 3.0])], "ordinal long, accession string, peaks array<double>")
    genes, names, taxa = (spark.createDataFrame([], f"accession string, {x}") for x in ("gene_count long", "name string", "taxonomy_id long, taxonomy string"))
    library = L.build_library(source, genes, names, taxa, str(tmp_path / "library"), order=order)
    got = [(r.genome_id, r.accession, r.total_peaks) for r in library.genomes.orderBy("genome_id").collect()]
    want = [("c", 1), ("b", 0), ("a", 2)]
    assert got == [(k, *x) for k, x in enumerate(want if order == "source" else want[::-1])]
    assert library.manifest["genome_count"] == 3 and library.peaks.where("genome_id = 1").count() == 0


def test_many_genomes_in_accession_order(spark, tmp_path):
    """No genome is lost where the table has many partitions, with the lists or without."""
    n, each = 20_000, 40
    accession = F.concat(F.lit("acc"), (F.col("id") * 7919 % n).cast("string"))
    peaks = F.transform(F.sequence(F.lit(1), F.lit(each)), lambda k: (F.col("id") % 97 * 10 + k).cast("double"))
    source = spark.range(0, n, 1, 16).select(F.col("id").alias("ordinal"), accession.alias("accession"), peaks.alias("peaks"))
    want = {f"acc{i * 7919 % n}": i for i in range(n)}
    got = L.numbered(source, "accession").select("genome_id", "accession", F.element_at("peaks", 1).alias("first")).collect()
    assert [(r.accession, r.first) for r in sorted(got)] == [(a, want[a] % 97 * 10 + 1.0) for a in sorted(want)]
    assert sorted(r.genome_id for r in got) == list(range(n))
    genes, names, taxa = (spark.createDataFrame([], f"accession string, {x}") for x in ("gene_count long", "name string", "taxonomy_id long, taxonomy string"))
    library = L.build_library(source, genes, names, taxa, str(tmp_path / "library"), order="accession", shards=4)
    assert (library.manifest["genome_count"], library.manifest["total_peak_count"]) == (n, n * each)
    assert library.genomes.count() == n and library.peaks.count() == library.postings.count() == n * each
    bad = {r.rule: r.violations for r in V.validate(library).collect()}
    assert len(bad) > 25 and not any(bad.values())
    assert V.stored_rules(library).count() == 4
    # a lookup reads one folder, and of it the row groups that can hold its key
    hits = library.postings_for(50_000)
    plan = hits._jdf.queryExecution()
    text = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(band" in text and "EqualTo(bin_id,500)" in text
    assert plan.toRdd().count() == hits.count() > 0
    read = plan.executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    assert 0 < read < len(library.table("postings").inputFiles())
    assert library.genome_peaks(123).count() == each and library.genome_metadata(123).first().accession == sorted(want)[123] and library.genome_peaks(n).count() == 0
    assert library.postings_for(10**12).count() == 0
    many = library.postings_of(spark.createDataFrame([(50_000,), (50_050,), (7,)], "milli_mz long"))
    assert many.count() == 2 * hits.count()


@pytest.mark.parametrize("order", ["source", "accession"])
def test_a_build_reads_its_source_thrice_at_most(spark, tmp_path, order):
    """For the sizes, for the ranges that the peaks are dealt by, and for the peaks; a join's shuffled lists serve the last two at once."""
    read, n = spark.sparkContext.accumulator(0), 500

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(0, n, 1, 4).select(F.col("id").alias("ordinal"), F.concat(F.lit("acc"), F.col("id") * 7 % n).alias("accession"), F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: k.cast("double")).alias("peaks"))
    genes, names, taxa = (spark.createDataFrame([], f"accession string, {x}") for x in ("gene_count long", "name string", "taxonomy_id long, taxonomy string"))
    library = L.build_library(rows.mapInArrow(count, rows.schema), genes, names, taxa, str(tmp_path / "library"), order=order, shards=4)
    assert 2 * n <= read.value <= 3 * n and library.manifest["total_peak_count"] == 3 * n
    assert not any(r.violations for r in V.validate(library).collect())


def test_stored_faults_are_found(spark, tmp_path):
    """Offsets, order and bytes of stored tables, each broken on purpose."""
    offsets = lambda *rows: spark.createDataFrame(rows, "k long, o long")
    count = lambda df: {r.rule.removeprefix("r_"): r.violations for r in df.collect()}
    good = [(k, 3 * k) for k in range(10_000)]
    edges = lambda rows: count(V.offset_edges(offsets(*rows), "k", "o", 29_997, "r"))
    assert edges(good) == {"first": 0, "last": 0, "gap": 0, "fall": 0}
    assert edges([(0, 1), *good[1:]]) == {"first": 1, "last": 0, "gap": 0, "fall": 0}
    assert edges(good[1:])["first"] == 1
    assert edges(good[:-1]) == {"first": 0, "last": 1, "gap": 0, "fall": 0}
    assert edges([*good[:4096], *good[4097:]]) == {"first": 0, "last": 0, "gap": 1, "fall": 0}
    assert edges([*good[:4095], (4095, 99_999), *good[4096:]]) == {"first": 0, "last": 0, "gap": 0, "fall": 1}
    assert edges([*good, good[7]])["gap"] == 1
    assert edges([])["first"] == edges([])["last"] == 1
    counts = spark.createDataFrame([(k, 3) for k in range(9999)], "k long, n long")
    assert V.offsets_agree(offsets(*good), "k", "o", counts, "n", "r").first().violations == 0
    assert V.offsets_agree(offsets(*good), "k", "o", counts.where("k != 4095"), "n", "r").first().violations == 1
    rows = spark.range(30_000).select((F.col("id") * 7919 % 3001).alias("a"), (F.col("id") % 977).alias("b"))
    rows.repartitionByRange(5, "a", "b").sortWithinPartitions("a", "b").write.parquet(str(tmp_path / "t"))
    rows.repartition(3).write.parquet(str(tmp_path / "shuffled"))
    ends = rows.orderBy("a", "b").collect()
    import zlib

    import numpy as np

    whole = np.array([(r.b, r.a) for r in ends], "<u4").tobytes()
    assert tuple(layout.checksum(spark, str(tmp_path / "t"), ["a", "b"], ["b", "a"]).first()) == (30_000, zlib.crc32(whole))
    assert layout.order_faults(spark, str(tmp_path / "t"), ["a", "b"]).first().violations == 0
    assert layout.order_faults(spark, str(tmp_path / "shuffled"), ["a", "b"]).first().violations > 10_000
    changed = rows.withColumn("b", F.when((F.col("a") == 5) & (F.col("b") == rows.where("a = 5").first().b), 976).otherwise(F.col("b")))
    changed.repartitionByRange(5, "a", "b").sortWithinPartitions("a", "b").write.parquet(str(tmp_path / "changed"))
    assert layout.checksum(spark, str(tmp_path / "changed"), ["a", "b"], ["b", "a"]).first().crc != zlib.crc32(whole)
    # two sorted files whose ranges overlap
    rows.where("a < 2000").coalesce(1).sortWithinPartitions("a", "b").write.parquet(str(tmp_path / "two"))
    rows.where("a > 1000").coalesce(1).sortWithinPartitions("a", "b").write.mode("append").parquet(str(tmp_path / "two"))
    assert layout.order_faults(spark, str(tmp_path / "two"), ["a", "b"]).first().violations == 1


def test_stored_checksum_is_the_binary_layouts(spark, source, tmp_path):
    session = Session(spark)
    library = session.build(str(source), str(tmp_path / "library"))
    binary.from_library(library, tmp_path / "binary")
    head = binary.header((tmp_path / "binary" / "header.bin").read_bytes())
    assert library.manifest["crc_peaks"] == head["crc_peaks"]
    spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "genome_id long, local_peak_idx long, milli_mz long").withColumn("shard", F.lit(0).cast("long")).write.mode("overwrite").partitionBy("shard").parquet(str(tmp_path / "library/peaks"))
    bad = {r.rule for r in session.validate().collect() if r.violations}
    assert {"crc_peaks", "total_peak_count", "posting_count", "coverage", "genome_offsets_agree"} <= bad
    again = L.build_library(spark.createDataFrame([(0, "z", [5.0])], "ordinal long, accession string, peaks array<double>"), *(spark.createDataFrame([], f"accession string, {x}") for x in ("gene_count long", "name string", "taxonomy_id long, taxonomy string")), str(tmp_path / "library"), mode="overwrite")
    assert again.manifest["genome_count"] == 1 and not any(r.violations for r in V.validate(again).collect())


def test_one_ordered_csv(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("query_id"), F.lit(1).alias("rank")).withColumn("line", F.concat(F.lit("l"), F.col("query_id").cast("string"))).repartition(7)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        export.write_lines(rows, "head", ["query_id", "rank"], str(tmp_path / "csv"))
    finally:
        spark.conf.unset(key)
    parts = sorted((tmp_path / "csv").glob("part-*"))
    assert len(parts) > 1 and b"".join(p.read_bytes() for p in parts) == ("head\n" + "".join(f"l{i}\n" for i in range(5000))).encode()
    broken = rows.withColumn("line", F.when(F.col("query_id") == 4999, F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        export.write_lines(broken, "head", ["query_id", "rank"], str(tmp_path / "failed"))
    assert not list((tmp_path / "failed").glob("part-*"))


def test_lines_of_large_files(spark, tmp_path):
    """A file that Spark splits gives its peaks in order, and a spectrum for each block of an MGF file; names may hold blanks and signs."""
    lines = [f"{100 + i * 0.5:.1f} {i % 9 + 1}" + ("\r" if i % 3 else "") for i in range(40_000)]
    mgf = "".join(f"BEGIN IONS\nTITLE={k}\n" + "\n".join(lines[k * 100 : k * 100 + 100]) + "\nEND IONS\n" for k in range(400))
    paths = [str(tmp_path / n) for n in ("a b+c%41.txt", "m.mgf")]
    for path, text in zip(paths, ("\n".join(lines), mgf), strict=True):
        with open(path, "w", newline="") as f:
            f.write(text)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "30000")
        assert spark.read.text(paths[:1]).rdd.getNumPartitions() > 8
        got = read_queries(spark, paths).orderBy("query_id", "ord").collect()
        split = read_queries(spark, paths[1:], split_mgf=True).collect()
    finally:
        spark.conf.set(key, before)
    want = [100_000 + 500 * i for i in range(40_000)]
    for q, name in enumerate(("a b+c%41.txt", "m.mgf")):
        own = [r for r in got if r.query_id == q]
        assert [r.milli_mz for r in own] == want and [r.ord for r in own] == list(range(40_000)) and {r.query_file for r in own} == {name}
    assert sorted((r.query_id, r.ord, r.milli_mz) for r in split) == [(1 + i // 100, i % 100, m) for i, m in enumerate(want)]
    (tmp_path / "none.txt").write_text("# nothing\n")
    with pytest.raises(Exception, match="no peaks in none.txt"):
        read_queries(spark, [str(tmp_path / "none.txt")]).collect()


def test_folder_run_with_progress_and_cancel(spark, tmp_path):
    """A run is stopped midway: finished batches stay; the next one goes on and ends with what one run gives."""
    folder = tmp_path / "in"
    folder.mkdir()
    library = spark.createDataFrame([(g, 1000 * g + 100 * k) for g in range(1, 30) for k in range(5)], "genome_id long, milli_mz long")
    for i in range(1, 9):
        (folder / f"q{i}.txt").write_text(f"{i}.0 1\n{i}.1 2\n" if i != 5 else "# empty\n")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    seen, again = [], []
    whole = identify_folder(spark, str(folder), library, out, mark, every=2, on_progress=lambda *x: seen.append(x), cancelled=lambda: len(seen) > 2)
    assert not whole and seen[:3] == [(0, 8), (2, 8), (4, 8)]
    kept = spark.read.parquet(f"{out}/files").where("batch < 2").count()
    assert kept == 4
    assert identify_folder(spark, str(folder), library, out, mark, every=2, on_progress=lambda *x: again.append(x))
    assert again[0][0] >= 4 and again[-1] == (8, 8) and again == sorted(again)
    columns = ["query_file", "genome_id", "score", "matched_ribosomal", "matched_total", "rank"]
    assert identify_folder(spark, str(folder), library, str(tmp_path / "one"), str(tmp_path / "mark1"), every=100)
    rows = lambda path: sorted(tuple(r) for r in spark.read.parquet(f"{path}/results").select(columns).collect())
    assert rows(out) == rows(tmp_path / "one") and len({r[0] for r in rows(out)}) == 7
    assert {r.query_file: r.peaks for r in spark.read.parquet(f"{out}/files").collect()} == {f"q{i}.txt": 0 if i == 5 else 2 for i in range(1, 9)}
    # a batch that is given again replaces itself
    shutil.rmtree(tmp_path / "mark")
    assert identify_folder(spark, str(folder), library, out, mark, every=2)
    assert rows(out) == rows(tmp_path / "one")


def test_shuffled_streams_give_the_batch_rows(spark, tmp_path):
    """Events that come late and out of order, over several batches, fold as the batch queries fold them."""
    rnd = random.Random(4)
    t = dt.datetime(2024, 1, 1)
    rows = []
    for run in range(1, 5):
        at, stages = 0.0, ["start", *["genome"] * 40, "indexStart", *["genome"] * 3, "metaStart", "finalizeStart", "done"]
        for i, stage in enumerate(stages):
            at += rnd.choice([0.0, 5.0, 30.0, 61.0])
            rows.append((run, i, t + dt.timedelta(seconds=at), stage, i * 10, i * 100))
    schema = "run_id long, seq long, ts timestamp, stage string, genomes long, peaks long"
    events = spark.createDataFrame(rows, schema)
    # up to five minutes late, in files that are read one by one; last of all, one event far ahead lets all others out
    shuffled = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rnd.uniform(0, 290)))
    for k in range(0, len(shuffled), 30):
        spark.createDataFrame(shuffled[k : k + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in order of their times
    spark.createDataFrame([(99, 0, t + dt.timedelta(days=1), "start", 0, 0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    came = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, stream, batch in (
        ("late_throttled", P.throttle_late_stream(came(), 60_000_000, "5 minutes"), P.throttle(events, 60_000_000).select("run_id", "seq", "stage")),
        ("late_reduced", P.reduce_stream(came(), "5 minutes"), P.reduce_status(events)),
    ):
        query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        got = sorted(tuple(r) for r in spark.table(name).where("run_id < 99").collect())
        assert got == sorted(tuple(r) for r in batch.collect()), name
        assert len([p for p in query.recentProgress if p["numInputRows"]]) > 4


def test_coverage_without_a_join(spark):
    from lumispec.operators import validate as V

    peaks = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 2), (2, 0), (None, 0)], "genome_id long, local_peak_idx long")
    postings = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (3, 0), (3, 0), (None, 0), (None, 0)], "genome_id long, local_peak_idx long")
    found = V.coverage(postings, peaks)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.first().violations == 7  # two postings, two peaks without, one without a peak, a peak, nulls on both sides
    assert V.coverage(postings.limit(0), peaks.limit(0)).first().violations == 0


def test_places_are_checked_from_one_shuffle(spark):
    from lumispec.operators import validate as V

    peaks = spark.createDataFrame([(1, 0, 100), (1, 1, 250), (1, 1, 990), (2, 0, None), (None, 0, 5), (3, 0, 300)], "genome_id long, local_peak_idx long, milli_mz long")
    postings = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (9, 1, 1), (0, 2, 0), (0, None, 0), (4, 3, 0), (None, 3, 0), (7, 8, 0)], "bin_id long, genome_id long, local_peak_idx long")
    got = V.places(postings, peaks, 100)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    one = {r.rule: r.violations for r in V.bin_consistency(postings, peaks, 100).union(V.coverage(postings, peaks)).collect()}
    assert {r.rule: r.violations for r in got.collect()} == one and all(one.values())
    assert {r.rule: r.violations for r in V.places(postings.limit(0), peaks.limit(0), 100).collect()} == {"bin_consistency": 0, "coverage": 0}
