import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispec.functions import encode as E
from lumispec.functions.peaks import parse_peak_line
from lumispec.operators import progress as P
from lumispec.operators import search as S

SF = "/root/testdata/sf0.001"
LIBRARY = [(0, 1000000), (0, 1200000), (1, 1001000), (1, 1400000)]


def frames(spark, library, queries):
    return spark.createDataFrame(library, "genome_id long, milli_mz long"), spark.createDataFrame(queries, "query_id long, ord long, milli_mz long, intensity float")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def model(library, queries, limit=8, ppm=50, width=100):
    """The semantics step by step, as plain loops."""
    out = []
    f32 = np.float32
    genomes = sorted({g for g, _ in library})
    for query in sorted({q[0] for q in queries}):
        own = sorted(q[1:] for q in queries if q[0] == query)
        hits = {g: sum(m // width == p // width for _, m, _ in own for x, p in library if x == g) for g in genomes}
        ranked = sorted(((n, g) for g, n in hits.items() if n), key=lambda x: (-x[0], x[1]))[:limit]
        results = []
        for n, g in ranked:
            score, matched = f32(0), 0
            for _, m, intensity in own:
                if ppm <= 0 or m <= 0:
                    continue
                ds = [abs(m - p) * 1000000 // m for x, p in library if x == g and p >= m - m * ppm // 1000000]
                ds = [d for d in ds if d <= ppm]
                if ds:
                    matched += 1
                    score = f32(score + f32(f32(intensity) * f32(f32(1) - f32(f32(min(ds)) / f32(ppm)))))
            results.append((g, float(score), n, matched))
        results.sort(key=lambda r: (-r[1], -r[3], r[0]))
        out += [(query, *r, i + 1) for i, r in enumerate(results)]
    return sorted(out)


def test_golden(spark):
    queries = [(0, 0, 1000000, 0.5), (0, 1, 1200000, 0.3), (0, 2, 1001000, 0.2), (1, 0, 1001000, 0.6), (1, 1, 1400000, 0.4)]
    lib, q = frames(spark, LIBRARY, queries)
    assert rows(S.coarse_hits(lib, q)) == [(0, 0, 2), (0, 1, 1), (1, 1, 2)]
    got = rows(S.identify(lib, q))
    assert [(r[0], r[1], round(r[2], 6), *r[3:]) for r in got] == [(0, 0, 0.8, 2, 2, 1), (0, 1, 0.2, 1, 1, 2), (1, 1, 1.0, 2, 2, 1)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("limit", "ppm", "width"), [(8, 50, 100), (2, 500, 50), (3, 0, 1000)])
def test_against_the_model(spark, seed, limit, ppm, width):
    rnd = random.Random(seed)
    base = [rnd.randrange(0, 3_000_000) for _ in range(30)]
    near = lambda: max(0, rnd.choice(base) + rnd.choice([0, 0, 1, -1, 20, -40, 99, 150]))
    library = [(g, near()) for g in range(6) for _ in range(rnd.randrange(1, 20))]
    queries = [(q, i, near() if rnd.random() > 0.05 else 0, rnd.random()) for q in range(5) for i in range(rnd.randrange(1, 15))]
    queries = [(a, b, c, float(np.float32(d))) for a, b, c, d in queries]
    lib, q = frames(spark, library, queries)
    assert rows(S.identify(lib, q, limit, ppm, width)) == model(library, queries, limit, ppm, width)


def test_edges(spark):
    lib, q = frames(spark, [(3, 1000), (1, 1000), (2, 1099)], [(0, 0, 1000, 1.0), (0, 1, 1000, 1.0)])
    hits = S.coarse_hits(lib, q)
    assert rows(hits) == [(0, 1, 2), (0, 2, 2), (0, 3, 2)]  # repeated query peaks count again
    assert rows(S.top_per_query(hits, 1)) == [(0, 1, 2)]  # ties go to the smaller id
    assert S.top_per_query(hits, 0).count() == 0
    got = rows(S.identify(lib, q))
    assert (0, 2, 0.0, 2, 0, 3) in got  # no ppm match: it stays, with score 0
    assert S.identify(lib.limit(0), q).count() == 0
    assert S.identify(lib, q.limit(0)).count() == 0


def test_window_edges(spark):
    q = 1_234_567
    low, high = q - q * 50 // 10**6, q + (q * 51 - 1) // 10**6
    lib, queries = frames(spark, [(0, low), (1, high), (2, high + 1), (3, low - 1)], [(0, 0, q, 1.0)])
    cand = spark.createDataFrame([(0, g, 1) for g in range(4)], "query_id long, genome_id long, hit_count long")
    assert {r.genome_id: r.matched_total for r in S.rerank(cand, lib, queries).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}


@pytest.mark.parametrize(
    ("line", "peak"),
    [
        ("1000.0 0.5", (1000.0, 0.5)), ("1000", (1000.0, 1.0)), ("  1200,7.5 x", (1200.0, 7.5)), ("", None), ("# x", None), ("COM=demo", None), ("BEGIN IONS", None), ("PEPMASS=1000.0", None),
        ("1000 abc", None), ("1000d", None), ("1e3\t.5", (1000.0, 0.5)), ("1000 2", (1000.0, 2.0)), (",,5,,6,,", (5.0, 6.0)), ("inf", (float("inf"), 1.0)), ("+5 -1", (5.0, -1.0)), (".", None), ("5. 1", (5.0, 1.0)), (None, None),
    ],
)
def test_peak_lines(spark, line, peak):
    got = spark.createDataFrame([(line,)], "line string").select(parse_peak_line("line").alias("p")).first().p
    assert (tuple(got) if got else None) == peak


def test_encoding(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.0005, 1.0004, 1.0005, 4294967.295)], "mz double")
    assert [r[0] for r in df.select(E.encode_mz("mz")).collect()] == [0, 1, 1000, 1001, 4294967295]
    for bad in (-1.0, float("nan"), float("inf"), 4294967.296):
        one = spark.createDataFrame([(bad,)], "mz double")
        assert one.select(E.encode_mz("mz", strict=False)).first()[0] is None
        with pytest.raises(Exception, match="out of range"):
            one.select(E.encode_mz("mz")).collect()
    x = spark.createDataFrame([(1e39,), (-1.0,), (2.5,)], "x double").select(E.encode_intensity("x", strict=False)).collect()
    assert [r[0] for r in x] == [None, None, 2.5]
    with pytest.raises(ValueError):
        E.bin_id("mz", 0)


def test_text_functions(spark):
    df = spark.createDataFrame([('a,"b"\nc', "/x/y z.db"), ("plain\r", "q.mgf")], "a string, b string")
    got = df.select(E.csv_escape("a"), E.basename("b"), E.sanitize_filename("b")).collect()
    assert [tuple(r) for r in got] == [('"a,""b""\nc"', "y z.db", "_x_y_z.db"), ("plain\r", "q.mgf", "q.mgf")]
    kind = spark.createDataFrame([("Failed to open x",), ("CRC mismatch",), ("?",)], "m string").select(E.classify_error("m", E.DATABASE_ERRORS)).collect()
    assert [r[0] for r in kind] == ["unreadable", "format", "other"]
    shown = spark.createDataFrame([(1.235, 1234567, 2_320_000)], "s double, n long, us long").select(E.score_text("s"), E.count_text("n"), E.seconds_text("us")).first()
    assert tuple(shown) in (("1.24", "1,234,567", "2.32 s"), ("1.23", "1,234,567", "2.32 s"))
    d = spark.createDataFrame([(0, 5)], "q long, p long").select(E.ppm_distance("q", "p")).first()[0]
    assert d is None
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_rerank_drops_unknown_genomes(spark):
    library = spark.createDataFrame([(1, 100_000), (2, 200_000)], "genome_id long, milli_mz long")
    queries = spark.createDataFrame([(9, 0, 100_000, 1.0)], "query_id long, ord long, milli_mz long, intensity float")
    asked = spark.createDataFrame([(9, 1, 1), (9, 2, 1), (9, 7, 5)], "query_id long, genome_id long, hit_count long")
    assert {(r.genome_id, r.score) for r in S.rerank(asked, library, queries).collect()} == {(1, 1.0), (2, 0.0)}


def test_throttle_keeps_null_stages(spark):
    rows = [(1, 0, "2024-01-01 00:00:00", None), (1, 1, "2024-01-01 00:00:01", "genome"), (1, 2, "2024-01-01 00:00:02", "genome")]
    events = spark.createDataFrame(rows, "run_id long, seq long, ts string, stage string")
    assert sorted(r.seq for r in P.throttle(events, 10_000_000).collect()) == [0, 1]


def test_pairs_arise_in_blocks(spark):
    # many genomes that hold all of a query's bins: hits are pairs of all, of which none is shuffled
    library = spark.range(400).selectExpr("id div 4 AS genome_id", "1000000 + id % 4 * 5000 AS milli_mz")
    queries = spark.range(200).selectExpr("id div 4 AS query_id", "id % 4 AS ord", "1000010 + id % 4 * 5000 AS milli_mz", "CAST(0.5 AS FLOAT) AS intensity")
    hits = S.coarse_hits(library, queries)
    plan = hits._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Join Inner, (bin_id" not in plan and "Aggregate" not in plan
    assert hits.count() == 100 * 50 and hits.where("hit_count = 4").count() == 5000
    ranked = S.identify(library, queries, None)
    assert "Window" not in ranked._jdf.queryExecution().toString()
    assert {(r.genome_id, r["rank"]) for r in ranked.where("query_id = 7").collect()} == {(g, g + 1) for g in range(100)}
    best = S.coarse_sweep(library, queries, [50, 100], 3)
    assert {(r.bin_width, r.genome_id) for r in best.where("query_id = 7").collect()} == {(w, g) for w in (50, 100) for g in range(3)}


@pytest.mark.parametrize("limit", [2, None])
def test_small_blocks_and_chunks_against_the_model(spark, monkeypatch, limit):
    from lumispec.operators import blocks as B

    monkeypatch.setattr(B, "CHUNK", 4)
    monkeypatch.setattr(B, "HITS", 3)
    blocks = B.blocks
    monkeypatch.setattr(B, "blocks", lambda queries, asked=None, size=5: blocks(queries, asked, 5))
    rnd = random.Random(9)
    library = [(g, 100_000 + rnd.randrange(60) * 10) for g in range(40) for _ in range(rnd.randrange(1, 12))]
    queries = [(q, i, 100_000 + rnd.randrange(60) * 10, float(np.float32(rnd.random()))) for q in range(12) for i in range(rnd.randrange(1, 9))]
    lib, q = frames(spark, library, queries)
    want = model(library, queries, limit or 1000, 500, 100)
    assert rows(S.identify(lib, q, limit, 500, 100)) == want
    asked = spark.createDataFrame([(r[0], r[1], r[3]) for r in want], "query_id long, genome_id long, hit_count long")
    assert rows(S.rerank(asked, lib, q, 500)) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_are_dealt_once(spark):
    from lumispec.operators import blocks as B
    from lumispec.plans import adapter as A

    plan = A.queries(spark, SF).repartition("query_id").where("milli_mz is not null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    packed = B.chunks(A.library(spark, SF))
    assert packed.inputFiles() and all(name.endswith(".zstd.parquet") for name in packed.inputFiles())


def test_lines_are_numbered_without_a_shuffle(spark, tmp_path):
    from lumispec.sources.spectra import numbered_lines, text_lines

    path = str(tmp_path / "text")
    spark.range(5000).selectExpr("concat('line ', id) AS value").repartitionByRange(3, "value").sortWithinPartitions("value").write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # several splits a file
    try:
        got = numbered_lines(text_lines(spark.read.option("lineSep", "\n").text(path)))
        lines = {r.line_no: r.line for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [lines[i] for i in range(5000)] == sorted(f"line {i}" for i in range(5000))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_known_candidates_pack_the_library_once(spark, monkeypatch):
    from lumispec.operators import blocks as B
    from lumispec.plans import queries as Q

    calls, chunks = [], B.chunks
    monkeypatch.setattr(B, "chunks", lambda library: calls.append(1) or chunks(library))
    found = Q.known_candidates(spark, SF)
    assert len(calls) == 1
    assert rows(found) == rows(Q.identify_flagship(spark, SF).select("query_id", "genome_id"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_files_are_parsed_once(spark):
    from lumispec.plans import queries as Q

    plan = Q.identify_query_files(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "o_totalprice" not in plan  # the texts were packed already
