"""The jobs over copies of small tables: reruns, growing input, faults, command lines."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import identify_run, text_intake
from lumispec.functions.peaks import parse_peak_line
from lumispec.plans import adapter as A

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ORDERS = "o_orderkey long, o_totalprice double, o_orderpriority string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def config(job) -> dict:
    return json.loads(job.CONFIG.read_text())


def add(spark, tables, name, docs=(), orders=()):
    """One more file of each table; a folder is made of files under their final names."""
    for table, data, schema in (("documents", docs, "doc_id long, text string"), ("orders", orders, ORDERS)):
        if not (folder := tables / f"{table}.parquet").exists() or data:
            folder.mkdir(parents=True, exist_ok=True)
            part = tables / f"tmp-{name}-{table}"
            spark.createDataFrame(list(data), schema).coalesce(1).write.parquet(str(part))
            shutil.move(str(next(part.glob("part-*"))), str(folder / f"part-{name}.parquet"))
            shutil.rmtree(part)


def test_intake_of_growing_input(spark, tmp_path):
    tables, out, mark = tmp_path / "t", str(tmp_path / "out"), str(tmp_path / "mark")
    add(spark, tables, "a", [(1, "100.5 2\r\n# c\n\nCOM=x y\nwords here\n7 x\n8,9 z"), (2, None), (3, ""), (3, "")], [(8, 12.9, "3-LOW"), (10, 5.0, "1-URGENT")])
    first = text_intake.run(spark, str(tables), out, mark, config(text_intake))
    assert [b["wrote"] for b in first] == [{"peak": 3, "blank": 4, "comment": 2, "title": 1, "no_mz": 1, "no_intensity": 1, "out_of_range": 0}]
    kinds = {(r.source, r.id, r.line_no): (r.kind, r.milli_mz, r.intensity) for r in text_intake.read(spark, out).where("id != 3").collect()}
    assert kinds == {
        ("documents", 1, 0): ("peak", 100500, 2.0), ("documents", 1, 1): ("comment", None, None), ("documents", 1, 2): ("blank", None, None), ("documents", 1, 3): ("title", None, None),
        ("documents", 1, 4): ("no_mz", None, None), ("documents", 1, 5): ("no_intensity", None, None), ("documents", 1, 6): ("peak", 8000, 9.0), ("documents", 2, 0): ("blank", None, None),
        ("orders", 8, 0): ("peak", 12250, 3.0), ("orders", 10, 0): ("comment", None, None),
    }
    before = rows(text_intake.read(spark, out))
    assert text_intake.run(spark, str(tables), out, mark, config(text_intake)) == [] and rows(text_intake.read(spark, out)) == before
    add(spark, tables, "b", [(4, "-1 2\n9e9\ninf 1\n5 -1\n5 1e39\n" + "9 " * 200_000)])
    add(spark, tables, "c", [(5, "6")], [(12, 3.0, "2-HIGH")])
    more = text_intake.run(spark, str(tables), out, mark, config(text_intake) | {"max_files_per_trigger": 1})
    assert len(more) == 2 and sum(b["wrote"]["out_of_range"] for b in more) == 5 and sum(b["wrote"]["peak"] for b in more) == 3
    whole = text_intake.read(spark, out)
    assert whole.where("id = 4 and kind = 'peak'").first().milli_mz == 9000
    # what the batch plan makes of everything at once
    files = text_intake.texts(spark.read.parquet(str(tables / "documents.parquet")), spark.read.parquet(str(tables / "orders.parquet")))
    assert rows(whole) == rows(text_intake.classified_files(files).select(whole.columns))
    lines = files.select("source", "id", F.explode(F.split(F.coalesce("content", F.lit("")), "\r?\n")).alias("line"))
    assert whole.count() == lines.count()  # peaks and faults together are all lines
    peaks = lines.select(parse_peak_line("line").alias("p")).where("p is not null").count()
    assert whole.where("kind in ('peak', 'out_of_range')").count() == peaks
    folders = {p.name for p in Path(out).iterdir() if p.is_dir()}
    assert {"source=documents", "source=orders"} <= folders


def test_intake_goes_on_after_a_failure(spark, tmp_path):
    """A batch with a broken file fails as a whole; once the file is mended, each line is there once."""
    tables, out, mark = tmp_path / "t", str(tmp_path / "out"), str(tmp_path / "mark")
    add(spark, tables, "a", [(1, "1 2")], [(8, 12.9, "3-LOW")])
    text_intake.run(spark, str(tables), out, mark, config(text_intake))
    add(spark, tables, "b", [(2, "3 4\nx")])
    add(spark, tables, "c", [(3, "5 6")])
    broken = tables / "documents.parquet" / "part-c.parquet"
    good, at = broken.read_bytes(), broken.stat()
    broken.write_bytes(good[: len(good) // 2])
    (tables / "documents.parquet" / ".part-c.parquet.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):  # noqa: B017
        text_intake.run(spark, str(tables), out, mark, config(text_intake))
    assert text_intake.read(spark, out).count() == 2
    broken.write_bytes(good)
    os.utime(broken, ns=(at.st_atime_ns, at.st_mtime_ns))
    text_intake.run(spark, str(tables), out, mark, config(text_intake))
    assert rows(text_intake.read(spark, out).select("source", "id", "line_no", "kind")) == [("documents", 1, 0, "peak"), ("documents", 2, 0, "peak"), ("documents", 2, 1, "no_mz"), ("documents", 3, 0, "peak"), ("orders", 8, 0, "peak")]


def test_identification_runs_again(spark, tmp_path):
    tables, out = tmp_path / "t", str(tmp_path / "out")
    shutil.copytree(SF, tables)
    made = identify_run.run(spark, str(tables), out, config(identify_run))
    once = rows(identify_run.read_results(spark, out))
    assert made["wrote"]["results"] == len(once) == 88 and made["read"]["query_peaks"] == spark.read.parquet(f"{SF}/orders.parquet").count()
    asked = A.queries(spark, str(tables)).select("query_id").distinct().count()
    assert made["wrote"]["unmatched"] + len({r[0] for r in once}) == asked
    report = [json.loads(r.value) for r in spark.read.text(f"{out}/report").collect()]
    assert sum(r["results"] for r in report) == 88 and {r["domain"] for r in report} == {r[-1] for r in once}
    assert identify_run.run(spark, str(tables), out, config(identify_run)) == made
    assert rows(identify_run.read_results(spark, out)) == once
    # results of domains that are gone go with them
    shutil.copytree(tables, tmp_path / "fewer")
    shutil.rmtree(tmp_path / "fewer" / "region.parquet", ignore_errors=True)
    (tmp_path / "fewer" / "region.parquet").unlink(missing_ok=True)
    spark.read.parquet(f"{SF}/region.parquet").where("r_regionkey = 0").write.parquet(str(tmp_path / "fewer" / "region.parquet"))
    identify_run.run(spark, str(tmp_path / "fewer"), out, config(identify_run) | {"top": 1})
    fewer = identify_run.read_results(spark, out)
    assert {r.domain for r in fewer.select("domain").distinct().collect()} < {r[-1] for r in once}
    assert fewer.where("rank > 1").count() == 0 and fewer.count() == len({r[0] for r in once})


def test_a_broken_library_identifies_nothing(spark, tmp_path, monkeypatch):
    bad = spark.createDataFrame([("coverage", 3), ("crc_peaks", 0)], "rule string, violations long")
    monkeypatch.setattr(identify_run.V, "validate", lambda library: bad)
    with pytest.raises(ValueError, match="coverage"):
        identify_run.run(spark, SF, str(tmp_path / "out"), config(identify_run))
    assert not (tmp_path / "out" / "results").exists()


@pytest.mark.parametrize("job", ["text_intake", "identify_run"])
def test_command_line(tmp_path, job):
    own = tmp_path / "config.json"
    own.write_text(json.dumps(json.loads((ROOT / "jobs" / f"{job}.json").read_text())))
    more = ["--checkpoint", str(tmp_path / "mark")] if job == "text_intake" else []
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--tables", SF, "--out", str(tmp_path / "out"), "--config", str(own), *more], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read {" in done.stderr and "wrote {" in done.stderr and any((tmp_path / "out").rglob("*.parquet"))


def test_jobs_need_no_text_operators():
    assert not any("lumispec.llm" in p.read_text() or "corpus_pipeline" in p.read_text() for p in (ROOT / "jobs").glob("*.py"))
