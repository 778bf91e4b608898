"""Each query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query(spark, name, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(f"CREATE TABLE want AS {entry.oracle_sql()[name]}")
    entry.queries()[name](spark, SF).write.parquet(str(tmp_path / "got"))
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    kinds = lambda t: sorted((r[0], r[1]) for r in con.execute(f"DESCRIBE {t}").fetchall())
    assert kinds("got") == kinds("want")
    columns = ", ".join(f'"{c}"' for c, _ in kinds("want"))
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchone()[0] == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 88


def test_peak_lines_beyond_the_first(spark, tmp_path):
    spark.createDataFrame([(1, "noise\n100.5 2\n# no\n300 1"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "o_orderkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = entry.queries()["parse_peak_lines"](spark, str(tmp_path)).collect()
    assert sorted((r.src, r.id, r.mz) for r in got) == [("documents", 1, 100.5), ("documents", 1, 300.0)]
