"""The registered queries against what they promise: columns, types, folds, and what follows from other columns; and columns of any names."""

import hashlib
import os
import threading
import zlib
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lumispec.llm import _util as U
from lumispec.llm import language_cnn, quality, registry, shingle_join, toxicity

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CONTRACTS = {
    "op1_maxent_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_span_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_simhash": "doc_id bigint, fingerprint string, component_id bigint",
}
HELD_OUT = {"op1_maxent_score": 1, "op2_quality": 0, "op7_toxicity": 0, "op10_language": 0}


@tables
@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, name):
    out = registry.QUERIES[name](spark, SF)
    kinds = dict(out.dtypes)
    for column in CONTRACTS[name].split(", "):
        c, kind = column.split()
        assert kinds[c] == kind, column
    rows = out.collect()
    if name == "op11_prefix_trie":
        return
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name in HELD_OUT:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == HELD_OUT[name]) for r in rows)
    if "score" in kinds and name != "op1_maxent_score":
        assert all(0 <= r.score <= 1 for r in rows)
    if "predicted" in kinds:
        assert all(r.predicted == (r.score >= (0.3 if name == "op2_quality" else 0.5)) for r in rows)
    if name == "op1_maxent_score":
        assert all(r.n_tokens == len(texts[r.doc_id].encode().split()) + 1 and r.n_known <= r.n_tokens for r in rows)
        assert {r.train_tokens for r in rows} == {sum(r.n_tokens for r in rows if not r.held_out)}
    if name == "op3_span_fingerprints":
        ids = sorted(texts)
        after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
        for r in rows:
            text, other = texts[r.doc_id], texts[after[r.doc_id]]
            part = other[: len(text) // 2]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - len(text) // 2] + part).encode()).hexdigest()
    if name == "op9_token_files":
        ordered = sorted(rows, key=lambda r: r.doc_id)
        assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False)) and ordered[0].start == 0
    if name == "op10_language":
        assert {r.lang_pred for r in rows} <= {r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | {"und"}


ODD = ["x.y", "a`b", "lang pred", "score", "é.x"]


def odd(spark):
    rows = [(i, " ".join(f"w{(i * k) % 31}" for k in range(40)), i, str(i), None, 0.5, "z") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, c0 long, c1 string, c2 string, score double, c4 string").toDF("doc_id", "text", *ODD)


def test_columns_of_any_names(spark, tmp_path):
    docs = odd(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    assert quality.score_documents(docs, model).columns == [c for c in docs.columns if c != "score"] + ["score"]
    kept = quality.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    chain = toxicity.fit(docs.select("doc_id", "text"), labels)
    assert toxicity.score_documents(docs, chain).where(F.col("`x.y`") == 7).first()["a`b"] == "7"
    known = docs.select("doc_id", "text", F.lit("en").alias("lang"))
    assert language_cnn.identify(docs, language_cnn.fit(known)).where(F.col("`é.x`") == "z").count() == 60
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"w{(7 * k) % 31}" for k in range(40)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", *ODD], name
        docs.collect()


def test_leaks_without_doc_id_go(spark, tmp_path):
    item = " ".join(f"term{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "before " + item + " after"), (None, "clean words only"), (5, item), (5, "other words of the same id"), (6, None), (7, "")]
    out = corpus_pipeline.drop_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([rows[1], *rows[3:]], "doc_id long, text string").collect()))


@tables
def test_each_query_leaves_its_result_alone(spark):
    """Two queries at once: neither deletes what the other reads, and each leaves one table."""
    folder = Path(U.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.glob("lumispec-*")}
    counts = {}
    names = ["op5_shingle_join", "op12_simhash"]
    threads = [threading.Thread(target=lambda n=n: counts.__setitem__(n, registry.QUERIES[n](spark, SF).count())) for n in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert counts == {"op5_shingle_join": 200, "op12_simhash": 200}
    left = [p for p in folder.glob("lumispec-*") if p.name not in before]
    assert len(left) == 2
    assert shingle_join.link_documents(spark.read.parquet(f"{SF}/documents.parquet")).count() == 200
