import random

import corpus_pipeline as C

from lumispec.llm import substring_dedup


def test_stages(spark, tmp_path):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage, item = words(60), words(30)
    docs, labels = [], []
    for i in range(300):
        text, good = words(rnd.randrange(60, 150)), i % 5 != 4
        if not good:
            text = [w + "%%%" for w in text]
        docs.append([i, text])
        labels.append((i, int(good)))
    docs += [[400, docs[10][1]], [401, docs[11][1][:-1] + ["new"]], [402, words(50) + passage], [403, passage + words(50)], [404, words(40) + item + words(40)], [405, list(passage)]]
    rows = [(i, " ".join(t), "en", "s", len(" ".join(t)), 1.5) for i, t in docs] + [(406, None, None, None, None, None), (407, "", "en", "s", 0, None)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    at = {}
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES:
        before = frame.columns
        frame = stage(spark, frame, sf)
        frame.write.parquet(f"{sf}/out/{name}")
        frame = spark.read.parquet(f"{sf}/out/{name}")
        assert name == "packing" or frame.columns == before
        at[name] = {r.doc_id: r for r in frame.collect()}
    good = {i for i in range(300) if i % 5 != 4}
    assert good | {400, 401, 402, 403, 404, 405} <= set(at["quality"]) and not {i for i in range(300) if i % 5 == 4} & set(at["quality"])
    assert set(at["quality"]) - set(at["near_duplicates"]) == {400, 401}
    cut = at["repeated_passages"]
    assert set(at["near_duplicates"]) - set(cut) == {405}  # nothing is left of it
    assert cut[402].text == dict(docs).get(402) or cut[402].text == " ".join(docs[302][1])
    assert len(cut[403].text.split()) == 50 and cut[403].n_chars == len(cut[403].text)
    assert set(cut) - set(at["benchmark_leaks"]) == {404}
    assert set(at["packing"]) == set(at["benchmark_leaks"])
    assert C.run(spark, sf).count() == len(at["packing"])


def test_stages_on_nothing(spark, tmp_path):
    sf = str(tmp_path)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert C.run(spark, sf).count() == 0
    assert substring_dedup.without_repeats(spark.createDataFrame([(1, " a  b ")], "doc_id long, text string")).first() == (1, " a  b ")


def test_near_duplicates_by_brute_force(spark):
    """Five words and 0.8: shortened, extended and edited copies on both sides of the threshold, many of them between 0.80 and 0.85."""
    rnd = random.Random(5)
    texts = []
    for i in range(24):
        text = [f"w{i}x{rnd.randrange(10**6)}" for _ in range(100)]
        edited = list(text)
        for at in (30, 60)[: 1 + i % 2]:
            edited[at] = "new"
        texts += [text, text[: 78 + i % 12], text + [f"more{i}y{k}" for k in range(18 + i % 12)], edited]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    near = lambda a, b: len(a & b) / len(a | b)
    alike = {(i, j): near(sets[i], sets[j]) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j]}
    assert sum(0.80 <= x < 0.85 for x in alike.values()) > 20 and sum(0.75 < x < 0.80 for x in alike.values()) > 5
    least = list(range(len(texts)))
    for _ in texts:
        for (i, j), x in alike.items():
            if x >= 0.8:
                least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in C.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {i for i, x in enumerate(least) if i == x}
