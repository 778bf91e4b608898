"""Operators that learn, on small made-up corpora: held-out results, odd rows, and exact parts against plain loops."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispec.llm import decontaminate, language_cnn, linear, maxent, quality, toxicity
from lumispec.llm import _util as U

WORDS = {"en": "the of and thing is water other with house that over under", "de": "der die und nicht haus über schön straße auch wasser", "fr": "le la et été où garçon maison être eau près"}
ODD = [None, "", " \n", "!!! 123 %%", "x " * 40_000]


def prose(rnd, lang, n):
    own = WORDS[lang].split()
    return " ".join(rnd.choice(own) + (rnd.choice(own) if rnd.random() < 0.3 else "") for _ in range(n))


def table(spark, rows, columns):
    return spark.createDataFrame(rows, columns).repartition(3)


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of two kinds of quality; toxic ones hold words of a list."""
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(500):
        text = prose(rnd, "en", rnd.randrange(20, 120)).split()
        good, toxic = rnd.random() < 0.7, rnd.random() < 0.25
        if not good:
            text = [w + rnd.choice(["%%%", "&&&"]) for w in text] if rnd.random() < 0.5 else [x for w in text[:30] for x in [w] * 5]
        if toxic:
            for _ in range(rnd.randrange(2, 6)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["vilebeast", "scumbagish", "dirtface"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "the house")]
    labels += [(7, None, None), (None, 1, 1), (3, labels[3][1], labels[3][2]), (9999, 1, 0)]
    return table(spark, docs, "doc_id long, text string"), table(spark, labels, "doc_id long, quality int, toxic int")


def accuracy(rows, labels, name, score, cut):
    truth = {r.doc_id: r[name] for r in labels.collect() if r[name] is not None and r.doc_id is not None}
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    return sum((r[score] >= cut) == bool(truth[r.doc_id]) for r in held) / len(held)


def test_quality(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels.where(U.remainder5(F.col("doc_id")) != 0))
    out = quality.score_documents(docs.withColumn("score", F.lit("old")), model)
    assert out.columns == ["doc_id", "text", "score"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, labels, "quality", "score", 0.3) > 0.95
    assert quality.score_documents(docs.limit(0), model).count() == 0
    kept = quality.keep_good(docs.withColumn("score", F.lit("old")).withColumn("score_in", F.lit(2)), model, 0.3)
    assert kept.columns == ["doc_id", "text", "score", "score_in"] and kept.count() == sum(r.score >= 0.3 for r in rows)
    again = docs.union(docs.where("doc_id = 3")).union(docs.where("doc_id = 3").withColumn("text", F.lit("zzz")))  # one id, several rows
    assert quality.bounded_sample(again, labels, "quality", 400).count() == quality.bounded_sample(docs, labels, "quality", 400).count() <= 400
    one = quality.fit(docs, labels.where("quality = 1"))  # one class alone
    assert {r.score for r in quality.score_documents(docs, one).collect()} == {1.0}
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}


def test_toxicity(spark, labelled):
    docs, labels = labelled
    chain = toxicity.fit(docs, labels.where(U.remainder5(F.col("doc_id")) != 0))
    assert chain.names == ["severe_toxic", "toxic"]
    rows = toxicity.score_documents(docs, chain).collect()
    assert len(rows) == docs.count() and all(0 <= r.p_toxic <= 1 and 0 <= r.p_severe_toxic <= 1 for r in rows)
    assert accuracy(rows, labels, "toxic", "p_toxic", 0.5) > 0.95
    assert all(r.p_toxic < 0.5 for r in rows if r.doc_id in (1000, 1001, 1002, 1003, 1004))
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.p_toxic for r in toxicity.score_documents(docs, empty).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), chain).count() == 0


def test_chain_uses_earlier_categories():
    rnd = np.random.default_rng(0)
    rows = [np.array(sorted({int(x) for x in rnd.integers(0, 30, 4)})) for _ in range(400)]
    first = np.array([int(3 in r or 4 in r) for r in rows])
    chain = toxicity.Chain(rows, {"a": first, "b": first.copy()})
    assert chain.links[1].more[0] > 0
    doc, ids = np.repeat(np.arange(400), [len(r) for r in rows]), np.concatenate(rows)
    ids = np.searchsorted(chain.kept, ids) * np.isin(ids, chain.kept) - 1 * ~np.isin(ids, chain.kept)
    doc, ids = doc[ids >= 0], ids[ids >= 0]
    assert ((chain.score(doc, ids, 400)[:, 1] > 0.5) == first).mean() > 0.95


def test_linear():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ [1, -2, 0, 0, 3] + 0.3 > 0, 1.0, -1.0)
    rows = linear.Sparse([np.arange(6)] * 200, [np.append(v, 1.0) for v in x])
    w = linear.hinge_dual(rows, y, 6, np.full(200, 1.0), passes=3000)
    assert (np.sign(rows.dot(w)) == y).mean() > 0.96
    primal = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * rows.dot(w)).sum()
    assert all(primal(w) <= primal(w + d) + 1e-2 for d in rng.normal(scale=0.05, size=(50, 6)))
    a, b = linear.platt(rows.dot(w), (y > 0).astype(int))
    assert a > 0 and ((linear.sigmoid(a * rows.dot(w) + b) > 0.5) == (y > 0)).mean() > 0.95


def test_language(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, lang, rnd.randrange(1, 200)), lang) for i, lang in enumerate(rnd.choice(list(WORDS)) for _ in range(600))]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(2000, "ä", "de"), (None, "le garçon", None)]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    model = language_cnn.fit(docs.where(U.remainder5(F.col("doc_id")) != 0), per_language=200)
    assert model.classes == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language_cnn.identify(docs.withColumn("score", F.lit(1)), model).collect()}
    assert [got[1000 + i].lang_pred == "und" for i in range(5)] == [True, True, True, True, False]
    assert got[2000].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values())
    held = [(i, lang) for i, _, lang in rows if lang and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == lang for i, lang in held) / len(held) > 0.95
    assert language_cnn.identify(docs.limit(0), model).count() == 0
    alone = language_cnn.fit(docs.limit(0))
    assert {r.lang_pred for r in language_cnn.identify(docs, alone).collect()} == {"und"}


def test_training_windows_reach_the_end():
    import pyarrow as pa

    text = "".join(chr(97 + i % 26) for i in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([text, "short"])], names=["lang", "text"])
    got = next(language_cnn._training_windows(iter([batch]))).to_pydict()
    assert got["lang"] == ["a"] * 3 + ["b"] and got["window"][0] == text[:256].encode() and got["window"][2] == text[-256:].encode()


def test_network_gradients_and_windows():
    texts = [b"abc", b"x" * 256, b"y" * 257, bytes(range(1, 200)) * 7]
    windows, counts = language_cnn.windows_of(texts)
    assert counts.tolist() == [1, 1, 2, 1 + -(-(1393 - 256) // language_cnn.STRIDE)]
    grams = {bytes(w[i : i + 4]) for w in windows[4:] for i in range(253)}
    assert all(texts[3][i : i + 4] in grams for i in range(1390))  # no n-gram of bytes is lost between windows
    model = language_cnn.ByteCNN(["a", "b"], 1)
    pairs = model.pairs()
    x = np.ascontiguousarray(windows.T)
    tops = np.concatenate([r.max(0) for r in model._answers(x)], 1)
    z = np.maximum(tops + model.bias, 0) @ model.out + model.out_bias
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.abs(model.log_probabilities(windows, pairs) - want).max() < 1e-4


def test_language_model(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.choice(list(WORDS)), rnd.randrange(0, 60))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5, "THE house"), (5, "THE house"), (None, "unseenword der")]
    docs = table(spark, rows, "doc_id long, text string")
    train = docs.where(U.remainder5(F.col("doc_id")) != 1)
    model, counts = maxent.fit(train)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*(t or "").translate(low).encode().split(), b""]
    c = Counter(w for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for w in tokens(t))
    total = sum(c.values())
    assert (model.total, model.distinct) == (total, len(c))
    got = Counter()
    for r in maxent.score_documents(docs, model, counts).collect():
        assert r.score < 0
        got[r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)] += 1
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        want[i, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in w), 3)] += 1
    assert got == want
    assert maxent.score_documents(docs.limit(0), model, counts).count() == 0


def test_language_model_adds_up(spark):
    """In any context, the probabilities of all known words and of the unseen ones add up to 1."""
    rnd = random.Random(6)
    docs = table(spark, [(i, prose(rnd, rnd.choice(list(WORDS)), 50)) for i in range(60)], "doc_id long, text string")
    model, counts = maxent.fit(docs)
    words = [bytes(r.word) for r in counts.collect() if r.word]
    context = "the haus"
    probe = [f"{context} {w.decode()}" for w in words]
    unseen, k = {}, 0
    while len(unseen) < maxent.TAIL_CLASSES:
        w = f"zz{k}"
        k += 1
        if w.encode() not in words:
            unseen.setdefault(int(maxent.tail_classes([w.encode()])[0]), w)
    probe += [f"{context} {w}" for w in unseen.values()]
    total = sum(math.exp(plain_log(model, counts, t)[-2]) for t in probe)
    total += math.exp(plain_log(model, counts, context)[-1])
    # classes that no known word is in hold what is missing
    reader = maxent.Reader(model)
    doc, word, cls, _ = reader.read([context.encode()])
    z = maxent._logits(model.weights, model.bias, reader.features(doc, word, cls)[1])
    used = set(model.head_class.tolist()) | set(range(maxent.HEAD_CLASSES, maxent.CLASSES))
    unused = 1 - np.exp(z[-1])[sorted(used)].sum() / np.exp(z[-1]).sum()
    assert abs(total + unused - 1) < 1e-3


def plain_log(model, counts, text):
    """log P of each token of a text, token by token from the model's tables."""
    head, c = min(maxent.HEAD, len(model.listed)), {bytes(r.word): r.c for r in counts.collect()}
    place = {w: i for i, w in enumerate(model.listed[:head])}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [*(text or "").translate(low).encode().split(), b""]
    tail = lambda w: int(maxent.tail_classes([w])[0])
    symbol = [place[w] if w in place else head + tail(w) for w in tokens]
    cls = [int(model.head_class[place[w]]) if w in place else maxent.HEAD_CLASSES + tail(w) for w in tokens]
    n, out = head + maxent.TAIL_CLASSES + 1, []
    row = lambda x, k: int(U.mix64(np.array([x + (k << 32)], np.uint64))[0] >> np.uint64(64 - maxent.ROW_BITS))
    for t, w in enumerate(tokens):
        back = [symbol[t - k] if t >= k else n - 1 for k in (1, 2, 3)]
        z = model.bias + sum(model.weights[row(x, k)].astype(float) for x, k in ((back[0], 1), (back[0] * n + back[1], 2), (back[1], 3), (back[2], 4)))
        log = z[cls[t]] - math.log(np.exp(z).sum())
        if w in place:
            log += model.within[cls[t - 1] if t else maxent.CLASSES, place[w]]
        else:
            j = tail(w)
            log += math.log((1 - model.tail_unseen[j]) * c[w] / model.tail_total[j] if w in c else model.tail_unseen[j])
        out.append(log)
    return out


def test_language_model_scores_by_plain_loops(spark, monkeypatch):
    """score is the sum over tokens of what the model's tables say, for head words, other listed ones, unlisted ones and unseen ones."""
    monkeypatch.setattr(maxent, "LISTED", 60)
    rnd = random.Random(12)
    rows = [(i, prose(rnd, rnd.choice(list(WORDS)), rnd.randrange(0, 40))) for i in range(120)] + [(500, None), (501, "neverseen der THE"), (502, "x" * 100 + " the " * 2000)]
    docs = table(spark, rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("log", F.lit(1))
    model, counts = maxent.fit(docs.where("doc_id < 100 or doc_id = 502"))
    assert len(model.listed) == 60 < model.distinct
    got = {r.doc_id: r.score for r in maxent.score_documents(docs, model, counts).collect()}
    for i, t in rows[80:]:
        if i != 502:
            assert abs(got[i] - sum(plain_log(model, counts, t)) / math.log(10)) < 1e-3 * max(1, abs(got[i]))


def test_language_model_without_training(spark):
    docs = table(spark, [(1, "the house"), (2, None), (None, "x")], "doc_id long, text string")
    model, counts = maxent.fit(docs.limit(0))
    got = {r.doc_id: r for r in maxent.score_documents(docs, model, counts).collect()}
    assert {i: (r.n_tokens, r.n_known) for i, r in got.items()} == {1: (3, 0), 2: (1, 0), None: (2, 0)}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values()) and abs(got[1].base_score) < 1e-9


def test_language_model_trains_on_all_tokens(spark):
    """Weights move for every feature of every training token: in a document of several batches, in one of many, and in short ones."""
    rnd = random.Random(7)
    docs = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(n)) for n in (5000, 30_000, 300)]
    for text in docs:
        model, _ = maxent.fit(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1))
        doc, word, cls, _ = (reader := maxent.Reader(model)).read([text.encode()])
        rows = reader.features(doc, word, cls)[1]
        assert np.abs(model.weights[np.unique(rows)]).sum(1).min() > 0


def test_row_sums():
    rng = np.random.default_rng(1)
    sizes = -np.sort(-np.concatenate([rng.integers(1, 60, 50), np.ones(200, np.int64)]))
    of, g = rng.integers(0, 500, sizes.sum()), rng.normal(size=(500, 7))
    heads = np.cumsum(sizes) - sizes
    want = [g[of[h : h + n]].sum(0) for h, n in zip(heads, sizes)]
    assert np.abs(maxent.row_sums(g, of, heads, sizes) - want).max() < 1e-9


def test_language_model_classes_see_all_documents(spark):
    """Which documents hold a word must not matter for its class, as a sample of documents would make it."""
    rnd = random.Random(9)
    texts = [f"the w{rnd.randrange(2000)} of w{rnd.randrange(2000)} a w{rnd.randrange(2000)}" for _ in range(2600)]
    c = Counter(w for t in texts for w in maxent.tokens(t.encode()))
    listed = sorted(c, key=lambda w: (-c[w], w))
    model = maxent.Model(listed, np.array([c[w] for w in listed]), c.total(), len(c), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    one, other = (maxent.find_classes(model, table(spark, [(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")) for first in (0, 50_000))
    assert (one == other).all()


def test_leaks(spark):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [words(rnd.randrange(12, 45)) for _ in range(12)]
    docs, want = [], set()
    for i in range(80):
        text = words(rnd.randrange(0, 300))
        if i % 4 == 0:
            own, k = list(rnd.choice(items)), rnd.randrange(len(text) + 1)
            item = items.index(own)
            for _ in range(i % 3):  # slightly reworded
                own[rnd.randrange(len(own) - 5)] = "other"
            text[k:k] = [w.title() + rnd.choice(["", ",", "."]) for w in own]
            want.add((i, item))
        docs.append((i, " ".join(text)))
    docs += [(100 + i, t) for i, t in enumerate(ODD)]
    frame = table(spark, docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = table(spark, [(i, " ".join(t)) for i, t in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()}
    assert got == want
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0


def test_leaks_by_brute_force(spark):
    """Items of 5 to 1000 words, copied or reworded, against a judgement of every item at every place of every document."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8))) for _ in range(2000)]
    words = lambda n: [vocabulary[int(2000 * rnd.random() ** 2)] for _ in range(n)]
    items = [words(n) for n in (5, 12, 30, 60, 65, 100, 200, 300, 500, 1000) for _ in range(2)]
    docs = []
    for rate in (0, 0.1, 0.2, 0.3):
        for item in items:
            docs.append(words(rnd.randrange(200)) + [rnd.choice(vocabulary) if rnd.random() < rate else w for w in item] + words(rnd.randrange(200)))
    docs += [words(300) for _ in range(60)]
    want, size = set(), 2 * decontaminate.BLOCK
    for d, text in enumerate(docs):
        text = [w.encode() for w in text]
        for i, item in enumerate(items):
            item = [w.encode() for w in item]
            around = (text[max(0, at - len(item)) : at + size + len(item)] for at in range(0, len(text), decontaminate.BLOCK))
            if any(decontaminate.leaked(*decontaminate.judged(item, x)) for x in around if 2 * len({*item} & {*x}) >= 0.9 * len({*item})):
                want.add((d, i))
    assert {(d, d) for d in range(len(items))} <= want
    frame = table(spark, [(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = table(spark, [(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and {(d, d) for d in range(len(items))} <= got


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    rnd = random.Random(4)
    items = [[f"w{rnd.randrange(300)}" for _ in range(20)] for _ in range(8)]
    docs = [(i, " ".join([f"w{rnd.randrange(300)}" for _ in range(40)] + items[i % 8])) for i in range(16)]
    bench = table(spark, [(i, " ".join(t)) for i, t in enumerate(items)] + [(0, " ".join(items[0])), (None, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, docs, "doc_id long, text string"), bench).collect())
    assert got == sorted([(i, i % 8) for i in range(16)] + [(0, 0), (8, 0)])


def test_severe_counts_words():
    """Three short strong words make a document severe, one long word with its beginnings doesn't."""
    n = 200  # a word of one class alone is strong from about 150 documents on
    texts = [b"vile bad ugly x", b"horrendously y", b"fine words here"] * n
    doc, ids = toxicity.word_features(texts)
    rows = [ids[doc == i] for i in range(len(texts))]
    y = np.array([1, 1, 0] * n)
    assert toxicity.severe(rows, y).tolist() == [1, 0, 0] * n


def test_lcs():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = ([bytes([rnd.randrange(97, 101)]) for _ in range(rnd.randrange(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_randomised_svd(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 20)) for _ in range(40)]
    numbers = {f"w{i}".encode(): i for i in range(60)}
    weight = rng.random(60) + 0.5
    passages = table(spark, [(t,) for t in texts], "text string")
    a = np.zeros((40, 60))
    for k, (ids, values) in enumerate(decontaminate._rows([t.encode() for t in texts], numbers, weight)):
        a[k, ids] = values
    space = decontaminate.latent_space(passages, numbers, weight, rank=20)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.linalg.norm(a @ space) ** 2 > 0.98 * (s[:20] ** 2).sum()
    assert np.abs(space.T @ space - np.eye(20)).max() < 1e-6
