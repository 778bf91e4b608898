"""Operators with exact results, against plain loops."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lumispec.llm import components, packing, registry, shingle_join, span_hash, substring_dedup, token_files
from lumispec.llm import _util as U

LONG = "x" * 50_000 + " " + "ab " * 3000
ODD = [None, "", " \t\n", "a", "Ein Wort und é", LONG, LONG, "tie tie", "tie tie"]


def texts(seed: int, n: int = 40) -> list:
    """Documents with copies, near copies and shared passages."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    words = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passage, out = words(20), list(ODD)
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.4 and out:
            own = (rnd.choice(out) or "").split()[:400]
            for _ in range(rnd.randrange(0, 4)):
                if own:
                    own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        else:
            own = words(rnd.randrange(0, 80))
            if kind > 0.7:
                own[rnd.randrange(len(own) + 1) : 0] = passage
        out.append(rnd.choice([" ", "  ", "\n"]).join(own))
    return out


def documents(spark, values, ids=None, parts=3):
    rows = [(i, t, "en", 1) for i, t in zip(ids or range(len(values)), values, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, ranges string, n_words int").repartition(parts)


def split(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [8 << 20, 300])
def test_substrings(spark, seed, limit, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", limit)
    monkeypatch.setattr(substring_dedup, "HOT", 4096 if limit > 300 else 3)
    monkeypatch.setattr(substring_dedup, "LOCAL", 64 if limit > 300 else seed)
    monkeypatch.setattr(substring_dedup, "REMEMBERED", 200_000 if seed == 1 else 5)
    values = texts(seed)
    ids = [*range(5, len(values) + 2), 5, None, None]  # two documents of one id, and some of none
    ids = ids[: len(values)]
    first = {}
    rows = list(zip(ids, values, strict=True))
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    want = []
    for i, t in rows:
        w = split(t)
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(13)}
        want.append((i if i is not None else -1, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    out = substring_dedup.dedup_substrings(documents(spark, values, ids))
    assert out.columns == ["doc_id", "ranges", "n_words_in", "kept", "n_words", "n_removed"]
    got = [(r.doc_id if r.doc_id is not None else -1, r.kept, r.n_words, r.n_removed) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert substring_dedup.dedup_substrings(documents(spark, values).limit(0)).count() == 0


def test_substrings_names_and_ties(spark):
    """Columns with any names come back with their own values; equal rows, texts and ids are told apart."""
    w = [f"w{i}" for i in range(20)]
    text = " ".join(w)
    rows = [(2, text, 1, 2, "k", "ki", "p", "r", 5), (2, text, 1, 2, "k", "ki", "p", "r", 5), (2, "x " + text, 3, 4, "l", "li", "q", "s", 6), (1, "y " + text, 5, 6, "m", "mi", "t", "u", 7)]
    names = "doc_id long, text string, n_words int, digest int, kept string, kept_in string, places string, ranges string, rest int"
    docs = spark.createDataFrame(rows, names)
    out = substring_dedup.dedup_substrings(docs)
    assert out.columns == ["doc_id", "n_words_in", "digest", "kept_in_in", "kept_in", "places", "ranges", "rest", "kept", "n_words", "n_removed"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, 5, 6, "m", "mi", "t", "u", 7, "y " + text, 21, 0), *[(2, 1, 2, "k", "ki", "p", "r", 5, "", 20, 20)] * 2, (2, 3, 4, "l", "li", "q", "s", 6, "x", 21, 20)]
    assert substring_dedup.without_repeats(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect() == [(1, None), (2, "")]
    back = substring_dedup.without_repeats(docs)
    assert back.columns == docs.columns
    assert sorted(tuple(r) for r in back.collect()) == [rows[3], (2, "x", *rows[2][2:])]


def test_shared_places():
    """Places of keys that several documents have pass, once each, however batches are cut; those of hot keys are marked."""
    import pyarrow as pa

    rnd = random.Random(2)
    rows = sorted((rnd.randrange(9), rnd.randrange(4)) for _ in range(60)) + [(20, 1)] * 30 + [(21, k) for k in range(30)] + [(22, 5)]
    docs, sizes = defaultdict(set), defaultdict(int)
    for k, d in rows:
        docs[k].add(d)
        sizes[k] += 1
    want = sorted((k, d, substring_dedup.SPREAD if sizes[k] > 10 else substring_dedup.PLAIN) for k, d in rows if len(docs[k]) > 1)
    for cut in (1, 3, 8, 500):
        parts = [rows[i : i + cut] for i in range(0, len(rows), cut)]
        batches = [substring_dedup._rows(substring_dedup.PLACES, *(np.array(x) for x in zip(*p)), np.zeros(len(p)), np.zeros(len(p), int), np.zeros(len(p), int)) for p in parts]
        got = sorted((r["key"], r["doc_id"], r["kind"]) for x in substring_dedup._shared(10)(iter(batches)) for r in x.to_pylist())
        assert [g for g in got if g[0] != 20] == want  # one document's places of a hot key may pass or not


def test_hinted_places():
    """A hint makes all places of its minimiser hot, though they be few or of one document, and ends there; places dealt by windows pass."""
    import pyarrow as pa

    plain, spread, hint = substring_dedup.PLAIN, substring_dedup.SPREAD, substring_dedup.HINT
    rows = [(1, 0, hint), (1, 0, hint), (1, 5, plain), (2, 7, plain), (3, 0, spread), (3, 4, plain), (3, 6, plain), (4, -9, plain), (4, 0, hint)]
    for cut in (1, 2, 9):
        parts = [rows[i : i + cut] for i in range(0, len(rows), cut)]
        batches = [pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in p]) for k in (0, 1)), *(pa.array([0] * len(p)),) * 2, pa.array([r[2] for r in p], pa.int32())], names=["key", "doc_id", "digest", "place", "kind"]) for p in parts]
        got = sorted((r["key"], r["doc_id"], r["kind"]) for x in substring_dedup._shared(10)(iter(batches)) for r in x.to_pylist())
        assert got == [(1, 5, spread), (3, 0, spread), (3, 4, plain), (3, 6, plain), (4, -9, spread)]


def test_frequent_window(spark):
    """A window in every document, between words of its own: each task sends few rows to its bucket, and the result is whole."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**9)}"
    passage = [word() for _ in range(13)]
    values = [" ".join([*(word() for _ in range(rnd.randrange(30))), *passage, *(word() for _ in range(rnd.randrange(30)))]) for _ in range(3000)]
    ids = list(range(len(values)))
    rnd.shuffle(ids)
    batch = lambda names, *c: pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=names)
    places = pa.Table.from_batches(substring_dedup._places(13)(iter([batch(["doc_id", "digest", "text"], ids, ids, values)]))).to_pylist()
    hinted = {r["key"] for r in places if r["kind"] == substring_dedup.HINT}
    assert hinted  # and of the windows beside it
    assert sum(r["kind"] == substring_dedup.SPREAD for r in places) >= 3000
    assert not any(r["key"] in hinted and r["kind"] != substring_dedup.HINT for r in places)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(documents(spark, values, ids)).collect()}
    assert len(got) == 3000
    for i, t in zip(ids, values, strict=True):
        assert got[i].n_removed == (13 if i else 0)
        assert got[i].kept == (t if i == 0 else " ".join(w for w in t.split() if w not in passage))

    import zstandard

    press = zstandard.ZstdCompressor()
    folded = batch(["doc_id", "digest", "text"], ids, ids, [press.compress(t.encode()) for t in values])
    kind = pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int64()), ("kind", pa.int32())]))
    where = [[{"key": 1, "place": t.split().index(passage[0]) << 32 | 13, "kind": substring_dedup.SPREAD}] for t in values]
    pieces = pa.Table.from_batches(substring_dedup._pieces(13)(iter([folded.append_column("places", pa.array(where, kind))])))
    sent = pieces.filter(pa.compute.is_valid(pieces["packed"]))
    assert len(sent) <= 2  # two chunks: the smallest document of each
    assert len(pieces) == 3000


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("rounds", "many"), [(3, 200), (3, -1)])
def test_shingle_join(spark, seed, rounds, many, monkeypatch):
    monkeypatch.setattr(shingle_join, "ROUNDS", rounds)
    monkeypatch.setattr(shingle_join, "MANY", many)  # -1: every round compares with hubs first
    monkeypatch.setattr(shingle_join, "PIECE", 4)
    rnd = random.Random(seed)
    values = texts(seed, 25)
    base = [f"w{rnd.randrange(90)}" for _ in range(150)]
    for _ in range(25):  # a group of near copies about the threshold
        own = list(base)
        for _ in range(rnd.randrange(0, 12)):
            own[rnd.randrange(len(own))] = f"v{rnd.randrange(9)}"
            if rnd.random() < 0.4:
                del own[rnd.randrange(len(own))]
        values.append(" ".join(own))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in values:
        w = split((t or "").translate(low))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    label = list(range(len(values)))
    for _ in values:
        for a in range(len(values)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.link_documents(documents(spark, values)).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_shingle_join_odd(spark):
    got = sorted(tuple(-1 if x is None else x for x in r) for r in shingle_join.link_documents(documents(spark, ["a b c d e"] * 4, [None, 7, 7, 3])).collect())
    assert got == [(-1, 2, -1), (3, 2, 3), (7, 2, 3), (7, 2, 3)]
    assert shingle_join.link_documents(documents(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_overlaps(percent):
    rng = np.random.default_rng(percent)
    a, b = [], []
    for _ in range(300):
        pool = rng.integers(0, 2**64, 40, dtype=np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 40))) for _ in range(2))
        a.append(x)
        b.append(x if rng.random() < 0.2 else np.unique(np.append(x, y[:3])))
    want = [100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)) for x, y in zip(a, b)]
    assert shingle_join.overlaps_reach(a, b, percent).tolist() == want
    assert shingle_join.overlaps_reach([], [], percent).tolist() == []


def test_buckets():
    """Members of buckets of two nodes or more, once each and in pieces, however the batches are cut."""
    import pyarrow as pa

    rnd = random.Random(1)
    rows = sorted({(rnd.randrange(12), rnd.randrange(30)) for _ in range(90)} | {(50, k) for k in range(40)} | {(60, 1)})
    sizes = defaultdict(int)
    for k, _ in rows:
        sizes[k] += 1
    place, want = defaultdict(int), []
    for k, n in rows:
        if sizes[k] > 1:
            want.append((k, n, place[k] // 8))
        place[k] += 1
    for cut in (1, 2, 7, 1000):
        twice = [r for r in rows for _ in range(2)]  # as several tasks send them
        batches = [pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in part], pa.int64()) for i in range(2)), pa.array([9] * len(part), pa.int64()), pa.nulls(len(part), pa.int64()), pa.array([False] * len(part))], names=shingle_join._ROW_NAMES) for part in (twice[i : i + cut] for i in range(0, len(twice), cut))]
        got = [tuple(r.values()) for x in shingle_join._buckets(8)(iter(batches)) for r in x.select(["a", "b", "part"]).to_pylist()]
        assert sorted(got) == sorted(want)


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_prefix_hashes():
    rnd = random.Random(3)
    a, b = ("".join(rnd.choice("abé") for _ in range(300)) for _ in range(2))
    b = b[:100] + a[50:170] + b[100:]
    x, y = span_hash.PrefixHash(a), span_hash.PrefixHash(b)
    for _ in range(300):
        i, j, n = rnd.randrange(300), rnd.randrange(300), rnd.randrange(1, 12)
        if i + n <= len(a) and j + n <= len(b):
            assert span_hash.equal_spans(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert span_hash.longest_common_extension(x, i, y, j) == want
    assert span_hash.longest_common_extension(x, 50, y, 100) >= 120
    assert x.joined(120, y, 33) == (z := span_hash.PrefixHash(a[:120] + b[:33])).span(0, z.n)
    assert (x.all_spans(7) == x.spans(slice(0, 294), 7)).all()


def test_fingerprints(spark):
    values = texts(9)
    got = {r.doc_id: r for r in span_hash.fingerprint_documents(documents(spark, values)).collect()}
    assert len(got) == len(values)
    whole = [t or "" for t in values]
    for i, t in enumerate(whole):
        after = whole[(i + 1) % len(whole)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (span_hash.fingerprint(t), span_hash.fingerprint(edited))
        assert r.near_next == span_hash.likeness(span_hash.fingerprint(t), span_hash.fingerprint(after))
        assert r.near_edited == span_hash.likeness(span_hash.fingerprint(t), span_hash.fingerprint(edited))
        common = [len(os.path.commonprefix([t, x])) for x in (edited, after)]
        assert [r.common_edited, r.common_next] == common
    prints = {span_hash.fingerprint(t) for t in whole}
    assert len(prints) == len(set(whole))
    assert span_hash.fingerprint_documents(documents(spark, values).limit(0)).count() == 0
    one = span_hash.fingerprint_documents(documents(spark, ["abcd"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_likeness():
    rnd = random.Random(4)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    near, far = a[:2400] + "zzzz" + a[2400:], "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    f = [span_hash.fingerprint(x) for x in (a, near, far)]
    assert span_hash.likeness(f[0], f[0]) == 1 and span_hash.likeness(f[0], f[1]) > 0.9 and span_hash.likeness(f[0], f[2]) < 0.1


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_bit_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        packed = token_files.pack(ids, bits)
        assert len(packed) == -(-n // 64) * 8 * bits
        assert (token_files.unpack(packed, bits, n) == ids).all()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert (token_files.unpack_span(packed, bits, a, b) == ids[a:b]).all()
    docs = [rng.integers(0, 1 << bits, k, dtype=np.uint64).astype(np.uint32) for k in (5, 0, 100, 1)]
    block = token_files.encode_block(docs, bits)
    assert all((token_files.read_document(block, i) == d).all() for i, d in enumerate(docs))
    assert (token_files.decode_block(block)[0] == np.concatenate(docs)).all()
    with pytest.raises(ValueError):
        token_files.decode_block(b"x" * 64)


@pytest.mark.parametrize("whole", [False, True])
def test_token_files(spark, tmp_path, whole, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    values = [*texts(6), "It's <|endoftext|> <|EndOfText|> 12,3...!! ÉtÉ, straße. éa\x1cb naïve, x", "A%%% b&&& C.\nD,e f.,\n"]
    tokenizer = Tokenizer.from_file(path)
    out = str(tmp_path / "tokens")
    token_files.write_token_files(documents(spark, values), path, out, whole=whole, file_bytes=20_000)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, out).collect()}
    start = 0
    for i, t in enumerate(values):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (start, len(ids), ids)
        start += len(ids)
    digests = {r.doc_id: r.crc for r in token_files.read_token_files(spark, out, token_files.crc_of_ids, "doc_id long, start long, n_tokens long, crc long").collect()}
    assert digests == {i: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for i, r in got.items()}
    empty = str(tmp_path / "empty")
    token_files.write_token_files(documents(spark, values).limit(0), path, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_odd_ids(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    out = str(tmp_path / "tokens")
    token_files.write_token_files(documents(spark, ["b", "a", "c", None], [4, 4, None, None]), public_tokenizers.path("word_bpe_49k.json"), out)
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_files(spark, out).collect()))
    assert got == [(0, None, 1), (1, None, 2), (3, 4, 2), (5, 4, 2)]


@pytest.mark.parametrize("buckets", [1, 2, 3, 9])
def test_boundaries(buckets):
    from itertools import combinations

    rnd = random.Random(buckets)
    for _ in range(20):
        lengths = np.array(sorted(rnd.sample(range(1, 60), rnd.randrange(1, 8))))
        counts = np.array([rnd.randrange(1, 9) for _ in lengths])
        cost = lambda cuts: sum(int(n) * min(c for c in cuts if c >= v) for v, n in zip(lengths, counts, strict=True))
        best = min(cost([*some, lengths[-1]]) for k in range(min(buckets, len(lengths))) for some in combinations(lengths[:-1], k))
        cuts = packing.boundaries(lengths, counts, buckets)
        assert len(cuts) <= buckets and cuts == sorted(cuts) and cost(cuts) == best
    assert packing.boundaries(lengths[:0], counts[:0], 3) == []
    lengths, counts = np.arange(1, 400) * 7, np.array([rnd.randrange(1, 90) for _ in range(399)])
    cost, before = lengths * np.cumsum(counts), np.append(0, np.cumsum(counts))
    for _ in range(1, buckets):  # the plain quadratic programme
        cost = np.array([min([cost[j], *(cost[:j] + lengths[j] * (before[j + 1] - before[1 : j + 1]))]) for j in range(399)])
    cuts = packing.boundaries(lengths, counts, buckets)
    assert sum(int(n) * min(c for c in cuts if c >= v) for v, n in zip(lengths, counts, strict=True)) == cost[-1]


def test_packing_odd(spark):
    """Null lengths, names that the operator uses itself, repeated rows, and one far-off doc_id, which must not put all others into one shard."""
    rows = [(i % 50 if i else 10**15, None if i == 3 else 5, i, "u", "v", 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, n long, `row` int, shard string, place string, slot int")
    out = packing.pack(docs, "n", 2, 20)
    assert out.columns == ["doc_id", "n", "row", "shard", "place", "bucket", "bucket_length", "batch", "slot"]
    got = out.collect()
    assert sorted(r["row"] for r in got) == list(range(400)) and {(r["shard"], r["place"]) for r in got} == {("u", "v")}
    assert [(r.bucket, r.bucket_length, r.batch, r.slot) for r in got if r.n is None] == [(0, 1, 0, 0)]
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == 400 and {r.bucket_length for r in got} == {1, 5}


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 10)
    values = [*texts(8, 60), "w " * 9000]
    lengths = packing.word_lengths(documents(spark, values, [None, *range(1, len(values))]))
    out = packing.pack(lengths, "n_tokens", 4, 500).collect()
    assert len(out) == len(values)
    batches = defaultdict(list)
    for r in out:
        assert r.n_tokens == len(split(values[r.doc_id or 0])) + 1 <= r.bucket_length
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), rows in batches.items():
        per = max(1, 500 // rows[0].bucket_length)
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == per or (bucket, batch + 1) not in batches
    order = sorted(out, key=lambda r: (r.bucket, r.batch, r.slot))
    assert all(a.bucket != b.bucket or (a.doc_id or -1) < b.doc_id for a, b in zip(order, order[1:]))
    assert packing.pack(lengths.limit(0), "n_tokens").count() == 0


def test_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "bbbb", "cc", "c"])], names=["text"])
    assert [len(x) for x in U.slices(iter([batch]), "text", 3)] == [2, 1, 2]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name, tmp_path):
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(f"CREATE TABLE want AS {registry.ORACLE_SQL[name]}")
    registry.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "got"))
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    columns = ", ".join(r[0] for r in con.execute("DESCRIBE want").fetchall())
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchone()[0] == 0
