"""The prefix trie and SimHash links, against plain loops."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lumispec.llm import _util as U
from lumispec.llm import prefix_trie, registry, simhash


def plain_trie(rows: list) -> dict:
    """(conv_id, depth) to the other columns, node by node."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            r, x = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        base = int(np.fix(c / 100)) * 100
        h = 0 if c == base else zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = {}
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = lambda m: [x for x in members if len(x) == len(m) + 1 and x[: len(m)] == m]
        ends = [str(c) for c in convs if len(built[c]) == len(node)]
        out[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None, len(convs), len(kids(node)), sum(not kids(m) for m in below),
            sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m), hashlib.sha256(",".join(ends).encode()).hexdigest(),
        )
    return out


def conversations(seed: int) -> list:
    rnd = random.Random(seed)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, None, None), (7, 1, "user", "é" * 3000), (205, 3, "user", "alone")]
    for c in [0, 1, 2, 3, 55, 99, 100, 101, 150, 301, 302, -3, -150, -100, 10**15 + 7]:
        for t in range(rnd.randrange(0, 9)):
            rows.append((c, rnd.choice([t, t, t, None, 2]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a", "b", None, "", "a b"])))
    rows += [(200 + i, t, "u", f"t{t}") for i in (0, 1, 2) for t in range(30 + 7 * i)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 3), (3, 4096)])
def test_trie(spark, seed, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations(seed)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, `k0.x` string, n_convs int").repartition(5)
    want = plain_trie(rows)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.prefix_trie(frame).collect()}
    assert got == want


def test_trie_of_one_chain_of_runs(spark):
    """Each shorter conversation has the larger id: every node's smallest member changes, and a run finishes a round."""
    n = 12
    rows = [(1000 + n - k, t, "u", f"t{t}") for k in range(1, n) for t in range(k)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = prefix_trie.prefix_trie(frame, rebuild=False).collect()
    assert len(out) == n and all(r.n_leaves == 1 for r in out)
    forks = [(1000 - k, t, "u", f"t{t}" if t < k else f"end{k}") for k in range(n) for t in range(k + 1)]
    out = prefix_trie.prefix_trie(spark.createDataFrame(forks, "conv_id long, turn int, role string, text string"), rebuild=False).collect()
    assert len(out) == 2 * n and max(r.n_leaves for r in out) == n and sum(r.n_leaves == 1 for r in out) == n + 1


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_print(text) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = low.split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(prints: list, distance: int) -> list:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def near_texts(seed: int) -> list:
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [None, "", " \n", "A B", "a b", "a  b\tC d", "É é x y z", "x" * 70_000, "solo"]
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(4, 400))]
        for _ in range(8):
            own = list(base)
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            out.append(rnd.choice([" ", "\n", "\x0b "]).join(own).upper() if rnd.random() < 0.3 else " ".join(own))
    return out


@pytest.mark.parametrize("seed,part,rows", [(1, 4096, 1 << 16), (2, 4, 50), (3, 8, 1 << 16)])
def test_simhash(spark, seed, part, rows, monkeypatch):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "ROWS", rows)
    texts = near_texts(seed)
    ids = [*range(3, len(texts)), 3, None, 10**12]
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, print int, `a.b` string").repartition(3)
    prints = [plain_print(t) for t in texts]
    of = plain_components(prints, 4)
    least = {c: min((i for i, d in zip(ids, of, strict=True) if d == c and i is not None), default=None) for c in of}
    want = sorted((str(i), f"{p:016x}", least[c]) for i, p, c in zip(ids, prints, of, strict=True))
    out = simhash.link_documents(frame).select("doc_id", simhash.hexadecimal("print").alias("f"), "component_id").collect()
    assert sorted((str(r.doc_id), r.f, r.component_id) for r in out) == want
    assert len({c for c in of}) < len(texts) - 10


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_blocks_lose_no_link(spark, blocks):
    """Fingerprints a few bits apart, wherever the bits lie; the number of blocks changes nothing."""
    rnd = random.Random(blocks)
    prints = {0, (1 << 64) - 1}
    for _ in range(150):
        p = rnd.getrandbits(64)
        for _ in range(3):
            prints.add(p)
            for j in rnd.sample(range(64), rnd.randrange(3, 6)):
                p ^= 1 << j
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(r.u, r.v) for r in simhash.close_links(spark.createDataFrame([(p,) for p in signed], "print long"), blocks=blocks).collect()]
    at = {p: i for i, p in enumerate(signed)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in links:
        root[find(at[u])] = find(at[v])
    want = plain_components(prints, 4)
    assert len({(find(i), w) for i, w in enumerate(want)}) == len(set(want)) == len({find(i) for i in range(len(prints))})


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"W{i % 97}" for i in range(5000)).encode()
    whole = simhash.simhashes([text, b"a b c", b"", b"x" * 900])
    monkeypatch.setattr(U, "CHUNK_BYTES", 100)
    assert simhash.simhashes([text, b"a b c", b"", b"x" * 900]).tolist() == whole.tolist() == [plain_print(text.decode()), plain_print("a b c"), 0, plain_print("x" * 900)]
    assert simhash.simhashes([b"aaa " * 40 + b"b"]).tolist() == [plain_print("aaa " * 40 + "b")]
    assert simhash.simhashes([b"y" * 120 + b"  " + b"z" * 120]).tolist() == [plain_print("y" * 120 + " " + "z" * 120)]


def test_simhash_of_nothing(spark):
    assert simhash.link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_simhash_query(spark):
    """The registered query over the smallest tables, by plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    out = registry.QUERIES["op12_simhash"](spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    prints = [plain_print(r.text) for r in docs]
    of = plain_components(prints, 4)
    least = {}
    for r, c in zip(docs, of, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert sorted(tuple(r) for r in out.collect()) == sorted((r.doc_id, f"{p:016x}", least[c]) for r, p, c in zip(docs, prints, of, strict=True))
