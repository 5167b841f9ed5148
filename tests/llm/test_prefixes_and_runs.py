"""Periodic runs, byte-level BPE and the prefix trie against plain versions."""

import hashlib
import random
import re
import string
import time
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from veracel.llm import byte_bpe, periodic, prefix_trie, registry

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


def naive_runs(w):
    """Every period, every maximal stretch of it; kept if no shorter period holds there."""
    n, out = len(w), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if length >= max(6, 4 * p) and all(any(w[k] != w[k + d] for k in range(i, i + length - d)) for d in range(1, p)):
                out.add((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=5), st.integers(1, 8)), max_size=8), max_size=4))
def test_runs(parts):
    texts = [[w for some, n in p for w in some * n] for p in parts]
    assert periodic.find_runs(texts) == [naive_runs(t) for t in texts]


def test_runs_of_long_texts_are_linear():
    r = random.Random(5)
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 100_000:
        fib.append(fib[-1] + fib[-2])
    for w in ([b"a"] * 200_000, [b"ab"[i % 2 : i % 2 + 1] for i in range(200_000)], [bytes([c]) for c in fib[-1][:100_000]], [bytes([r.choice(b"ab")]) for _ in range(100_000)]):
        start = time.perf_counter()
        periodic.find_runs([w])
        assert time.perf_counter() - start < 30
    assert periodic.find_runs([[b"a"] * 50_000]) == [[(0, 50_000, 1)]]


def plain_runs_row(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = naive_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_op11(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    short = [d for d in docs if len(d.text or "") < 6_000]
    got = {r.doc_id: tuple(r) for r in registry.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and sum(1 for r in got.values() if r[1]) > 5
    for d in short:
        assert got[d.doc_id] == plain_runs_row(d.doc_id, d.text)


def test_runs_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.unionByName(spark.createDataFrame([(70, "x y " * 9, "s")], "doc_id long, text string, source string"), allowMissingColumns=True)
    got = sorted(map(tuple, periodic.run_digests(rows, periodic.repeat_tail).collect()), key=str)
    given_rows = [(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]
    assert sorted(((r[0], r[1]) for r in got if r[0] not in (4, 5)), key=str) == sorted(((i, plain_runs_row(i, t)[1]) for i, t in given_rows if i not in (4, 5)), key=str)
    assert periodic.run_digests(no_docs).count() == 0
    runs = {r.doc_id: r for r in periodic.periodic_runs(rows).where("doc_id in (2, 70)").collect()}
    assert runs[70].collapsed == "x y" and [tuple(x) for x in runs[70].runs] == [(0, 18, 2)] and runs[2].runs == [] and runs[2].collapsed == ""


def library(path):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


@pytest.fixture(params=[(4096, 7, 64), (8, 2, 1), (16, 4, 4), (7, 1, 2)])
def small_leaves(request, monkeypatch):
    for name, v in zip(("LEAF_CHARS", "LEAF_BYTES", "WINDOW"), request.param):
        monkeypatch.setattr(byte_bpe, name, v)


def test_byte_bpe_equals_library(small_leaves):
    """Texts of few characters, whose merges run on across every border, with leaves and windows of any size."""
    path, r = byte_bpe.default_ranks(), random.Random(2)
    own, lib = byte_bpe.Coder(path, byte_bpe.default_pattern()), library(path)
    alphabets = ["ab", "a", "abc '", "s t're'll've d'm", "é汉😀 x\n\t ", "  \n\r　a1.", "the of and in ing er", "0 1,-'s", string.printable]
    for _ in range(1500):
        chars = r.choice(alphabets)
        t = "".join(r.choice(chars) for _ in range(r.randint(0, 120))) + "a" * r.choice([0, 0, 0, 200])
        ids = np.frombuffer(own.encode(t), "<u4")
        assert ids.tolist() == lib.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_byte_bpe_join_is_associative():
    own, r = byte_bpe.Coder(byte_bpe.default_ranks(), byte_bpe.default_pattern()), random.Random(4)
    for _ in range(500):
        a, b, c = ("".join(r.choice("aabentio ") for _ in range(r.randint(1, 25))).encode() for _ in range(3))
        e = own.encode_bytes
        assert own.join(own.join(e(a), e(b)), e(c)) == own.join(e(a), own.join(e(b), e(c))) == list(own.merge(a + b + c))


def test_byte_bpe_long_pieces_are_linear():
    own = byte_bpe.Coder(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    for t in ("a" * 200_000, "ab" * 100_000, " " * 200_000, "!" * 50_000, "x1" * 100_000):
        start = time.perf_counter()
        ids = own.encode(t)
        assert time.perf_counter() - start < 20 and own.decode(np.frombuffer(ids, "<u4")) == t.encode()


def test_op12(spark):
    lib = library(byte_bpe.default_ranks())
    got = {r.doc_id: r for r in registry.op12_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array(lib.encode_ordinary(d.text or ""), "<u4")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_byte_bpe_odd_rows(spark, odd_docs, no_docs):
    coded = byte_bpe.encode_documents(odd_docs)
    assert coded.columns == ["doc_id", "ids"]
    texts = sorted((r.text or "").encode() for r in odd_docs.select("text").collect())
    assert sorted(bytes(r.data) for r in byte_bpe.decode_documents(coded).collect()) == texts
    assert byte_bpe.coded_digests(odd_docs).where("n_tokens = 0").count() == 2 and byte_bpe.coded_digests(no_docs).count() == 0


def naive_trie(rows, rebuild=True):
    by = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [v[-1] for v in sorted(vs)] for c, vs in by.items()}
    nodes, kids, conv = {}, {}, {}
    for c, s in own.items():
        h = crc32(str(c).encode()) % 4 if rebuild else 0
        conv[c] = own.get(c - c % 20, [])[:h] + s[h:]
        for d in range(len(conv[c]) + 1):
            nodes.setdefault(tuple(conv[c][:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out, leaves, saved = [], {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        n = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = sum(saved[x] for x in below) + (len(nodes[k]) - 1) * n
        ends = sorted(c for c in nodes[k] if len(conv[c]) == len(k))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_turns():
    """Ties, nulls, repeated rows, long conversations that share beginnings of any depth, one that is copied often."""
    r, rows = random.Random(3), []
    for c in range(120):
        rows += [(c, r.choice([None, t, t]), r.choice(["user", None, "assistant"]), r.choice(["a b", "c", None, "d e  f"])) for t in range(r.choice([0, 1, 3, 5, 9]))]
    rows += [(c, t, "user", f"x {t // 500} y") for c in (7777, 7780, 7781) for t in range(600)]
    rows += [(c, t, "user", f"same {t}") for c in range(9000, 9100) for t in range(4)]
    rows += [(None, 1, "user", "x"), *rows[:3]]
    r.shuffle(rows)
    return rows


def test_trie_odd_rows(spark):
    rows = odd_turns()
    df = spark.createDataFrame([(*x, "z", 1) for x in rows], "conv_id long, turn long, role string, text string, part string, depth int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that conversations lie in several ranges
    try:
        for rebuild in (True, False):
            assert sorted(map(tuple, prefix_trie.trie(df, rebuild).collect()), key=str) == naive_trie(rows, rebuild)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert prefix_trie.trie(df.limit(0), True).count() == 0


def test_trie_with_a_full_sketch(spark, monkeypatch):
    """A sketch far too small proves nothing and changes no node."""
    monkeypatch.setattr(prefix_trie, "width_for", lambda rows: prefix_trie.MIN_WIDTH)
    monkeypatch.setattr(prefix_trie, "cells", lambda d1, d2, width: np.stack([np.full(len(d1), r * width) for r in range(prefix_trie.DEEP)]))
    rows = [(c, t, "user", f"w{t} {c % 3 if t > 1 else ''}") for c in range(30) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie.trie(df).collect()), key=str) == naive_trie(rows, False)


def test_sketch_never_takes_a_shared_prefix_for_a_single_one(spark):
    rows = spark.range(4000).selectExpr("xxhash64(id % 3000) as d1", "xxhash64(id % 3000, 7) as d2", "id % 3000 as k", "1L as depth", "null as p1", "null as p2")
    width = prefix_trie.MIN_WIDTH
    seen = prefix_trie.screened(rows.withColumns({"p1": rows.p1.cast("long"), "p2": rows.p2.cast("long")}), prefix_trie.sketch(rows, width), width)
    assert seen.where("single and k < 1000").count() == 0 and seen.where("single").count() > 1900
