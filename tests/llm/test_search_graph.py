"""Multi-index hashing, components, and SimHash against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from chartline.llm import graph, hamming, simhash
from chartline.llm.common import tables

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def longs(code, bits):
    return [signed(code >> i & (1 << 64) - 1) for i in range(0, bits, 64)]


@pytest.mark.parametrize("bits", [16, 64, 100])
def test_search_equals_all_distances(spark, bits):
    rnd = random.Random(bits)
    codes = [rnd.getrandbits(bits) for _ in range(60)]
    rows = [(i, c ^ (1 << rnd.randrange(bits)) if i % 3 else c) for i, c in enumerate(codes * 4)]
    index = spark.createDataFrame([(i, longs(c, bits)) for i, c in rows], "id long, code array<long>")
    queries = index.where("id % 17 = 0").select(F.col("id").alias("q"), F.col("code").alias("qcode"))
    got = {}
    for r in hamming.search(index, queries, 5, bits).collect():
        got.setdefault(r.q, []).append((r.distance, r.id))
    for i, c in rows:
        if i % 17 == 0:
            assert sorted(got[i]) == sorted(((c ^ d).bit_count(), j) for j, d in rows if j != i)[:5]


def test_search_fewer_rows_than_k_and_ties(spark):
    index = spark.createDataFrame([(i, [7]) for i in range(1, 5)] + [(9, [8])], "id long, code array<long>")
    got = hamming.search(index, spark.createDataFrame([(1, [7])], "q long, qcode array<long>"), 10).collect()
    assert sorted((r.distance, r.id) for r in got) == [(0, 2), (0, 3), (0, 4), (4, 9)]


def test_search_nulls_and_empty(spark):
    e = spark.createDataFrame([(0, [1.0, -1.0, None], "x"), (100, [1.0], "x"), (None, [1.0], "x"), (7, None, "x"), (100, [1.0], "x")], "vec_id long, embedding array<float>, rank string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in hamming.report(e).collect())
    assert got == [(0, 1, 100, 0), (100, 1, 0, 0)]
    assert hamming.report(e.limit(0)).count() == 0


def test_sign_code(spark):
    v = [1.0 if i in (0, 5, 63, 67) else -1.0 for i in range(70)]
    got = spark.createDataFrame([(v,)], "v array<float>").select(hamming.sign_code(F.col("v"), 70).alias("c")).first().c
    assert got == [signed(1 | 1 << 5 | 1 << 63), 1 << 3]


def test_entries_beyond_64_count(spark):
    """The width comes from the longest vector; shorter ones have zeros there."""
    rows = [(0, [1.0] * 64 + [1.0] * 36), (1, [1.0] * 64 + [-1.0] * 36), (2, [1.0] * 64 + [1.0] * 35 + [-1.0]), (3, [1.0] * 64)]
    got = hamming.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r.vec_id, r.distance) for r in got] == [(2, 1), (1, 36), (3, 36)]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", None, "  ", "a", "A b", "a  b\tc", "Hello World foo bar baz", "x y z " * 50, "É ç d e f g", "one two three four five six seven " * 30, "\na b c\n", "q\x0bw\x0ce r"]


def test_fingerprints():
    assert simhash.fingerprints(pa.array(TEXTS)).tolist() == [fingerprint(t) for t in TEXTS]
    assert simhash.fingerprints(pa.array([], pa.string())).tolist() == []


def test_fingerprint_of_a_long_text_is_summed_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "_ROWS", 7)
    assert simhash.fingerprints(pa.array(TEXTS)).tolist() == [fingerprint(t) for t in TEXTS]


def brute_components(fps):
    """{fp: least index} by all pairs."""
    fps = list(fps)
    a = np.array(fps, np.uint64)
    root = list(range(len(a)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= 3):
            p, q = find(i), find(int(j))
            root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(a))]


def test_clusters_equal_all_pairs(spark):
    docs = tables(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fps = [fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (d, _), c in zip(rows, comp):
        least[c] = min(d, least.get(c, d))
    want = {(d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp)}
    assert {tuple(r) for r in simhash.report(docs).select("doc_id", "fingerprint", "component_id").collect()} == want


@pytest.mark.parametrize("hot", [8192, 16])
def test_links_of_dense_groups(spark, monkeypatch, hot):
    """Chains and clouds of near fingerprints; a low limit sends their keys through the tiles across tasks."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = random.Random(5)
    fps = set()
    for _ in range(4):
        x = rnd.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            for b in rnd.sample(range(64), 3):
                x ^= 1 << b
        for _ in range(60):
            fps.add(x ^ sum(1 << b for b in rnd.sample(range(64), 2)))
    fps = sorted(fps | {rnd.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    groups = {}
    for f, c in zip(fps, brute_components(fps)):
        groups.setdefault(c, set()).add(signed(f))
    mine = {}
    for f in fps:
        mine.setdefault(got.get(signed(f), signed(f)), set()).add(signed(f))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_simhash_odd_documents(odd_docs, no_docs, clashing):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.report(odd_docs).collect()}
    assert {(1, "0" * 16, 1), (2, "0" * 16, 1), (3, "0" * 16, 1)} <= got
    assert [c for d, _, c in got if d == 7] == [6]
    assert simhash.report(odd_docs).count() == odd_docs.count()
    assert simhash.report(no_docs).count() == 0 and simhash.deduplicated(no_docs).count() == 0
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 8, 9, 10]
    two = simhash.deduplicated(clashing)
    assert two.columns == clashing.columns and sorted(r.doc_id for r in two.collect()) == [1, 3]


def test_documents_without_ids_are_kept(make_docs):
    docs = make_docs((None, "first text of some words"), (None, "quite another text with words"), (None, "first text of some words"), (3, "quite another text with words"), (4, ""), (None, None))
    got = sorted((r.doc_id or -1, r.text or "") for r in simhash.deduplicated(docs).collect())
    assert got == [(-1, "first text of some words"), (3, "quite another text with words"), (4, "")]
