"""Near-dedup at 0.8: recall against all pairs, no pair below, large groups, odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartline.llm import simhash_near as near
from chartline.llm.common import tables


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i:i + n]) for i in range(max(len(w) - n, 0) + 1)) if w else frozenset()


def alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def all_pairs(sets, limit=0.8):
    """Pairs of documents at the limit, by an inverted index; equal sets included."""
    of = {}
    for i, s in enumerate(sets):
        for x in s:
            of.setdefault(x, []).append(i)
    seen = {(i, j) for v in of.values() for k, i in enumerate(v) for j in v[k + 1:]} | {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if not sets[i] and not sets[j]}
    return {(i, j) for i, j in seen if alike(sets[i], sets[j]) >= limit}


def roots(df):
    return {r["doc_id"]: r["root"] for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_documents(spark, sf):
    rows = tables(spark, f"/root/testdata/{sf}", "documents").select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    pairs = all_pairs(sets)
    root = roots(near.clusters(tables(spark, f"/root/testdata/{sf}", "documents")))
    found = {(i, j) for i, j in pairs if root[rows[i].doc_id] == root[rows[j].doc_id]}
    unequal = {(i, j) for i, j in pairs if sets[i] != sets[j]}
    print(sf, len(pairs), len(found), len(unequal), len(found & unequal))
    assert len(found) >= 0.9 * len(pairs) and len(found & unequal) >= 0.9 * len(unequal)
    # components are those of pairs at the limit, or parts of them
    comp = list(range(len(rows)))
    for _ in rows:
        new = comp[:]
        for i, j in pairs:
            new[i] = new[j] = min(new[i], new[j])
        if new == comp:
            break
        comp = new
    assert len({(c, root[r.doc_id]) for c, r in zip(comp, rows)}) == len(set(root.values()))


def copies(seed, n, words, changed):
    """n texts made of one by changing a share of its words."""
    g = random.Random(seed)
    base = [f"w{g.randrange(10**6)}" for _ in range(words)]
    return [" ".join(f"z{g.randrange(10**9)}" if g.random() < changed else w for w in base) for _ in range(n)]


def test_recall_near_the_limit_and_large_groups(spark, make_docs):
    texts = [t for s in range(60) for t in copies(s, 3, 150, 0.011)] + copies(99, 400, 120, 0.008)
    sets = [shingles(t) for t in texts]
    root = roots(near.clusters(make_docs(*enumerate(texts)).repartition(4)))
    pairs = [(i, j) for i in range(180) for j in range(i + 1, 180) if alike(sets[i], sets[j]) >= 0.8]
    assert sum(root[i] == root[j] for i, j in pairs) >= 0.9 * len(pairs)
    big = [root[i] for i in range(180, 580)]
    assert max(big.count(r) for r in set(big)) >= 0.9 * 400
    assert len({root[i] for i in range(180)} & set(big)) == 0


def test_tiles_against_all_pairs():
    g = np.random.default_rng(2)
    f = np.repeat(g.integers(0, 1 << 63, (40, 2), dtype=np.uint64), 30, 0)
    for _ in range(12):
        f ^= np.where(g.random(f.shape) < 0.7, np.uint64(1) << g.integers(0, 64, f.shape, dtype=np.uint64), np.uint64(0))
    node = g.permutation(len(f)) * 3
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(-1)
    row, other, alone = near._tiles(node, f, near.RADIUS)
    least, nearest = other[: len(other) // 2], other[len(other) // 2:]
    want = {}
    for i in range(len(f)):
        c = [(int(node[j]), int(d[i, j])) for j in np.flatnonzero((d[i] <= near.RADIUS) & (node < node[i]))]
        if c:
            want[i] = (min(c)[0], min((k, n) for n, k in c)[1])
    half = row[: len(row) // 2]
    assert {int(i): (int(a), int(b)) for i, a, b in zip(half, least, nearest)} == want and sorted(alone.tolist()) == [i for i in range(len(f)) if i not in want]


def test_salted_keys_meet_again(spark):
    """A key with more nodes than a part takes is still one group."""
    g = np.random.default_rng(4)
    n = near.HOT * 2 + 100
    f = np.full((n, 2), 12345, np.uint64) ^ (np.uint64(1) << g.integers(0, 64, (n, 2), dtype=np.uint64))
    rows = spark.createDataFrame([(7, i % 3, 3, i, int(a), int(b)) for i, (a, b) in enumerate(f.view(np.int64).tolist())], "key long, salt long, parts long, node long, f1 long, f2 long")
    found = near._met(rows, near.RADIUS)
    ends = {r["a"] for r in found.where("b IS NULL").collect()}
    assert ends == {0, 1, 2} and found.where("b IS NOT NULL").count() >= n - 3


def test_remaining_pairs_of_long_keys(spark, monkeypatch):
    """All candidates between different components of a long key, each in bounded cells; none of a key of one component."""
    monkeypatch.setattr(near, "PART", 16)
    g = np.random.default_rng(5)
    n = 150
    f = np.repeat(g.integers(0, 1 << 63, (3, 2), dtype=np.uint64), n // 3, 0)
    for _ in range(10):
        f ^= np.where(g.random(f.shape) < 0.7, np.uint64(1) << g.integers(0, 64, f.shape, dtype=np.uint64), np.uint64(0))
    root = np.where(np.arange(n) % 3 == 0, np.arange(n), 1000 + np.arange(n) % 2)
    keyed = [(k, i, int(a), int(b)) for k in (7, 8) for i, (a, b) in enumerate(f.view(np.int64).tolist())]
    keyed += [(9, i + 500, *f.view(np.int64)[0].tolist()) for i in range(60)] + [(10, i + 700, *f.view(np.int64)[0].tolist()) for i in range(near.SHORT)]
    rows = spark.createDataFrame(keyed, "key long, node long, f1 long, f2 long")
    roots_ = spark.createDataFrame([(i, int(r)) for i, r in enumerate(root) if i != r] + [(i + 500, 500) for i in range(1, 60)], "node long, root long")
    got = {(r.a, r.b) for r in near.remaining(rows, roots_).collect()}
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(-1)
    assert got == {(i, j) for i in range(n) for j in range(i) if d[i, j] <= near.RADIUS and root[i] != root[j]}


def test_no_link_of_a_long_key_is_lost(spark, make_docs):
    """Two groups of near copies joined by one text: its link to the second group is neither to the nearest nor to the least."""
    g = random.Random(12)
    base = [f"w{g.randrange(10**6)}" for _ in range(400)]
    texts = []
    for k in range(90):
        w = base[:]
        for at in g.sample(range(400), 1 + k % 9):
            w[at] = f"z{g.randrange(10**9)}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    root = roots(near.clusters(make_docs(*enumerate(texts)).repartition(4)))
    pairs = [(i, j) for i in range(90) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    assert all(root[i] == root[j] for i, j in pairs)


def test_odd_rows(odd_docs, no_docs, clashing):
    got = near.deduplicated(odd_docs)
    assert got.columns == odd_docs.columns
    # empty, blank and null texts are one group; the two long ones, the repeated rows another each
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 8), (False, 9), (False, 10), (True, 0)]
    assert near.deduplicated(no_docs).count() == 0
    d = clashing.withColumn("node", F.lit(1)).withColumn("_keep_id", F.lit(2)).withColumn("f1", F.lit(3))
    assert [(r["doc_id"], r["node"], r["_keep_id"], r["f1"]) for r in near.deduplicated(d).orderBy("doc_id").collect()] == [(1, 1, 2, 3), (3, 1, 2, 3)]


def test_marks_lose_no_similar_pair():
    g = np.random.default_rng(11)
    own = [np.unique(g.integers(0, 1 << 32, n, dtype=np.uint64)) for n in (1, 40, 300, 5000)]
    sets = []
    for s in own:
        for gone in (0.0, 0.05, 0.11, 0.19, 0.2, 0.24, 0.5):
            keep = s[int(len(s) * gone):]
            sets += [keep, np.unique(np.concatenate((keep[len(keep) // 20:], g.integers(0, 1 << 32, len(keep) // 20, dtype=np.uint64))))]
    off = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    short, cut = near.short_sets(np.concatenate(sets) << np.uint64(32), off)
    bits, size = near.marks(short, cut), np.diff(cut)
    assert np.array_equal(cut, off)
    told = 0
    for i, p in enumerate(sets):
        for j, q in enumerate(sets):
            same = len(np.intersect1d(p, q))
            passes = np.bitwise_count(bits[i] ^ bits[j]).sum(dtype=int) <= near.allowed(0.8) * (size[i] + size[j]) + 1e-6
            assert passes or same < 0.8 * (len(p) + len(q) - same)
            told += not passes
    assert told > 1000


def test_pairs_compared_grow_with_a_group(spark, make_docs, monkeypatch):
    """Texts that share three quarters of their words are candidates of each other but not similar: next to none are read."""
    seen, plain = [], near.confirmed

    def counted(docs, nodes, pairs, *rest):
        seen.append(pairs.count())
        return plain(docs, nodes, pairs, *rest)

    monkeypatch.setattr(near, "confirmed", counted)
    g = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[:228] + [f"x{t}y{g.random()}" for _ in range(72)]) for t in range(300)]
    root = roots(near.clusters(make_docs(*enumerate(texts)).repartition(4)))
    assert len(set(root.values())) == 300 and sum(seen) < 300
