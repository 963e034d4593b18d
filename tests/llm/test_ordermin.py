"""Order MinHash against a plain version, and its sense of order."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from chartline.llm import ordermin
from chartline.llm.common import tables

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def h64(data: bytes, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def longs(values, seed=42):
    for v in values:
        seed = h64(struct.pack("<Q", v & MASK), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain(text, k=3, tup=2, size=64, bits=16):
    """The signature by its definition: numbered k-mers, minima in rotated orders, text order."""
    units = [h64(u.encode()) for u in re.findall(r"[^\x20\x09-\x0D]{1,4}", text or "")]
    if not units:
        return []
    seen, mers = {}, []
    for i in range(max(len(units) - k, 0) + 1):
        v = signed(longs(units[i:i + k])) >> 28
        occ = seen.get(v, 0)
        seen[v] = occ + 1
        mers.append((signed(h64(struct.pack("<I", occ), longs([v]))) >> 28 if occ else v, i))
    out = []
    for j in range(size):
        low = (j - size // 2) * (1 << 36) // size
        turn = sorted(mers, key=lambda m: ((m[0] - low) % (1 << 36), m[1]))[:tup]
        out.append(longs([v & ((1 << 36) - 1) for v, _ in sorted(turn, key=lambda m: (m[1], m[0]))]) & ((1 << bits) - 1))
    return out


def like(a, b):
    return 1.0 if not a and not b else sum(x == y for x, y in zip(a, b)) / max(len(a), len(b), 1)


def brute(rows):
    """Rows of the contract from (doc_id, text) rows."""
    distinct = sorted({(i is None, -(i or 0), signed(h64((t or "").encode())), t or "") for i, t in rows})
    after = {d: distinct[(n + 1) % len(distinct)] for n, d in enumerate(distinct)}
    out = []
    for i, t in rows:
        d = (i is None, -(i or 0), signed(h64((t or "").encode())), t or "")
        text, nxt = t or "", after[d][3]
        cut = len(text) // 3
        new = text[:len(text) - cut] + nxt[:cut]
        a, b, c = plain(text), plain(new), plain(nxt)
        hexed = lambda s: "".join(f"{x:04x}" for x in s)
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), hexed(a), hexed(b), like(a, b), like(a, c)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equal_to_brute_force(spark):
    d = tables(spark, SF, "documents")
    assert got(ordermin.report(d)) == brute([(r["doc_id"], r["text"]) for r in d.collect()])


def test_odd_rows(odd_docs, clashing, no_docs, make_docs):
    """Nulls, blanks, repeated rows and ids, long texts, one unit, unusual letters, clashing columns, empty tables."""
    for d in (odd_docs.where("doc_id IS NULL OR doc_id NOT IN (6, 7)"), clashing, make_docs((5, "alone")), make_docs((1, "a b"), (1, "b a"), (1, "b a"), (None, "x"), (None, None))):
        assert got(ordermin.report(d)) == brute([(r["doc_id"], r["text"]) for r in d.collect()])
    assert ordermin.report(no_docs).collect() == []


@pytest.mark.parametrize("text", ["w " * 3000, "ab cd " * 500 + "ef", "x" * 5000, "é漢😀 " * 40])
def test_repeated_kmers_are_numbered(spark, text):
    d = spark.createDataFrame([(text,)], "text string")
    assert d.select(ordermin.fingerprint(F.col("text"))).first()[0] == plain(text)


def test_settings(spark):
    d = spark.createDataFrame([("some words in some order and some more of them",)], "text string")
    for k, t, size, bits in ((1, 3, 16, 20), (2, 1, 32, 31), (5, 4, 8, 8)):
        assert d.select(ordermin.fingerprint(F.col("text"), k, t, size, bits)).first()[0] == plain("some words in some order and some more of them", k, t, size, bits)


def test_order_matters(spark):
    """The same k-mers in another order are less alike than with a few words changed."""
    a = [f"word{i}" for i in range(400)]
    swapped = a[200:] + a[:200]
    few = [*a[:100], "other", *a[101:]]
    d = spark.createDataFrame([(" ".join(a), " ".join(swapped), " ".join(few), " ".join(reversed(a)))], "a string, s string, f string, r string")
    fp = {c: ordermin.fingerprint(F.col(c)) for c in d.columns}
    s, f, r = d.select(*[ordermin.likeness(fp["a"], fp[c]) for c in "sfr"]).first()
    assert f > 0.9 > 0.7 > s > r
