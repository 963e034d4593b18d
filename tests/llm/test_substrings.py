"""Repeated word sequences against a dictionary of all windows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartline.llm import substrings
from chartline.llm.common import tables


def brute(rows, size=20):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i:i + size]), (d, i))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] != (d, i):
                gone[i:i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("group", [20_000, 25])
def test_equals_brute_force(spark, group):
    docs = tables(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(substrings.report(docs, group)) == brute(rows)


@pytest.mark.parametrize("group", [20_000, 7])
def test_hand_made(make_docs, group):
    a = [f"a{i}" for i in range(60)]
    b = [f"b{i}" for i in range(60)]
    rows = [(5, " ".join(a)), (3, " ".join(b[:10] + a[20:45] + b[10:])), (9, "x " * 70), (4, " ".join(a[:19])), (7, "  ".join(a[30:] + b[:19])), (8, " ".join(a)), (11, "x " * 25),
            (12, "p q " * 40), (13, "\t".join(b[:40])), (14, " ".join(a[10:29])), (15, " ".join(a[10:30]))]
    assert result(substrings.report(make_docs(*rows), group)) == brute(rows)


def test_odd_documents(odd_docs, no_docs, clashing):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.report(odd_docs).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (7, 60_000, 60_000), (8, 2, 0), (None, 5, 0)} <= got
    # the long text repeats itself every 977 words
    assert [g for g in got if g[0] == 6] == [(6, 60_000, 60_000 - 977)]
    assert substrings.report(odd_docs).count() == odd_docs.count()
    assert substrings.report(no_docs).count() == 0
    kept = substrings.deduplicated(clashing)
    assert kept.columns == clashing.columns and kept.where("text = 'other words'").count() == 1


def test_rows_with_one_id_and_different_texts(make_docs):
    a = " ".join(f"a{i}" for i in range(30))
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.report(make_docs((1, a), (1, "b " + a), (2, a))).collect())
    assert [g[:2] for g in got] == [(1, 30), (1, 31), (2, 30)] and got[2][2] == 30 and sorted(g[2] for g in got[:2]) in ([0, 30], [0, 31])


def test_texts_without_ids_are_different_documents(make_docs):
    """At the same place of two texts without an id, or of one id, a passage is still a repeat."""
    a = " ".join(f"a{i}" for i in range(40))
    for i in (None, 4):
        got = sorted(r.n_removed for r in substrings.report(make_docs((i, a + " x"), (i, a + " y"), (i, a + " y"))).collect())
        assert got in ([0, 40, 40], [0, 0, 40])


def test_columns_of_any_name(make_docs):
    d = make_docs((1, "some words"), (2, "others"))
    for c in ("row", "runs", "tag", "doc", "kept", "_runs", "_doc"):
        d = d.withColumn(c, F.lit(c))
    got = substrings.deduplicated(d)
    assert got.columns == d.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, d.collect()))


def test_bitmap_has_every_key(spark):
    keys = [0, 1, -1, 1 << 62, -(1 << 63), 123456789 << 20]
    seen = substrings.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"), 10)
    u = np.array(keys, np.int64).view(np.uint64) >> np.uint64(54)
    assert all(int(seen[int(x >> np.uint64(6))]) >> int(x & np.uint64(63)) & 1 for x in u)
    assert sum(int(x).bit_count() for x in seen) == len({int(x) for x in u})
