"""Correlations of sparse columns against numpy, and of very many against products of shared entities."""

from collections import Counter

import numpy as np
import pytest

from chartline.operators import sparse_correlation as sc


def long_of(spark, x, names=None):
    i, j = np.nonzero(x)
    rows = [(int(a), (names or [f"f{k:05d}" for k in range(x.shape[1])])[b], float(x[a, b])) for a, b in zip(i, j)]
    return spark.createDataFrame(rows, "entity int, feature string, value double"), spark.range(x.shape[0]).selectExpr("cast(id as int) entity", "cast(id % 3 = 0 as int) label")


def numpy_pairs(x, limit):
    with np.errstate(all="ignore"):
        c = np.corrcoef(x.T)
    return {(f"f{i:05d}", f"f{j:05d}"): c[i, j] for i in range(len(c)) for j in range(i + 1, len(c)) if abs(c[i, j]) > limit}


def table(n=400):
    g = np.random.default_rng(3)
    x = np.where(g.random((n, 40)) < 0.03, g.integers(1, 5, (n, 40)), 0).astype(float)
    d = g.normal(size=(n, 6)) * 0.01
    d[:, 1] = d[:, 0] * 3 + 7  # dense, shifted
    d[:, 2] = np.where(g.random(n) < 0.6, 1.0, 0.0)
    d[:, 3] = 1 - d[:, 2]  # complements: no entity shared
    d[:, 4] = x[:, 0] * 5 + d[:, 4] * 0.1  # spikes where a sparse column is, noise elsewhere
    d[:, 5] = 9 + x[:, 1]  # a constant added to a sparse column
    x[:, 10] = -2 * x[:, 11]
    x[:, 12] = x[:, 13] + np.where(g.random(n) < 0.003, 1.0, 0.0)
    x[:, 14] = 4.0
    x[:, 15] = 0.0
    x[:, 16] = 0.0
    x[7, 15] = x[7, 16] = 1.0
    return np.concatenate((x, d), 1)


@pytest.mark.parametrize("limit", [0.98, 0.9, 0.7, 0.4])
def test_equal_to_numpy(spark, limit):
    x = table()
    long, who = long_of(spark, x)
    got = {(r["a"], r["b"]): r["corr"] for r in sc.correlated_pairs(long, who, limit).collect()}
    want = numpy_pairs(x, limit)
    assert got.keys() == want.keys() and len(want) >= 6
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fifty_thousand_sparse_columns(spark):
    n, k, limit = 3000, 50_000, 0.98
    g = np.random.default_rng(8)
    cols = [np.unique(g.integers(0, n, g.integers(2, 7))) for _ in range(k)]
    vals = [g.integers(1, 4, len(c)).astype(float) for c in cols]
    for j in range(0, k, 100):  # copies and multiples
        cols[j + 1], vals[j + 1] = cols[j], vals[j] * 2.5
    rows = [(int(e), f"f{j:05d}", float(v)) for j in range(k) for e, v in zip(cols[j], vals[j])]
    import pandas as pd

    long = spark.createDataFrame(pd.DataFrame(rows, columns=["entity", "feature", "value"]))
    got = {(r["a"], r["b"]): r["corr"] for r in sc.correlated_pairs(long, spark.range(n).withColumnRenamed("id", "entity"), limit).collect()}
    # all pairs that share an entity; others have a negative correlation near 0
    e, f, v = (np.concatenate(z) for z in zip(*[(c, np.full(len(c), j), w) for j, (c, w) in enumerate(zip(cols, vals))]))
    dot: Counter = Counter()
    by = np.argsort(e, kind="stable")
    key, val = [], []
    for part in np.split(by, np.flatnonzero(np.diff(e[by])) + 1):
        i, j = np.triu_indices(len(part), 1)
        a, b = np.minimum(f[part[i]], f[part[j]]), np.maximum(f[part[i]], f[part[j]])
        key.append(a * k + b)
        val.append(v[part[i]] * v[part[j]])
    key, back = np.unique(np.concatenate(key), return_inverse=True)
    dot = np.bincount(back, np.concatenate(val))
    s1, s2 = np.bincount(f, v, k), np.bincount(f, v * v, k)
    a, b = key // k, key % k
    c = (dot - s1[a] * s1[b] / n) / np.sqrt((s2[a] - s1[a] ** 2 / n) * (s2[b] - s1[b] ** 2 / n))
    want = {(f"f{i:05d}", f"f{j:05d}"): x for i, j, x in zip(a[c > limit].tolist(), b[c > limit].tolist(), c[c > limit].tolist())}
    assert len(want) >= 500 and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_drops_leave_one_of_each_group(spark):
    x = table()
    long, spine = long_of(spark, x)
    gone = {r["feature"]: r["same_as"] for r in sc.correlated_drops(long, spine, 0.9).collect()}
    pairs = numpy_pairs(x, 0.9)
    assert all(a in gone or b in gone for a, b in pairs) and all(s not in gone and tuple(sorted((f, s))) in pairs for f, s in gone.items())
    y = (np.arange(len(x)) % 3 == 0).astype(float)
    own = {f"f{j:05d}": round(abs(np.corrcoef(x[:, j], y)[0, 1]), 12) for j in range(x.shape[1]) if x[:, j].std() > 0}
    assert all((own[s], f) >= (own[f], s) or own[s] > own[f] for f, s in gone.items())


def test_label_correlation_far_from_zero(spark):
    """Large means cancel nothing."""
    g = np.random.default_rng(1)
    x = 1e8 + g.normal(size=(300, 1))
    long, spine = long_of(spark, x)
    y = (np.arange(300) % 3 == 0).astype(float)
    assert sc.label_correlation(long, spine).first()["corr"] == pytest.approx(np.corrcoef(x[:, 0] - 1e8, y)[0, 1], abs=1e-6)


def test_dense_pairs_come_from_block_sums(spark, monkeypatch):
    """Pairs of dense columns are not expanded into rows of entities; batches may cut an entity's rows."""
    g = np.random.default_rng(12)
    x = np.where(g.random((700, 12)) < 0.4, g.integers(1, 9, (700, 12)), 0).astype(float)
    x[:, 5] = x[:, 2] * 0.5 + x[:, 4] * 0.2
    x[:, 8] = np.where(x[:, 3] > 0, 0, 2)
    x[:, 9] = np.where((x[:, 1] >= 8) & (g.random(700) < 0.7), 3, 0)  # sparse, follows a dense column
    x[:40] = 0  # entities without any feature
    long, who = long_of(spark, x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["a"], r["b"]): r["corr"] for r in sc.correlated_pairs(long, who, 0.3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = numpy_pairs(x, 0.3)
    assert got.keys() == want.keys() and len(want) >= 3 and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    counts = []
    cut = sc.cut_lineage

    def counted(df):
        out = cut(df)
        if "other" in df.columns:
            counts.append(out.count())
        return out

    monkeypatch.setattr(sc, "cut_lineage", counted)
    sc.correlated_pairs(long.where("feature <> 'f00009'"), who, 0.3).collect()
    assert counts == [0]  # pairs to be read row by row
