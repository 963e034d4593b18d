"""Percentile intervals against a plain loop over draws."""

import hashlib

import numpy as np
import pytest

from chartline.operators import resample

SCHEMA = "entity int, label int, score double"


def plain(rows, threshold, draws):
    rows = [r for r in rows if r[2] is not None]
    s, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    w = np.ones((draws + 1, len(rows)))
    for i, r in enumerate(rows):
        for d in range(draws):
            h = hashlib.sha256(f"{r[0]}|42|{d // 8}".encode()).hexdigest()[8 * (d % 8):8 * (d % 8) + 8]
            w[d + 1, i] = sum(int(h, 16) / 2**32 >= c for c in resample.POISSON)
    out = []
    for v in w:
        p, q = v * (y == 1), v * (y == 0)
        P, N, hit = p.sum(), q.sum(), s >= threshold
        u = sum(p[i] * (q[s < s[i]].sum() + q[s == s[i]].sum() / 2) for i in range(len(s)))
        above = [(p[s >= x].sum(), q[s >= x].sum()) for x in s]
        ap = sum(p[i] * a / (a + b) for i, (a, b) in enumerate(above) if a + b)
        tp, fp = p[hit].sum(), q[hit].sum()
        div = lambda a, b: a / b if b else np.nan
        out.append([div(u, P * N), div(ap, P), div(tp, P), div(N - fp, N), div(tp, tp + fp), div(N - fp, N - fp + P - tp)])
    out = np.array(out)
    return {n: (out[0, i], *np.nanpercentile(out[1:, i], [2.5, 97.5])) for i, n in enumerate(resample.METRICS)}


@pytest.mark.parametrize("kind", ["spread", "hot score", "few scores"])
def test_equal_to_a_loop(spark, monkeypatch, kind):
    g = np.random.default_rng(5)
    n = 300
    score = {"spread": g.random(n).round(3), "hot score": np.where(g.random(n) < 0.6, 0.5, g.random(n).round(2)), "few scores": g.integers(0, 3, n) / 3}[kind]
    rows = [(i, int(g.random() < 0.3 + 0.4 * x), float(x)) for i, x in enumerate(score)] + [(900, 1, None)]
    got = {r["metric"]: (r["point"], r["lo"], r["hi"]) for r in resample.bootstrap(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.5, 60).collect()}
    want = plain(rows, 0.5, 60)
    assert set(got) == set(want)
    for m in want:
        assert got[m] == pytest.approx(want[m], abs=1e-9), m


def test_one_class_and_no_rows(spark):
    got = {r["metric"]: r for r in resample.bootstrap(spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.9)], SCHEMA), 0.5, 20).collect()}
    assert got["auroc"]["point"] is None and got["sensitivity"]["point"] == 0.5 and got["ppv"]["point"] == 1.0
    assert all(r["point"] is None for r in resample.bootstrap(spark.createDataFrame([], SCHEMA), 0.5, 20).collect())


def test_weights_at_the_limits():
    """Draws next to a limit of the distribution, and the digests read once for each row."""
    got = resample.weights(["7", "x"], 1003, "9")
    for row, name in zip(got, ("7", "x")):
        for d in range(1003):
            u = int(hashlib.sha256(f"{name}|9|{d // 8}".encode()).hexdigest()[8 * (d % 8):8 * (d % 8) + 8], 16)
            assert row[d + 1] == sum(u / 2**32 >= c for c in resample.POISSON)
    for c, limit in zip(resample.POISSON, resample.LIMITS.tolist()):
        assert limit / 2**32 >= c > (limit - 1) / 2**32


def test_each_row_is_drawn_once(spark, monkeypatch, tmp_path):
    log, plain = tmp_path / "ids", resample._scores

    def scores(batches, draws, seed):
        def seen():
            for b in batches:
                with open(log, "a") as f:
                    f.write("".join(f"{i}\n" for i in b.column("id").to_pylist()))
                yield b

        return plain(seen(), draws, seed)

    monkeypatch.setattr(resample, "_scores", scores)
    rows = [(i, i % 2, i / 500) for i in range(500)]
    assert resample.bootstrap(spark.createDataFrame(rows, SCHEMA), 0.5, 20).count() == 6
    assert sorted(map(int, log.read_text().split())) == list(range(500))

