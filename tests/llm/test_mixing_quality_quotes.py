"""Entropy balancing, the weak-label classifier and quotation linking."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartline.llm import balance, quality, quotes
from chartline.llm.common import n_words, tables
from tests import oracle

SF = "/root/testdata/sf0.01"


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """The contract's words: shares of all words, capped, the excess reshared until none is above."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, left, total = {}, set(names), sum(sizes.values())
    while left:
        share = (total - sum(done.values())) / sum(w[s] for s in left)
        over = [s for s in left if w[s] * share > cap * sizes[s]]
        if not over:
            return done | {s: w[s] * share for s in left}
        for s in over:
            done[s] = cap * sizes[s]
            left.discard(s)
    return done


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 7, "é": 400, "z": 1}, {"a": 1, "b": 1, None: 50}, {"q": 10}, {"a": 0, "b": 30, "c": 0}, {f"s{i:02}": (i * 37) % 11 for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in balance.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_mix(spark):
    docs = tables(spark, SF, "documents")
    rows = balance.report(docs).collect()
    text = {r.doc_id: r for r in docs.collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in text.items()}
    per, biggest = {}, {}
    for r in rows:
        s = text[r.doc_id].source
        assert r.size == size[r.doc_id] and r.taken <= 3 * r.size
        per.setdefault(s, [0, 0, r.target])
        per[s][0] += r.size
        per[s][1] += r.taken
        biggest[s] = max(biggest.get(s, 0), r.size)
    want = plain_targets({s: v[0] for s, v in per.items()})
    for s, (_, taken, target) in per.items():
        assert math.isclose(target, want[s], rel_tol=1e-9)
        assert abs(taken - target) <= biggest[s]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, balance.report(docs).collect()))
    # the balanced rates keep the mean of log2(1 + size) over words, where no cap is in the way
    mass = sum(r.size for r in rows)
    z = sum(r.size * math.log2(1 + r.size) for r in rows) / mass
    tilted = sum(r.rate * r.size * math.log2(1 + r.size) for r in rows) / sum(r.rate * r.size for r in rows)
    assert abs(tilted - z) < 1e-3
    out = balance.remix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)


def test_newton_finds_the_dual_optimum(spark):
    """Rates solve min KL under the constraints: compared with a direct solution in numpy."""
    rng = np.random.default_rng(3)
    cells = [(s, int(rng.integers(1, 500)), int(rng.integers(1, 4))) for s in "abc" for _ in range(30)]
    df = spark.createDataFrame(cells, "source string, size long, n long").groupBy("source", "size").agg(F.sum("n").alias("n"))
    size = {s: sum(c[1] * c[2] for c in cells if c[0] == s) for s in "abc"}
    goal = spark.createDataFrame([(s, size[s], f * size[s]) for s, f in zip("abc", (0.4, 1.3, 2.2))], "source string, source_size long, target double")
    lam, rate = balance.rates(df, goal, balance.length_profile())
    got = df.join(lam, "source").withColumn("rate", rate).collect()
    m = np.array([r.size * r.n for r in got], float)
    w = np.array([r.rate for r in got])
    z = np.log2(1 + np.array([r.size for r in got]))
    mean = (m * z).sum() / m.sum()
    src = np.array([r.source for r in got])
    for s, f in zip("abc", (0.4, 1.3, 2.2)):
        assert abs((m * w)[src == s].sum() / size[s] - f) < 1e-5
    assert abs((m * w * (z - mean)).sum()) < 1e-4 * m.sum()
    assert w.max() <= 3
    # tilted exponentially: below the cap log w is linear in z with one slope for all sources
    slopes = []
    for s in "abc":
        i = (src == s) & (w < 3 - 1e-9)
        slopes.append(np.polyfit(z[i], np.log(w[i]), 1)[0])
    assert max(slopes) - min(slopes) < 1e-6


@pytest.mark.parametrize("kinds", [{"a": [20] * 300, "b": [5000] * 12}, {"a": [7] * 200, "b": [90] * 60, "c": [800] * 20},
                                   {"a": [3, 4, 5] * 80, "b": [2000, 3000] * 8, "c": [1, 4000] * 6}])
def test_targets_are_met_whatever_the_sizes(make_docs, kinds):
    """Sources whose documents differ in length: no rates keep the mean length, or only extreme ones do."""
    docs = [(s, n) for s, ns in kinds.items() for n in ns]
    rows = balance.report(make_docs(*((i, "w " * n, s) for i, (s, n) in enumerate(docs)))).collect()
    want = plain_targets({s: sum(ns) for s, ns in kinds.items()})
    for s, ns in kinds.items():
        assert abs(sum(r.taken for r in rows if docs[r.doc_id][0] == s) - want[s]) <= max(ns) / 2 + 1e-4 * sum(ns)


def test_targets_above_the_cap_are_an_error(spark):
    cells = spark.createDataFrame([("a", 10, 1)], "source string, size long, n long")
    with pytest.raises(ValueError):
        balance.tilt(cells, spark.createDataFrame([("a", 10, 31.0)], "source string, source_size long, target double"))


def test_mix_of_odd_documents(odd_docs, no_docs, clashing, make_docs):
    rows = balance.report(odd_docs).collect()
    assert len(rows) == odd_docs.count() and balance.report(no_docs).count() == 0 and balance.remix(no_docs).count() == 0
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert balance.remix(odd_docs).columns == odd_docs.columns
    out = balance.remix(clashing)
    assert out.columns == clashing.columns and out.where("size = 'own'").count() == out.count() > 0
    empty = balance.report(make_docs((1, ""), (2, None))).collect()
    assert [(r.size, r.taken, r.target) for r in empty] == [(0, 0, 0.0)] * 2
    same = balance.report(make_docs(*[(5, "a b c d")] * 3)).collect()
    assert len(same) == 3 and len({tuple(r) for r in same}) == 1


def test_word_counts(spark):
    texts = ["", None, " ", "a", " a  b\t\nc\x0bd\x0ce\rf ", "é x", "x" * 10]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(n_words(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_labellers_estimated(spark):
    """EM finds how good simulated labellers are, and the posterior separates the classes."""
    rng = np.random.default_rng(8)
    n, counts = 20_000, {}
    bad = rng.random(n) < 0.15
    kind = rng.integers(0, 3, n)
    hit = {0: (0, 2, 5), 1: (1, 0, 7), 2: (4, 6, 7)}
    votes = np.zeros((n, 8), int)
    for k, ls in hit.items():
        for x in ls:
            i = bad & (kind == k)
            votes[i, x] = rng.random(i.sum()) < 0.9
    votes[~bad] = rng.random((int((~bad).sum()), 8)) < 0.01
    votes[rng.random((n, 8)) < 0.1] = 2
    for c in votes @ 3 ** np.arange(8):
        counts[int(c)] = counts.get(int(c), 0) + 1
    post, table, prior = quality.estimate(counts)
    p = np.array([post[int(c)] for c in votes @ 3 ** np.arange(8)])
    assert ((p > 0.5) == bad).mean() > 0.97
    assert abs(prior[0] - 0.85) < 0.03 and np.abs(table[0] - 0.01).max() < 0.01


def test_classifier_against_held_out_labels(spark):
    d, labels = tables(spark, "/root/testdata/sf0.1", "documents"), tables(spark, "/root/testdata/sf0.1", "labels")
    n = {(r.quality, r.keep): r["count"] for r in quality.report(d).join(labels, "doc_id").groupBy("quality", "keep").count().collect()}
    good = n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0))
    bad = n.get((0, False), 0) / (n.get((0, True), 0) + n.get((0, False), 0))
    assert good > 0.995 and bad > 0.95


def test_scores_do_not_depend_on_batches():
    texts = pa.array(["a b c. " * 30, None, "x", "", "ab", "!!! ??? " * 40, "é"])
    rng = np.random.default_rng(0)
    w, v = rng.random(quality.BUCKETS), rng.random(quality.SHAPES)

    def score(t):
        tri, to, shape, so = quality.Measured(t).features()
        return quality._mean(w, tri, to) + quality._mean(v, shape, so)

    whole = score(texts)
    assert np.allclose(whole, np.concatenate([score(texts.slice(i, 1)) for i in range(len(texts))]))
    assert np.array_equal(quality.Measured(texts).votes(), np.concatenate([quality.Measured(texts.slice(i, 1)).votes() for i in range(len(texts))]))


def test_quality_of_odd_documents(odd_docs, no_docs, clashing):
    got = {r.doc_id: r.keep for r in quality.report(odd_docs).collect()}
    assert not got[1] and not got[2] and not got[3] and quality.report(odd_docs).count() == odd_docs.count()
    assert quality.report(no_docs).count() == 0 and quality.accepted(no_docs).count() == 0
    assert quality.accepted(clashing).columns == clashing.columns and quality.accepted(odd_docs).columns == odd_docs.columns


THREAD = [
    (1, 0, "user", "Hello there.\nHow do I sort a table?\nThanks"),
    (1, 1, "assistant", "On Monday user wrote:\n> How do I sort a table?\nWith ORDER BY.\nIt takes columns."),
    (1, 2, "user", "> > How do I sort a table?\n> With ORDER   BY.\n> It takes columns.\nAnd descending?"),
    (1, 3, "user", "A new question about joins."),
    (1, 4, "assistant", ">> With ORDER BY.\n> And descending?\nUse DESC.\n\nOn a b wrote:\n>>> how do i SORT a table\n"),
    (1, 5, "user", "> nobody said this\nok"),
    (2, 0, "user", "> How do I sort a table?\nnot in this conversation"),
    (2, 1, "user", "x > y is no quote"),
    (None, 3, "user", "> How do I sort a table?\nq"), (3, None, "user", "> a\nb"), (3, None, "user", "> a\nb"), (3, 1, None, None), (3, 2, "user", ""),
]


def conversations(spark):
    return spark.createDataFrame(THREAD, "conv_id long, turn long, role string, text string")


def test_threads(spark):
    rows = {(r.conv_id, r.turn): r for r in quotes.threads(conversations(spark)).collect()}
    own = {k: r.own_text for k, r in rows.items()}
    assert own[1, 1] == "With ORDER BY.\nIt takes columns." and own[1, 2] == "And descending?" and own[1, 4] == "Use DESC." and own[2, 1] == "x > y is no quote" and own[3, 1] == ""
    parent = {k[1]: r.parent_turn for k, r in rows.items() if k[0] == 1}
    assert parent == {0: None, 1: 0, 2: 1, 3: None, 4: 2, 5: None}
    assert {k[1]: (r.root_turn, r.depth) for k, r in rows.items() if k[0] == 1} == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (3, 0), 4: (0, 3), 5: (5, 0)}
    assert rows[1, 2].n_quoted == 2 and rows[1, 4].n_quoted == 3 and rows[2, 0].parent_turn is None and rows[None, 3].n_quoted == 0
    order = sorted((r.reply_order, r.turn) for k, r in rows.items() if k[0] == 1)
    assert [t for _, t in order] == [0, 1, 2, 4, 3, 5]


def test_threads_equal_sql(spark, tmp_path):
    for df, folder in ((conversations(spark), tmp_path), (None, "/root/testdata/sf0.001")):
        if df is not None:
            df.coalesce(1).write.parquet(str(tmp_path / "c"))
            import duckdb

            con = duckdb.connect()
            con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
        else:
            con, df = oracle.duck(folder), tables(spark, folder, "conversations")
        msg, n = oracle.compare(quotes.threads(df), con, quotes.SQL)
        assert not msg and n == df.count()


def test_long_reply_chain(spark):
    rows = [(9, i, "user", f"line {i}\n" + (f"> line {i - 1}" if i else "")) for i in range(70)]
    got = quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.depth, r.root_turn) for r in got} == {i: (i, 0) for i in range(70)}


def test_no_conversations_and_no_python(spark):
    assert quotes.threads(conversations(spark).limit(0)).count() == 0
    plan = quotes.threads(conversations(spark).withColumn("uid", F.lit("own")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
