"""Helpers on data that a size switch or a crowded range of values would betray."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from chartline import session, skew
from chartline.operators import discover, hygiene, learn, occurrence, split, values
from chartline.sources import tables


def test_crowded_values_spread_over_many_segments(spark):
    df = spark.range(100_000).select((F.col("id") / 100_000 + 36.5).alias("v"), F.lit(1).alias("n"), (F.col("id") % 2).alias("k"))
    coarse, fine = skew.number_buckets(F.col("v"))
    top = df.groupBy("k", fine.alias("b")).count().agg(F.max("count")).first()[0]
    assert top <= 10 and df.groupBy("k", coarse.alias("b")).agg(F.count_distinct(fine).alias("c")).agg(F.max("c")).first()[0] <= 4096
    r = skew.running_total(df, ["k"], "v", ["n"], skew.number_buckets(F.col("v")))
    w = W.partitionBy("k").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    plain = df.withColumn("e", F.coalesce(F.sum("n").over(w), F.lit(0)))
    assert r.join(plain, ["k", "v"]).where("e <> n_before OR n_all <> 50000").count() == 0


def test_buckets_keep_the_order(spark):
    v = sorted([0.0, -0.0, 1e-300, -1e-300, 5e-324, 1.0, -1.0, 1e308, -1e308, 2.0**52, 2.0**52 + 1, 36.6, 36.600001, -7.25, 0.1, 0.3])
    df = spark.createDataFrame([(x,) for x in v], "v double")
    coarse, fine = skew.number_buckets(F.col("v"))
    rows = df.select("v", coarse.alias("c"), fine.alias("f")).orderBy("v").collect()
    assert [r.f for r in rows] == sorted(r.f for r in rows) and [r.c for r in rows] == sorted(r.c for r in rows)


def test_one_month_of_one_key(spark):
    """All readings of a key in one month, many on one day, some equal."""
    rng = np.random.default_rng(1)
    rows = [("e", "c", f"2024-01-{d:02}", float(v), int(100 - d)) for d, v in zip(rng.integers(1, 29, 3000), rng.integers(0, 40, 3000))]
    ev = spark.createDataFrame(rows, "entity string, category string, d string, value double, days_before int").withColumn("event_date", F.to_date("d")).withColumn("time_window", F.lit("B"))
    order = sorted((r[2], r[3]) for r in rows)
    step = [b[1] - a[1] for a, b in zip(order, order[1:])]
    assert values.volatility(ev).first().max_step == max(map(abs, step))
    assert values.max_jump(ev).first().max_jump == max(step)
    v = [x for _, x in order]
    t = [int(d[-2:]) for d, _ in order]
    h = (len(v) + 1) // 2
    want = np.polyfit(t[h:], v[h:], 1)[0] - np.polyfit(t[:h], v[:h], 1)[0]
    assert abs(values.value_accel(ev).first().value_accel - want) < 1e-6


def test_first_rows_of_a_key_for_any_number(spark):
    df = spark.range(6000).withColumn("k", F.col("id") % 2)
    top = skew.top_by(df, ["k"], [F.desc("id")], 1500)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.count() == 3000 and top.agg(F.min("id")).first()[0] == 3000


def test_fitted_table_of_25000_rows(spark):
    t = session.literal_table(spark, [{"feature": f"f{i}", "importance": i / 2} for i in range(25_000)], "feature string, importance double")
    assert t.dtypes == [("feature", "string"), ("importance", "double")] and t.agg(F.sum("importance")).first()[0] == 25_000 * 24_999 / 4
    assert session.literal_table(spark, [], "feature string, importance double").count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_correlated_pairs_equal_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(hygiene, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) + 1e6
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=200) * 0.01
    x[:, 6] = -x[:, 1]
    x[:, 7] = 5.0
    names = [f"f{i}" for i in range(8)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    got = {(r.i, r.j): r.corr for r in hygiene.correlated_pairs(df, names, 0.9).collect()}
    assert got.keys() == {(0, 3), (1, 6)} and abs(got[1, 6] + 1) < 1e-9 and abs(got[0, 3] - np.corrcoef(x[:, 0], x[:, 3])[0, 1]) < 1e-9


def test_wide_table(spark):
    """Every feature is looked at; the second half repeats the first."""
    n, k = 40, 1500
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, k))
    x[:, k // 2:] = x[:, :k // 2]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    wide = df.select(*[F.get("v", i).alias(f"f{i}") for i in range(k)])
    got = hygiene.correlated_pairs(wide, wide.columns, 0.999).count()
    assert got >= k // 2


def test_isotonic_uses_raw_scores(spark):
    """Scores that round to one grid point still get different calibrated values."""
    rows = [(i, int(i >= 50), 0.0100 + i * 1e-6) for i in range(100)]
    df = spark.createDataFrame(rows, "entity long, label int, score double")
    out = [r.c for r in learn.fit_isotonic(df).apply(df, "c").orderBy("score").collect()]
    assert out[0] == 0.0 and out[-1] == 1.0


def test_levels_are_numbered_in_order(spark):
    words = sorted({f"{a}{b}" for a in ("a", "ab", "é", "Z", "") for b in range(40)})
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "c string")
    assert {r.c: r.id for r in hygiene.fit_labels(df, "c").collect()} == {w: i for i, w in enumerate(words)}


def test_flat_series_have_no_direction(spark):
    """A slope of exactly 0, and readings of one day, in whatever parts their rows are merged."""
    rng = np.random.default_rng(3)
    rows = []
    for e in range(300):
        d, v = rng.integers(1, 1500, 7).tolist(), (rng.integers(1, 50, 7) / 7).tolist()
        rows += [(f"flat{e}", "c", a, y) for a in d for y in v]  # every day has the same readings
        rows += [(f"day{e}", "c", d[0], y) for y in v * 7]
    ev = spark.createDataFrame(rows, "entity string, category string, days_before int, value double").repartition(8).withColumn(
        "event_date", F.date_sub(F.lit("2024-01-01").cast("date"), F.col("days_before")))
    got = values.ols(ev, r2=True)
    assert got.where("entity LIKE 'flat%' AND (slope <> 0 OR direction <> 0)").count() == 0
    assert got.where("entity LIKE 'day%' AND (slope IS NOT NULL OR corr IS NOT NULL OR r2 IS NOT NULL)").count() == 0
    assert values.doubling_time(ev).where("doubling_months IS NOT NULL OR fast = 1").count() == 0


def test_scores_on_a_limit(spark):
    """One of four readings apart from three equal ones scores exactly 1.5, whatever the rounding."""
    rows = []
    for e in range(400):
        a, b = (e % 37) / 7 + 0.1, (e % 41) / 3 + 6.3
        rows += [(f"up{e}", "c", f"c{e}", 9 - i, i + 1, v) for i, v in enumerate([b, a, a, a])]
        rows += [(f"down{e}", "c", f"d{e}", 9 - i, i + 1, v) for i, v in enumerate([a, b, b, b])]
        rows += [(f"same{e}", "c", f"s{e}", i + 1, i + 1, a) for i in range(7)]
    ev = spark.createDataFrame(rows, "entity string, category string, code string, d int, days_before int, value double").repartition(8).withColumn(
        "event_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    z = values.own_z(ev)
    assert z.where("high = 1 OR low = 1 OR entity LIKE 'same%' AND z <> 0").count() == 0
    d = values.derangement(ev, extreme=1.5)
    assert d.where("n_extreme <> CASE WHEN entity LIKE 'same%' THEN 0 ELSE 1 END").count() == 0
    s = occurrence.structure(values.apply_code_z(ev, values.fit_code_z(ev)), 1.5)
    assert s.where("n_extreme <> CASE WHEN entity LIKE 'same%' THEN 0 ELSE 1 END").count() == 0


def test_inputs_of_tasks_stay_small(spark):
    """A shuffle of 300 MB is read in parts of 16 MB, however few tasks run at once."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = session.tune(spark).range(24_000_000, numPartitions=8).select("id", F.xxhash64("id").alias("v")).groupBy("v").agg(F.max("id").alias("id"))
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 12
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_class_weights_leave_rows_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(10_000, numPartitions=8).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
        got = split.class_weights(df)
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() == 8
        assert {(r.label, r.weight) for r in got.select("label", F.round("weight", 9).alias("weight")).distinct().collect()} == {(0, 0.666666667), (1, 2.0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unpacked_rows_are_made_once(spark):
    wide = spark.range(100).select(F.col("id").alias("entity"), (F.col("id") % 3).alias("n"), F.when(F.col("id") % 2 == 0, "F").otherwise("M").alias("sex"))
    packed = tables.pack_json(wide.groupBy("entity").agg(F.max("n").alias("n"), F.max("sex").alias("sex")), ["entity"])
    got = tables.unpack_json(packed, "n bigint, sex string")
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.agg(F.sum("sex_F"), F.sum("sex_M"), F.sum("n")).first()[0:3] == (50.0, 50.0, 99.0)


def test_weights_of_a_small_file_spread_over_tasks(spark):
    """A file of one task holds the entities; their hashes are made in several, and 20 weights travel in one long."""
    spine = spark.range(400_000).select((F.col("id") * 7919 % 999_983).alias("entity"), (F.col("id") % 2).cast("int").alias("label")).coalesce(1)
    w = discover.with_weights(spine, 20, "42", ["entity", "label"])
    assert w.columns == ["entity", "label", "w0"] and w.rdd.getNumPartitions() > 1
    for r in w.where("entity % 50021 = 0").select("entity", *[discover.weight(b).alias(f"w{b}") for b in range(20)]).collect():
        assert list(r[1:]) == [_poisson(r.entity, b) for b in range(20)]


def _poisson(entity, draw):
    u = int(hashlib.md5(f"{entity}|42|{draw}".encode()).hexdigest()[:7], 16) / 2**28
    return sum(u >= t for t in discover.POISSON_1)


def test_stability_with_a_hot_code_and_many_draws(spark):
    """A code of every entity, codes of one, ties at the limit, more draws than a long holds; against plain sums."""
    draws, k, n = 23, 4, 300
    has = {(e, "hot") for e in range(n)} | {(e, f"c{e * 7 % 40}") for e in range(n)} | {(e, f"d{e * 3 % 11}") for e in range(n)} | {(5, "one"), (5, "two")}
    label = {e: int(e % 3 == 0) for e in range(n)}
    w = {(e, b): _poisson(e, b) for e in range(n) for b in range(draws)}
    codes, hits = sorted({c for _, c in has}), Counter()
    for b in range(draws):
        tp, tn = (sum(w[e, b] for e in range(n) if label[e] == y) for y in (1, 0))
        place = []
        for c in codes:
            p, q = (sum(w[e, b] for e, d in has if d == c and label[e] == y) + 0.5 for y in (1, 0))
            place.append((-round(p * (tn + 1 - q) / ((tp + 1 - p) * q), 9), c))
        hits.update(c for _, c in sorted(place)[:k])
    pairs = spark.createDataFrame(sorted(has), "entity long, code string")
    spine = spark.createDataFrame(sorted(label.items()), "entity long, label int")
    got = discover.bootstrap_stability(pairs, spine, draws=draws, top_k=k, threshold=0.5)
    assert {(r.code, r.stability, r.stable) for r in got.collect()} == {(c, hits[c] / draws, int(hits[c] / draws >= 0.5)) for c in codes}


def test_rows_that_may_be_among_the_highest(spark):
    """No row of the first k is lost, equal values and few rows included, and most of the others are gone."""
    df = spark.range(30_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 3 == 2, 1.5).otherwise((F.col("id") % 5000) / 7 - 100).alias("v"), "id")
    df = df.unionByName(spark.createDataFrame([(7, -2.0, -1), (7, 0.0, -2), (None, 3.0, -3)], "k long, v double, id long"))
    order = [F.round("v", 2).desc(), F.col("id")]
    few = skew.high_rows(df, ["k"], "v", 100, 0.01)
    got, want = (sorted(map(repr, skew.top_by(t, ["k"], order, 100).collect())) for t in (few, df))
    assert got == want and few.where("k < 2").count() < 1000 and few.where("k = 2").count() == 10_000
