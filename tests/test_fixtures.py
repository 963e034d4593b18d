"""Hand-made rows for the edge cases: ties, bounds, big ids, NULLs, single events, hot keys."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from chartline import session, skew
from chartline.functions import scalar as x
from chartline.operators import cohort, counts, discover, evaluate, hygiene, learn, occurrence, patterns, sequence, split, timeline, values
from chartline.sources import tables

D = dt.date


def one(df):
    return df.first().asDict()


def days(spark, rows, schema="entity int, event_date date, category string, value double, days_before int"):
    return spark.createDataFrame(rows, schema)


def test_ids_keep_all_digits(spark):
    df = spark.createDataFrame([("39115611000001103",), ("39115611000001104.0",), ("x1",)], "c string")
    assert [r[0] for r in df.select(x.exact_long("c")).collect()] == [39115611000001103, 39115611000001104, None]


def test_null_like_values(spark):
    df = spark.createDataFrame([("",), ("nan",), ("1.0",), ("7",), (" NULL ",), ("7 mg",)], "c string")
    assert [r[0] for r in df.select(x.parse_value("c")).collect()] == [None, None, 1.0, 7.0, None, None]


def test_window_is_half_open(spark):
    sp = spark.createDataFrame([(1, D(2020, 1, 31))], "entity int, anchor_date date")
    ev = spark.createDataFrame([(1, D(2015, 1, 31)), (1, D(2015, 1, 30)), (1, D(2019, 12, 31)), (1, D(2019, 12, 30))], "entity int, event_date date")
    kept = {r["event_date"] for r in ev.join(sp, "entity").where(cohort.in_lookback(5, 1)).collect()}
    assert kept == {D(2015, 1, 31), D(2019, 12, 30)}


def test_not_in_and_not_like_drop_nulls(spark):
    sp = spark.createDataFrame([(1, D(2020, 1, 1))], "entity int, anchor_date date")
    ev = spark.createDataFrame([(1, D(2019, 1, 1), 5, None, "a"), (1, D(2019, 1, 2), 5, "x", None), (1, D(2019, 1, 3), 5, "x", "Cancer"), (1, D(2019, 1, 4), 5, "x", "b")],
                               "entity int, event_date date, code bigint, obs_type string, term string")
    out = cohort.lookback(sp, ev, 5, 1, not_types=["Immunisation"], not_like="%cancer%")
    assert [r["event_date"] for r in out.collect()] == [D(2019, 1, 4)]


def test_latest_breaks_ties(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), 1, "a"), (1, D(2020, 1, 1), 2, "b")], "k int, d date, n int, v string")
    assert one(cohort.latest(df, ["k"], ["d", "n"]))["v"] == "b"


def test_same_day_values_have_no_slope(spark):
    ev = days(spark, [(1, D(2020, 1, 1), "L", 1.0, 10), (1, D(2020, 1, 1), "L", 3.0, 10)])
    r = one(values.ols(ev, r2=True))
    assert r["slope"] is None and r["corr"] is None and r["n"] == 2


def test_single_event_and_equal_intervals(spark):
    rows = [(1, D(2020, 1, 1), "S", 1.0, 100)] + [(2, D(2020, 1, 1) + dt.timedelta(10 * i), "S", 1.0, 100 - 10 * i) for i in range(4)]
    out = {r["entity"]: r for r in occurrence.visit_profile(days(spark, rows)).collect()}
    assert out[1]["trend"] == "Single occurrence" and out[1]["interval_mean"] is None
    assert out[2]["interval_slope"] == 0.0 and out[2]["interval_median"] == 10.0 and out[2]["trend"] == "Stable frequency"


def test_shrinking_intervals_are_worsening(spark):
    dates = [D(2020, 1, 1) + dt.timedelta(d) for d in (0, 100, 160, 190, 200)]
    r = one(occurrence.visit_profile(days(spark, [(1, d, "S", 1.0, 0) for d in dates])))
    assert r["trend"].startswith("Increasing") and r["is_worsening"] == 1


def test_burst_window_is_inclusive(spark):
    def ev(*pairs):
        return days(spark, [(1, D(2020, 1, 1) + dt.timedelta(o), c, 1.0, 0) for o, c in pairs])
    assert one(patterns.burst(ev((0, "a"), (30, "b"), (31, "c"))))["max_in_window"] == 2
    assert one(patterns.burst(ev((0, "a"), (29, "b"), (30, "c"))))["max_in_window"] == 3


def test_gini_and_entropy(spark):
    ev = days(spark, [(1, D(2020, 1, 1), c, 1.0, 0) for c in "aaab"] + [(2, D(2020, 1, 1), "a", 1.0, 0)])
    g = {r["entity"]: r["gini"] for r in counts.gini(ev).collect()}
    assert g[2] == 0.0 and g[1] == pytest.approx(2 * (1 * 1 + 2 * 3) / (2 * 4) - 3 / 2)
    e = {r["entity"]: r["entropy"] for r in counts.entropy(ev, "ln").collect()}
    assert e[1] == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))


def test_yates_and_haldane_with_zero_cell(spark):
    c = spark.createDataFrame([("a", 8, 0, 20, 20)], "code string, n_pos bigint, n_neg bigint, total_pos bigint, total_neg bigint")
    r = one(discover.chi2(discover.association(c)))
    assert r["odds_ratio"] == pytest.approx(8.5 * 20.5 / (12.5 * 0.5))
    cut = abs(8 * 20 - 12 * 0) - 20
    assert r["chi_squared"] == pytest.approx(40 * cut * cut / (20 * 20 * 8 * 32))
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(r["chi_squared"] / 2)))


def test_constant_score_and_single_class(spark):
    p = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 0, 0.5), ("b", 0, 0.1)], "g string, label int, score double")
    out = {r["g"]: r for r in evaluate.auroc_auprc(p, ["g"]).collect()}
    assert out["a"]["auroc"] == 0.5 and out["a"]["auprc"] == pytest.approx(1 / 3) and out["b"]["auroc"] is None


def test_entity_in_both_classes(spark):
    ev = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "entity int, label int")
    assert sorted(map(tuple, cohort.fix_overlap(ev).collect())) == [(1, 1), (2, 0)]
    assert sorted(map(tuple, cohort.fix_overlap(ev, "drop").collect())) == [(2, 0)]


def test_roster_keeps_entities_without_events(spark):
    roster = spark.createDataFrame([(1,), (2,)], "entity int")
    mat = spark.createDataFrame([(1, 3, 2.5)], "entity int, n int, mean double")
    assert {r["entity"]: (r["n"], r["mean"]) for r in cohort.align(roster, mat, zero=["n"]).collect()} == {1: (3, 2.5), 2: (0, None)}


def test_short_sequences_and_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6],)], "s array<int>")
    assert [r[0] for r in df.select(sequence.pad("s", 5)).collect()] == [[1, 2, 3, 0, 0], [2, 3, 4, 5, 6]]


def test_retried_append_replaces_its_own_date(spark, tmp_path):
    path = str(tmp_path / "store")
    a, b = (spark.createDataFrame([(i,)], "entity int") for i in (1, 2))
    tables.append_partition(a, path, "2026-01-01")
    tables.append_partition(b, path, "2026-01-02")
    tables.append_partition(b, path, "2026-01-02")
    assert spark.read.parquet(path).count() == 2 and one(tables.latest_partition(spark, path))["entity"] == 2


def test_shard_with_other_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\n")
    (tmp_path / "b.csv").write_text("id,w\n3,4\n")
    good = tables.read_shards(spark, str(tmp_path / "a.csv"), "id int, v int")
    assert [tuple(r) for r in good.collect()] == [(1, 2)]
    with pytest.raises(Exception):
        tables.read_shards(spark, str(tmp_path / "*.csv"), "id int, v int").collect()


def test_code_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"obs": {"39115611000001103": "A"}, "med": {"7": "B"}}')
    (tmp_path / "m.tsv").write_text("code_type\tcategory\tcode_id\tterm\nobs\tC\t12\tcough\n")
    (tmp_path / "keep.json").write_text('{"features": ["f1", "f2"]}')
    got = {tuple(r) for r in tables.load_code_map(spark, str(tmp_path / "m.json")).select("event_type", "code", "category").collect()}
    assert got == {("obs", 39115611000001103, "A"), ("med", 7, "B")}
    assert one(tables.load_code_map(spark, str(tmp_path / "m.tsv")))["term"] == "cough"
    assert tables.load_keep(spark, str(tmp_path / "keep.json")) == ["f1", "f2"]


def test_hot_key_matches_plain_windows(spark):
    """One key with most rows: segment-wise results equal a plain window over the key."""
    rng = random.Random(1)
    rows = [(0 if i % 3 else rng.randrange(1, 30), D(2015, 1, 1) + dt.timedelta(rng.randrange(900)), float(rng.randrange(60))) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, d date, v double")
    p = skew.previous(df, ["k"], ["d", "v"], ["v"], F.col("d")).groupBy("k").agg(F.sum("prev_v").alias("s"), F.count("prev_v").alias("n"))
    df.createOrReplaceTempView("hot")
    want = spark.sql("SELECT k, sum(p) AS s, count(p) AS n FROM (SELECT k, lag(v) OVER (PARTITION BY k ORDER BY d, v) AS p FROM hot) GROUP BY k")
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, want.collect()))
    q = skew.quantiles(df, ["k"], "v", {"a": 0.25, "m": 0.5})
    exact = spark.sql("SELECT k, percentile(v, 0.25) AS a, percentile(v, 0.5) AS m FROM hot GROUP BY k")
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, exact.collect()))


def test_number_bucket_never_decreases(spark):
    vals = sorted([0.0, -1.0, 1e-9, 0.5, 0.999, 1.0, 1.0000001, 3.7, 1e6, 1e6 + 1, -1e9, 1e18, 2.0**60])
    coarse, fine = skew.number_buckets(F.col("v"))
    b = [(r[0], r[1]) for r in spark.createDataFrame([(v,) for v in vals], "v double").select(coarse, fine).collect()]
    assert [x for x, _ in b] == sorted(x for x, _ in b) and [y for _, y in b] == sorted(y for _, y in b)
    assert all(x == y // 4096 for x, y in b)


def test_split_does_not_depend_on_partitioning(spark):
    sp = spark.range(500).selectExpr("id AS entity", "cast(id % 3 = 0 AS int) AS label")
    got = []
    for n in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got.append({tuple(r) for r in split.split(sp.repartition(n), {"train": 0.8, "valid": 0.1, "test": 0.1}).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]
    by = {}
    for _, y, s in got[0]:
        by.setdefault(y, []).append(s)
    assert all(abs(v.count("train") / len(v) - 0.8) < 0.01 for v in by.values())


def test_extend_ratio_keeps_members_and_is_disjoint(spark):
    s = spark.createDataFrame([(1, "train", 1), (2, "train", 0), (3, "test", 1), (4, "test", 0)], "entity bigint, split string, label int")
    out = cohort.extend_ratio(s, spark.range(10, 60).selectExpr("id AS entity"), 5).collect()
    assert len({r["entity"] for r in out}) == len(out) == 2 + 2 * 5
    assert {(1, "train"), (4, "test")} <= {(r["entity"], r["split"]) for r in out}


def test_duplicates_need_equal_values(spark):
    rows = [(e, f, float(e * (2 if f == "c" and e == 3 else 1))) for e in range(5) for f in "abc"]
    out = hygiene.duplicate_features(spark.createDataFrame(rows, "entity int, feature string, value double"))
    assert [tuple(r) for r in out.select("feature", "same_as").collect()] == [("b", "a")]


def test_calibrators_are_monotone(spark):
    p = spark.range(2000).selectExpr("id AS entity", "id / 2000D AS score", "cast((id * 7919) % 2000 < id * 0.6 AS int) AS label")
    for c in (learn.fit_platt(p), learn.fit_isotonic(p)):
        got = [r[0] for r in c.apply(p, "cal").orderBy("score").select("cal").collect()]
        assert all(a <= b + 1e-12 for a, b in zip(got, got[1:])) and 0 <= got[0] and got[-1] <= 1


def test_prep_uses_training_numbers_only(spark):
    rows = [(i, i % 2, float(i), None if i % 5 == 0 else float(i * 2), "a" if i % 3 else "b") for i in range(1, 60)]
    df = spark.createDataFrame(rows, "entity int, label int, u double, v double, g string")
    prep = learn.Prep(categorical=["g"], value_cols=["v"], max_corr=2.0).fit(df.where("entity < 40"), ["u", "v", "g"])
    alone = prep.transform(df.where("entity = 50")).first()
    among = prep.transform(df).where("entity = 50").first()
    assert alone == among and set(prep.features) == {"u", "v", "g"}
    unseen = prep.transform(df.where("entity = 50").withColumn("g", F.lit("zzz"))).first()
    m, s = prep.scale["g"]
    assert unseen["g"] == pytest.approx((-1 - m) / s)


def test_missing_contract_column_is_reported(spark):
    df = spark.createDataFrame([(1, "valid")], "entity int, split string")
    assert evaluate.validate_preds(df).count() == 5


def test_literal_table_of_any_length(spark):
    many = session.literal_table(spark, [{"a": i, "b": f"x{i}"} for i in range(5000)], "a int, b string")
    assert many.count() == 5000 and many.agg(F.sum("a")).first()[0] == sum(range(5000))
    assert session.literal_table(spark, [], "a int").count() == 0
    assert [tuple(r) for r in session.literal_table(spark, [{"a": 1, "b": "x, y"}], "a int, b string").collect()] == [(1, "x, y")]


def test_platt_solves_its_score_equations(spark):
    rows = [(i, i / 50.0, int((i * 7) % 50 < i)) for i in range(50)]
    a, b = learn.fit_platt(spark.createDataFrame(rows, "entity int, score double, label int")).params
    p = [1 / (1 + math.exp(-(a * s + b))) for _, s, _ in rows]
    assert sum(y - q for (_, _, y), q in zip(rows, p)) == pytest.approx(0, abs=1e-6)
    assert sum((y - q) * s for (_, s, y), q in zip(rows, p)) - a == pytest.approx(0, abs=1e-6)
