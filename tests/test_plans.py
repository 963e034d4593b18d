"""Shape of physical plans: what must not appear in them."""

import pytest

from chartline.catalog import base, load

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    df = load()[name].run(base.Tables(spark, FOLDER))
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["c12_ratio_sample", "a01_category_counts", "b01_occurrence", "l04_volatility", "k03_association", "f10_univariate_auc", "v02_auroc_auprc", "plan_feature_matrix"])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_latest_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "c01_latest_snapshot")


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "c09_last_record_anchor")
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:" in text and "o_totalprice" not in text


def test_filter_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan(spark, "s01_read_table")


def test_every_disease_runs_on_its_own_categories(spark):
    """Each configuration compiles and finds its groups, series and orderings on events of its categories."""
    import datetime as dt

    from chartline.plans import disease
    from chartline.plans.diseases import ALL

    sp = spark.createDataFrame([(1, 72, "M"), (2, 40, "F")], "entity int, age int, sex string")
    for name, d in ALL.items():
        cats = sorted({c for cs in d.groups.values() for c in cs} | {c for cs, _ in d.labs.values() for c in cs})
        rows = [(1, dt.date(2019, 1, 1) + dt.timedelta(3 * i), c, "haemoglobin psa culture frank", 50.0 + i, "B" if i % 2 else "A", dt.date(2020, 6, 1), "obs")
                for i, c in enumerate(cats)]
        ev = spark.createDataFrame(rows, "entity int, event_date date, category string, term string, value double, time_window string, anchor_date date, event_type string")
        out = {r["entity"]: r.asDict() for r in disease.features(ev, sp, d).collect()}
        assert all(out[1][f"has_{g}"] == 1 and out[2][f"has_{g}"] == 0 for g in d.groups), name
        assert all(out[1][f"first_{g}_months"] > 0 and out[2][f"first_{g}_months"] == -1 for g in d.onsets), name
        assert set(d.flags) | set(d.lab_flags) | set(d.scores) <= set(out[1]), name


def test_laboratory_terms_are_matched_once_a_row(spark):
    from chartline.plans import disease
    from chartline.plans.diseases import ALL

    ev = spark.createDataFrame([], "entity int, event_date date, category string, term string, value double")
    d = ALL["ovarian"]
    text = disease.lab_rows(ev, d)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < text.count("RLIKE") <= 2 * len(d.labs)  # in the filter and as columns
