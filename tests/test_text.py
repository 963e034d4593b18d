"""Vocabularies, vectors and patterns of texts."""

import random
import re

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from chartline.operators import assemble, text, text_dictionaries as td


def test_vectors_have_every_place(spark):
    rows = [("x", "f0", 1.0), ("x", "f3", 2.0), ("x", "f3", 5.0), ("y", "f4", 7.0), ("z", "f1", None), ("z", "f2", -1.0), ("z", "other", 9.0)]
    df = spark.createDataFrame(rows, "entity string, feature string, value double")
    got = assemble.vectors(df, assemble.feature_index([f"f{i}" for i in range(5)], spark), 5)
    assert "try_element_at" not in got._jdf.queryExecution().optimizedPlan().toString()  # a search of a map for every place
    want = {"x": [1.0, 0, 0, 5, 0], "y": [0, 0, 0, 0, 7.0], "z": [0, 0, -1.0, 0, 0]}
    assert {r["entity"]: r["v"] for r in got.select("entity", vector_to_array("features").alias("v")).collect()} == want


def test_counts_of_a_vocabulary_shuffle_no_other_terms(spark):
    rows = [(e, k, f"word{e % 3} common red common word{k}") for e in range(20) for k in range(3)]
    pcs = spark.createDataFrame(rows, "entity int, turn int, body string").withColumn("body", F.translate("body", "012", "abc"))
    every = text.term_counts(pcs, order=["turn"])
    vocab = text.fit_vocabulary(every, 20, 2, 1.0, 4)
    some = text.term_counts(pcs, order=["turn"], terms=vocab)
    assert "LeftSemi" in some._jdf.queryExecution().optimizedPlan().toString()
    want = every.join(vocab.select("term"), "term").select("entity", "term", "tf")
    assert some.exceptAll(want).isEmpty() and want.exceptAll(some).isEmpty() and some.count() > 0


def test_guards_of_patterns_lose_no_match(spark):
    """Every match contains one of the strings that are looked for first, in texts put together from the patterns' own words."""
    every = {rx for d in [*td.ALL.values()] for rx in [*d.findings.values(), *d.severity.values(), *d.context.values(), d.normal, d.search]}
    every |= {*text.IMAGING.values(), *text.SEVERITY.values(), *text.CONTEXT.values(), r"a(bcd|ef\)g)?hij+k", r"x(?:abc|de)y|[)|]q", r"uvw*|\d+xyz", r"ab{2}cde?f"}
    g = random.Random(3)
    bits = sorted({w for rx in every for w in re.findall(r"[a-z]{2,}", rx)}) + [" ", "  ", "-", "7", "a", "bb", "j", ")", "q"]
    texts = [g.choice(("", " ", "-")).join(g.choices(bits, k=g.randint(1, 6))) for _ in range(6000)]
    guarded = matched = 0
    for rx in every:
        some, p = text.required(rx), re.compile(rx)
        guarded += some is not None
        for t in texts:
            if p.search(t):
                matched += 1
                assert some is None or any(s in t for s in some), (rx, t)
    assert guarded > 0.9 * len(every) and matched > 5000
    assert text.required(r"\d+\s*mm|measur") is None and text.required("(?i)psa") is None and text.required(r"ab?c*") is None
    assert text.required(r"lymph.{0,20}(?:node|swollen)|spleen") == ["lymph", "spleen"]
    assert "Contains" in td.flags(spark.createDataFrame([(1, "x")], "entity int, body string"), td.LYMPHOMA)._jdf.queryExecution().optimizedPlan().toString()
