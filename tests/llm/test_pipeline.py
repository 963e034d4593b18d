"""The pipeline: stages against brute force, and the entry's guard."""

import re
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from chartline.llm import quality
from chartline.llm.common import lean, tables
from chartline.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle

from .test_pii import brute
from .test_simhash_near import all_pairs, shingles
from .test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = tables(spark, SF, "documents")
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    want = {r.doc_id for r in quality.report(docs).where("keep").collect()}
    before = {r.doc_id: r for r in kept.collect()}
    assert set(before) == want and kept.columns == docs.columns
    labels = {r.doc_id: r.quality for r in tables(spark, SF, "labels").collect()}
    assert all(d in before for d, q in labels.items() if q == 1)

    once = corpus_pipeline.simhash_dedup(spark, kept, SF)
    ids = sorted(before)
    sets = [shingles(before[d].text) for d in ids]
    pairs = all_pairs(sets)
    left = {r.doc_id for r in once.collect()}
    # of every pair of near copies one goes at least; a document that has no copy stays
    assert sum(not {ids[i], ids[j]} <= left for i, j in pairs) >= 0.9 * len(pairs) and once.columns == docs.columns
    assert left >= set(ids) - {ids[k] for p in pairs for k in p} and all(any(p[0] == ids.index(d) or p[1] == ids.index(d) for p in pairs) for d in set(ids) - left)

    clean = corpus_pipeline.pii_masking(spark, once, SF)
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and all(sum(brute(t)[0]) == 0 for t in rows.values())
    assert all(rows[d] == before[d].text for d in rows if not re.search("[0-9@]", before[d].text))

    mix = corpus_pipeline.source_mixing(spark, clean, SF)
    got = mix.collect()
    assert mix.columns == docs.columns and {(r.doc_id, r.text) for r in got} <= set(rows.items())
    assert max(sum(r.doc_id == d for r in got) for d in rows) <= 3

    check_pieces([(r.doc_id, r.text) for r in got], corpus_pipeline.curve_packing(spark, mix, SF).collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"] and out.count() > 100


def test_stages_keep_empty_tables(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_stages_on_odd_documents(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0


def test_entry():
    assert len([n for n, _ in corpus_pipeline.STAGES]) == 5 and set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    msg, _ = oracle.compare(QUERIES[name](spark, SF), oracle.duck(SF), ORACLE_SQL[name])
    assert not msg, msg


def test_workers_give_freed_memory_back():
    """A worker that is done holds no more than before, though what it freed lies between blocks that are still in use."""
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    kept = []

    def run(batches):
        for b in batches:
            blocks = [np.ones(8000) for _ in range(4000)]
            kept.extend(blocks[::100])
            yield b

    before = resident()
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 64 << 20
