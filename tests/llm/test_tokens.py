"""Token ids against the library, the compressed format, and packing."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartline.llm import packing, rans, tokens
from chartline.llm.common import tables

SF = "/root/testdata/sf0.001"
HARD = ["", None, " ", "  a  b\n\nc ", "don't can't I'll 'tis o'clock's", "x y   z", "é é e ́ ﬁ Ω İstanbul ẞ ß", "a1b22c 333,44.5!!", "漢字 かな　x", "\t\ttabs\r\nnew  ",
        "<|endoftext|> x <|startoftext|>", "one <|endoftext|> two", "a<|endoftext|>b  <|endoftext|>\n<|ENDOFTEXT|> <|endoftext|", "ÿ×÷Ãx1a22B Ã", "word—dash “quote” it’s", "a\x0bb\x0cc\x1cd\x85e", "ÀÉÎÕÜ ÿ × ÷ Ç!", "_under_score_ [x](y) {z} `q` ~", " x   y", "🙂 👍🏽 ok", "\x00\x01 \x7f",
        "'s 's's 'S", "a 'b' c", "\n \n x", " \n", "x \ny", "x\n y", "x \u0085 y", "x  y   z"]
FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


def plain(kind, texts):
    t = Tokenizer.from_file(public_tokenizers.path(FILES[kind]))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["byte", "word"])
@pytest.mark.parametrize("kept", [1_000_000, 3])
def test_ids_equal_the_library(spark, monkeypatch, kind, kept):
    monkeypatch.setattr(tokens, "KEPT", kept)
    enc = tokens.Encoder(public_tokenizers.path(FILES[kind]), kind)
    texts = HARD + [r.text for r in tables(spark, SF, "documents").select("text").collect()]
    for part in (texts[:20], texts[20:], texts):
        ids, off = enc.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == plain(kind, part)


def test_regrouped_keeps_rows():
    b = pa.RecordBatch.from_pydict({"text": ["ab", None, "c" * 10, "", "d"], "i": list(range(5))})
    got = list(tokens.regrouped([b, b.slice(0, 0), b.slice(2)], "text", 4))
    assert [x for g in got for x in g.column("i").to_pylist()] == [0, 1, 2, 3, 4, 2, 3, 4]


def test_blocks_round_trip():
    g = np.random.default_rng(1)
    for n in (1, 511, 512, 513, 70_001, 300_000):
        ids = (g.zipf(1.3, n) % 49_000).astype(np.uint32)
        table = rans.Table.of_counts(np.bincount(np.append(ids, 48_999)))
        assert int(table.freq.sum()) == 1 << rans.SCALE
        cut = np.sort(g.integers(0, n, 3))
        sizes = np.diff(np.concatenate(([0], cut, [n])))
        raw = rans.encode(ids, sizes, [5, None, -7, 2**62], table)
        block = rans.Block(raw, table)
        assert np.array_equal(block.ids(), ids) and block.sizes.tolist() == sizes.tolist() and block.docs == [5, None, -7, 2**62]
        # every part is decoded on its own
        parts = [rans.Block(raw, table).part(k) for k in reversed(range(len(block.marks)))]
        assert np.array_equal(np.concatenate(parts[::-1]), ids)
    assert len(block.marks) == 3
    p = np.bincount(ids) / n
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
    assert len(raw) < 1.1 * entropy + 8 * rans.LANES * 4
    for at in (0, 30, len(raw) // 2, len(raw) - 1):
        with pytest.raises(ValueError):
            rans.Block(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1:], table)
    with pytest.raises(ValueError):
        rans.Block(raw, rans.Table.of_counts(np.bincount(ids[:5])))


def test_table_of_many_rare_symbols():
    counts = np.ones(49_408, np.int64)
    counts[7] = 10**12
    t = rans.Table.of_counts(counts)
    assert int(t.freq.sum()) == 1 << rans.SCALE and t.freq.min() == 1
    assert rans.Table.of_counts(np.zeros(4, np.int64)).freq.sum() == 0


def brute_start(rows):
    out, at = [], 0
    for (d, _), ids in zip(rows, plain("word", [t for _, t in rows])):
        ids = np.array([*ids, 2], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_written_ids(spark):
    docs = tables(spark, SF, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.report(docs).collect())
    assert got == brute_start(rows)


def test_written_ids_of_odd_documents(odd_docs, no_docs, clashing):
    got = rans.report(odd_docs).orderBy("start").collect()
    assert len(got) == odd_docs.count() and [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10]
    assert [r.n_tokens for r in got][1:4] == [1, 1, 1] and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert rans.report(no_docs).count() == 0 and rans.report(clashing).count() == 3


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve(dims, bits):
    pts = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    k = packing.hilbert(pts, bits)
    assert sorted(k.tolist()) == list(range(len(pts)))
    assert (np.abs(np.diff(pts[np.argsort(k)], axis=0)).sum(1) == 1).all()


def check_pieces(rows, pieces, end=0):
    """Each document's ids in order and once; sequences without gaps, full or of lengths that are powers of two."""
    want = {}
    for (d, _), ids in zip(rows, plain("byte", [t for _, t in rows])):
        want.setdefault(d, []).append(np.array([*ids, end], "<u4").tobytes())
    docs, seqs = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
    assert docs.keys() == want.keys()
    for d, ps in docs.items():
        whole = b"".join(want[d])
        if len(want[d]) == 1:
            ps.sort(key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in ps) == whole and {p.doc_tokens for p in ps} == {len(whole) // 4}
            assert [p.start for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        else:
            assert sum(len(p.ids) for p in ps) == len(whole)
    for ps in seqs.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        n = sum(p.length for p in ps)
        assert n <= 1024 and n & (n - 1) == 0
    return seqs


def test_packing(spark):
    docs = tables(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_pieces(rows, packing.packed(docs).collect())
    got = packing.packed(docs).select("doc_id", "start", F.crc32("ids").alias("c")).collect()
    assert sorted(got) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packing.report(docs).collect())


def test_neighbours_share_sequences(make_docs):
    """Documents of one kind lie together along the curve."""
    kinds = ["alpha beta gamma delta ", "uno dos tres cuatro ", "QQ## ZZ!! XX%% "]
    docs = make_docs(*((i, kinds[i % 3] * (30 + i)) for i in range(90)))
    seqs = check_pieces([(r.doc_id, r.text) for r in docs.collect()], packing.packed(docs.coalesce(1)).collect())
    mixed = [len({p.doc_id % 3 for p in ps}) > 1 for ps in seqs.values()]
    assert sum(mixed) <= 0.2 * len(mixed)


def test_packing_of_odd_documents(odd_docs, no_docs, clashing):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    check_pieces(rows, packing.packed(odd_docs).collect())
    assert packing.report(no_docs).count() == 0 and packing.report(clashing).count() >= 3
