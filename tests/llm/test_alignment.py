"""Alignment of two vocabularies against the libraries and a plain count; runs and their merge."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chartline.llm import alignment
from chartline.llm.common import tables

SF = "/root/testdata/sf0.001"
HARD = ["a", " ", "   ", " lead", "trail ", "trail   ", "two  spaces   three", "tab\there", "line\nend\n", " \n x", "x \n", "<|endoftext|> x <s> </s> <unk> <0x41>", "▁x", "a ▁ b", "x▁", "é ﬁ Ａ漢字かな 😀👍🏽", "\x00a\x01",
        "a b   c", "don't can't 'tis", "x" * 300, "1234567 89", "a\x0bb\x0cc\x1cd\x85e", "  \t  ", "é ́", "﻿bom", "​ zero"]


def byte_letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            table[chr(256 + extra)] = b
            extra += 1
    return table


def sides():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()

    def a(text):
        ids = tok.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(letters[c] for c in tok.id_to_token(i)) for i in ids]

    def b(text):
        ids = piece.encode(text)
        return ids, [bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    return a, b


def brute(rows):
    a, b = sides()
    per, pairs = [], Counter()
    for i, text in rows:
        links, digest, groups, na, nb = [], "", 0, 0, 0
        if text:
            (ia, ba), (ib, bb) = a(text), b(text)
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                na, nb = len(ia), len(ib)
                ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                p = q = 0
                parts = []
                at_a, at_b = ({e: k for k, e in enumerate(x)} for x in (ea, eb))
                for e in sorted(set(ea) & set(eb)):
                    p2, q2 = at_a[e] + 1, at_b[e] + 1
                    parts.append(",".join(map(str, ia[p:p2])) + "|" + ",".join(map(str, ib[q:q2])))
                    for x in range(p, p2):
                        for y in range(q, q2):
                            if max(ea[x] - len(ba[x]), eb[y] - len(bb[y])) < min(ea[x], eb[y]):
                                links.append((ib[y], ia[x]))
                    p, q = p2, q2
                groups, digest = len(parts), hashlib.sha256(";".join(parts).encode()).hexdigest()
        pairs.update(links)
        per.append((i, na, nb, groups, links, digest))
    best = defaultdict(int)
    for (y, _), n in pairs.items():
        best[y] = max(best[y], n)
    out = [(i, na, nb, g, len(k), sum(pairs[p] == best[p[0]] for p in k), sum(pairs[p] for p in k), d) for i, na, nb, g, k, d in per]
    return sorted(out, key=repr), sorted((y, x, n, n == best[y]) for (y, x), n in pairs.items())


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_documents(spark):
    d = tables(spark, SF, "documents")
    want, pairs = brute([(r["doc_id"], r["text"]) for r in d.collect()])
    per, table = alignment.aligned(d)
    assert got(per) == want
    assert sorted(map(tuple, table.collect())) == pairs


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 40, "run_links": 7, "batch_bytes": 30}])
def test_hard_texts(spark, make_docs, sizes):
    """Special strings, white space of all kinds, texts that a side changes; slices and runs of any size give the same."""
    rows = [(i, t) for i, t in enumerate([*HARD, None, "", "the same text again", "the same text again", HARD[6]])] + [(None, "no id"), (3, "again 3"), (3, "again 3")]
    want, pairs = brute(rows)
    per, table = alignment.aligned(make_docs(*rows).coalesce(2), **sizes)
    assert got(per) == want
    assert sorted(map(tuple, table.collect())) == pairs


def test_odd_rows(odd_docs, clashing, no_docs):
    for d in (odd_docs, clashing):
        assert got(alignment.report(d)) == brute([(r["doc_id"], r["text"]) for r in d.collect()])[0]
    assert alignment.report(no_docs).collect() == []


def test_runs_and_their_merge(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 50)
    g = np.random.default_rng(3)
    lists = [np.sort(g.integers(0, 900, n)) for n in (0, 1, 49, 50, 51, 700, 2000)] + [np.full(5, 7), np.array([1 << 54, (1 << 54) + 1])]
    runs, want = [], Counter()
    for x in lists:
        k, n = np.unique(x, return_counts=True)
        runs.append(alignment.run_of(k, n))
        back = list(alignment.frames(runs[-1]))
        assert all(len(f[0]) <= 50 for f in back) and [v for f in back for v in f[0].tolist()] == k.tolist() and [v for f in back for v in f[1].tolist()] == n.tolist()
        want.update(x.tolist())
    keys, counts = zip(*alignment.merged(runs))
    assert dict(zip(np.concatenate(keys).tolist(), np.concatenate(counts).tolist())) == want
    assert np.concatenate(keys).tolist() == sorted(want)
    assert list(alignment.merged([])) == [] and list(alignment.merged([b""])) == []


def test_chunks_encode_like_whole_texts():
    """Cut texts give the ids of whole ones, on both sides."""
    a, b = sides()
    left, right = alignment.sides(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    for t in HARD:
        data, edge, number, at = alignment.chunked(pa.array([t]))
        raw = data.tobytes()
        chunks = [raw[edge[k]:edge[k + 1]] for k in number.tolist()]
        assert b"".join(chunks) == (" " + t).encode()
        edge = np.cumsum([0, *map(len, chunks)])
        data = np.frombuffer(b"".join(chunks), np.uint8)
        assert left.encode(data, edge)[0].tolist() == a(t)[0]
        assert right.encode(data, edge)[0].tolist() == b(t)[0]
