"""Lossless WebP: every feature of the format against a plain writer, round trips, and the media query."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from chartline.llm import media, webp
from chartline.llm.common import tables

from . import webp_writer

P, C, G, T = webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PALETTE
CASES = [
    {}, {"cache": 4}, {"cache": 11, "copies": True}, {"copies": True}, {"block_bits": 2}, {"block_bits": 3, "cache": 2, "copies": True}, {"transforms": [(G, 0)]},
    {"transforms": [(P, 2)]}, {"transforms": [(P, 3)], "copies": True}, {"transforms": [(C, 2)]}, {"transforms": [(P, 2), (C, 3), (G, 0)], "cache": 5},
    {"transforms": [(G, 0), (P, 4)]}, *({"transforms": [(T, 0)], "colours": n, "copies": n % 2 == 0} for n in (1, 2, 3, 4, 13, 16, 17, 200)), {"transforms": [(P, 2), (T, 0)], "colours": 5},
    {"transforms": [(T, 0), (P, 2)], "colours": 9, "cache": 1},
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_every_feature(case):
    rnd = random.Random(case)
    for w, h in ((1, 1), (1, 9), (13, 1), (17, 11), (40, 23)):
        raw, rows = webp_writer.picture(rnd, w, h, **CASES[case])
        assert np.array_equal(webp.decode([raw])[0], rows), (case, w, h)


def test_a_batch_of_different_files():
    rnd = random.Random(99)
    made = [webp_writer.picture(rnd, rnd.randrange(1, 30), rnd.randrange(1, 20), **rnd.choice(CASES)) for _ in range(40)]
    for got, (_, rows) in zip(webp.decode([m[0] for m in made]), made):
        assert np.array_equal(got, rows)


def test_damaged_files():
    rnd = random.Random(1)
    raw, _ = webp_writer.picture(rnd, 20, 20, copies=True)
    for bad in (b"", raw[:15], b"RIFX" + raw[4:], raw[:20] + b"\0" + raw[21:]):
        with pytest.raises(ValueError):
            webp.decode([bad])
    short = raw[:60]
    short = short[:16] + (len(short) - 20).to_bytes(4, "little") + short[20:]
    with pytest.raises(ValueError):
        webp.decode([short])


def test_encoder_round_trip():
    g = np.random.default_rng(2)
    px = np.concatenate([g.integers(0, 1 << 32, 144 * 3, dtype=np.uint32), np.zeros(144 * 64, np.uint32), np.repeat(g.integers(0, 99, 144, dtype=np.uint32), 5)])
    off = np.array([0, 144 * 3, 144 * 67, 144 * 72])
    files = webp.Encoder(webp.count_symbols(px, off)).encode(px, off)
    assert b"".join(x.tobytes() for x in webp.decode(files)) == px.tobytes()
    alone = webp.Encoder(webp.count_symbols(px, off)).encode(px[144 * 3:144 * 67], np.array([0, 144 * 64]))
    assert alone[0] == files[1] and len(files[1]) < 700  # the same file wherever it is encoded; a run costs little


def used(raw):
    """What the file of an image makes use of."""
    plan = webp.Headers().plan(raw)
    return {t[0] for t in plan.transforms} | ({"cache"} if plan.cache_bits else set()) | ({"far"} if plan.groups[0][4].width else set())


def test_files_of_the_query_use_the_whole_format(spark):
    """Transforms, colour cache and distances above 1 are met in the stored files and undone when they are read back."""
    g = random.Random(3)
    pick = lambda letters, n: g.choices(letters, k=n)
    texts = ["", "short", "".join(pick(["wxyz", "WXYZ"], 400)), "".join(c * 4 for c in pick("0123456789QXZ", 300)), "".join(a + b + a + c for a, b, c in zip(pick("!#$%&()*+/<=>?@[]^_{|}~QXZJKV0123456789", 900), pick("eta ", 900), pick("eta ", 900))),
             "".join(chr(33 + k % 90) * 4 for k in range(600)), "".join(pick("QXZJKV", 700)) * 5, "".join(pick(["abcd", "efgh", "ijkl", *("".join(pick("mnopqrst", 4)) for _ in range(20))], 2000))]
    docs = tables(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(texts)], docs.schema))
    files = {r.doc_id: r.media for r in media.encoded(docs).collect()}
    found = [used(bytes(f)) for m in files.values() for f in m]
    assert {P, C, G, T, "cache", "far"} <= set().union(*found) and set() in found
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    for d, m in files.items():
        assert b"".join(x.tobytes() for x in webp.decode(list(map(bytes, m)))).rstrip(b"\xff") == texts[d]


def test_every_way_round_trips():
    """Whatever way is chosen, the pixels come back; a file tells nothing of the batch it was made in."""
    g = np.random.default_rng(5)
    parts = [g.integers(0, 1 << 32, 144, dtype=np.uint32), np.tile(g.integers(0, 1 << 32, 37, dtype=np.uint32), 40)[:144 * 10], g.choice(g.integers(0, 1 << 32, 50, dtype=np.uint32), 144 * 3),
             np.arange(144 * 2, dtype=np.uint32) * np.uint32(0x01010101), np.zeros(144 * 64, np.uint32), g.choice(np.array([1, 2, 3], np.uint32), 144 * 2)]
    px, off = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    enc = webp.Encoder(webp.count_symbols(px, off))
    for way in webp.WAYS:
        files = enc._packed(px, off, way, webp.WIDTH)
        assert b"".join(x.tobytes() for x in webp.decode(files)) == px.tobytes(), way
    files = enc.encode(px, off)
    assert b"".join(x.tobytes() for x in webp.decode(files)) == px.tobytes()
    for k, p in enumerate(parts):
        assert enc.encode(p, np.array([0, len(p)])) == [files[k]]


def test_code_lengths_are_limited():
    n = webp.code_lengths(np.array([1 << k for k in range(40)]), 12)
    assert n.max() <= 12 and sum(2.0 ** -x for x in n) == 1


def test_report(spark):
    docs = tables(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r for r in media.report(docs).collect()}
    for d, t in docs.select("doc_id", "text").collect():
        raw = t.encode()
        pay = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))


def test_odd_documents(spark, odd_docs, no_docs, clashing):
    got = {r.doc_id: r for r in media.report(odd_docs).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == 576 and got[1].n_bytes == 0 and got[1].media_sha256 == got[2].media_sha256
    assert got[6].media_sha256 == got[7].media_sha256 and got[6].payload_bytes > 9216 * 4
    assert media.report(odd_docs).count() == odd_docs.count() and media.report(no_docs).count() == 0
    px = media.pixels(media.encoded(clashing)).collect()
    assert {(r.width, r.height) for r in px} == {(144, 1)} and bytes(px[0].rgba)[:4] in (b"some", b"othe")


def test_payloads():
    px, off = media.payloads(pa.array(["a" * 576, "a" * 577, None]))
    assert off.tolist() == [0, 144, 432, 576] and px.tobytes()[576 * 2 + 1:] == b"\xff" * (575 + 576)
