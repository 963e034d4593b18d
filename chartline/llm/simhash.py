"""SimHash near-dedup: tiled exact comparison of fingerprints, skipping tile pairs by population count.

A text's fingerprint has a bit where more than half of its 3-word shingles' XXH64 have it. Distinct fingerprints
with at most ``RADIUS`` differing bits are linked. Comparing all of them would be quadratic, so the 64 bits are cut
into ``BLOCKS`` blocks first: two fingerprints within the radius agree in at least BLOCKS - RADIUS of them, and
meet under the key of such a choice of blocks (ten keys a fingerprint). Under a key they are sorted by population
count and compared tile by tile with exclusive-or and bit counts; tile pairs whose counts differ by more than the
radius are skipped. Keys with more than ``HOT`` fingerprints are cut into tiles across tasks. No pair within
the radius is lost, and each comparison gives at most one link a fingerprint, a spanning forest of what it found.

No words (null, empty or white space): fingerprint zero, linked like any other. Repeated rows and equal texts share
a fingerprint. A component's id is the smallest doc_id in it, nulls aside. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..skew import join_null_safe
from .common import SPACE, buffers, stored, words
from .graph import components
from .tokens import sliced

SHINGLE, SEED, RADIUS = 3, 42, 3
BLOCKS = 5
HOT, TILE = 8192, 512
STRETCH = 2 << 20  # bytes of text taken together
_ROWS = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprints(texts: pa.Array) -> np.ndarray:
    data, off = buffers(texts)
    start, end, at = words(data, off)
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    if not len(start):
        return out
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    # one space after each word, no other white space
    keep = ~SPACE[data]
    after = end[end < len(data)]
    keep[after[SPACE[data[after]]]] = True
    low[SPACE[data]] = 32
    place = np.cumsum(keep) - keep
    joined = low[keep].tobytes()
    s, e = place[start], place[end - 1] + 1
    first = np.arange(len(s))
    text = np.repeat(np.arange(len(n)), n)
    room = at[1:][text] - first  # words from here to the text's end
    whole = (n[text] < SHINGLE) & (first == at[:-1][text])
    begins = np.flatnonzero((room >= SHINGLE) | whole)
    span = np.minimum(n[text[begins]], SHINGLE)
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(joined[a:b], SEED) for a, b in zip(s[begins].tolist(), e[begins + span - 1].tolist())), np.uint64, len(begins))
    owner, total = text[begins], np.zeros((len(n), 64), np.int64)
    for a in range(0, len(h), _ROWS):
        o = owner[a:a + _ROWS]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(o)) + 1))
        bits = np.unpackbits(h[a:a + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total[o[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    m = np.bincount(owner, minlength=len(n))
    return np.packbits(2 * total > m[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, hash, fp): a hash of the text, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x, y in sliced(whole.column(text), STRETCH):
                b = whole.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array(fingerprints(b.column(text)).view(np.int64))], names=["doc_id", "hash", "fp"])

    source = docs.select("doc_id", F.col(text).alias(text), F.xxhash64(text).alias("hash"))
    return source.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hash long, fp long")


def keys(fp: Column) -> Column:
    """array<long>: for each choice of BLOCKS - RADIUS blocks its number and the fingerprint's bits there."""
    edge = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    out = []
    for i, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS)):
        key, width = F.lit(i).cast("long"), 0
        for b in chosen:
            w = edge[b + 1] - edge[b]
            bits = F.shiftrightunsigned(fp, edge[b]).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
            key, width = F.shiftleft(key, w).bitwiseOR(bits), width + w
        out.append(key)
    return F.array(*out)


def _forest(fp: np.ndarray, left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among rows ``left`` of fp, or between them and rows ``right``; tiles skipped by bit count."""
    count = np.bitwise_count(fp).astype(np.int16)
    root = np.arange(len(fp))
    left = left[np.argsort(count[left], kind="stable")]
    other = left if right is None else right[np.argsort(count[right], kind="stable")]
    for a in range(0, len(left), TILE):
        x = left[a:a + TILE]
        for b in range(a if right is None else 0, len(other), TILE):
            y = other[b:b + TILE]
            if count[y[0]] - count[x[-1]] > RADIUS:
                break
            if count[x[0]] - count[y[-1]] > RADIUS:
                continue
            i, j = np.nonzero(np.bitwise_count(fp[x][:, None] ^ fp[y][None, :]) <= RADIUS)
            i, j = x[i], y[j]
            while True:
                while not np.array_equal(root, root[root]):
                    root = root[root]
                p, q = root[i], root[j]
                apart = p != q
                if not apart.any():
                    break
                np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def _compare(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys."""
    cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
    size = np.diff(cut)
    out = [[], []]
    near = np.repeat(size, size) <= 32  # short runs: row i with row i + d, all at once
    for d in range(1, int(size[size <= 32].max(initial=1))):
        i = np.flatnonzero((key[:-d] == key[d:]) & near[:-d]) if len(key) > d else np.zeros(0, int)
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS]
        out[0].append(fp[i])
        out[1].append(fp[i + d])
    for a, b in zip(cut[:-1][size > 32], cut[1:][size > 32]):
        p, q = _forest(fp[a:b], np.arange(b - a))
        out[0].append(p)
        out[1].append(q)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out)


def _link(batches: Iterator[pa.RecordBatch], sides: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; whole keys are held until they end, so a chunk has at most one key more than it needs."""
    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table) -> pa.RecordBatch:
        key, fp = t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        if not sides:
            a, b = _compare(key, fp)
        else:
            side = t.column("side").to_numpy()
            got = []
            cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])) if len(key) else [0]
            for x, y in zip(cut[:-1], cut[1:]):
                s = side[x:y]
                left, right = np.flatnonzero(s < 2), np.flatnonzero(s == 2)
                got.append(_forest(fp[x:y], left, None if s.min() == 0 else right))
            a, b = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.uint64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= 1 << 17 and batch.column("key")[0].as_py() != batch.column("key")[-1].as_py():
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield flush(t.slice(0, last))
            held = t.slice(last).to_batches()
    if held:
        yield flush(pa.Table.from_batches(held))


def links(fps: DataFrame) -> DataFrame:
    """Distinct fp -> (a, b): links that connect all fingerprints within the radius of each other."""
    rows = stored(fps.select(F.explode(keys(F.col("fp"))).alias("key"), "fp"), "simhash-keys")
    many = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT), "simhash-hot")
    calm = rows.join(many, "key", "left_anti").repartition("key").sortWithinPartitions("key", "fp")
    found = calm.mapInArrow(lambda it: _link(it, False), "a long, b long")
    # hot keys: strata by bit count, cut into tiles by hash; every pair of tiles within the radius meets once
    hot = rows.join(many.select("key"), "key", "left_semi").withColumn("p", F.bit_count("fp"))
    tiles = hot.groupBy("key", "p").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(HOT) / 2)).cast("int").alias("parts"))
    hot = hot.join(tiles, ["key", "p"]).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tile = tiles.select("key", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"))
    near = tile.select("key", F.col("p").alias("p2"), F.col("s").alias("s2"), F.explode(F.sequence(F.col("p") - RADIUS, F.col("p"))).alias("p"))
    pairs = tile.join(near, ["key", "p"]).where("p < p2 OR s <= s2").select("key", "p", "s", "p2", "s2")
    pairs = pairs.withColumn("pair", F.xxhash64("key", "p", "s", "p2", "s2"))
    same = (F.col("p") == F.col("p2")) & (F.col("s") == F.col("s2"))
    pairs = pairs.hint("merge")  # never broadcast: it grows with the square of a hot key's tiles
    left = hot.join(pairs, ["key", "p", "s"]).select(F.col("pair").alias("key"), "fp", F.when(same, 0).otherwise(1).alias("side"))
    right = hot.withColumnsRenamed({"p": "p2", "s": "s2"}).join(pairs.where(~same), ["key", "p2", "s2"]).select(F.col("pair").alias("key"), "fp", F.lit(2).alias("side"))
    over = left.unionByName(right).repartition("key").sortWithinPartitions("key", "side").mapInArrow(lambda it: _link(it, True), "a long, b long")
    return found.unionByName(over)


def clusters(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, hash, fp, root, component_id), one row per document; root: a fingerprint that stands for the component."""
    fp = stored(marked(docs, text), "simhash-fp")
    nodes = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    root = components(links(nodes))
    with_root = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    of = with_root.join(least, "root").select("fp", "root", "component_id")
    return fp.join(of, "fp").select("doc_id", "hash", "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """op8: fingerprint as 16 hexadecimal digits and component_id per document."""
    return clusters(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id, nulls last, then by fingerprint and text hash; repeated rows once."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "fp", "hash")).alias("f")
    kept = clusters(docs).groupBy("root").agg(first).select("f.doc_id", F.col("f.hash").alias("_hash"))
    d = join_null_safe(docs.withColumn("_hash", F.xxhash64("text")), kept, ["doc_id", "_hash"])
    row = W.partitionBy("doc_id", "_hash").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)])
    return d.withColumn("_row", F.row_number().over(row)).where("_row = 1").select(*docs.columns)
