"""Near-dedup at a similarity: SimHash tiles find candidates, whole shingle sets confirm them.

Documents whose sets of ``SHINGLE``-word shingles (fewer words: the whole sequence) are equal are one node. A node's
128-bit fingerprint has a bit where more than half of its distinct shingles' hashes have it. At similarity 0.8 two
fingerprints differ in about 19 bits, unrelated ones in 64; pairs within ``RADIUS`` are candidates. Nodes meet under keys of
some fixed random bits of their fingerprints: log2(nodes) - 4 bits a key, so that a key holds a few unrelated nodes at any
corpus size, and as many keys as it takes for a pair of the similarity to meet with probability ``MEET``. Under a key, nodes
are compared tile by tile by exclusive-or and bit counts, tile pairs skipped by population count.

Keys of at most ``SHORT`` nodes give all their candidates, others two for each node: the nearest and the least of those
before it. Keys of more than ``HOT`` nodes are salted; nodes with none before them in their part meet once more under the key. So
a group of copies of any size gives a number of pairs in proportion to it. Candidates are screened by parity marks (a bit flips
with each shingle that falls on it: sets that differ in k shingles differ in at most k bits, so what is too far apart for the
similarity is known without the sets, and no similar pair is lost), then confirmed by the Jaccard similarity of the whole sets (as
32-bit hashes); confirmed pairs are linked to components. Then the longer keys whose nodes are not all of one component are
compared again between different components, the only pairs that can still link anything, and what the marks leave is
confirmed. No key drops a pair that would change a component. Meeting under a key is a matter of
chance, so recall is measured (tests, README), not guaranteed.

No words (null, empty or white space): one node. Repeated rows and equal texts are one node; a null doc_id is last in its
component. An empty table gives an empty one. Own columns of the input with inner names are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffers, lean, mix, slice_hashes, stored, words
from .graph import components
from .tokens import encoder, sliced

SHINGLE, SIMILARITY, RADIUS, MEET = 5, 0.8, 30, 0.97
BITS = 128
SHORT, HOT, TILE = 32, 8192, 512
PART = 2048  # nodes of a key compared with as many others at a time
STRETCH = 512 << 10  # bytes of text taken together
MARKS = 2048  # bits of a set's parity marks
_ROWS = 1 << 14  # shingles whose bits are unpacked at a time
_LANE = (np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127))
_BASE = np.uint64(0xD1342543DE82EF95)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the offsets of the texts among them."""
    data, off = buffers(texts)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, at = words(low, off)
    h, size = slice_hashes(low, start, end), np.diff(at)
    text = np.repeat(np.arange(len(size)), size)
    first = np.arange(len(h))
    room = at[1:][text] - first
    short = np.flatnonzero((size[text] < n) & (first == at[:-1][text]))
    begin = np.concatenate((np.flatnonzero(room >= n), short))
    long = np.minimum(size[text[begin]], n)
    out = np.zeros(len(begin), np.uint64)
    for j in range(n):
        live = long > j
        out[live] = out[live] * _BASE + h[begin[live] + j]
    out = mix(out)
    owner = text[begin]
    by = np.lexsort((out, owner))
    out, owner = out[by], owner[by]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.searchsorted(owner[new], np.arange(len(size) + 1))


def fingerprints(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 2) fingerprints and (texts, 2) digests of the sets."""
    n = len(off) - 1
    total, digest = np.zeros((n, BITS), np.int64), np.zeros((n, 2), np.uint64)
    owner = np.repeat(np.arange(n), np.diff(off))
    for a in range(0, len(sets), _ROWS):
        o, s = owner[a:a + _ROWS], sets[a:a + _ROWS]
        cut = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        lanes = np.stack([mix(s ^ c) for c in _LANE], 1)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
        total[o[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
        digest[o[cut]] += np.add.reduceat(mix(lanes + _BASE), cut, axis=0)
    return np.packbits(2 * total > np.diff(off)[:, None], axis=1, bitorder="little").view(np.uint64), digest


def short_sets(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets as 32-bit hashes, distinct and ascending in each text, and their offsets."""
    short, owner = (sets >> np.uint64(32)).astype(np.uint32), np.repeat(np.arange(len(off) - 1), np.diff(off))
    new = np.ones(len(short), bool)
    new[1:] = (short[1:] != short[:-1]) | (owner[1:] != owner[:-1])
    return short[new], np.searchsorted(owner[new], np.arange(len(off)))


def marks(short: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, MARKS / 64) parity marks of the sets: each shingle flips one bit."""
    out = [np.zeros((0, MARKS // 64), np.uint64)]
    for a in range(0, len(off) - 1, 1024):
        at = off[a:a + 1025]
        n = len(at) - 1
        place = np.repeat(np.arange(n), np.diff(at)) * MARKS + short[at[0]:at[-1]] % MARKS
        odd = (np.bincount(place, minlength=n * MARKS) & 1).astype(np.uint8).reshape(n, MARKS)
        out.append(np.packbits(odd, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(out)


def allowed(similarity: float) -> float:
    """The share of both sets' sizes in which similar sets may differ."""
    return (1 - similarity) / (1 + similarity)


def measured(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, hash, d1, d2, f1, f2, size, marks): a hash of the text, the digest, fingerprint, size and marks of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # left by a stage that encodes
        for whole in batches:
            for x, y in sliced(whole.column("text"), STRETCH):
                b = whole.slice(x, y - x)
                sets, off = shingle_sets(b.column("text"), shingle)
                fp, digest = fingerprints(sets, off)
                cols = [*digest.T, *fp.T]
                short, off = short_sets(sets, off)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * (MARKS // 64), pa.int32()), pa.array(marks(short, off).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols], pa.array(np.diff(off), pa.int64()), bits],
                                                 names=["doc_id", "hash", "d1", "d2", "f1", "f2", "size", "marks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(lean(run), f"doc_id {kind}, hash long, d1 long, d2 long, f1 long, f2 long, size long, marks array<long>")


def bands(nodes: int, similarity: float = SIMILARITY, meet: float = MEET) -> np.ndarray:
    """The bit positions of each key, for a number of nodes: sets of equal size at the similarity agree in a bit with a chance
    that follows from the angle between them."""
    width = max(8, math.ceil(math.log2(max(nodes, 2))) - 4)
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    count = math.ceil(math.log(1 - meet) / math.log(1 - agree**width))
    g = np.random.default_rng(42)
    return np.array([np.sort(g.choice(BITS, width, replace=False)) for _ in range(count)])


def keyed(nodes: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(key, node, f1, f2): a row for each key of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.uint64(1) << np.arange(chosen.shape[1], dtype=np.uint64)
        for b in batches:
            for x in range(0, b.num_rows, 512):
                part = b.slice(x, 512)
                f = [part.column(c).to_numpy() for c in ("f1", "f2")]
                bits = np.unpackbits(np.stack(f, 1).view(np.uint8), axis=1, bitorder="little")
                key = np.stack([mix(bits[:, pos] @ power * np.uint64(len(chosen)) + np.uint64(i)) for i, pos in enumerate(chosen)], 1)
                n = len(chosen)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *[pa.array(np.repeat(v, n)) for v in (part.column("node").to_numpy(), *f)]], names=["key", "node", "f1", "f2"])

    return nodes.select("node", "f1", "f2").mapInArrow(lean(run), "key long, node long, f1 long, f2 long")


def _far(f: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f[i] ^ f[j]).sum(-1, dtype=np.int16)


def _tiles(node: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, the least and the nearest of the rows before it (smaller nodes) within the radius: (row, other node); and rows with none."""
    count = np.bitwise_count(f).sum(1, dtype=np.int16)
    by = np.argsort(count, kind="stable")
    none = np.iinfo(np.int64).max
    least, near, at = np.full(len(node), none), np.full(len(node), none), np.full(len(node), BITS + 1)
    for a in range(0, len(by), TILE):
        x = by[a:a + TILE]
        for b in range(a, len(by), TILE):
            y = by[b:b + TILE]
            if count[y[0]] - count[x[-1]] > radius:
                break
            i, j = np.nonzero(_far(f, x[:, None], y[None, :]) <= radius)
            i, j = x[i], y[j]
            apart = node[i] != node[j]
            i, j = i[apart], j[apart]
            late, early = np.where(node[i] > node[j], i, j), np.where(node[i] > node[j], j, i)
            d = _far(f, late, early)
            np.minimum.at(least, late, node[early])
            order = np.lexsort((node[early], d, late))
            late, early, d = late[order], early[order], d[order]
            head = np.concatenate(([True], late[1:] != late[:-1])) if len(late) else np.zeros(0, bool)
            late, early, d = late[head], early[head], d[head]
            closer = (d < at[late]) | (d == at[late]) & (node[early] < near[late])
            near[late[closer]], at[late[closer]] = node[early[closer]], d[closer]
    has = np.flatnonzero(least != none)
    return np.concatenate((has, has)), np.concatenate((least[has], near[has])), np.flatnonzero(least == none)


def _candidates(t: pa.Table, radius: int) -> pa.RecordBatch:
    """Rows sorted by key and salt: pairs (a, b), and of parts of salted keys the rows with none before them (b null)."""
    key, salt, parts, node = (t.column(c).to_numpy() for c in ("key", "salt", "parts", "node"))
    f = np.stack([t.column(c).to_numpy() for c in ("f1", "f2")], 1).view(np.uint64)
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))))
    cut = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
    size = np.diff(cut)
    a, b, alone = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = np.repeat((size <= SHORT) & (parts[cut[:-1]] == 1), size)
    for d in range(1, min(int(size.max()), SHORT)):
        i = np.flatnonzero((group[:-d] == group[d:]) & few[:-d])
        i = i[_far(f, i, i + d) <= radius]
        a.append(node[i])
        b.append(node[i + d])
    for x, y in zip(cut[:-1], cut[1:]):
        if not few[x]:
            row, other, free = _tiles(node[x:y], f[x:y], radius)
            a.append(node[x + row])
            b.append(other)
            if parts[x] > 1:
                alone.append(x + free)
    a, b, alone = (np.concatenate(v) for v in (a, b, alone))
    n, m = len(a), len(alone)
    late, early = np.maximum(a, b), np.minimum(a, b)
    nulls = np.concatenate((np.zeros(n, bool), np.ones(m, bool)))
    pad = lambda v, w: pa.array(np.concatenate((v, w)))
    z = np.zeros(n, np.int64)
    return pa.RecordBatch.from_arrays([pad(late, node[alone]), pa.array(np.concatenate((early, np.zeros(m, np.int64))), mask=nulls), pad(z, key[alone]), *[pad(z, np.ascontiguousarray(f[alone, k]).view(np.int64)) for k in (0, 1)]],
                                      names=["a", "b", "key", "f1", "f2"])


def _met(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b, key, f1, f2) of rows (key, salt, parts, node, f1, f2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(h.num_rows for h in held) < 1 << 16:
                continue
            t = pa.Table.from_batches(held)
            key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
            ended = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
            if len(ended):
                yield _candidates(t.slice(0, int(ended[-1]) + 1), radius)
                held = t.slice(int(ended[-1]) + 1).to_batches()
        if held:
            yield _candidates(pa.Table.from_batches(held), radius)

    laid = rows.select("key", "salt", "parts", "node", "f1", "f2").repartition("key", "salt").sortWithinPartitions("key", "salt", "node")
    return laid.mapInArrow(lean(run), "a long, b long, key long, f1 long, f2 long")


def candidates(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct pairs (a, b) of keyed nodes to be confirmed first."""
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).withColumn("parts", F.ceil(F.col("_n") / HOT).cast("long")).drop("_n")
    salted = rows.join(many, "key").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")))
    found = stored(_met(salted, radius), "near-pairs")
    again = found.where("b IS NULL").select("key", F.lit(0).cast("long").alias("salt"), F.lit(1).cast("long").alias("parts"), F.col("a").alias("node"), "f1", "f2")
    return found.where("b IS NOT NULL").select("a", "b").unionByName(_met(again, radius).select("a", "b")).distinct()


def remaining(rows: DataFrame, roots: DataFrame, radius: int = RADIUS, nodes: DataFrame | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs (a, b) of different components within the radius, of keys of more than SHORT nodes; with nodes
    (node, size, marks) those whose marks allow the similarity.

    Under a key the nodes outside its most frequent component are compared with all, in cells of at most PART by PART nodes. A key
    of one component is left out. What leaves a cell are pairs that the marks can't tell from similar ones."""
    limit = allowed(similarity)
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"))
    keys = keys.where((F.col("n") > SHORT) & (F.col("n") > F.col("most")))
    parts = lambda n: F.ceil(n / PART).cast("long")
    own, hash_ = F.col("root") == F.col("main"), F.xxhash64("node")
    d = rooted.join(keys, "key").withColumn("own", own).withColumn("others", parts(F.col("n") - F.col("most")))
    d = d.withColumn("part", F.pmod(hash_, F.when(F.col("own"), parts(F.col("most"))).otherwise(F.col("others"))))
    row, base = ["key", "node", "root", "f1", "f2", "size", "marks"], parts(F.col("most"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    d = d.join(nodes.select("node", "size", "marks"), "node") if nodes is not None else d.select("*", F.lit(0).cast("long").alias("size"), F.lit([0] * (MARKS // 64)).cast("array<long>").alias("marks"))
    rest = d.where("NOT own")
    # cells (i, j) of one part of the others and one part of the main component, or of the others (j counts on)
    sides = [d.where("own").select(*row, every(F.col("others")).alias("i"), F.col("part").alias("j"), F.lit(1).alias("side")),
             rest.select(*row, F.col("part").alias("i"), every(base + F.col("others")).alias("j"), F.lit(0).alias("side")),
             rest.select(*row, every(F.col("others")).alias("i"), (base + F.col("part")).alias("j"), F.lit(1).alias("side"))]
    laid = sides[0].unionByName(sides[1]).unionByName(sides[2]).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def compared(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, root, side, size = (t.column(c).to_numpy() for c in ("node", "root", "side", "size"))
        bits = t.column("marks").combine_chunks().flatten().to_numpy().reshape(-1, MARKS // 64).view(np.uint64)
        f = np.stack([t.column(c).to_numpy() for c in ("f1", "f2")], 1).view(np.uint64)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a in range(0, len(x), TILE):
            for b in range(0, len(y), TILE):
                i, j = np.nonzero(_far(f, x[a:a + TILE, None], y[None, b:b + TILE]) <= radius)
                i, j = x[a + i], y[b + j]
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                for k in range(0, len(i), 1 << 14):
                    p, q = i[k:k + (1 << 14)], j[k:k + (1 << 14)]
                    near = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64) <= limit * (size[p] + size[q]) + 1e-6
                    p, q = p[near], q[near]
                    out.append((np.maximum(node[p], node[q]), np.minimum(node[p], node[q])))
        return tuple(np.concatenate(v) for v in zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ended(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            cell = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], 0)) + 1
            edges = [0, *cut.tolist(), *([t.num_rows] if last else [])]
            for x, y in zip(edges, edges[1:]):
                a, b = compared(t.slice(x, y - x))
                for k in range(0, len(a), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(a[k:k + (1 << 16)]), pa.array(b[k:k + (1 << 16)])], names=["a", "b"])
            held[:] = t.slice(edges[-1]).to_batches() if not last else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(h.num_rows for h in held) >= 1 << 14:
                    yield from ended(pa.Table.from_batches(held), False)
        if held:
            yield from ended(pa.Table.from_batches(held), True)

    return laid.select(*row, "i", "j", "side").mapInArrow(lean(run), "a long, b long").distinct()


def screened(pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose marks allow the similarity."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("marks").alias(f"marks_{c}"))
    differ = F.aggregate(F.zip_with("marks_a", "marks_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    return pairs.join(of("a"), "a").join(of("b"), "b").where(differ <= (F.col("size_a") + F.col("size_b")) * allowed(similarity) + 1e-6).select("a", "b")


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose whole shingle sets have the similarity. nodes: node, and doc_id, hash of a document that stands for it."""
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    keys = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    of = nodes.join(used, "node").select("node", *keys, "hash")
    texts = docs.select(*keys, F.xxhash64("text").alias("hash"), "text").join(of, ["_id", "_none", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x, y in sliced(whole.column("text"), STRETCH):
                b = whole.slice(x, y - x)
                short, off = short_sets(*shingle_sets(b.column("text"), shingle))
                raw = [short[i:j].tobytes() for i, j in zip(off.tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(raw, pa.binary())], names=["node", "shingles"])

    sets = stored(texts.select("node", "text").mapInArrow(lean(run), "node long, shingles binary").dropDuplicates(["node"]), "near-sets", "zstd")
    both = pairs.join(sets.withColumnsRenamed({"node": "b", "shingles": "q"}), "b").join(sets.withColumnsRenamed({"node": "a", "shingles": "p"}), "a")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column("p"), b.column("q")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint32) for v in (p, q))
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(same >= similarity * (len(p) + len(q) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return both.select("a", "b", "p", "q").mapInArrow(lean(alike), "a long, b long")


def clusters(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, hash, root) of every document; root: a node that stands for its component."""
    m = stored(measured(docs, shingle), "near-measured", "zstd")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("f")
    nodes = m.groupBy("d1", "d2").agg(first, F.min("f1").alias("f1"), F.min("f2").alias("f2"), F.min("size").alias("size"), F.first("marks").alias("marks"))
    nodes = stored(nodes.select("d1", "d2", "f1", "f2", "size", "marks", "f.doc_id", "f.hash", F.monotonically_increasing_id().alias("node")), "near-nodes", "zstd")
    n = nodes.count()
    rows = stored(keyed(nodes, bands(n, similarity)), "near-keys")
    pairs = stored(screened(candidates(rows), nodes, similarity), "near-candidates")
    links = components(confirmed(docs, nodes, pairs, shingle, similarity))
    rest = stored(remaining(rows, links, nodes=nodes, similarity=similarity).join(pairs, ["a", "b"], "left_anti"), "near-remaining")
    more = confirmed(docs, nodes, rest, shingle, similarity)
    links = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    root = nodes.select("node", "d1", "d2").join(links, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("root"))
    return m.join(root, ["d1", "d2"]).select("doc_id", "hash", "root")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component: that with the smallest doc_id, nulls last, then by text hash; repeated rows once."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("f")
    kept = clusters(docs.select("doc_id", "text"), shingle, similarity).groupBy("root").agg(first)
    kept = kept.select(F.coalesce("f.doc_id", F.lit(0)).alias("_keep_id"), F.col("f.none").alias("_keep_none"), F.col("f.hash").alias("_keep_hash"))
    row = F.struct(*docs.columns)
    d = docs.select(F.coalesce("doc_id", F.lit(0)).alias("_keep_id"), F.col("doc_id").isNull().alias("_keep_none"), F.xxhash64("text").alias("_keep_hash"), row.alias("_keep_row"))
    once = d.join(kept, ["_keep_id", "_keep_none", "_keep_hash"]).groupBy("_keep_id", "_keep_none", "_keep_hash").agg(F.min("_keep_row").alias("_keep_row"))
    return once.select("_keep_row.*")
