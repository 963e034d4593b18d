"""Substring dedup by prefix-partitioned suffix trees.

The suffixes of all texts (at words, with ``WORDS`` words or more left) are split into groups by prefixes of variable
length: a suffix's prefix ends with the least, by hash, of the ``GRAM``-word grams among its first WORDS words, and
that gram is the group's key. Suffixes that agree on WORDS words have the same prefix, so a repeat never crosses
groups. Neighbouring suffixes of a text mostly share their gram, so they travel as one record, a short stretch of
words. Grams that occur once in the corpus can't begin a repeat: the others are marked in a bitmap of fixed size, and a
stretch is sent only if its gram's bit is set (a gram that shares a bit by chance is a group of its own and finds nothing).

A task reads its groups in chunks of bounded size and builds their trees as sorted suffixes with common prefixes,
cut at WORDS words: internal nodes at that depth are the repeated word sequences, the first leaf of a node by
(doc_id, start) is its earliest place, and the others are repeats. Groups with more than ``GROUP`` suffixes are salted
by document: each part reports its nodes' earliest leaves, and these meet once more under the whole sequence's
128-bit hash, at most one per part. Adjacent repeats of a text join to maximal repeated stretches.

Windows are judged on the input. A null text has no words; a null doc_id counts as later than all others; different texts
of one doc_id follow each other by a hash; repeated rows (same doc_id and text) are one document, equally treated and all
returned; an empty table gives an empty one; columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import buffers, mix, ragged, slice_hashes, stored, words
from .tokens import sliced

WORDS, GRAM = 20, 6
GROUP = 4_000  # suffixes of a group that a task builds at once
CHUNK = 1 << 20  # words of records that a task looks at together
LONGEST = 256  # suffixes in a record
SLOTS = 26  # bits of the map of keys that occur again, 8 MB whatever the corpus
LAST = (1 << 63) - 1  # stands for a null doc_id
_R = np.uint64(0xD1342543DE82EF95)
_Q = np.uint64(0xAF251AF3B0F025B5)


def _rolled(h: np.ndarray, n: int, base: np.uint64 = _R) -> np.ndarray:
    """Hash of each run of n words, given the words' hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * base + h[j:len(h) - n + 1 + j]
    return mix(out)


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """The least of each run of n values."""
    done, size = g, 1
    while size * 2 <= n:
        done, size = np.minimum(done[:-size], done[size:]), size * 2
    return np.minimum(done[:len(g) - n + 1], done[n - size:]) if size < n else done


class Stretches:
    """Records of a batch of texts: text, first suffix, suffixes, key, and how often the key's gram is in the record."""

    def __init__(self, texts: pa.Array, n_words: int = WORDS, gram: int = GRAM):
        data, off = buffers(texts)
        start, end, at = words(data, off)
        z = np.zeros(0, np.int64)
        self.text, self.lo, self.n, self.key, self.times = z, z, z, np.zeros(0, np.uint64), z
        if len(start) < n_words:
            return
        g = _rolled(slice_hashes(data, start, end), gram)
        span = n_words - gram + 1
        least = _least(g, span)
        size = np.diff(at)
        valid = np.zeros(len(least) + 1, bool)  # suffixes with enough words left in their text
        valid[ragged(at[:-1], np.maximum(size - n_words + 1, 0))] = True
        valid = valid[:-1] if len(valid) > len(least) else valid
        head = valid.copy()
        head[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        s = np.flatnonzero(head)
        # where each run ends: the next head, or the first suffix that isn't valid
        stop = np.flatnonzero(np.concatenate((valid, [False])) & ~np.concatenate((valid[1:], [False, False]))) + 1
        nxt = np.append(s[1:], len(least) + n_words)
        n = np.minimum(nxt, stop[np.searchsorted(stop, s, "right")]) - s
        # long runs (a gram repeated on and on) are cut
        parts = -(-n // LONGEST)
        k = ragged(np.zeros(len(n), np.int64), parts)
        s, n = np.repeat(s, parts) + k * LONGEST, np.minimum(np.repeat(n, parts) - k * LONGEST, LONGEST)
        self.key = least[s]
        reach = n + span - 1
        same = g[ragged(s, reach)] == np.repeat(self.key, reach)
        self.times = np.add.reduceat(same, np.cumsum(reach) - reach).astype(np.int64) if len(s) else z
        self.text = np.searchsorted(at, s, "right") - 1
        # texts without words share an offset with the next one
        self.lo, self.n = s - at[self.text], n


def _keys() -> list[Column]:
    """What a document is known by: its id, and a hash of its text that tells texts of one id (or of none) apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("tag")]


def grams(docs: DataFrame) -> DataFrame:
    """(key, n): how often each prefix-ending gram occurs, summed by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in sliced(b.column("text"), 8 << 20):
                s = Stretches(b.column("text").slice(x, y - x))
                key, back = np.unique(s.key, return_inverse=True)
                n = np.bincount(back, np.maximum(s.times, s.n // (WORDS - GRAM + 1)), len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long")


def bitmap(many: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """A bit for each value of a key's upper ``slots`` bits: whether such a key is in the table. Its size is fixed."""
    slot = F.shiftrightunsigned("key", 64 - slots)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = many.select(F.shiftright(slot, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (slots - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def records(docs: DataFrame, seen: np.ndarray) -> DataFrame:
    """(key, doc, tag, lo, n, words): the stretches whose key may occur again, with their words."""
    shift, low = np.uint64(64 - (len(seen).bit_length() + 5)), np.uint64(63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in sliced(b.column("text"), 4 << 20):
                part = b.slice(x, y - x)
                s = Stretches(part.column("text"))
                slot = s.key >> shift
                use = np.flatnonzero(seen[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & low) & np.uint64(1))
                data, off = buffers(part.column("text"))
                start, end, edge = words(data, off)
                row, lo, n = s.text[use], s.lo[use], s.n[use]
                first = edge[row] + lo
                raw = data.tobytes()
                cut = [raw[i:j] for i, j in zip(start[first].tolist(), end[first + n + WORDS - 2].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s.key[use].view(np.int64)), *[pa.array(part.column(c).to_numpy()[row]) for c in ("doc", "tag")], pa.array(lo), pa.array(n), pa.array(cut, pa.binary())],
                                                 names=["key", "doc", "tag", "lo", "n", "words"])

    return docs.select(*_keys(), "text").mapInArrow(run, "key long, doc long, tag long, lo long, n long, words binary")


def _subtrees(t: pa.Table) -> pa.RecordBatch:
    """Repeats of whole groups: rows (whole, doc, tag, lo, hi, w1, w2); of salted groups also the earliest leaves (whole false)."""
    key, salt, parts, doc, tag, lo, n = (t.column(c).to_numpy() for c in ("key", "salt", "parts", "doc", "tag", "lo", "n"))
    text = t.column("words").combine_chunks()
    text = (pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text).cast(pa.large_binary())
    data, off = buffers(pa.LargeStringArray.from_buffers(len(text), text.buffers()[1], text.buffers()[2]) if text.offset == 0 else pa.array(text.to_pylist(), pa.large_binary()).view(pa.large_string()))
    start, end, edge = words(data, off)
    # words as numbers; equal numbers mean equal words
    cuts = np.empty(2 * len(start) + 1, np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = start, end, len(data)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    ids = pieces.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode().indices.to_numpy().astype(np.int64)
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))))
    rec = np.repeat(np.arange(len(key)), n)
    begin = lo[rec] + ragged(np.zeros(len(n), np.int64), n)
    p = ragged(edge[:-1], n)
    # suffixes in the order of their words: three words in each sort key (fewer than 2^21 different words in a chunk)
    cols = []
    for j in range(0, WORDS, 3):
        c = ids[p + j] << 42
        for i in (1, 2):
            if j + i < WORDS:
                c |= ids[p + j + i] << (42 - 21 * i)
        cols.append(c)
    order = np.lexsort((begin, tag[rec], doc[rec], *cols[::-1], group[rec]))
    new = np.ones(len(order), bool)
    if len(order):
        alike = group[rec][order][1:] == group[rec][order][:-1]
        for c in cols:
            alike &= c[order][1:] == c[order][:-1]
        new[1:] = ~alike
    # the earliest leaf of each node; leaves at the very same place (repeated rows) are no repeats
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    later = np.zeros(len(order), bool)
    later[order] = (doc[rec][order] != doc[rec][first]) | (tag[rec][order] != tag[rec][first]) | (begin[order] != begin[first])
    kept = ~later & (parts[rec] > 1)
    # repeats as stretches of suffixes
    i = np.flatnonzero(later)
    head = np.ones(len(i), bool)
    head[1:] = (rec[i][1:] != rec[i][:-1]) | (begin[i][1:] != begin[i][:-1] + 1)
    h = np.flatnonzero(head)
    size = np.diff(np.append(h, len(i)))
    a = i[h]
    k = np.flatnonzero(kept)
    w = [np.zeros(len(k), np.uint64)] * 2
    if len(k):
        hashes = slice_hashes(data, start, end)
        w = []
        for base in (_R, _Q):
            x = np.zeros(len(k), np.uint64)
            for j in range(WORDS):
                x = x * base + (hashes[p[k] + j] if base == _R else mix(hashes[p[k] + j] + _Q))
            w.append(mix(x))
    z = np.zeros(len(a), np.int64)
    both = lambda x, y: pa.array(np.concatenate((x, y)).astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((np.ones(len(a), bool), np.zeros(len(k), bool)))), both(doc[rec[a]], doc[rec[k]]), both(tag[rec[a]], tag[rec[k]]), both(begin[a], begin[k]),
         both(begin[a] + size - 1, begin[k]), both(z, w[0].view(np.int64)), both(z, w[1].view(np.int64))], names=["whole", "doc", "tag", "lo", "hi", "w1", "w2"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups come sorted; whole ones are gathered until there are about CHUNK words."""
    held, size = [], 0
    for b in batches:
        # a batch may hold many words: it is taken in slices
        for x in range(0, b.num_rows, 4096):
            part = b.slice(x, 4096)
            held.append(part)
            size += int(part.column("n").to_numpy().sum()) + WORDS * part.num_rows
            if size < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
            ended = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
            if len(ended):
                yield _subtrees(t.slice(0, int(ended[-1]) + 1))
                held = t.slice(int(ended[-1]) + 1).to_batches()
                size = sum(int(h.column("n").to_numpy().sum()) + WORDS * h.num_rows for h in held)
    if held:
        yield _subtrees(pa.Table.from_batches(held))


def repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc, tag, lo, hi): suffixes lo .. hi of a document start with WORDS words that also start earlier."""
    many = stored(grams(docs).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "grams", "zstd")
    hot = stored(many.where(F.col("n") > group).select("key", F.ceil(F.col("n") / group).cast("long").alias("parts")), "hot-grams")
    recs = records(docs, bitmap(many)).join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("salt", F.pmod(F.xxhash64("doc", "tag"), F.col("parts")))
    found = recs.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_trees, "whole boolean, doc long, tag long, lo long, hi long, w1 long, w2 long")
    found = stored(found, "repeats")
    leaves = found.where("NOT whole")
    least = leaves.groupBy("w1", "w2").agg(F.min(F.struct("doc", "tag", "lo")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    late = leaves.join(least, ["w1", "w2"]).where("struct(doc, tag, lo) > m")
    return found.where("whole").select("doc", "tag", "lo", "hi").unionByName(late.select("doc", "tag", "lo", "hi"))


def removed(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(row, n_words, n_removed, kept): each row of ``docs`` as a struct, and the words no repeat covers, joined by one space."""
    runs = repeats(docs.select("doc_id", "text"), group).groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    # the input's columns travel as one, so that their names meet no others
    d = docs.select(F.struct(*docs.columns).alias("row"), *_keys()).join(runs, ["doc", "tag"], "left").select("row", F.col("row.text").alias("text"), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x, y in sliced(whole.column("text"), 8 << 20) or [(0, 0)]:
                b = whole.slice(x, y - x)
                data, off = buffers(b.column("text"))
                start, end, edge = words(data, off)
                rec = b.column("runs")
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(rec).fill_null(0).to_numpy())
                flat = rec.flatten()
                lo, hi = (flat.field(c).to_numpy() for c in ("lo", "hi"))
                step = np.zeros(len(start) + 1, np.int64)
                np.add.at(step, edge[row] + lo, 1)
                np.add.at(step, edge[row] + hi + WORDS, -1)
                gone = np.cumsum(step)[:-1] > 0
                # the bytes of kept words, one space after each; the last of a text is cut off
                live = np.flatnonzero(~gone)
                size = end[live] - start[live] + 1
                pad = np.append(data, np.uint8(32))
                src = ragged(start[live], size)
                stop = np.cumsum(size) - 1
                out = pad[np.minimum(src, len(data))]
                out[stop] = 32
                byte = np.concatenate(([0], np.cumsum(size)))
                at = byte[np.searchsorted(live, edge)]
                raw = out.tobytes()
                kept = [raw[i:max(i, j - 1)] for i, j in zip(at.tolist(), at[1:].tolist())]
                n_gone = np.concatenate(([0], np.cumsum(gone)))[edge]
                more = [pa.array(np.diff(edge)), pa.array(np.diff(n_gone)), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([b.column("row"), *more], names=["row", "n_words", "n_removed", "kept"])

    schema = StructType([StructField("row", docs.schema), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    return d.mapInArrow(run, schema)


def report(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """op2: per document its words, those removed, and the digest of the kept ones."""
    d = removed(docs.select("doc_id", "text"), group)
    return d.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with their texts cut down to the kept words; all other columns unchanged."""
    return removed(docs).select(*[F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
