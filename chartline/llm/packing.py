"""Packing along a space-filling curve.

A document's byte trigrams are hashed into a vector of ``BUCKETS`` counts, which is set to length 1 and projected on
``DIMS`` fixed random directions. Its place on the Hilbert curve through that space is its key. Documents are
sorted by key across partitions (ranges of the key, then doc_id, so that many equal documents spread out), turned
into token ids, and laid one after another into sequences of ``LENGTH`` ids, cut wherever a sequence is full; so
neighbours on the curve share sequences. What is left at the end of a partition is cut into sequences whose
lengths are powers of two, which need no padding.

A null or empty text is its end id alone. Repeated rows are packed each; ties on key and doc_id go by a hash of the text.
An empty table gives an empty result. The order in a partition, and so the pieces, depend on the data and the
partitions' bounds alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import buffers
from .tokens import encoder, regrouped, sliced

LENGTH, END = 1024, 0
RANGES = 4  # ranges of the curve for each shuffle partition
BUCKETS, DIMS, BITS = 256, 4, 15
TOKENIZER = "byte_bpe_50k.json"
_DIRECTIONS = np.random.default_rng(42).standard_normal((BUCKETS, DIMS))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vectors(texts: pa.Array) -> np.ndarray:
    """One row of DIMS numbers per text."""
    out = np.zeros((len(texts), DIMS))
    for a, b in sliced(texts, 4 << 20):
        data, off = buffers(texts.slice(a, b - a))
        n = len(off) - 1
        count = np.zeros(n * BUCKETS)
        if len(data) > 2:
            d = data.astype(np.uint32)
            t = (d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]) * np.uint32(2654435761) >> np.uint32(24)
            text = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(off))[:-2]
            inside = np.ones(len(data), bool)
            for k in (1, 2):
                ends = off[1:] - k
                inside[ends[ends >= 0]] = False
            count = np.bincount((text + t)[inside[:-2]], minlength=n * BUCKETS).astype(float)
        v = count.reshape(n, BUCKETS)
        v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
        out[a:b] = v @ _DIRECTIONS
    return out


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of points with integer coordinates of ``bits`` bits, one row each."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    # undo the turns of each level, from the coarsest to the finest cell
    q = np.int64(1 << (bits - 1))
    while q > 1:
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(turned, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.int64(1 << (bits - 1))
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    # one bit of each coordinate in turn, the highest first
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    cell = np.clip((vectors(texts) + 3.0) / 6.0, 0, 1) * ((1 << BITS) - 1)
    return hilbert(np.round(cell))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(curve_keys(b.column("text")))], names=["doc_id", "text", "_key"])


class Layer:
    """Lays documents' ids into sequences; gives finished pieces."""

    def __init__(self, first_id: int, length: int):
        self.next, self.length = first_id, length
        self.open: list[tuple] = []  # pieces of the sequence that isn't full: doc, start, ids, tokens of the document
        self.fill = 0
        self.done: list[tuple] = []

    def _close(self) -> None:
        at = 0
        for doc, start, ids, total in self.open:
            self.done.append((doc, start, len(ids), total, self.next, at, ids))
            at += len(ids)
        self.open, self.fill, self.next = [], 0, self.next + 1

    def add(self, doc, ids: np.ndarray, room: int | None = None, start: int = 0, total: int | None = None) -> None:
        total, at = len(ids) if total is None else total, 0
        while at < len(ids):
            take = min((room or self.length) - self.fill, len(ids) - at)
            self.open.append((doc, start + at, ids[at:at + take], total))
            self.fill += take
            at += take
            if self.fill == (room or self.length):
                self._close()
                if room is not None:
                    self.rest.append((doc, start + at, ids[at:], total))
                    return

    def finish(self) -> None:
        """Cuts what is left into sequences whose lengths are powers of two, the longest first."""
        left = self.open
        size = self.fill
        self.open, self.fill = [], 0
        while size:
            room = 1 << (size.bit_length() - 1)
            self.rest = []
            todo = [x for x in left if len(x[2])]
            for k, (doc, start, ids, total) in enumerate(todo):
                self.add(doc, ids, room, start, total)
                if self.rest:
                    left = self.rest + todo[k + 1:]
                    break
            size -= room

    def batch(self, doc_type: pa.DataType) -> pa.RecordBatch:
        rows, self.done = self.done, []
        cols = list(zip(*rows)) if rows else [()] * 7
        types = [doc_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(cols[:6], types)]
        arrays.append(pa.array([x.astype("<u4").tobytes() for x in cols[6]], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    path = path or tokenizer_path(TOKENIZER)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text").mapInArrow(_keyed, f"doc_id {kind}, text string, _key long")
    order = ["_key", "doc_id", F.xxhash64("text")]
    # ranges hold equal numbers of documents, and long ones lie close on the curve: more, smaller ranges even out bytes
    parts = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, layer, doc_type = encoder(path, "byte"), Layer(TaskContext.get().partitionId() << 36, length), pa.int64()
        for b in regrouped(batches, "text"):
            ids, off = enc.encode(b.column("text"))
            doc_type = b.schema.field("doc_id").type
            for doc, x, y in zip(b.column("doc_id").to_pylist(), off.tolist(), off[1:].tolist()):
                layer.add(doc, np.append(ids[x:y], np.uint32(end)))
            yield layer.batch(doc_type)
        layer.finish()
        yield layer.batch(doc_type)

    return laid.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def report(docs: DataFrame) -> DataFrame:
    """op5: the pieces with the crc32 of their ids."""
    return packed(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
