"""Token ids in a compressed binary format: static range asymmetric numeral systems.

One table of symbol frequencies, counted over the whole corpus, is shared by all blocks. A block holds whole
documents with about ``BLOCK`` ids; its symbols are dealt to ``LANES`` coders in turn, whose 64-bit states are
renormalised by 32-bit words into one interleaved stream. Blocks are independent of each other; inside a block
checkpoints (states and place in the stream, every ``EVERY`` steps) let its parts be decoded apart, and checksums
cover the block and tie it to its table. Numpy codes all lanes at once.

A block, little-endian, all of it opaque to the table that carries it (columns part, seq, before, n_docs, n_tokens, block):

    4s magic, u16 version, u16 lanes, u8 scale bits, 3x, u32 crc of the table, u32 documents, u64 ids, u32 checkpoints,
    u32 words; per document i64 doc_id, u8 whether it is null, u32 ids; per checkpoint u32 step, u32 word, lanes x u64
    states; words x u32; u32 crc of all before

Documents are laid out in ascending doc_id order (nulls first, equal ids by a hash of the text): range partitions,
and in them blocks by ``seq``, the number of their first document. A null or empty text is its end id alone; repeated
rows are kept each; an empty table gives no blocks. One document is never cut, so a block may be longer than ``BLOCK``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .packing import tokenizer_path
from .tokens import encoder, regrouped

TOKENIZER, END = "word_bpe_49k.json", 2
LANES, SCALE, BLOCK, EVERY = 512, 20, 1 << 18, 256
_HEAD = struct.Struct("<4sHHB3xIIQII")
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


class Table:
    """Frequencies of all symbols, scaled to sum to 2^SCALE; every symbol that occurs has one at least."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        """The symbol of each slot."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        total, m = int(counts.sum()), 1 << SCALE
        if not total:
            return cls(np.zeros(len(counts), np.int64))
        if np.count_nonzero(counts) > m:
            raise ValueError("more symbols than slots")
        freq = np.where(counts > 0, np.maximum(1, counts * (m / total)).astype(np.int64), 0)
        order = np.argsort(-freq, kind="stable")
        short = m - int(freq.sum())
        if short > 0:
            freq[order[0]] += short
        while short < 0:  # the most frequent give what the rare ones were raised by
            for s in order:
                give = min(-short, int(freq[s]) // 8 + (freq[s] > 1))
                give = min(give, int(freq[s]) - 1)
                freq[s] -= give
                short += give
                if not short:
                    break
        return cls(freq)


def encode(ids: np.ndarray, sizes: np.ndarray, docs: list, table: Table) -> bytes:
    """A block of documents, given all their ids and how many each has."""
    n, shift = len(ids), np.uint64(63 - SCALE)
    steps = -(-n // LANES)
    state = np.full(LANES, _LOW, np.uint64)
    groups: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    marks: list[tuple[int, np.ndarray]] = []
    scale = np.uint64(SCALE)
    freq, cum = table.freq[ids], table.cum[ids]
    limit = freq << shift
    for t in range(steps - 1, -1, -1):
        now = slice(t * LANES, min((t + 1) * LANES, n))
        f = freq[now]
        x = state[:len(f)]
        full = np.flatnonzero(x >= limit[now])
        over = x[full]
        groups[t] = over.astype(np.uint32)
        x[full] = over >> _32
        q = x // f
        x -= q * f
        x += (q << scale) + cum[now]
        if t % EVERY == 0:
            marks.append((t, state.copy()))
    before = np.concatenate(([0], np.cumsum([len(g) for g in groups])))
    words = np.concatenate(groups) if groups else np.zeros(0, np.uint32)
    out = [_HEAD.pack(b"RANS", 1, LANES, SCALE, table.crc, len(docs), n, len(marks), len(words)),
           np.array([0 if d is None else d for d in docs], "<i8").tobytes(), bytes(d is None for d in docs), sizes.astype("<u4").tobytes()]
    for t, st in reversed(marks):
        out += [struct.pack("<II", t, int(before[t])), st.astype("<u8").tobytes()]
    out.append(words.astype("<u4").tobytes())
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block read back; raises ValueError where a checksum or the table doesn't fit."""

    def __init__(self, raw: bytes, table: Table):
        if len(raw) < _HEAD.size + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged block")
        magic, version, self.lanes, self.scale, crc, docs, self.n, marks, words = _HEAD.unpack_from(raw)
        if magic != b"RANS" or version != 1 or crc != table.crc:
            raise ValueError("not a block of this table")
        at = _HEAD.size
        ids = np.frombuffer(raw, "<i8", docs, at)
        null = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
        self.docs = [None if z else int(d) for d, z in zip(ids, null)]
        self.sizes = np.frombuffer(raw, "<u4", docs, at + 9 * docs).astype(np.int64)
        at += 13 * docs
        self.marks = []
        for _ in range(marks):
            step, word = struct.unpack_from("<II", raw, at)
            self.marks.append((step, word, np.frombuffer(raw, "<u8", self.lanes, at + 8)))
            at += 8 + 8 * self.lanes
        self.words, self.table = np.frombuffer(raw, "<u4", words, at).astype(np.uint64), table

    def part(self, k: int) -> np.ndarray:
        """The ids from checkpoint k to the next, decoded on their own."""
        t, at, state = self.marks[k]
        last = self.marks[k + 1][0] if k + 1 < len(self.marks) else -(-self.n // self.lanes)
        x, out = state.astype(np.uint64), np.empty(min(last * self.lanes, self.n) - t * self.lanes, np.uint32)
        mask, scale, done, tb = np.uint64((1 << self.scale) - 1), np.uint64(self.scale), 0, self.table
        for step in range(t, last):
            k = min(self.lanes, self.n - step * self.lanes)
            y = x[:k]
            slot = y & mask
            s = tb.symbol[slot.view(np.int64)]
            out[done:done + k] = s
            done += k
            y = tb.freq[s] * (y >> scale) + slot - tb.cum[s]
            low = np.flatnonzero(y < _LOW)
            y[low] = y[low] << _32 | self.words[at:at + len(low)]
            at += len(low)
            x[:k] = y
        return out

    def ids(self) -> np.ndarray:
        return np.concatenate([self.part(k) for k in range(len(self.marks))]) if self.marks else np.zeros(0, np.uint32)


def _tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(part, seq, before, doc_id, n, ids): documents in order; before: ids earlier in the part; ids little-endian unsigned
    32-bit or, where the whole vocabulary fits, 16-bit."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", F.xxhash64("text")]
    laid = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, before = encoder(path, "word"), TaskContext.get().partitionId(), 0, 0
        unit = "<u2" if enc.tok.get_vocab_size() <= 1 << 16 else "<u4"
        for b in regrouped(batches, "text"):
            ids, off = enc.encode(b.column("text"))
            ids, tail = ids.astype(unit), np.array([end], unit).tobytes()
            n = np.diff(off) + 1
            rows = [ids[x:y].tobytes() + tail for x, y in zip(off.tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(seq + np.arange(len(n))), pa.array(before + np.cumsum(n) - n), b.column("doc_id"), pa.array(n),
                                              pa.array(rows, pa.binary())], names=["part", "seq", "before", "doc_id", "n", "ids"])
            seq, before = seq + len(n), before + int(n.sum())

    return laid.mapInArrow(run, f"part int, seq long, before long, doc_id {kind}, n long, ids binary")


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    n = int(pc.sum(batch.column("n")).as_py() or 0)
    raw = b"".join(batch.column("ids").to_pylist())
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def frequencies(tokens: DataFrame) -> Table:
    """Counted over all ids; one row per symbol of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            got = np.bincount(_ids(b), minlength=len(total)) if b.num_rows else total * 0
            got[:len(total)] += total
            total = got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return Table.of_counts(counts)


def _blocks(tokens: DataFrame, table: Table) -> DataFrame:
    freq = table.freq.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        rows: list[tuple] = []
        held: list[tuple] = []  # part, seq, doc_id, ids, before of the documents of the next block

        def close() -> None:
            ids = np.concatenate([x[3] for x in held])
            sizes = np.array([len(x[3]) for x in held])
            rows.append((held[0][0], held[0][1], held[0][4], len(held), len(ids), encode(ids, sizes, [x[2] for x in held], table)))
            held.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 6
            rows.clear()
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "seq", "before", "n_docs", "n_tokens", "block"])

        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = _ids(b), b.column("n").to_numpy()
            at = np.cumsum(n) - n
            for part, seq, before, doc, x, k in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "before", "doc_id")), at.tolist(), n.tolist()):
                if held and (size >= BLOCK or part != held[-1][0] or seq != held[-1][1] + 1):
                    close()
                    size = 0
                held.append((part, seq, doc, ids[x:x + k].astype(np.uint32), before))
                size += k
            yield batch()
        if held:
            close()
        yield batch()

    return tokens.mapInArrow(run, "part int, seq long, before long, n_docs long, n_tokens long, block binary")


def written(docs: DataFrame, path: str | None = None, end: int = END) -> tuple[DataFrame, Table]:
    """The corpus in the format: a stored table of blocks, and the frequencies they share."""
    tokens = stored(_tokenised(docs, path or tokenizer_path(TOKENIZER), end), "rans-tokens", "zstd")
    table = frequencies(tokens)
    return stored(_blocks(tokens, table), "rans-blocks"), table


def read(blocks: DataFrame, table: Table) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    freq = table.freq.astype(np.int64)
    # ids before each part: one number per range partition reaches the driver
    first, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        first[r["part"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for b in batches:
            for part, before, raw in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), b.column("block")):
                block = Block(raw.as_py(), table)
                ids, edge = block.ids(), np.concatenate(([0], np.cumsum(block.sizes)))
                docs = [ids[x:y].tobytes() for x, y in zip(edge.tolist(), edge[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(block.docs, pa.int64()), pa.array(first[part] + before + edge[:-1]), pa.array(block.sizes), pa.array(docs, pa.binary())],
                                                 names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("part", "before", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def report(docs: DataFrame) -> DataFrame:
    """op3: place, number and crc32 of each document's ids, read back from the blocks."""
    blocks, table = written(docs)
    return read(blocks, table).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
