"""Cross-tokenizer alignment: which tokens of two vocabularies share bytes, and how often over the corpus.

Every text is encoded by a byte-level vocabulary (side A) and a piece vocabulary (side B). Byte offsets where tokens of
both end cut the two sequences into groups; every pair of an A token and a B token whose byte ranges overlap is a link.

Neither vocabulary has an entry that goes on over the start of a run of spaces, so a text falls into chunks there, and
each distinct chunk of a batch is encoded and aligned once.

Counting the links of an id pair over the corpus is done by external spilling. The records (B id, A id, document) of a
slice of the corpus (``SLICE`` bytes of text) are sorted in memory whenever there are ``RUN`` of them, counted, radix
partitioned by their B id, and written as zstd runs. Per slice and radix partition a k-way merge over the runs' frames
(a heap holds their last keys) counts each pair without holding more than a frame of each run. Spark adds the slices'
counts; in B-major order the pairs of a B id lie together and give its maximum. The totals of the pairs that a slice has
come back to it, the same merge streams its records once more beside them, and each document gets its contributions. No
document leaves its slice, so the id that is in every document is no hot key: each slice sends one row for a pair.

Null and empty texts, and texts that a side doesn't give back byte by byte, have no tokens: zeros and an empty digest. Ids
of special tokens never occur: their strings are ordinary text. Repeated rows are documents of their own; a null doc_id
is kept; an empty table gives an empty result; only doc_id and text are read, so other columns' names don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import SPACE, buffers, ragged, stored
from .packing import tokenizer_path
from .tokens import _byte_letters, encoder, regrouped, white_tails

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE = 64 << 20  # bytes of text whose records are merged together
RUN = 2 << 20  # links sorted in memory before a run is written
FRAME = 1 << 16  # records in a frame of a run
RADIX = 16  # partitions by the low bits of the B id
DOC_BITS = 20  # documents of a slice
A_BITS = 20
BATCH = 4 << 20  # bytes of text aligned together
KEPT = 200_000  # chunks of side B remembered by a worker; others are encoded again


# --- the two sides ------------------------------------------------------------------------------------------------


class Bytes:
    """The bytes of every entry of a vocabulary, end to end."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.at = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.at[ids], self.size[ids])]


class ByteSide:
    """Side A: a byte-level vocabulary; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        self.enc = encoder(path, "byte", True)
        tok = self.enc.tok
        byte = {c: b for b, c in enumerate(_byte_letters())}
        special = set(tok.get_added_tokens_decoder())
        self.bytes = Bytes([b"" if i in special else bytes(byte[c] for c in tok.id_to_token(i)) for i in range(tok.get_vocab_size())])

    def encode(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and how many each has."""
        ids, off = self.enc.encode(pa.LargeStringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))))
        return ids.astype(np.int64), np.diff(off)


class PieceSide:
    """Side B: a piece vocabulary that puts a space before a text; a chunk starts with a space, which is left to it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries, self.whole = [], False
        for i in range(self.model.get_piece_size()):
            p = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                entries.append(bytes([int(p[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                entries.append(b"")
            else:
                entries.append(p.replace("▁", " ").encode())
                self.whole |= "▁" in p.lstrip("▁")  # an entry goes on over a space: texts can't be cut
        self.bytes, self.kept = Bytes(entries), {}

    def encode(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, cut = data.tobytes(), edge.tolist()
        chunks = [raw[x:y] for x, y in zip(cut, cut[1:])]
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = [c for c in chunks if c not in self.kept]
        if new:
            self.kept.update(zip(new, (np.array(x, np.int32) for x in self.model.encode([c[1:].decode() for c in new], num_threads=1))))
        rows = [self.kept[c] for c in chunks]
        return np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int64), np.fromiter(map(len, rows), np.int64, len(rows))


@lru_cache(maxsize=1)
def sides(a: str, b: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a), PieceSide(b)


# --- alignment ----------------------------------------------------------------------------------------------------


class Aligned:
    """Tokens, groups and links of distinct chunks, one after another; ``ok``: both sides give a chunk's bytes back."""

    def __init__(self, data: np.ndarray, edge: np.ndarray, a: ByteSide, b: PieceSide):
        ids, n = zip(*(side.encode(data, edge) for side in (a, b)))
        self.ok = np.ones(len(edge) - 1, bool)
        for side, i, k in zip((a, b), ids, n):
            self.ok &= self._same(side.bytes, i, k, data, edge)
        (ia, na), (ib, nb) = ((i[np.repeat(self.ok, k)], np.where(self.ok, k, 0)) for i, k in zip(ids, n))
        ea, eb = np.cumsum(a.bytes.size[ia]), np.cumsum(b.bytes.size[ib])
        sa, sb = ea - a.bytes.size[ia], eb - b.bytes.size[ib]
        self.n_a, self.n_b = na, nb
        ends_a, ends_b = np.isin(ea, eb, assume_unique=True), np.isin(eb, ea, assume_unique=True)
        per = lambda x, k: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], np.cumsum(k)))])
        self.n_groups = per(ends_a, na)
        first, last = np.searchsorted(eb, sa, "right"), np.searchsorted(sb, ea, "left")
        links = last - first
        self.n_links = per(links, na)
        self.pairs = ib[ragged(first, links)] << A_BITS | np.repeat(ia, links)  # B-major
        # the text of the groups: all tokens of a group's A side, then its B side, each with the sign that follows it
        ga, gb = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        code = np.empty(len(ia) + len(ib), np.int64)
        code[np.arange(len(ia)) + np.searchsorted(gb, ga, "left")] = ia * 4 + ends_a
        code[np.arange(len(ib)) + np.searchsorted(ga, gb, "right")] = ib * 4 + 2 + ends_b
        digits = [f"{c >> 2}{',|,;'[c & 3]}" for c in code.tolist()]
        at = np.concatenate(([0], np.cumsum(na + nb))).tolist()
        self.text = ["".join(digits[x:y]) for x, y in zip(at, at[1:])]

    @staticmethod
    def _same(table: Bytes, ids: np.ndarray, n: np.ndarray, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        size = np.diff(np.concatenate(([0], np.cumsum(table.size[ids])))[np.concatenate(([0], np.cumsum(n)))])
        long = np.diff(edge)
        ok = size == long
        bad = np.repeat(~ok, n)
        if bad.any():  # compare the others
            ids = ids[~bad]
        other = table.joined(ids) != data[np.repeat(ok, long)]
        if other.any():
            text = np.repeat(np.flatnonzero(ok), long[ok])
            ok[text[other]] = False
        return ok


def chunked(texts: pa.Array, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a space before each that isn't empty, as distinct chunks: their bytes, the edges, the number of each chunk in
    text order, and the n + 1 offsets of the texts among those. A chunk starts with a space that no white space precedes; spaces at
    the end of a text stay with what precedes them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    data, off = buffers(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))))
    if not len(data):
        return data, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cut = np.zeros(len(data), bool)
    if not whole:
        space = SPACE[data]
        cut[1:] = (data[1:] == 32) & ~space[:-1] & ~white_tails(data)[:-1]
        # runs of spaces that reach the end of their text
        other = np.flatnonzero(data != 32)
        last = np.searchsorted(other, off[1:]) - 1
        full = off[1:] > off[:-1]
        tail = np.append(other, -1)[last]  # none: -1
        tail = np.maximum(tail, off[:-1] - 1) + 1
        tail = tail[full & (tail < off[1:])]
        cut[tail] = False
    cut[off[:-1][off[:-1] < len(data)]] = True
    begin = np.flatnonzero(cut)
    at = np.searchsorted(begin, off)
    begin = np.append(begin, len(data))
    coded = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return (*buffers(coded.dictionary), coded.indices.to_numpy().astype(np.int64), at)


class Documents:
    """Counts, digests and link records of a batch of documents."""

    def __init__(self, texts: pa.Array, a: ByteSide, b: PieceSide):
        data, edge, number, at = chunked(texts, b.whole)
        c = Aligned(data, edge, a, b)
        size = np.diff(at)
        doc = np.repeat(np.arange(len(size)), size)
        ok = np.bincount(doc, c.ok[number], len(size)) == size
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[number])))[at]) * ok
        self.n_a, self.n_b, self.n_groups, self.n_links = total(c.n_a), total(c.n_b), total(c.n_groups), total(c.n_links)
        order, cut = number.tolist(), at.tolist()
        self.sha = []
        for x, y, good in zip(cut, cut[1:], ok.tolist()):
            text = "".join([c.text[k] for k in order[x:y]]) if good else ""
            self.sha.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
        # one record a link: pair above document
        live = ok[doc]
        number, doc = number[live], doc[live]
        first = np.cumsum(c.n_links) - c.n_links
        self.pairs, self.doc = c.pairs[ragged(first[number], c.n_links[number])], np.repeat(doc, c.n_links[number])


# --- runs ---------------------------------------------------------------------------------------------------------


_HEAD = struct.Struct("<II")


def run_of(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys with their counts as a run: frames of at most FRAME records, each of its own zstd frame."""
    out, z = [], zstandard.ZstdCompressor(level=1)
    for x in range(0, len(keys), FRAME):
        k, c = keys[x:x + FRAME], n[x:x + FRAME]
        step = np.diff(k, prepend=0)
        # bytes of one significance side by side
        raw = step.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() + c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        packed = z.compress(raw)
        out += [_HEAD.pack(len(k), len(packed)), packed]
    return b"".join(out)


def frames(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The frames of a run, one at a time."""
    at, z = 0, zstandard.ZstdDecompressor()
    while at < len(run):
        n, size = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        raw = np.frombuffer(z.decompress(run[at:at + size], max_output_size=12 * n), np.uint8)
        at += size
        keys = np.cumsum(np.ascontiguousarray(raw[:8 * n].reshape(8, n).T).view("<i8").ravel())
        yield keys, np.ascontiguousarray(raw[8 * n:].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of runs: (keys, counts) in ascending order, stretch by stretch; every key lies in one stretch.

    The heap has the last key of each run's frame in memory. Up to the least of these nothing can come any more from
    frames not yet read, so those records are merged and given; then that run reads its next frame.
    """
    order, heap, held = count(), [], {}
    for source in map(frames, runs):
        f = next(source, None)
        if f is not None:
            i = next(order)
            held[i] = [source, *f]
            heapq.heappush(heap, (int(f[0][-1]), i))
    while heap:
        limit, i = heap[0]
        keys, counts = [], []
        for h in held.values():
            cut = int(np.searchsorted(h[1], limit, "right"))
            keys.append(h[1][:cut])
            counts.append(h[2][:cut])
            h[1], h[2] = h[1][cut:], h[2][cut:]
        yield summed(np.concatenate(keys), np.concatenate(counts))
        while heap and heap[0][0] <= limit:  # frames that are used up
            i = heapq.heappop(heap)[1]
            f = next(held[i][0], None)
            while f is not None and not len(f[0]):
                f = next(held[i][0], None)
            if f is None:
                del held[i]
            else:
                held[i][1:] = f
                heapq.heappush(heap, (int(f[0][-1]), i))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts."""
    if not len(keys):
        return keys, n
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[head], np.add.reduceat(n, head)


# --- Spark --------------------------------------------------------------------------------------------------------


_FOUND = "slice long, place int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, runs array<binary>"


def spilled(docs: DataFrame, a: str, b: str, slice_bytes: int = SLICE, run_links: int = RUN, batch_bytes: int = BATCH) -> DataFrame:
    """A row for each document (slice, place, doc_id, counts, digest), and one for each radix partition of a slice with its runs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(a, b)
        number = TaskContext.get().partitionId() << 32
        place, size, links = 0, 0, []
        runs: list[list[bytes]] = [[] for _ in range(RADIX)]
        doc_type = None

        def spill() -> None:
            keys = np.sort(np.concatenate(links))
            links.clear()
            head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n, keys = np.diff(np.append(head, len(keys))), keys[head]
            part = keys >> (A_BITS + DOC_BITS) & (RADIX - 1)
            for r in np.unique(part).tolist():
                runs[r].append(run_of(keys[part == r], n[part == r]))

        def ended() -> pa.RecordBatch:
            if links:
                spill()
            used = [r for r in range(RADIX) if runs[r]]
            none = lambda t: pa.nulls(len(used), t)
            out = pa.RecordBatch.from_arrays(
                [pa.array([number] * len(used), pa.int64()), none(pa.int32()), none(doc_type), *[none(pa.int64())] * 4, none(pa.string()), pa.array(used, pa.int32()),
                 pa.array([runs[r] for r in used], pa.list_(pa.binary()))], names=names)
            for r in used:
                runs[r] = []
            return out

        names = [f.split()[0] for f in _FOUND.split(", ")]
        for batch in regrouped(batches, "text", batch_bytes):
            doc_type = batch.schema.field("doc_id").type
            for x in range(0, batch.num_rows, 1 << DOC_BITS - 1):
                rows = batch.slice(x, 1 << DOC_BITS - 1)
                if size >= slice_bytes or place + rows.num_rows > 1 << DOC_BITS:
                    yield ended()
                    number, place, size = number + 1, 0, 0
                d, n = Documents(rows.column("text"), left, right), rows.num_rows
                keys = d.pairs << DOC_BITS | d.doc + place
                for k in range(0, len(keys), run_links):
                    links.append(keys[k:k + run_links])
                    if sum(map(len, links)) >= run_links:
                        spill()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.array(place + np.arange(n, dtype=np.int32)), rows.column("doc_id"), *[pa.array(v.astype(np.int64)) for v in (d.n_a, d.n_b, d.n_groups, d.n_links)],
                     pa.array(d.sha, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.binary()))], names=names)
                place, size = place + n, size + int(buffers(rows.column("text"))[1][-1])
        if doc_type is not None:
            yield ended()
        for kept in (sides, encoder):  # workers are used again by other operators
            kept.cache_clear()

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND.format(kind=kind))


def partial_counts(found: DataFrame) -> DataFrame:
    """(slice, pair, n): links of each pair in a slice, by merging its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("slice")[i].as_py()
                last: tuple[int, int] | None = None  # a pair can go on in the next stretch
                for keys, n in merged(batch.column("runs")[i].as_py()):
                    pair, m = summed(keys >> DOC_BITS, n)
                    if last and len(pair) and pair[0] == last[0]:
                        m[0] += last[1]
                    elif last:
                        pair, m = np.append(last[0], pair), np.append(last[1], m)
                    last = int(pair[-1]), int(m[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair) - 1, number)), pa.array(pair[:-1]), pa.array(m[:-1])], names=["slice", "pair", "n"])
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([last[0]]), pa.array([last[1]])], names=["slice", "pair", "n"])

    return found.where("radix IS NOT NULL").select("slice", "runs").mapInArrow(run, "slice long, pair long, n long")


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, total, best): links of each pair over the corpus, and whether its B id has no pair with more; a B id has at most
    as many pairs as side A has entries."""
    total = parts.groupBy("pair").agg(F.sum("n").alias("total"))
    side = F.shiftright("pair", A_BITS)
    return total.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy(side)))


def _contributions(key: tuple, runs: pa.Table, totals: pa.Table) -> pa.Table:
    """Of each document of a slice: how many of its links are best for their B id, and the sum of its links' counts."""
    totals = totals.sort_by("pair")
    pair, total, best = (totals.column(c).to_numpy() for c in ("pair", "total", "best"))
    n_best, sums, top = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    for i in range(runs.num_rows):
        for keys, n in merged(runs.column("runs")[i].as_py()):
            at, doc = np.searchsorted(pair, keys >> DOC_BITS), keys & ((1 << DOC_BITS) - 1)
            top = max(top, int(doc.max()) + 1)
            if len(sums) < top:
                n_best, sums = (np.concatenate((x, np.zeros(2 * top - len(x), np.int64))) for x in (n_best, sums))
            np.add.at(n_best, doc, n * best[at])
            np.add.at(sums, doc, n * total[at])
    place = np.flatnonzero(sums[:top])
    return pa.table({"slice": pa.array(np.full(len(place), key[0].as_py())), "place": pa.array(place.astype(np.int32)), "n_best": n_best[place], "count_sum": sums[place]})


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; and the table of pairs
    (b, a, total, best) over the corpus."""
    found = stored(spilled(docs, a or tokenizer_path(SIDE_A), b or tokenizer_path(SIDE_B), **sizes), "align-runs")
    parts = stored(partial_counts(found), "align-parts", "zstd")
    totals = stored(pair_counts(parts), "align-pairs", "zstd")
    back = parts.select("slice", "pair").join(totals, "pair")
    runs = found.where("radix IS NOT NULL").select("slice", "runs")
    more = runs.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(_contributions, "slice long, place int, n_best long, count_sum long")
    of = found.where("radix IS NULL").drop("radix", "runs").join(more, ["slice", "place"], "left")
    per = of.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    return per, totals.select(F.shiftright("pair", A_BITS).alias("b"), F.col("pair").bitwiseAND(F.lit((1 << A_BITS) - 1)).alias("a"), "total", "best")


def report(docs: DataFrame) -> DataFrame:
    """op12: counts, links and digest of each document's aligned groups."""
    return aligned(docs)[0]
