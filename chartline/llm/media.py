"""Media columns: texts' bytes stored as lossless WebP files, and what is read from their pixels.

Each payload is the text's UTF-8 bytes and bytes 255 up to a positive multiple of 576 (a null or empty text: one such
block), laid out as RGBA images of 144 pixels a row. The prefix codes are made from counts over the whole corpus, a
table of 6 x 5 x 344 numbers, one set for each way to write an image; each image is written the shortest way. The files are stored as a column of binaries in the shared folder and read back from there.
Repeated rows are stored each, with equal files; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffers, ragged, stored
from .tokens import regrouped, sliced
from .webp import ROWS, SYMBOLS, WAYS, WIDTH, Encoder, count_symbols, decode

UNIT = 576
TOGETHER = 6 << 20  # bytes of text encoded or of files decoded at once


def payloads(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All payloads as pixels one after another, and the pixels' n + 1 offsets."""
    data, off = buffers(texts)
    size = np.diff(off)
    whole = np.maximum(-(-size // UNIT), 1) * UNIT
    at = np.concatenate(([0], np.cumsum(whole)))
    out = np.full(int(at[-1]), 255, np.uint8)
    out[ragged(at[:-1], size)] = data
    return out.view(np.uint32), at // 4


def tiles(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of images of ROWS rows at most within the payloads, and the number of images of each payload."""
    most = WIDTH * ROWS
    n = -(-np.diff(off) // most)
    start = np.repeat(off[:-1], n) + ragged(np.zeros(len(n), np.int64), n) * most
    return np.append(start, off[-1]), n


def counted(docs: DataFrame) -> np.ndarray:
    """Symbol counts over the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(WAYS), 5, SYMBOLS), np.int64)
        for b in batches:
            for x, y in sliced(b.column("text"), TOGETHER):
                px, off = payloads(b.column("text").slice(x, y - x))
                total += count_symbols(px, tiles(off)[0])
        used = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.reshape(-1)[used])], names=["i", "n"])

    out = np.zeros(len(WAYS) * 5 * SYMBOLS, np.int64)
    for r in docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out.reshape(len(WAYS), 5, SYMBOLS)


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the files of each document's payload."""
    counts, kind = counted(docs), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(counts)
        for whole in regrouped(batches, "text", TOGETHER):
            px, off = payloads(whole.column("text"))
            cut, n = tiles(off)
            files = enc.encode(px, cut)
            media = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(files, pa.binary()))
            yield pa.RecordBatch.from_arrays([whole.column("doc_id"), media], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, media array<binary>")


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[bytes]], list[list[np.ndarray]]]]:
    """(ids, files, pixel arrays) of about TOGETHER bytes of files at a time, decoded in one go."""
    ids, files, size = [], [], 0

    def flush():
        got = iter(decode([f for m in files for f in m]))
        return pa.concat_arrays(ids), files, [[next(got) for _ in m] for m in files]

    for b in batches:
        for i, m in enumerate(b.column("media").to_pylist()):
            ids.append(b.column("doc_id").slice(i, 1))
            files.append(m)
            size += sum(map(len, m))
            if size >= TOGETHER:
                yield flush()
                ids, files, size = [], [], 0
    if files:
        yield flush()


def feature(images: list[np.ndarray]) -> str:
    """Images, rows, and per channel the mean and the mean step to the next pixel of a row, of all images."""
    px = np.concatenate([x.reshape(-1, 4) for x in images]).astype(np.int64)
    step = np.concatenate([np.abs(np.diff(x.astype(np.int16), axis=1)).reshape(-1, 4) for x in images]).mean(0) if images else px.mean(0)
    return ";".join([str(len(images)), str(sum(x.shape[0] for x in images)), ",".join(f"{v:.4f}" for v in px.mean(0)), ",".join(f"{v:.4f}" for v in step)])


def pixels(media: DataFrame) -> DataFrame:
    """(doc_id, image, width, height, rgba): the pixel arrays of all files, one row per image."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _files, images in _images(batches):
            n = [len(m) for m in images]
            flat = [x for m in images for x in m]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([k for m in images for k in range(len(m))], pa.int32()), pa.array([x.shape[1] for x in flat], pa.int32()),
                 pa.array([x.shape[0] for x in flat], pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary())], names=["doc_id", "image", "width", "height", "rgba"])

    return media.mapInArrow(run, f"doc_id {kind}, image int, width int, height int, rgba binary")


def described(media: DataFrame) -> DataFrame:
    """Sizes, digests and the feature of each document, from its stored files alone."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, files, images in _images(batches):
            rows = []
            for m, x in zip(files, images):
                raw, stored_form = b"".join(i.tobytes() for i in x), b"".join(m)
                # a byte 255 is never part of UTF-8
                rows.append((len(raw.rstrip(b"\xff")), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(stored_form), hashlib.sha256(stored_form).hexdigest(), feature(x)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def report(docs: DataFrame) -> DataFrame:
    """op4: what is read back from each document's stored files."""
    return described(stored(encoded(docs), "media"))
