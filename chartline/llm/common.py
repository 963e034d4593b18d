"""What several operators share: scratch tables, text as byte buffers, words as slices of them."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import session

# white space between words, as in the pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = r"[^\x20\x09-\x0D]+"
BATCH = 2000
GAP = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Written as Parquet into the shared folder and read back: cuts lineage, survives lost executors."""
    path = session.scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(run: Callable) -> Callable:
    """A function over record batches whose worker, which lives on for later stages, gives freed memory back to the system when
    it is done."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return wrapped


def n_words(text: Column) -> Column:
    """Words of a text (null: 0), in the JVM."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " "))
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "))) + 1).cast("long")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and the n + 1 offsets of the texts in it; null reads as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset:]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the n + 1 offsets of the texts among the words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    gap = SPACE[data]
    first = np.empty(len(data), dtype=bool)
    first[0] = True
    first[1:] = gap[:-1]
    inner = off[1:-1]
    first[inner[inner < len(data)]] = True
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    last[:-1] = gap[1:]
    ends = inner[inner > 0] - 1
    last[ends] = True
    start = np.flatnonzero(first & ~gap)
    end = np.flatnonzero(last & ~gap) + 1
    return start, end, np.searchsorted(start, off)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C55)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2^64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        m = 1 << max(16, int(n - 1).bit_length())
        for name, r in (("up", _BASE), ("down", inverse)):
            p = np.full(m, r, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of the bytes; depends on the slice's bytes alone."""
    out = np.zeros(len(start), dtype=np.uint64)
    if not len(start):
        return out
    step = 1 << 19
    # in stretches, so that the table of powers and the running sums stay small
    cuts = np.searchsorted(start, np.arange(start[0], end[-1] + step, step))
    for a, b in zip(cuts, [*cuts[1:], len(start)]):
        if a == b:
            continue
        lo, hi = start[a], end[b - 1]
        up, down = _powers(hi - lo + 1)
        run = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[:hi - lo], out=run[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64) * _MIX[0])
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + length[i] - 1 of all i, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - first, length)


def importable(spark: SparkSession) -> SparkSession:
    """Python workers started from now on find this package where it lies, whatever folder the driver was started in,
    and get texts in batches of ``BATCH`` rows, which bounds what a worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
