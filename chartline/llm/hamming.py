"""Exact top-k search in binary codes by incremental multi-index hashing.

A code has a bit for each entry of the longest vector, in longs of 64 bits. It is cut into m segments of about log2(n) - 2 bits, n the number of different codes; each
segment has its own table. A code at distance d from a query is within floor(d / m) of it in one segment at least. So segment
radii grow step by step: step r probes each table with all values at distance r from the query's segment. After it
every code within m * (r + 1) - 1 of the query has been met; the query is finished when its k-th verified distance
is not beyond that. Met codes are verified by their whole distance, once, in the first table and step that meets
them; a query's k best stay with it from step to step.

The index is held over different codes, each with its k + 1 smallest ids, which is all a top-k answer can use (ties
go to the smaller id, and a query leaves itself out): equal vectors, however many, cost one row. At the width
of its segment a table has been probed in full, so every query ends; a query short of k rows to find returns all there are.

Codes are the signs of the vector's entries (bit i: entry i above 0; missing or null ones count as 0). Rows with a null id or vector are neither searched nor queries. Repeated rows (same id) count
once for each different code. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

WORD, K, EVERY = 64, 10, 100


def sign_code(vector: Column, bits: int) -> Column:
    """array<long>: the signs of a vector's entries, entry i in bit i % 64 of long i / 64."""
    out = []
    for low in range(0, bits, WORD):
        lit = [F.when(F.get(vector, low + i) > 0, F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(min(WORD, bits - low))]
        while len(lit) > 1:  # a balanced tree, not a chain
            lit = [a.bitwiseOR(b) for a, b in zip(lit[::2], lit[1::2])] + lit[len(lit) & ~1:]
        out.append(lit[0])
    return F.array(*out)


def segments(n: int, bits: int) -> list[tuple[int, int, int]]:
    """(long, lowest bit, width) of each segment: as many as leave about four codes to each of a segment's values.

    Wider segments need larger radii, whose values to probe grow faster than the codes met become fewer.
    """
    out = []
    for word in range(-(-bits // WORD)):
        own = min(WORD, bits - word * WORD)
        m = max(1, round(own / max(4.0, log2(max(n, 2)) - 2)))
        edge = [round(own * i / m) for i in range(m + 1)]
        out += [(word, a, b - a) for a, b in zip(edge, edge[1:])]
    return out


def _piece(code: Column, word: int, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code[word], low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))


def _distance(a: str, b: str, bits: int) -> Column:
    out = F.lit(0)
    for word in range(-(-bits // WORD)):
        out = out + F.bit_count(F.col(a)[word].bitwiseXOR(F.col(b)[word]))
    return out


def _probes(parts: list[tuple[int, int, int]], radius: int):
    """Rows (q, qcode) -> (q, qcode, part, value) for all values at this distance from the code's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = parts[-1][0] + 1
        for b in batches:
            q, c = b.column("q").to_numpy(), b.column("qcode").flatten().to_numpy().reshape(-1, words)
            for j, (word, low, width) in enumerate(parts):
                own = (np.ascontiguousarray(c[:, word]).view(np.uint64) >> np.uint64(low)) & np.uint64((1 << width) - 1)
                masks = (sum(1 << i for i in bits) for bits in combinations(range(width), radius))
                while some := list(islice(masks, max(1, (1 << 17) // max(len(q), 1)))):
                    value = (own[:, None] ^ np.array(some, np.uint64)[None, :]).reshape(-1).view(np.int64)
                    code = pa.ListArray.from_arrays(np.arange(len(value) + 1, dtype=np.int32) * words, pa.array(np.repeat(c, len(some), axis=0).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, len(some))), code, pa.array(np.full(len(value), j, np.int32)), pa.array(value)], names=["q", "qcode", "part", "value"])

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query: (q, qcode, id, distance)."""
    w = W.partitionBy("q", "qcode").orderBy("distance", "id")
    return rows.distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def search(index: DataFrame, queries: DataFrame, k: int = K, bits: int = WORD) -> DataFrame:
    """``index`` (id, code) and ``queries`` (q, qcode), codes as arrays of longs, nulls left out -> (q, qcode, id, distance), k rows a query, itself left out."""
    order = W.partitionBy("code").orderBy("id")
    ids = index.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    codes = stored(ids.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "mih-codes")
    n = codes.count()
    parts = segments(n, bits)
    m = len(parts)
    open_ = stored(queries.distinct(), "mih-queries")
    empty = open_.select("q", "qcode", F.lit(0).cast("long").alias("id"), F.lit(0).alias("distance")).limit(0)
    best, done = empty, []
    piece = F.array(*[_piece(F.col("code"), *p) for p in parts])
    table = stored(codes.select(F.posexplode(piece).alias("part", "value"), "code", "ids"), "mih-tables")
    near = [F.bit_count(_piece(F.col("code"), *p).bitwiseXOR(_piece(F.col("qcode"), *p))) for p in parts]
    for r in range(max(w for _, _, w in parts) + 1):
        probe = open_.mapInArrow(_probes(parts, r), "q long, qcode array<long>, part int, value long")
        met = probe.hint("merge").join(table, ["part", "value"])  # many rows from few: their size can't be estimated
        # met at a smaller radius, or in an earlier table at this one: already verified
        seen = reduce(lambda a, b: a | b, [(x < r) | ((F.col("part") > i) & (x == r)) for i, x in enumerate(near)])
        met = met.where(~seen).withColumn("distance", _distance("code", "qcode", bits))
        found = met.select("q", "qcode", F.explode("ids").alias("id"), "distance").where("id <> q")
        best = stored(_best(best.unionByName(found), k), "mih-best")
        cover = sum(min(r, w) + 1 for _, _, w in parts) - 1  # all codes within this distance have been met
        kth = best.groupBy("q", "qcode").agg(F.count(F.lit(1)).alias("c"), F.max("distance").alias("far"))
        ready = kth.where((F.col("c") >= k) & (F.col("far") <= cover)) if cover < bits else kth
        done.append(best.join(ready.select("q", "qcode"), ["q", "qcode"], "left_semi"))
        open_ = stored(open_.join(ready, ["q", "qcode"], "left_anti"), "mih-queries")
        if cover >= bits or open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        best = best.join(open_, ["q", "qcode"], "left_semi")
    raise AssertionError("every table has been probed in full")


def report(embeddings: DataFrame, k: int = K) -> DataFrame:
    """op1: the k nearest of every row whose id is divisible by 100, among all other rows."""
    some = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    bits = max(1, some.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 1)
    rows = stored(some.select(F.col("vec_id").cast("long").alias("id"), sign_code(F.col("embedding"), bits).alias("code")), "mih-rows")
    found = search(rows, rows.where(F.col("id") % EVERY == 0).select(F.col("id").alias("q"), F.col("code").alias("qcode")), k, bits)
    rank = F.row_number().over(W.partitionBy("q", "qcode").orderBy("distance", "id"))
    return found.select(F.col("q").alias("query_id"), rank.alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))


# The same for DuckDB: all distances, then the nearest.
SQL = f"""
WITH w AS (SELECT max(len(embedding)) AS n FROM embeddings WHERE vec_id IS NOT NULL),
h AS (SELECT DISTINCT vec_id, list_transform(list_resize(embedding, n), lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code
  FROM embeddings, w WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (
  SELECT q.vec_id AS query_id, q.code AS qcode, d.vec_id, CAST(list_sum(list_transform(list_zip(q.code, d.code), lambda z: abs(z[1] - z[2]))) AS INTEGER) AS distance
  FROM h q JOIN h d ON q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, qcode ORDER BY distance, vec_id) AS INTEGER) AS rank FROM (SELECT DISTINCT * FROM p))
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= {K}
"""
