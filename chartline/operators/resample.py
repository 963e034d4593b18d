"""Percentile intervals from many resamples, whose number does not touch the shuffle.

A draw gives every row a Poisson(1) weight taken from a digest of its id, so draws are reproducible and independent of
partitions. Rows are sorted by score into ranges of some 65,000 once, as they are; the weights of all draws are made once, inside tasks, a few
thousand rows at a time. What is kept is one row for each distinct score of a range, the sums of its positives' and negatives' weights
in as few bytes as they need. A range gives three sums an array wide (its first score, its last, what lies
between); these small rows are put in order per draw, and a second pass over the ranges starts from what lies before them.
Scores that many rows share may fill several ranges: their sums meet under the score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage, scratch

# Cumulative Poisson(1) probabilities; a draw above the last weighs 7.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
PER_DIGEST = 8  # draws read from one SHA-256
CHUNK = 2048  # rows whose weights are held at once (their sums fit 16 bits)
RANGE = 1 << 16  # rows of a range
METRICS = ("auroc", "auprc", "sensitivity", "specificity", "ppv", "npv")
_SLOT = "score double, middle int, p array<bigint>, q array<bigint>"


# Weights by the upper two bytes of a draw's 32 bits, as a little-endian machine reads them; UNSURE where a limit lies inside.
LIMITS = np.ceil(np.array(POISSON) * 4294967296.0).astype(np.uint32)
UNSURE = 255
UPPER = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint32) << np.uint32(16), "right").astype(np.uint8)
UPPER[LIMITS >> np.uint32(16)] = UNSURE
UPPER = UPPER[np.arange(1 << 16, dtype=np.uint16).byteswap()]


def weights(ids: list, draws: int, seed: str) -> np.ndarray:
    """One row per id: weight 1, the rows as they are, then the weights of the draws."""
    out = np.ones((len(ids), draws + 1), np.uint8)
    tails = [str(b).encode() for b in range(-(-draws // PER_DIGEST))]
    sha, digest, raw = hashlib.sha256, type(hashlib.sha256()).digest, []
    for entity in ids:
        raw.append(b"".join(map(digest, map(sha, map(f"{entity}|{seed}|".encode().__add__, tails)))))
    raw = b"".join(raw)
    w = UPPER[np.frombuffer(raw, "<u2").reshape(len(ids), -1)[:, :2 * draws:2]]
    x, y = np.nonzero(w == UNSURE)
    w[x, y] = np.searchsorted(LIMITS, np.frombuffer(raw, ">u4").reshape(len(ids), -1)[x, y], "right")
    out[:, 1:] = w
    return out


def _packed(v: np.ndarray) -> bytes:
    """Sums not below 0, in 1, 2 or 8 bytes each; the length tells which."""
    top = v.max(initial=0)
    return v.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int64).tobytes()


def _unpacked(raw: pa.Array, width: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 8: np.int64}
    out = np.empty((len(raw), width), np.int64)
    for i, v in enumerate(raw):
        b = v.as_buffer()
        out[i] = np.frombuffer(b, kind[b.size // width])
    return out


def _chunks(sums: pa.Table, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct scores in order, and the weights of positives and of negatives."""
    sums = sums.sort_by("score")
    for x in range(0, sums.num_rows, CHUNK):
        part = sums.slice(x, CHUNK)
        yield part.column("score").to_numpy(), *(_unpacked(part.column(c).combine_chunks(), width) for c in "pq")


def _scores(batches: Iterator[pa.RecordBatch], draws: int, seed: str) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their scores: one row for each distinct score."""
    held: tuple | None = None  # sums of the last score, which may go on

    def batch(part: int, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.float64()), *[pa.array([_packed(r[k]) for r in rows], pa.binary()) for k in (1, 2)]],
                                          names=["part", "score", "p", "q"])

    part = -1
    for whole in batches:
        for x in range(0, whole.num_rows, CHUNK):
            b = whole.slice(x, CHUNK)
            part = b.column("part")[0].as_py()
            w, y, s = weights(b.column("id").to_pylist(), draws, seed), b.column("label").to_numpy() == 1, b.column("score").to_numpy()
            head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            done = []
            for i, j in zip(head.tolist(), [*head[1:].tolist(), len(s)]):
                p, q = (w[i:j][m].sum(0, dtype=np.uint16).astype(np.int64) for m in (y[i:j], ~y[i:j]))
                if held is not None and held[0] == s[i]:
                    held = (held[0], held[1] + p, held[2] + q)
                    continue
                done += [held] if held is not None else []
                held = (s[i], p, q)
            if done:
                yield batch(part, done)
    if held is not None:
        yield batch(part, [held])


def _place(scores: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """0 the first score of a range, 1 between, 2 its last (if another)."""
    return np.where(scores == lo, 0, np.where(scores == hi, 2, 1))


def bootstrap(pred: DataFrame, threshold: float, draws: int = 1000, seed: str = "42", id_col: str = "entity") -> DataFrame:
    """(metric, point, lo, hi): the rows' own value and the 2.5 and 97.5 percentiles over the draws, of AUROC (ties half),
    average precision, sensitivity, specificity, PPV and NPV at ``threshold``. Rows without a score are left out; draws
    in which a metric is not defined do not count; with no rows there are none of it."""
    rows = pred.where(F.col("score").isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"))
    # rows of one score may lie in several ranges
    n = -(-rows.count() // RANGE) or 1
    ranges = rows.repartitionByRange(n, "score", F.xxhash64("id")).sortWithinPartitions("score").withColumn("part", F.spark_partition_id())
    path = scratch(pred.sparkSession, "bootstrap")
    ranges.mapInArrow(lambda batches: _scores(batches, draws, seed), "part int, score double, p binary, q binary").write.parquet(path, compression="zstd")
    laid = pred.sparkSession.read.schema("part int, score double, p binary, q binary").parquet(path)
    width = draws + 1

    def slots(key: tuple, rows: pa.Table) -> pa.Table:
        lo, hi = (f(rows.column("score").to_numpy()) for f in (np.min, np.max))
        sums = np.zeros((2, 3, width), np.int64)
        for s, p, q in _chunks(rows, width):
            at = _place(s, lo, hi)
            for k in np.unique(at):
                sums[0, k] += p[at == k].sum(0)
                sums[1, k] += q[at == k].sum(0)
        used = [0, 1, 2][: 1 if lo == hi else 3]
        return pa.table({"score": [float(hi if k == 2 else lo) for k in used], "middle": pa.array([int(k == 1) for k in used], pa.int32()),
                         "p": pa.array([sums[0, k].tolist() for k in used], pa.list_(pa.int64())), "q": pa.array([sums[1, k].tolist() for k in used], pa.list_(pa.int64()))})

    part = laid.groupBy("part")
    found = part.applyInArrow(lambda key, rows: slots(key, rows), _SLOT)
    # one row for each draw, score at the end of a range, and stretch between two
    long = found.select("score", "middle", F.posexplode(F.arrays_zip("p", "q")).alias("draw", "s")).groupBy("draw", "score", "middle").agg(F.sum("s.p").alias("p"), F.sum("s.q").alias("q"))
    all_, here = W.partitionBy("draw"), W.partitionBy("draw").orderBy("score", "middle").rowsBetween(W.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"{c}_before") for c in "pq"]
    placed = long.select("draw", "score", "middle", "p", "q", *before, *[F.sum(c).over(all_).alias(f"{c}_all") for c in "pq"])
    cols = ["p", "q", "p_before", "q_before", "p_all", "q_all"]
    in_order = F.array_sort(F.collect_list(F.struct("draw", *cols)))  # as many as there are draws
    table = cut_lineage(placed.groupBy("score", "middle").agg(in_order.alias("s")).select("score", "middle", *[F.col(f"s.{c}").alias(c) for c in cols]))
    edges = laid.groupBy("part").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    want = edges.select("part", F.explode(F.array_distinct(F.array(F.struct(F.col("lo").alias("score"), F.lit(0).alias("middle")), F.struct(F.col("lo").alias("score"), F.lit(1).alias("middle")),
                                                                     F.struct(F.col("hi").alias("score"), F.lit(0).alias("middle"))))).alias("e")).select(F.col("part").alias("of"), "e.*")
    starts = want.join(table, ["score", "middle"])

    def sweep(key: tuple, rows: pa.Table, starts: pa.Table) -> pa.Table:
        lo, hi = (f(rows.column("score").to_numpy()) for f in (np.min, np.max))
        of = {(r["score"], r["middle"]): {c: np.array(r[c], np.int64) for c in cols} for r in starts.to_pylist()}
        total = {n: np.zeros(width) for n in ("u", "ap", "p", "q", "tp", "fp")}
        middle = of.get((lo, 1))
        run = {c: middle[f"{c}_before"].copy() if middle else None for c in "pq"}
        held: list = []  # rows of the score between that may go on in the next chunk

        def add(p_own: np.ndarray, p_before: np.ndarray, q_before: np.ndarray, q_same: np.ndarray) -> None:
            a, n = of[(lo, 0)]["p_all"] - p_before, of[(lo, 0)]["q_all"] - q_before
            total["u"] += (p_own * (q_before + q_same / 2.0)).reshape(-1, width).sum(0)
            total["ap"] += np.divide(p_own * a, a + n, out=np.zeros(np.shape(p_own)), where=(a + n) > 0).reshape(-1, width).sum(0)

        def between(p: np.ndarray, q: np.ndarray) -> None:
            """Sums of distinct scores in order, one row each."""
            pb, qb = (run[c] + np.cumsum(v, 0) - v for c, v in (("p", p), ("q", q)))
            add(p, pb, qb, q)
            run["p"], run["q"] = run["p"] + p.sum(0), run["q"] + q.sum(0)

        for s, p, q in _chunks(rows, width):
            hit = (s >= threshold)[:, None]
            for n, v in (("p", p), ("q", q), ("tp", p * hit), ("fp", q * hit)):
                total[n] += v.sum(0)
            at = _place(s, lo, hi)
            for k in (0, 2):
                if (at == k).any():
                    e = of[(hi if k else lo, 0)]
                    add(p[at == k].sum(0), e["p_before"], e["q_before"], e["q"])
            m = at == 1
            if m.any():
                s, p, q = s[m], p[m], q[m]
                head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                p, q, s = np.add.reduceat(p, head, 0), np.add.reduceat(q, head, 0), s[head]
                if held and held[0] == s[0]:
                    p[0] += held[1]
                    q[0] += held[2]
                elif held:
                    between(held[1][None], held[2][None])
                between(p[:-1], q[:-1])
                held = [s[-1], p[-1], q[-1]]
        if held:
            between(held[1][None], held[2][None])
        return pa.table({n: pa.array([v.tolist()], pa.list_(pa.float64())) for n, v in total.items()})

    names = ["u", "ap", "p", "q", "tp", "fp"]
    swept = part.cogroup(starts.groupBy("of")).applyInArrow(lambda key, rows, starts: sweep(key, rows, starts), ", ".join(f"{n} array<double>" for n in names))
    per = swept.select(F.posexplode(F.arrays_zip(*names)).alias("draw", "s")).groupBy("draw").agg(*[F.sum(f"s.{n}").alias(n) for n in names])
    div = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    u, ap, p, q, tp, fp = (F.col(n) for n in names)
    per = per.select("draw", *[c.alias(n) for n, c in zip(METRICS, (div(u, p * q), div(ap, p), div(tp, p), div(q - fp, q), div(tp, tp + fp), div(q - fp, q - fp + p - tp)))])
    drawn = lambda n: F.when(F.col("draw") > 0, F.col(n))
    stats = per.agg(*[c for n in METRICS for c in (F.max(F.when(F.col("draw") == 0, F.col(n))).alias(f"{n}|point"), F.percentile(drawn(n), F.lit(0.025)).alias(f"{n}|lo"),
                                                   F.percentile(drawn(n), F.lit(0.975)).alias(f"{n}|hi"))])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), *[F.col(f"{n}|{k}").alias(k) for k in ("point", "lo", "hi")]) for n in METRICS])
    return stats.select(F.explode(rows).alias("r")).select("r.*")
