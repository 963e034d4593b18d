"""Quality classifier from weak labels.

Eight heuristic labellers look at a whole text and vote bad, good or abstain. Their votes overlap and disagree;
expectation-maximisation estimates how often each labeller votes bad on good texts and on each kind of bad ones
(votes independent within a class; an abstention says nothing). It needs only how many documents have each pattern of votes: at most 3^8 rows reach the driver.
The posterior of a pattern is the soft label of its documents, on which a hashed linear scorer is trained:
byte trigrams and word shapes hashed into 2^15 and 2^8 buckets, each group as shares of its text, logistic
loss, adaptive steps. Scoring takes the mean weight of a text's trigrams plus that of its words.

The scorer is fitted on about ``SAMPLE`` rows (all, if there are fewer): those with a hash of id and text in the lowest
SAMPLE / n of its range, repeated rows once. Counts, patterns and scores cover all rows. A text without words (null, empty, white space) is rejected with score 0.
Repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffers, lean, mix, slice_hashes, words
from .tokens import encoder, sliced

LABELLERS = ("symbols", "capitals", "doubled", "bars", "repeats", "lengths", "variety", "ends")
SAMPLE = 8000
STRETCH = 256 << 10  # bytes of text measured together
FEWEST = 6  # labellers abstain on shorter texts
BUCKETS, SHAPES = 1 << 15, 1 << 8
EPOCHS, RATE, DECAY = 60, 0.5, 1e-6
# (bad above, good below) for labellers on ratios, in the order of LABELLERS; fixed thresholds
LIMITS = {"symbols": (0.09, 0.07), "capitals": (0.25, 0.12), "doubled": (0.02, 0.004), "bars": (0.08, 0.01), "repeats": (0.15, 0.03)}


class Measured:
    """Byte and word statistics of a batch of texts, per text."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = buffers(texts)
        self.start, self.end, self.at = words(self.data, self.off)
        d = self.data
        letter = ((d >= 65) & (d <= 90)) | ((d >= 97) & (d <= 122)) | (d >= 128)
        upper, digit = (d >= 65) & (d <= 90), (d >= 48) & (d <= 57)
        space = (d == 32) | ((d >= 9) & (d <= 13))
        mark = ~(letter | digit | space)
        double = np.zeros(len(d), bool)
        double[1:] = mark[1:] & (d[1:] == d[:-1])
        self.n_bytes, self.n_words = np.diff(self.off), np.diff(self.at)
        per = lambda m: self._sum(m, self.off)
        solid = np.maximum(self.n_bytes - per(space), 1)
        self.hash = slice_hashes(d, self.start, self.end)
        same = np.zeros(len(self.hash), bool)
        same[1:] = self.hash[1:] == self.hash[:-1]
        same[self.at[:-1][self.n_words > 0]] = False
        long = self.end - self.start
        bar = (long == 1) & (d[self.start] == 124) if len(d) else np.zeros(0, bool)
        n = np.maximum(self.n_words, 1)
        w = lambda m: self._sum(m, self.at)
        self.same, self.long = same, long
        plain = np.maximum(per(letter & (d < 128)), 1)
        self.ratio = {"symbols": per(mark) / solid, "capitals": per(upper) / plain, "doubled": per(double) / solid, "bars": w(bar) / n, "repeats": w(same) / n}
        worded = long > 1 if len(d) else np.zeros(0, bool)
        worded = worded & (letter[self.start] if len(d) else worded)
        self.short = w(worded & (long <= 3)) / np.maximum(w(worded), 1)  # function words are short
        stop = ((d[self.end - 1] == 46) if len(d) else np.zeros(0, bool))
        self.stops = w(stop) / n
        text = np.repeat(np.arange(len(self.n_words)), self.n_words)
        # distinct words of each text
        key = np.lexsort((self.hash, text))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (self.hash[key][1:] != self.hash[key][:-1]) | (text[key][1:] != text[key][:-1])
        self.distinct = np.bincount(text[key][fresh], minlength=len(self.n_words)) if len(key) else np.zeros(len(self.n_words), int)

    @staticmethod
    def _sum(m: np.ndarray, off: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(m)))
        return run[off[1:]] - run[off[:-1]]

    def votes(self) -> np.ndarray:
        """One row per text: 1 bad, 0 good, 2 abstains, by labeller."""
        out = np.full((len(self.n_words), len(LABELLERS)), 2, np.int8)
        for i, name in enumerate(LABELLERS[:5]):
            bad, good = LIMITS[name]
            out[self.ratio[name] > bad, i], out[self.ratio[name] < good, i] = 1, 0
        enough = self.n_words >= 30
        out[enough & ((self.short < 0.08) | (self.short > 0.85)), 5] = 1
        out[enough & (self.short > 0.15) & (self.short < 0.75), 5] = 0
        variety = self.distinct / np.maximum(np.sqrt(self.n_words), 1)  # types over the root of tokens changes little with length
        out[enough & (variety < 2), 6], out[enough & (variety > 4), 6] = 1, 0
        out[enough & (self.stops < 0.005), 7], out[enough & (self.stops > 0.02), 7] = 1, 0
        out[self.n_words < FEWEST] = 2
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of each byte trigram with its offsets per text, shape of each word with its offsets."""
        d, tri = self.data, np.zeros(0, np.int64)
        n = np.maximum(self.n_bytes - 2, 0)
        if len(d) > 2:
            t = np.empty(len(d) - 2, np.uint16)
            for x in range(0, len(t), STRETCH):  # a long text is a stretch of its own
                w = d[x:x + STRETCH + 2].astype(np.uint64)
                w = w[:-2] << np.uint64(16) | w[1:-1] << np.uint64(8) | w[2:]
                t[x:x + STRETCH] = mix(w + np.uint64(1)) >> np.uint64(64 - 15)
            inside = np.ones(len(d), bool)  # trigrams that cross the end of a text don't count
            for k in (1, 2):
                ends = self.off[1:] - k
                inside[ends[ends >= 0]] = False
            # a text of one byte ends where the one before it does
            tri = t[inside[:-2]]
            n = self._sum(inside, self.off)
        b = self.data
        if len(b):
            first, last = b[self.start], b[self.end - 1]
            before = b[np.maximum(self.end - 2, 0)]
            up = ((first >= 65) & (first <= 90)) * 1 + ((before >= 65) & (before <= 90)) * 2
            tail = (last == 46) * 1 + (last == 44) * 2 + ((last < 48) & (last != 46) & (last != 44)) * 3
            shape = up | tail << 2 | ((last == before) & (self.long > 1)) << 4 | self.same << 5 | (self.long == 1) << 6
        else:
            shape = np.zeros(0, np.int64)
        return tri, np.concatenate(([0], np.cumsum(n))), shape.astype(np.int64), self.at


def _mean(weight: np.ndarray, index: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0.0], np.cumsum(weight[index])))
    return (run[off[1:]] - run[off[:-1]]) / np.maximum(np.diff(off), 1)


def patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, text hash, pattern): the votes as a string of digits, one per labeller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # a worker may have served a stage that encodes: nothing of it is needed here
        for b in batches:
            for x, y in sliced(b.column("text"), STRETCH):
                v = Measured(b.column("text").slice(x, y - x)).votes()
                yield pa.RecordBatch.from_arrays([pa.array((v @ 3 ** np.arange(v.shape[1])).astype(np.int32))], names=["pattern"])

    return docs.select("text").mapInArrow(lean(run), "pattern int")


def estimate(counts: dict[int, int], rounds: int = 300) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """Posterior of bad for every possible pattern, P(votes bad | class, no abstention) as class x labeller, class shares.

    Bad texts are bad in different ways, and a labeller sees one or two of them; so class 0 is good and there is a
    class of bad texts for each labeller on a ratio and one for the rest. Within a class votes are independent.
    """
    n = len(LABELLERS)
    every = np.array(list(product(range(3), repeat=n)))[:, ::-1]
    code = every @ 3 ** np.arange(n)
    weight = np.array([counts.get(int(c), 0) for c in code], float)
    bad, good = (every == 1).astype(float), (every == 0).astype(float)
    # start: texts that two labellers or more call bad are bad, in the ways that these see
    kinds = np.concatenate([bad[:, :len(LIMITS)], (bad[:, :len(LIMITS)].sum(1) == 0)[:, None]], 1)
    kinds /= kinds.sum(1, keepdims=True)
    resp = np.where(bad.sum(1, keepdims=True) >= 2, np.concatenate([np.zeros((len(every), 1)), kinds], 1), np.eye(kinds.shape[1] + 1)[:1])
    for _ in range(rounds):
        own = resp * weight[:, None]
        table = (own.T @ bad + 0.5) / (own.T @ (bad + good) + 1.0)
        prior = (own.sum(0) + 0.5) / (own.sum() + 0.5 * own.shape[1])
        log = np.log(prior) + bad @ np.log(table).T + good @ np.log1p(-table).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - resp).max()
        resp = new
        if moved < 1e-9:
            break
    return dict(zip(code.tolist(), (1 - resp[:, 0]).tolist())), table, prior


def fit(texts: pa.Array, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of trigram buckets and word shapes, and the bias; target: the chance that a text is bad."""
    cells: list[list[tuple]] = [[], []]
    for x, y in sliced(texts, STRETCH):
        tri, to, shape, so = Measured(texts.slice(x, y - x)).features()
        for k, (index, off, size) in enumerate(((tri, to, BUCKETS), (shape, so, SHAPES))):
            cell, n = np.unique(np.repeat(np.arange(len(off) - 1), np.diff(off)) * size + index, return_counts=True)
            row = cell // size
            cells[k].append(((x + row).astype(np.int32), (cell % size).astype(np.int32), (n / np.maximum(np.diff(off), 1)[row]).astype(np.float32)))
    groups = [(*(np.concatenate(c) for c in zip(*got)), np.zeros(size), np.full(size, 1e-8)) for got, size in zip(cells, (BUCKETS, SHAPES))]
    bias, bias_g, rows = 0.0, 1e-8, max(len(target), 1)
    for _ in range(EPOCHS):
        z = np.full(len(target), bias)
        for row, col, x, w, _g in groups:
            z += np.bincount(row, x * w[col], minlength=len(target))
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / rows
        for row, col, x, w, g in groups:
            grad = np.bincount(col, x * err[row], minlength=len(w)) + DECAY * w
            g += grad * grad
            w -= RATE * 4 * grad / np.sqrt(g)
        bias_g += err.sum() ** 2
        bias -= RATE * err.sum() / np.sqrt(bias_g)
    return groups[0][3], groups[1][3], bias


def train(docs: DataFrame) -> tuple[dict[int, float], tuple[np.ndarray, np.ndarray, float]]:
    """The posterior of each pattern, and the scorer fitted on the sample, in one executor task."""
    counts = {r["pattern"]: r["n"] for r in patterns(docs).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    post, _, _ = estimate(counts)
    # rows whose hash is in the lowest part of its range: no row of the corpus is moved to choose them
    share = min(1.0, SAMPLE / max(1, sum(counts.values())))
    below = int(-(1 << 63) + share * ((1 << 64) - 1))
    keyed = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("doc_id", "text"))
    sample = keyed.where(F.col("_h") <= F.lit(min(below, (1 << 63) - 1))).dropDuplicates(["_h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("_h", "ascending"), ("doc_id", "ascending")])
        text = t.column("text").combine_chunks()
        text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
        v = Measured(text).votes()
        target = np.array([post[int(c)] for c in v @ 3 ** np.arange(v.shape[1])])
        a, b, c = fit(text, target)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes() for x in (a, b, np.array([c]))], pa.binary())], names=["w"])

    got = [np.frombuffer(bytes(r["w"]), "<f8") for r in sample.select("_h", F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(1).mapInArrow(lean(run), "w binary").collect()]
    return post, (got[0], got[1], float(got[2][0])) if got else (np.zeros(BUCKETS), np.zeros(SHAPES), 0.0)


def scored(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and _words, _votes, _posterior, _score (the chance that a text is good) and _keep."""
    post, (tri_w, shape_w, bias) = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in sliced(whole.column(text), STRETCH):
                batch = whole.slice(a, b - a)
                m = Measured(batch.column(text))
                v = m.votes()
                code = v @ 3 ** np.arange(v.shape[1])
                tri, to, shape, so = m.features()
                z = _mean(tri_w, tri, to) + _mean(shape_w, shape, so) + bias
                good = np.where(m.n_words == 0, 0.0, 1 / (1 + np.exp(np.clip(z, -50, 50))))
                more = [pa.array(m.n_words.astype(np.int64)), pa.array(["".join("gb."[x] for x in r) for r in v], pa.string()),
                        pa.array([1 - post[int(c)] for c in code], pa.float64()), pa.array(good), pa.array(good >= 0.5)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_words", "_votes", "_posterior", "_score", "_keep"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lean(run), f"{fields}, _words long, _votes string, _posterior double, _score double, _keep boolean")


def report(docs: DataFrame) -> DataFrame:
    """op10: per document its words, the labellers' votes, the posterior and score of being good, and keep."""
    d = scored(docs.select("doc_id", "text"))
    return d.select("doc_id", F.col("_words").alias("n_words"), F.col("_votes").alias("votes"), F.round("_posterior", 6).alias("posterior"), F.round("_score", 6).alias("score"),
                    F.col("_keep").alias("keep"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the scorer keeps, all their columns unchanged."""
    return scored(docs).where("_keep").select(*docs.columns)
