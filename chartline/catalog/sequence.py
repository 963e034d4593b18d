"""Q: sequence preparation; arrays are shown as joined text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as q
from .base import ANCH, query, r, rounded, with_

AN = with_(ANCH)
VOC = "voc AS (SELECT code, count(*) AS freq, CAST(row_number() OVER (ORDER BY code) + 1 AS INTEGER) AS id FROM anch GROUP BY 1 HAVING count(*) >= 18)"
ENC = "enc AS (SELECT a.*, coalesce(v.id, 1) AS id FROM anch a LEFT JOIN voc v USING (code))"
SEQ = """lastn AS (SELECT entity, id, label, row_number() OVER (PARTITION BY entity ORDER BY event_date DESC, id DESC) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM enc),
seq AS (SELECT entity, list(id ORDER BY rn DESC) AS s, max(label) AS label, max(n) AS n_events FROM lastn WHERE rn <= 20 AND n >= 10 GROUP BY 1)"""


def encoded(t):
    return q.encode(t.anch, q.vocab(t.anch, 18))


def seqs(t):
    return q.sequences(encoded(t), 20, 10, static=["label"])


def text(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), " ")


@query("q01_vocab", f"{with_(ANCH, VOC)} SELECT * FROM voc")
def _(t):
    return q.vocab(t.anch, 18)


@query("q02_encode", f"{with_(ANCH, VOC, ENC)} SELECT id, count(*) AS n, count(DISTINCT entity) AS n_entities FROM enc GROUP BY 1")
def _(t):
    return encoded(t).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("n_entities"))


@query("q03_sequences", f"{with_(ANCH, VOC, ENC, SEQ)} SELECT entity, array_to_string(s, ' ') AS sequence, label, n_events FROM seq")
def _(t):
    return seqs(t).select("entity", text("sequence").alias("sequence"), "label", "n_events")


@query("q04_pad", f"{with_(ANCH, VOC, ENC, SEQ)} SELECT entity, array_to_string(s || list_resize([]::INTEGER[], 25 - len(s), 0), ' ') AS padded FROM seq")
def _(t):
    return seqs(t).select("entity", text(q.pad("sequence", 25)).alias("padded"))


@query("q05_length_stats", f"""{AN}, n AS (SELECT entity, label, event_type, count(*) AS len FROM anch GROUP BY 1, 2, 3)
SELECT label, event_type, count(*) AS entities, round(avg(len), 6) AS mean, min(len) AS min, max(len) AS max, round(quantile_cont(len, 0.25), 6) AS p25, round(quantile_cont(len, 0.5), 6) AS p50,
  round(quantile_cont(len, 0.75), 6) AS p75, round(quantile_cont(len, 0.95), 6) AS p95 FROM n GROUP BY 1, 2""")
def _(t):
    return rounded(q.length_stats(t.anch))


@query("q06_baseline_codes", f"""{with_(ANCH, VOC, ENC, SEQ)}, i AS (SELECT CAST(rn - 1 AS INTEGER) AS pos, id, count(*) AS n FROM lastn WHERE rn <= 20 AND n >= 10 AND label = 0 GROUP BY 1, 2)
SELECT pos, id, n FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, id) AS k FROM i) WHERE k = 1""")
def _(t):
    return q.position_mode(seqs(t).where("label = 0"))
