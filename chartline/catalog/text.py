"""W: text features on documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as x
from ..operators import cohort, learn, text as w, text_dictionaries as td
from ..session import cut_lineage
from .base import ANCH, SPINE, query, r, rounded, with_

# Conversations as text events of an entity: user and system turns count as clinical types.
CONV = """cv AS (SELECT conv_id AS entity, turn, role AS event_type, CASE WHEN turn % 5 = 0 THEN 'IMAGING' ELSE 'OTHER' END AS category,
  CASE WHEN turn % 3 = 0 THEN '<value id="1">' || text || '</value>' ELSE text END AS text FROM conversations)"""
BODY = r"""bd AS (SELECT *, lower(CASE WHEN turn % 3 = 0 AND NOT contains(inner_text, '<') THEN inner_text ELSE text END) AS body
  FROM (SELECT *, replace(replace(text, '<value id="1">', ''), '</value>', '') AS inner_text FROM cv))"""


def conv(t):
    tx = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('<value id="1">'), F.col("text"), F.lit("</value>"))).otherwise(F.col("text"))
    return t.conversations.select(
        F.col("conv_id").alias("entity"), "turn", F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")).alias("event_date"),
        F.col("role").alias("event_type"), F.when(F.col("turn") % 5 == 0, "IMAGING").otherwise("OTHER").alias("category"), tx.alias("text"))


_BOIL = [r"the\s*of", r"and\s*in", r"de\s*la"]
_BRX = r"the\s*of|and\s*in|de\s*la"
PIECES = rf"""pc AS (SELECT entity, turn, body FROM (SELECT entity, turn, CASE WHEN NOT regexp_matches(body, '{_BRX}') THEN body
    WHEN length(trim(regexp_replace(body, '{_BRX}', '', 'g'), ' ')) > 20 THEN trim(regexp_replace(body, '{_BRX}', '', 'g'), ' ') END AS body
  FROM (SELECT DISTINCT entity, turn, event_type, category, body FROM bd WHERE length(body) > 10
    AND (event_type IN ('user', 'system') OR category = 'IMAGING' OR regexp_matches(body, 'tion|ung')))) WHERE body IS NOT NULL)"""


def pieces(t):
    return w.pieces(conv(t), ["user", "system"], ["IMAGING"], search="tion|ung", boilerplate=_BOIL, keep=["turn"])


@query("w01_patient_documents", rf"""{with_(CONV, BODY, PIECES)}, d AS (SELECT entity, string_agg(body, ' ' ORDER BY turn, body) AS doc FROM pc GROUP BY 1)
SELECT entity, CASE WHEN len(regexp_split_to_array(trim(doc, ' '), '\s+')) > 60 THEN array_to_string(regexp_split_to_array(trim(doc, ' '), '\s+')[1:60], ' ') ELSE doc END AS doc FROM d""")
def _(t):
    return w.documents(pieces(t), 60, order=["turn"])


_FLAGS = {"img_a": r"tion.{0,15}the|ung\s*der", "img_b": r"ou\s+le", "sev_a": r"re\s*(the|of|de)", "ctx_a": r"\d+|[@]"}


@query("w02_keyword_flags", rf"""WITH d AS (SELECT doc_id, lower(text) AS body, source FROM documents)
SELECT source AS entity, """ + ", ".join(f"CAST(count(*) FILTER (WHERE regexp_matches(body, '{rx}') AND {'body LIKE ' + chr(39) + '%en%' + chr(39) if n.startswith('img') else 'true'}) > 0 AS INTEGER) AS {n}" for n, rx in _FLAGS.items()) +
       r""", CAST(count(*) FILTER (WHERE body LIKE '%en%') > 0 AS INTEGER) AS TEXT_IMG_has_report, CAST(count(*) FILTER (WHERE body LIKE '%en%' AND NOT regexp_matches(body, 'the|de')) > 0 AS INTEGER) AS TEXT_IMG_abnormal_report FROM d GROUP BY 1""")
def _(t):
    d = t.documents.select(F.col("source").alias("entity"), F.lower("text").alias("body"))
    scope = F.col("body").contains("en")
    a = w.keyword_flags(d, {k: v for k, v in _FLAGS.items() if k.startswith("img")}, scope)
    b = w.keyword_flags(d, {k: v for k, v in _FLAGS.items() if not k.startswith("img")})
    return a.join(b, "entity").join(w.report_flags(d, scope, "the|de"), "entity")


def _hit(rx: str) -> str:
    """A pattern's match in SQL; a negative look-ahead at its end becomes removal of what it forbids."""
    head, sep, tail = rx.partition("(?!")
    return f"regexp_matches(regexp_replace(body, '{head}{tail[:-1]}', '', 'g'), '{head}')" if sep else f"regexp_matches(body, '{rx}')"


def _flag_sql(scoped: dict[str, str], free: dict[str, str], scope: str, normal: str) -> str:
    one = [f"CAST(bool_or(regexp_matches(body, '{scope}') AND {_hit(rx)}) AS INTEGER) AS {n}" for n, rx in scoped.items()]
    one += [f"CAST(bool_or({_hit(rx)}) AS INTEGER) AS {n}" for n, rx in free.items()]
    one += [f"CAST(bool_or(regexp_matches(body, '{scope}')) AS INTEGER) AS TEXT_IMG_has_report",
            f"CAST(bool_or(regexp_matches(body, '{scope}') AND NOT regexp_matches(body, '{normal}')) AS INTEGER) AS TEXT_IMG_abnormal_report"]
    return f"SELECT entity, {', '.join(one)} FROM d GROUP BY 1"


# Clinical words do not occur in the invented prose, so each document gets some of them, by its id.
_WORDS = ("ovarian cyst on scan", "worsening pain", "normal scan", "biopsy and histology", "lymph node enlarged", "night sweats and itch", "fever range", "high temperature", "new mole, irregular border",
          "blast cells in blood film", "persistent fatigue", "weight loss", "monoclonal paraprotein", "recurrent infection", "severe anaemia", "family history", "no significant findings")


def clinical_texts(t):
    """Documents as entities' texts, three of the words above added to each."""
    pick = [F.element_at(F.array(*[F.lit(v) for v in _WORDS]), (F.col("doc_id") * m % len(_WORDS) + 1).cast("int")) for m in (1, 3, 7)]
    return t.documents.select((F.col("doc_id") % 400).alias("entity"), F.lower(F.concat_ws(" ", "text", *pick)).alias("body"))


_CLINICAL = "d AS (SELECT doc_id % 400 AS entity, lower(concat_ws(' ', text, " + ", ".join(
    f"(ARRAY[{', '.join(chr(39) + v + chr(39) for v in _WORDS)}])[doc_id * {m} % {len(_WORDS)} + 1]" for m in (1, 3, 7)) + ")) AS body FROM documents)"


@query("w02_clinical_dictionaries", f"{with_(_CLINICAL)} {_flag_sql(w.IMAGING, {**w.SEVERITY, **w.CONTEXT}, w.SCAN_PATTERN, w.NORMAL_PATTERN)}")
def _(t):
    d = clinical_texts(t)
    scope = F.col("body").rlike(w.SCAN_PATTERN)
    out = w.keyword_flags(d, w.IMAGING, scope).join(w.keyword_flags(d, {**w.SEVERITY, **w.CONTEXT}), "entity")
    return out.join(w.report_flags(d, scope), "entity")


def _dictionary_sql(d: td.Dictionary) -> str:
    some = lambda names: "(" + " OR ".join(f"{n} = 1" for n in names) + ")"
    comp = [" + ".join(n for n in d.findings if n != "TEXT_IMG_normal") + " AS TEXT_COMP_imaging_finding_count",
            f"CAST({some(d.key_findings)} AND {some(d.key_severity)} AS INTEGER) AS TEXT_COMP_finding_with_severity",
            f"CAST(TEXT_IMG_abnormal_report = 1 AND {some(d.abnormal_severity)} AS INTEGER) AS TEXT_COMP_abnormal_img_with_severity",
            *[f"CAST({' AND '.join(some(g) for g in groups)} AS INTEGER) AS {n}" for n, groups in d.clusters.items()]]
    names = [*d.findings, *d.severity, *d.context, "TEXT_IMG_abnormal_report", *[c.rpartition(" AS ")[2] for c in comp]]
    total = " + ".join(n for n in names if n != "TEXT_IMG_normal")
    return f"""{with_(_CLINICAL, f"f AS ({_flag_sql(d.findings, {**d.severity, **d.context}, d.search, d.normal)})", f"c AS (SELECT *, {', '.join(comp)} FROM f)")}
SELECT *, CAST({total} > 0 AS INTEGER) AS TEXT_COMP_any_signal, {total} AS TEXT_COMP_total_signal_count FROM c"""


def _dictionary_query(name: str) -> None:
    @query(f"w02_dictionary_{name}", _dictionary_sql(td.ALL[name]))
    def _(t):
        return td.flags(clinical_texts(t), td.ALL[name])


for _name in td.ALL:
    _dictionary_query(_name)


_F3 = r"f AS (SELECT doc_id AS entity, CAST(regexp_matches(lower(text), 'tion') AS INTEGER) AS a, CAST(regexp_matches(lower(text), 'ung') AS INTEGER) AS b, CAST(regexp_matches(lower(text), 'eaux') AS INTEGER) AS c, CAST(regexp_matches(lower(text), 'the\s') AS INTEGER) AS s, CAST(NOT regexp_matches(lower(text), 'de') AS INTEGER) AS ab FROM documents)"


@query("w03_text_composites", f"""{with_(_F3)} SELECT entity, a + b + c AS finding_count, CAST((a = 1 OR b = 1) AND s = 1 AS INTEGER) AS finding_with_severity, CAST(a + b + s > 0 AS INTEGER) AS any_signal, a + b + s AS signal_count,
  CAST(ab = 1 AND s = 1 AS INTEGER) AS abnormal_with_severity FROM f""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("entity"), F.lower("text").alias("body"))
    f = w.keyword_flags(d, {"a": "tion", "b": "ung", "c": "eaux", "s": r"the\s"}).join(
        d.groupBy("entity").agg(F.max(x.flag(~F.col("body").rlike("de"))).alias("ab")), "entity")
    out = w.composites(f, ["a", "b", "c"], ["a", "b"], ["s"], ["a", "b", "s"], "ab")
    return out.select("entity", "finding_count", "finding_with_severity", "any_signal", "signal_count", "abnormal_with_severity")


@query("w04_comment_features", f"""{with_(ANCH)}, c AS (SELECT entity, days_before, lower(trim(CASE WHEN line = 3 THEN ' ' WHEN line = 5 THEN 'NaN' ELSE upper(term) || ' ' END)) AS c FROM anch),
k AS (SELECT *, c LIKE '%ring%' OR c LIKE '%bolt%' AS g1, c LIKE '%red%' AS g2 FROM c WHERE c NOT IN ('', 'nan', 'none', 'null')),
s AS (SELECT entity, count(*) AS comments, count(*) FILTER (WHERE g1) AS kw_fasten, count(*) FILTER (WHERE g2) AS kw_red, round(min(days_before) FILTER (WHERE g1 OR g2) / 30.44::DOUBLE, 6) AS redflag_months FROM k GROUP BY 1)
SELECT *, CAST(kw_fasten > 0 AS INTEGER) + CAST(kw_red > 0 AS INTEGER) AS groups FROM s""")
def _(t):
    c = F.when(F.col("line") == 3, " ").when(F.col("line") == 5, "NaN").otherwise(F.concat(F.upper("term"), F.lit(" ")))
    return rounded(w.comment_features(t.anch.select("entity", "days_before", c.alias("comment")), {"fasten": ["ring", "bolt"], "red": ["red"]}))


TOK = rf"""tk AS (SELECT entity, turn, list_filter(regexp_split_to_array(translate(lower(body), '{w.ACCENTED}', '{w.PLAIN}'), '[^\p{{L}}\p{{N}}_]+'), lambda v: regexp_full_match(v, '[a-z][a-z]+')) AS ws, body FROM pc),
tp AS (SELECT entity, unnest(ws) AS term FROM tk UNION ALL SELECT entity, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM tk WHERE len(ws) > 1
  UNION ALL SELECT entity, pw || ' ' || fw FROM (SELECT entity, ws[1] AS fw, lag(ws[len(ws)]) OVER (PARTITION BY entity ORDER BY turn) AS pw FROM tk WHERE len(ws) > 0) WHERE pw IS NOT NULL),
tc AS (SELECT entity, term, count(*) AS tf FROM tp GROUP BY 1, 2), nd AS (SELECT count(DISTINCT entity) AS n FROM pc),
vo AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS freq, ln((1.0::DOUBLE + max(n)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tc, nd GROUP BY 1 HAVING count(*) >= 10 AND count(*) <= 0.5 * max(n) ORDER BY freq DESC, term LIMIT 500),
wt AS (SELECT entity, term, (ln(tf) + 1) * idf AS w FROM tc JOIN vo USING (term)), tw AS (SELECT entity, term, w / sqrt(sum(w * w) OVER (PARTITION BY entity)) AS weight FROM wt)"""


def weights(t):
    pcs = cut_lineage(pieces(t))  # read for the vocabulary and for its weights
    n = pcs.select("entity").distinct().count()
    vocab = w.fit_vocabulary(w.term_counts(pcs, order=["turn"]), n, size=500)
    return w.tfidf(w.term_counts(pcs, order=["turn"], terms=vocab), vocab), vocab


@query("w05_tfidf", f"{with_(CONV, BODY, PIECES, TOK)} SELECT entity, term, round(weight, 6) AS weight FROM tw")
def _(t):
    return rounded(weights(t)[0])


@query("w05_tfidf_svd", None)
def _(t):
    wt, vocab = weights(t)
    wt = cut_lineage(wt)  # at most a row for each entity and term of the vocabulary
    return w.project(wt, w.fit_svd(wt, vocab, 15))


@query("w06_term_enrichment", f"""{with_(CONV, BODY, PIECES, TOK)}, lb AS (SELECT conv_id AS entity, CASE WHEN max(turn) >= 4 THEN 1 ELSE 0 END AS label FROM conversations GROUP BY 1),
nn AS (SELECT count(*) FILTER (WHERE label = 1)::DOUBLE AS p, count(*) FILTER (WHERE label = 0)::DOUBLE AS q FROM lb),
e AS (SELECT term, coalesce(sum(weight) FILTER (WHERE label = 1), 0) / max(p) AS mp, coalesce(sum(weight) FILTER (WHERE label = 0), 0) / max(q) AS mq FROM tw JOIN lb USING (entity), nn GROUP BY 1)
SELECT term, round(mp, 6) AS mean_pos, round(mq, 6) AS mean_neg, round(CASE WHEN mq > 0 THEN mp / mq ELSE 0 END, 6) AS ratio FROM e ORDER BY round(CASE WHEN mq > 0 THEN mp / mq ELSE 0 END, 9) DESC, term LIMIT 15""")
def _(t):
    lb = t.conversations.groupBy(F.col("conv_id").alias("entity")).agg(x.flag(F.max("turn") >= 4).alias("label"))
    return rounded(w.enrichment(weights(t)[0], lb))


@query("w07_embedding_reduce", None)
def _(t):
    return rounded(w.reduce_embeddings(t.embeddings.select(F.col("vec_id").alias("entity"), "embedding"), 15))


# Text-derived events: a document of a customer mentions a concept, or mentions it as absent.
CONCEPTS = {"TEXT_tion": "tion", "TEXT_ung": "ung", "TEXT_eaux": "eaux"}
ARMS = ["SMALL", "LARGE", "PROMO", *CONCEPTS]
_TXE = "tx AS (" + " UNION ALL ".join(
    f"SELECT doc_id % 1500 + 1 AS entity, {9000 + i} AS code, doc_id % 700 AS days_before, '{n}' AS category, CASE WHEN regexp_matches(lower(text), '[,.] *[a-z]*{w_}') THEN 'absent' ELSE 'present' END AS assertion FROM documents WHERE contains(lower(text), '{w_}')"
    for i, (n, w_) in enumerate(CONCEPTS.items())) + ")"


def text_events(t):
    low = F.lower("text")
    parts = [t.documents.where(F.contains(low, F.lit(word))).select(
        (F.col("doc_id") % 1500 + 1).alias("entity"), F.lit(9000 + i).cast("bigint").alias("code"), (F.col("doc_id") % 700).cast("int").alias("days_before"), F.lit(n).alias("category"),
        F.when(low.rlike(f"[,.] *[a-z]*{word}"), "absent").otherwise("present").alias("assertion")) for i, (n, word) in enumerate(CONCEPTS.items())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def arms(t):
    """Events of the orders alone, and with the events found in texts merged in."""
    base = t.anch.select("entity", "code", "days_before", "category")
    return {"structured": base.withColumn("assertion", F.lit(None).cast("string")), "with_text": cohort.merge_text(base, text_events(t), tie=("category",))}


@query("w08_text_arms", f"""{with_(ANCH, _TXE)}, one AS (SELECT entity, code, days_before, assertion, min(category) AS category FROM tx GROUP BY 1, 2, 3, 4),
bs AS (SELECT entity, code, days_before, category FROM anch), nw AS (SELECT entity, code, days_before, category FROM one o WHERE assertion = 'present' AND NOT EXISTS (SELECT 1 FROM bs WHERE bs.entity = o.entity AND bs.code = o.code AND bs.days_before = o.days_before)),
ev AS (SELECT 'structured' AS build, entity, category, CAST(NULL AS VARCHAR) AS assertion FROM bs UNION ALL SELECT 'with_text', entity, category, NULL FROM bs UNION ALL SELECT 'with_text', entity, category, 'present' FROM nw
  UNION ALL SELECT 'with_text', entity, category, assertion FROM one WHERE assertion = 'absent')
SELECT build, category, assertion, count(*) AS events, count(DISTINCT entity) AS entities FROM ev GROUP BY 1, 2, 3""")
def _(t):
    out = [ev.groupBy("category", "assertion").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("entity").alias("entities")).withColumn("build", F.lit(n)) for n, ev in arms(t).items()]
    return out[0].unionByName(out[1])


@query("w08_text_ab_lift", None)
def _(t):
    """The same learner on both arms; absent findings stay out of the counts."""
    mats = {n: ev.where("coalesce(assertion, '') <> 'absent'").groupBy("entity").pivot("category", ARMS).count().na.fill(0) for n, ev in arms(t).items()}
    return rounded(learn.compare(t.spine, mats, ARMS))
