"""Text features: documents per entity, keyword flags, tf-idf, reduced embeddings.

Texts stay rows. Term counts are summed per entity from its pieces, so an
entity with very many texts is never joined into one string; bigrams across
two neighbouring pieces are added from their border words.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import skew
from ..functions import scalar as x
from ..session import literal_table
from .assemble import feature_index, vectors

# --- fixed values -----------------------------------------------------------
BOILERPLATE = (
    r"normal[\s,-]*no\s*action", r"no\s*significant\s*pathology", r"within\s*normal\s*limits", r"unremarkable",
    r"please\s*note\s*method\s*changed", r"reference\s*range", r"adjusting\s*egfr", r"ckd\s*guidelines", r"efi\s*score", r"frailty",
)
SEARCH_PATTERN = "scan|ultrasound|uss|imaging|x-ray|ct |mri|cyst|mass|ovari|pelvi|adnex|fibroid|ascites"
SCAN_PATTERN = "scan|ultrasound|uss|imaging|x-ray|ct "
NORMAL_PATTERN = r"normal|no\s*abnormal|unremark|no\s*significant|within\s*normal"
IMAGING = {
    "TEXT_IMG_cyst_any": r"(?:ovarian|adnexal|pelvic|pelvi).{0,30}cyst|cyst.{0,30}(?:ovar|adnex|pelvi)|cyst\s*visible|cystic\s*(density|lesion|mass|structure)",
    "TEXT_IMG_complex_cyst": r"complex.{0,15}(?:cyst|ovar|mass|adnex)|multilocul|septated|solid.{0,20}cyst|cyst.{0,15}complex",
    "TEXT_IMG_simple_cyst": r"simple\s*(?:cyst|ovar)|unilocular|thin.{0,10}wall.{0,10}cyst|anechoic\s*cyst",
    "TEXT_IMG_mass": r"(?:ovarian|adnexal|pelvic|abdomin|pelvi|mesenter).{0,20}mass|mass.{0,20}(?:ovar|adnex|pelvi|abdom)|adnexal\s*(?:mass|lesion)|pelvic\s*(?:mass|lesion)",
    "TEXT_IMG_solid": r"solid\s*(?:component|mass|lesion|area|nodule|tumou?r)|(?:mass|lesion).{0,10}solid",
    "TEXT_IMG_ascites": r"ascites|free\s*fluid|fluid.{0,15}(?:pelvi|pod|pouch|abdomen)|pod\s*fluid",
    "TEXT_IMG_enlarged_ovary": r"enlarg.{0,10}ovar|ovar.{0,10}enlarg|bulky\s*ovar|ovar.{0,10}(?:bulky|large|big)",
    "TEXT_IMG_endometrial_thick": r"endom[ea]tri.{0,15}(?:thick|measur|\d+\s*mm)|thick.{0,10}endom[ea]tri|lining.{0,15}(?:thick|\d+\s*mm)",
    "TEXT_IMG_fibroid": r"fibroid|leiomyoma|myoma|fibrom",
    "TEXT_IMG_irregular": r"irregular\s*(?:mass|border|margin|contour|shape|outline)",
    "TEXT_IMG_heterogenous": r"heterogen|mixed\s*echogen|coarse.{0,10}(?:echo|texture)",
    "TEXT_IMG_lymph_nodes": r"lymph\s*node|lymphadenopathy|enlarged\s*node",
    "TEXT_IMG_liver_lesion": r"liver\s*(?:lesion|mass|metast)|hepatic\s*(?:lesion|mass|metast)",
    "TEXT_IMG_pleural_effusion": r"pleural\s*effusion",
    "TEXT_IMG_hydronephrosis": r"hydronephrosis|dilat.{0,10}(?:renal|ureter|collecting)",
    "TEXT_IMG_normal": r"(?:normal|no\s*abnormal|unremark|no\s*significant|within\s*normal)",
}
SEVERITY = {
    "TEXT_SEV_worsening": r"worsen|getting\s*worse|deteriorat|increas.{0,10}(pain|symptom|bleed)",
    "TEXT_SEV_persistent": r"persistent\s*(pain|bleed|symptom|bloat|discharge|cough|discomfort)",
    "TEXT_SEV_severe": r"severe\s*(pain|bleed|abdom|pelvi|symptom|anae|discomfort|weight)",
    "TEXT_SEV_recurrent": r"recurrent\s*(pain|bleed|infection|uti|symptom|episode|presentation)",
    "TEXT_SEV_new": r"new\s*(symptom|lump|mass|bleed|pain)|recently\s*(develop|start|notic)",
}
CONTEXT = {
    "TEXT_CLIN_biopsy": r"biops|histolog|cytolog|sample\s*taken|specimen",
    "TEXT_CLIN_polyp": r"polyp|polypectomy",
    "TEXT_CLIN_endometrial": r"endometri|pipelle|endometrial\s*sampl",
    "TEXT_CLIN_cervical": r"cervic|smear|colposcop",
    "TEXT_CLIN_bleeding": r"bleed|blood|haemorrhag|spotting",
    "TEXT_CLIN_pain_context": r"pain.{0,20}(abdom|pelvi|lower|iliac|loin)|pain\s*score",
    "TEXT_CLIN_weight_loss": r"weight\s*(loss|lost|losing|reduc)|lost\s*weight|appetite\s*(loss|poor|reduc)",
    "TEXT_CLIN_family_history": r"family\s*histor|mother|sister|aunt|grandmother",
}
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# ----------------------------------------------------------------------------


def pieces(ev: DataFrame, types: Sequence[str], cats: Sequence[str], text: str = "text", tag: str = "value", min_len: int = 10,
           search: str = SEARCH_PATTERN, boilerplate: Sequence[str] = BOILERPLATE, keep: Sequence[str] = ()) -> DataFrame:
    """Meaningful text rows of each entity: of listed types or categories, or matching the search
    pattern; exact repeats once; boilerplate removed. Column ``body``."""
    body = x.tag_values(text, tag)
    t = ev.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0).withColumn("body", body).where(F.length("body") > min_len)
    t = t.where(F.col("event_type").isin(*types) | F.col("category").isin(*cats) | F.col("body").rlike(search))
    t = t.select("entity", "event_date", "event_type", "category", *keep, "body").distinct()
    return t.withColumn("body", x.strip_boilerplate("body", boilerplate)).where(F.col("body").isNotNull())


def documents(pcs: DataFrame, words: int = 400, order: Sequence[str] = ("event_date",)) -> DataFrame:
    """One document per entity of at most ``words`` words (the input size of an encoder).

    Every piece has a word, so the first ``words`` pieces are enough; the
    rest is cut before the shuffle.
    """
    first = skew.top_by(pcs, ["entity"], [F.col(c) for c in (*order, "body")], words, "_rn")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "body"))), lambda s: s["body"]), " ")
    return first.groupBy("entity").agg(joined.alias("doc")).select("entity", x.first_words("doc", words).alias("doc"))


def _alternatives(rx: str) -> list[str]:
    """A pattern cut at the bars outside its groups and classes."""
    out, depth, i, start = [], 0, 0, 0
    while i < len(rx):
        c = rx[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = rx.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(rx[start:i])
            start = i + 1
        i += 1
    return [*out, rx[start:]]


def required(rx: str, least: int = 3) -> list[str] | None:
    """Strings of which every match of the pattern contains one; None where they can't be told. Knows literals, escapes, classes,
    groups and quantifiers; any other construct just ends a string."""
    if "(?i" in rx or "\\Q" in rx:
        return None
    found: list[str] = []
    for alt in _alternatives(rx):
        options: list[list[str]] = []
        run, i = "", 0
        while i <= len(alt):
            c, literal, group, end = alt[i:i + 1], None, None, i + 1
            if c == "\\":
                literal, end = (None if alt[i + 1].isalnum() else alt[i + 1]), i + 2
            elif c == "[":
                end = alt.index("]", i + 2) + 1
            elif c == "(":
                depth, end = 1, i + 1
                while depth:
                    end += {"\\": 1}.get(alt[end], 0) if alt[end] != "[" else alt.index("]", end + 2) - end
                    depth += {"(": 1, ")": -1}.get(alt[end], 0) if alt[end - 1] != "\\" else 0
                    end += 1
                inner = alt[i + 1:end - 1]
                group = required(inner[2:], least) if inner.startswith("?:") else None if inner.startswith("?") else required(inner, least)
            elif c and c not in ".^$*+?{}|)":
                literal = c
            optional = alt[end:end + 1] in ("?", "*", "{") and alt[end:end + 1] != ""
            if literal and not optional:
                run += literal
            if not literal or optional or alt[end:end + 1] == "+":
                if len(run) >= least:
                    options.append([run])
                run = ""
            if group and not optional:
                options.append(group)
            while alt[end:end + 1] in ("?", "*", "+", "{") and alt[end:end + 1]:
                end = alt.index("}", end) + 1 if alt[end] == "{" else end + 1
            i = end
        if not options:
            return None
        found += max(options, key=lambda o: (min(map(len, o)), -len(o)))
    return [v for v in dict.fromkeys(found) if not any(o != v and o in v for o in found)]


def matches(c: Column, rx: str) -> Column:
    """``rlike``, tried only on texts with a string that every match contains: looking for these costs far less than the pattern."""
    some = required(rx)
    return c.rlike(rx) if some is None else x.any_of([c.contains(v) for v in some]) & c.rlike(rx)


def keyword_flags(ev: DataFrame, patterns: dict[str, str], scope: Column | None = None) -> DataFrame:
    """0/1 per pattern: any text of the entity (inside the scope) matches. Column ``body`` is lower case."""
    inside = F.lit(True) if scope is None else scope
    return ev.groupBy("entity").agg(*[F.max(x.flag(inside & matches(F.col("body"), rx))).alias(n) for n, rx in patterns.items()])


def report_flags(ev: DataFrame, scope: Column, normal: str = NORMAL_PATTERN, prefix: str = "TEXT_IMG_") -> DataFrame:
    """Has any report, and has a report without a normality phrase."""
    return ev.groupBy("entity").agg(F.max(x.flag(scope)).alias(f"{prefix}has_report"),
                                    F.max(x.flag(scope & ~F.col("body").rlike(normal))).alias(f"{prefix}abnormal_report"))


def composites(flags: DataFrame, findings: Sequence[str], key_findings: Sequence[str], severities: Sequence[str], signals: Sequence[str],
               abnormal: str | None = None) -> DataFrame:
    """Number of findings, finding with severity, abnormal report with severity, any signal and their number."""
    any_sev = x.any_of([F.col(c) == 1 for c in severities])
    any_key = x.any_of([F.col(c) == 1 for c in key_findings])
    n = x.total([F.col(c) for c in signals])
    out = [x.total([F.col(c) for c in findings]).alias("finding_count"), x.flag(any_key & any_sev).alias("finding_with_severity"),
           x.flag(n > 0).alias("any_signal"), n.alias("signal_count")]
    if abnormal:
        out.append(x.flag((F.col(abnormal) == 1) & any_sev).alias("abnormal_with_severity"))
    return flags.select("*", *out)


def comment_features(ev: DataFrame, groups: dict[str, Sequence[str]], text: str = "comment") -> DataFrame:
    """Comments per entity, per keyword group, distinct groups, months since the last red-flag comment."""
    c = F.lower(F.trim(F.col(text)))
    e = ev.withColumn("_c", c).where(~F.col("_c").isin("", "nan", "none", "null"))
    hits = {g: x.any_of([F.col("_c").contains(w) for w in words]) for g, words in groups.items()}
    any_hit = x.any_of(list(hits.values()))
    t = e.groupBy("entity").agg(
        F.count(F.lit(1)).alias("comments"), *[x.count_where(h).alias(f"kw_{g}") for g, h in hits.items()],
        (F.min(F.when(any_hit, F.col("days_before"))) / 30.44).alias("redflag_months"))
    return t.withColumn("groups", x.total([x.flag(F.col(f"kw_{g}") > 0) for g in groups]))


def words(c: Column | str) -> Column:
    """Lower-case words of two letters or more, accents removed; tokens with digits or other letters are dropped."""
    flat = F.translate(F.lower(x.col(c)), ACCENTED, PLAIN)
    return F.regexp_extract_all(flat, F.lit(r"(?<![\p{L}\p{N}_])([a-z]{2,})(?![\p{L}\p{N}_])"), F.lit(1))


def term_counts(pcs: DataFrame, order: Sequence[str] | None = None, text: str = "body", terms: DataFrame | None = None) -> DataFrame:
    """(entity, term, tf) for words and word pairs; with terms (term) only of these, so that no others are shuffled.

    With an order given, the pair formed by the last word of a piece and the
    first word of the entity's next piece counts as well.
    """
    t = pcs.withColumn("_w", words(text)).where(F.size("_w") > 0)
    w = F.col("_w")
    rest = F.size(w) - 1
    grams = F.concat(w, F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b)))
    rows = t.select("entity", F.explode(grams).alias("term"))
    if order:
        ends = t.select("entity", *order, F.element_at(w, 1).alias("a"), F.element_at(w, -1).alias("b"), F.hash(text).alias("_h"))
        prev = skew.previous(ends, ["entity"], [*order, "_h", "a", "b"], ["b"], _segment(ends, order[0]))
        rows = rows.unionByName(prev.where(F.col("prev_b").isNotNull()).select("entity", F.concat_ws(" ", "prev_b", "a").alias("term")))
    if terms is not None:
        rows = rows.join(F.broadcast(terms.select("term")), "term", "left_semi")
    return rows.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("tf"))


def _segment(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.year(c) * 12 + F.month(c) if kind in ("date", "timestamp") else F.floor(F.col(c) / 256)


def fit_vocabulary(tc: DataFrame, n_docs: int, min_df: int = 10, max_df: float = 0.5, size: int = 500) -> DataFrame:
    """The ``size`` most frequent terms inside the document-frequency bounds, with their idf.

    A fit step: the table of at most ``size`` rows is computed once and
    carried as literals, so applying it does not repeat the counting.
    """
    t = tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("freq"))
    t = t.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    top = t.orderBy(F.desc("freq"), "term").limit(size)
    rows = top.select("term", "df", "freq", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf")).collect()
    return literal_table(tc.sparkSession, [r.asDict() for r in rows], "term string, df bigint, freq bigint, idf double")


def tfidf(tc: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Unit-length weights (1 + ln tf) * idf as (entity, term, weight) rows. The norm's window holds at most one row per vocabulary term."""
    w = tc.join(vocabulary.select("term", "idf"), "term").select("entity", "term", ((F.log("tf") + 1.0) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("entity")))
    return w.select("entity", "term", (F.col("w") / norm).alias("weight"))


def fit_svd(weights: DataFrame, vocabulary: DataFrame, k: int = 15) -> DataFrame:
    """Right singular vectors as (term, component, loading): a vocabulary-by-k table.

    The Gram matrix is summed on the executors in one pass; only its numbers,
    vocabulary by vocabulary, come back.
    """
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    terms = [r["term"] for r in vocabulary.orderBy("term").select("term").collect()]
    index = {t: i for i, t in enumerate(terms)}
    spark, size = weights.sparkSession, len(index)
    long = weights.select("entity", F.col("term").alias("feature"), F.col("weight").alias("value"))
    vec = vectors(long, feature_index(terms, spark), size, "v").select("v")
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vec, "v"), 0, size).computeGramianMatrix().toArray()
    values, v = np.linalg.eigh(gram)  # vocabulary x vocabulary numbers
    v = v[:, np.argsort(-values)[: min(k, size - 1)]]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])  # largest loading positive
    flat = [{"term": t, "component": j, "loading": float(v[i, j])} for t, i in index.items() for j in range(v.shape[1])]
    return literal_table(spark, flat, "term string, component int, loading double")


def project(weights: DataFrame, loadings: DataFrame) -> DataFrame:
    """(entity, component, value): weights times loadings."""
    return weights.join(loadings, "term").groupBy("entity", "component").agg(F.sum(F.col("weight") * F.col("loading")).alias("value"))


def enrichment(weights: DataFrame, labels: DataFrame, k: int = 15) -> DataFrame:
    """Terms whose mean weight is largest in the positive class relative to the negative one."""
    n = labels.groupBy().agg(x.count_where(F.col("label") == 1).alias("p"), x.count_where(F.col("label") == 0).alias("q")).first()
    t = weights.join(labels.select("entity", "label"), "entity").groupBy("term").agg(
        (F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0.0)) / float(max(n["p"], 1))).alias("mean_pos"),
        (F.sum(F.when(F.col("label") == 0, F.col("weight")).otherwise(0.0)) / float(max(n["q"], 1))).alias("mean_neg"))
    r = t.withColumn("ratio", F.when(F.col("mean_neg") > 0, F.try_divide(F.col("mean_pos"), F.col("mean_neg"))).otherwise(0.0))
    return r.orderBy(F.desc(F.round("ratio", 9)), "term").limit(k)


def reduce_embeddings(emb: DataFrame, k: int = 15, c: str = "embedding") -> DataFrame:
    """Unit-length embeddings on their first k principal axes; missing embeddings give zeros."""
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    some = emb.where(F.col(c).isNotNull()).withColumn("_v", array_to_vector(F.col(c).cast("array<double>")))
    unit = Normalizer(inputCol="_v", outputCol="_u", p=2.0).transform(some)
    model = PCA(k=k, inputCol="_u", outputCol="_p").fit(unit)
    out = model.transform(unit).select("entity", vector_to_array("_p").alias("p"))
    got = emb.select("entity").join(out, "entity", "left")
    zero = F.array(*[F.lit(0.0)] * k)
    return got.select("entity", *[F.element_at(F.coalesce("p", zero), i + 1).alias(f"dim_{i}") for i in range(k)])
