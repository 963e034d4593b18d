"""Order MinHash fingerprints of documents: sensitive to edit distance, not only to what a text is made of.

A text is a sequence of units (stretches of up to four characters between white space), and its k-mers are ``K``
consecutive units (fewer units: the whole sequence is one k-mer). Equal k-mers are told apart by their occurrence number.
Every numbered k-mer has a 36-bit hash; component j of the signature orders the hashes from j / ``SIZE`` of the hash
range on, around the circle, selects the ``TUPLE`` minimal k-mers in that order, puts them back into text order, and
hashes the tuple. So a component agrees where the same k-mers are minimal and stand in the same order. The share of equal
components is the likeness of two texts, 0 to 1. Components keep ``BITS`` bits.

Column functions only. A text's k-mers are an array of longs, 36 bits of hash and 28 of position, sorted twice (to number
occurrences, to find minima). That holds for texts of up to 2^27 units.

A null text is empty; a text without units has an empty fingerprint, like only to another empty one. Rows of equal doc_id
and text are one document in the order of documents, and are all returned with the same values; other rows of equal
doc_id follow each other by a hash of their text; null doc_ids come last. A lone document is its own next one. An empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

UNIT = r"[^\x20\x09-\x0D]{1,4}"
K, TUPLE, SIZE, BITS = 3, 2, 64, 16
_PLACE = 28  # bits of a position


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _powers(n: Column) -> Column:
    """Powers of two up to n, the largest first."""
    return F.transform(F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1)), lambda j: F.pow(F.lit(2.0), j).cast("int"))


def _last_below(rows: Column, powers: Column, bound: Column) -> Column:
    """Index of the last entry of a sorted array that is less than a bound, or -1; places beyond the array are null."""
    return F.aggregate(powers, F.lit(-1), lambda at, p: F.when(F.get(rows, at + p) < bound, at + p).otherwise(at))


def _packed(h: Column, place: Column) -> Column:
    """36 bits of a hash above a position."""
    return F.shiftleft(F.shiftright(h, _PLACE), _PLACE) + place


def _hash(x: Column) -> Column:
    return F.shiftright(x, _PLACE)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << _PLACE) - 1))


def kmers(text: Column, k: int = K) -> Column:
    """array<long>: a text's k-mers as packed hash and position, in text order; empty without units."""
    units = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))

    def run(h: Column) -> Column:
        last = F.greatest(F.size(h) - k, F.lit(0))
        return F.when(F.size(h) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: _packed(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i)))

    return let(units, run)


def numbered(ordered: Column) -> Column:
    """k-mers in sorted order, their hashes made those of k-mer and occurrence number (the first keeps its own)."""
    def run(s: Column) -> Column:
        def again(x: Column, i: Column, powers: Column) -> Column:
            occurrence = i - 1 - _last_below(s, powers, F.shiftleft(_hash(x), _PLACE))
            return _packed(F.xxhash64(_hash(x), occurrence), _place(x))

        # equal hashes: a pair differs in the positions' bits alone; before the first there is null
        alike = lambda x, i: _hash(x.bitwiseXOR(F.get(s, i - 1))) == 0
        return let(_powers(F.size(s)), lambda powers: F.transform(s, lambda x, i: F.when(alike(x, i), again(x, i, powers)).otherwise(x)))

    return let(ordered, lambda s: F.when(F.size(s) == 0, s).otherwise(run(s)))


def components(ordered: Column, tuple_: int = TUPLE, size: int = SIZE, bits: int = BITS) -> Column:
    """Sorted packed hashes -> array<int>, the signature; empty without k-mers."""
    # the circle of hashes starts at the least long; the order of component j starts at its part of the circle
    marks = F.array(*[F.lit((j - size // 2) << (64 - (size.bit_length() - 1))).cast("long") for j in range(size)])
    mask = F.lit((1 << 64 - _PLACE) - 1)

    def run(s: Column, starts: Column) -> Column:
        n = F.size(s)
        # position above hash, so that sorting gives text order; the circle closes at its end
        turned = F.transform(F.concat(s, F.slice(s, 1, tuple_)), lambda x: F.shiftleft(x, 64 - _PLACE) + F.shiftrightunsigned(x, _PLACE))

        def component(circle: Column, length: Column, a: Column) -> Column:
            chosen = F.slice(circle, a % n + 1, length)
            return F.xxhash64(F.transform(F.sort_array(chosen), lambda e: e.bitwiseAND(mask))).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

        return let(turned, lambda circle: let(F.least(n, F.lit(tuple_)), lambda length: F.transform(starts, lambda a: component(circle, length, a))))

    # places of the marks among the hashes, from sorting both together
    starts = lambda s: let(F.sort_array(F.concat(s, marks)), lambda m: F.transform(marks, lambda t, j: (F.array_position(m, t) - 1 - j).cast("int")))
    return let(ordered, lambda s: F.when(F.size(s) == 0, F.expr("cast(array() as array<int>)")).otherwise(let(starts(s), lambda at: run(s, at))))


def fingerprint(text: Column, k: int = K, tuple_: int = TUPLE, size: int = SIZE, bits: int = BITS) -> Column:
    """array<int>: the signature of a text, ``size`` (a power of two) components of ``bits`` bits."""
    return components(F.sort_array(numbered(F.sort_array(kmers(text, k)))), tuple_, size, bits)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components; empty signatures are like each other only."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(same / F.greatest(F.size(a), F.size(b), F.lit(1)))


def shown(a: Column, bits: int = BITS) -> Column:
    """A signature as hexadecimal digits."""
    return F.array_join(F.transform(a, lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), -(-bits // 4), "0")), "")


_KEY = ["id", "none", "h"]


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, none, h, text): no nulls; a document is known by these keys."""
    t = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64(t).alias("h"), t.alias("text"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(id, none, h, copies, n_chars, next_id, next_none, next_h): each document's next one by descending doc_id, after the
    last the first. Ranges of the keys alone are sorted; ends of ranges meet in one row for each."""
    keys = _keyed(docs).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).cast("long").alias("n_chars"))
    order = [F.col("none"), F.col("id").desc(), F.col("h")]
    laid = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    laid = stored(laid, "ordermin-order").withColumn("part", F.shiftright("at", 33))
    here = F.struct(*_KEY)
    firsts = laid.groupBy("part").agg(F.min_by(here, "at").alias("first"))
    all_ = W.partitionBy(F.lit(0)).orderBy("part")
    seams = firsts.select("part", F.coalesce(F.lead("first").over(all_), F.first("first").over(all_.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("seam"))
    inside = laid.select("*", F.lead(here).over(W.partitionBy("part").orderBy("at")).alias("_next"))
    nxt = F.coalesce("_next", "seam")
    return inside.join(seams, "part").select(*_KEY, "copies", "n_chars", *[nxt[c].alias(f"next_{c}") for c in _KEY])


def edited(docs: DataFrame) -> DataFrame:
    """(id, none, h, copies, n_chars, next_id, next_none, next_h, text, edited): the last third of each text replaced by the
    start of the next document's."""
    links = stored(neighbours(docs), "ordermin-links")
    # one row a document; both joins use the same exchange of the texts
    texts = _keyed(docs).groupBy(*_KEY).agg(F.first("text").alias("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    of = links.select(*[F.col(c).alias(f"own_{c}") for c in _KEY], third.alias("third"), *[F.col(f"next_{c}").alias(c) for c in _KEY])
    heads = texts.join(of, _KEY).select(*[F.col(f"own_{c}").alias(c) for c in _KEY], F.substring("text", F.lit(1), F.col("third")).alias("head"))
    whole = texts.join(heads, _KEY).join(links.hint("shuffle_merge"), _KEY)
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int"))
    return whole.select(*links.columns, "text", F.concat(kept, "head").alias("edited"))


def compared(docs: DataFrame) -> DataFrame:
    """(id, none, h, copies, n_chars, next_*, edited_sha256, fp, edited_fp), one row a document; stored."""
    e = edited(docs)
    cols = [c for c in e.columns if c not in ("text", "edited")]
    return stored(e.select(*cols, F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("edited_fp")), "ordermin-prints", "zstd")


def report(docs: DataFrame) -> DataFrame:
    """op13: fingerprints of each document and of its edited text, and their likeness to it and to the next document."""
    kind = docs.schema["doc_id"].dataType
    rows = compared(docs.select("doc_id", "text"))
    nxt = rows.select(*[F.col(c).alias(f"next_{c}") for c in _KEY], F.col("fp").alias("next_fp"))
    out = rows.join(nxt, [f"next_{c}" for c in _KEY])
    # repeated rows come back as often as they were
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(F.when(~F.col("none"), F.col("id")).cast(kind).alias("doc_id"), "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
