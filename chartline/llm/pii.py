"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Column functions only. A pattern's matches are found by Java's matcher twice: once as matches, once as the
pieces between them; lengths of both give every match's place in code points. The patterns are anchored at
the start of a run (or at the end of the match before), so that they need no backtracking over long runs.

A text is cut into chunks once and places in it are sums over blocks, so the cost grows with the text and its spans, not with
their product.

Spans: array of struct(kind, start, end, score, base), ordered by kind and start; ``end`` is exclusive.
Base spans are those the plain patterns and checksums give. The method adds others, where they overlap no
span before them: account numbers (mod-97), cards and phones inside longer runs of digits, and, where a
word nearby says so, national ids and phone numbers without a country code.

Null or empty texts have no spans. Rows are mapped one by one: repeated rows give repeated results, an empty
table an empty one, and other columns of the input are kept as they are unless a result column has their name
(the result's stays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "id")
# one-of-a-kind patterns; the first four are equal to the plain ones of the contract, without their backtracking
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD_IN_RUN = r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"
PHONE_IN_RUN = r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])"
LOCAL_PHONE = r"(?<![0-9+.-])(?<!\+[0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
NATIONAL_ID = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
CONTEXT = {  # words that speak for a kind, looked for in the 48 characters before a span and the 24 after it
    "email": r"mail|contact|write to", "ip": r"\bip\b|address|host|server", "card": r"card|visa|master|credit|debit|payment",
    "phone": r"phone|call|tel\b|tel[.:]|mobile|fax|cell", "iban": r"iban|account|bank|konto|transfer", "id": r"ssn|social security|national id|tax id",
}
BEFORE, AFTER, ACCEPT, BONUS = 48, 24, 0.5, 0.3
BLOCK, CHUNK = 64, 512  # entries scanned one by one, code points of a piece of text


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def scan(xs: Column, op, depth: int = 3) -> Column:
    """array<int>: for each entry ``op`` of all before it, 0 for the first; op is associative and 0 leaves entries as they are.
    In blocks, their totals scanned alike, so that the arrays built entry by entry are short."""
    def fold(a: Column) -> Column:
        empty = F.struct(F.lit(0).alias("t"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(a, empty, lambda s, x: F.struct(op(s["t"], x).alias("t"), F.concat(s["out"], F.array(s["t"])).alias("out")))

    if depth == 1:
        return fold(xs)["out"]

    def blocks(a: Column) -> Column:
        count = F.ceil(F.size(a) / BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda b: fold(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
        joined = let(parts, lambda p: F.flatten(F.zip_with(p, scan(F.transform(p, lambda q: q["t"]), op, depth - 1), lambda q, o: F.transform(q["out"], lambda v: op(o, v)))))
        return F.when(F.size(a) == 0, F.expr("cast(array() as array<int>)")).otherwise(joined)

    return let(xs, blocks)


def chunks(text: Column) -> Column:
    """A text in pieces of CHUNK code points, so that a place in it is reached without reading all before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end (code points, end exclusive), from its chunks."""
    i, j = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    head = F.substring(piece(i), start % CHUNK + 1, F.when(i == j, end - start).otherwise(F.lit(CHUNK)))
    return F.when(i == j, head).otherwise(F.concat(head, F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), F.substring(piece(j), F.lit(1), end % CHUNK)))


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of a pattern's matches, leftmost and not overlapping."""
    def build(match: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(match))
        pairs = F.zip_with(match, between, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))
        return let(pairs, lambda p: F.zip_with(p, scan(F.transform(p, lambda x: x["g"] + x["n"]), lambda a, b: a + b),
                                               lambda x, at: F.struct((at + x["g"]).alias("start"), (at + x["g"] + x["n"]).alias("end"), x["m"].alias("match"))))

    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(build(m)))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """True where a string's digits pass Luhn's check."""
    d = digits(s)
    n = F.length(d)

    def part(i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return x - F.when(x > 9, 9).otherwise(0)

    return (n > 0) & (F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x) % 10 == 0)


def mod97(s: Column) -> Column:
    """True where an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    t = F.regexp_replace(s, " ", "")
    t = F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))
    value = lambda i: F.conv(F.substring(t, i, F.lit(1)), 36, 10).cast("int")
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(t)), value), F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _spans(text: Column, kind: str, pattern: str, valid, score: float, base: bool) -> Column:
    order = KINDS.index(kind)

    def build(x: Column, pieces: Column) -> Column:
        # words nearby are read only for what passed the checks
        near = F.lower(F.concat_ws(" ", cut(pieces, F.greatest(x["start"] - BEFORE, F.lit(0)), x["start"]), cut(pieces, x["end"], x["end"] + AFTER)))
        s = F.lit(score) + F.when(near.rlike(CONTEXT[kind]), BONUS).otherwise(0.0)
        return F.struct(F.lit(order).alias("k"), x["start"].alias("start"), x["end"].alias("end"), F.least(s, F.lit(1.0)).alias("score"), F.lit(base).alias("base"))

    good = F.filter(_found(text, pattern), lambda x: valid(x["match"]))
    out = let(good, lambda g: F.when(F.size(g) == 0, _none()).otherwise(let(chunks(text), lambda c: F.transform(g, lambda x: build(x, c)))))
    return out if base else F.filter(out, lambda x: x["score"] >= ACCEPT)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<k:int,start:int,end:int,score:double,base:boolean>>)")


def find(text: Column) -> list[tuple[str, Column]]:
    """(name, column) in the order in which they are to be added: base spans by kind, then the method's."""
    t = F.coalesce(text, F.lit(""))
    n = lambda m: F.length(digits(m))
    has_digit, has_at, has_plus = t.rlike("[0-9]"), F.contains(t, F.lit("@")), F.contains(t, F.lit("+"))
    when = lambda c, x: F.when(c, x).otherwise(_none())
    return [
        ("email", when(has_at, _spans(t, "email", EMAIL, lambda m: F.lit(True), 0.9, True))),
        ("ip", when(has_digit, _spans(t, "ip", IP, lambda m: m.rlike(OCTETS), 0.6, True))),
        ("card", when(has_digit, _spans(t, "card", CARD, luhn, 0.7, True))),
        ("phone", when(has_plus, _spans(t, "phone", PHONE, lambda m: n(m).between(8, 15), 0.6, True))),
        ("iban", when(has_digit, _spans(t, "iban", IBAN, mod97, 0.7, False))),
        ("card_in_run", when(has_digit, _spans(t, "card", CARD_IN_RUN, luhn, 0.6, False))),
        ("phone_in_run", when(has_plus, _spans(t, "phone", PHONE_IN_RUN, lambda m: n(m).between(8, 15), 0.55, False))),
        ("local_phone", when(has_digit, _spans(t, "phone", LOCAL_PHONE, lambda m: F.lit(True), 0.3, False))),
        ("national_id", when(has_digit, _spans(t, "id", NATIONAL_ID, lambda m: F.lit(True), 0.3, False))),
    ]


def _free(spans: Column, taken: Column) -> Column:
    """Those of the spans that overlap none that is taken: among the taken ones that start before a span's end, found by
    halving, the furthest end decides."""
    def check(t: Column) -> Column:
        powers = F.transform(F.sequence(F.floor(F.log2(F.size(t) + F.lit(1))).cast("int"), F.lit(0), F.lit(-1)), lambda j: F.pow(F.lit(2.0), j).cast("int"))
        # furthest end of the first i taken spans, at i
        ends = F.concat(scan(F.transform(t, lambda x: x["end"]), F.greatest), F.array(F.array_max(F.transform(t, lambda x: x["end"]))))

        def far(x: Column, e: Column, p: Column) -> Column:
            before = F.aggregate(p, F.lit(-1), lambda at, step: F.when(F.get(t, at + step)["start"] < x["end"], at + step).otherwise(at))
            return F.get(e, before + 1)

        return let(ends, lambda e: let(powers, lambda p: F.filter(spans, lambda x: far(x, e, p) <= x["start"])))

    ordered = F.transform(taken, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when((F.size(spans) == 0) | (F.size(taken) == 0), spans).otherwise(let(F.array_sort(ordered), check))


def with_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds ``out``, all spans of the text: array<struct<kind,start,end,score,base>> by kind and start."""
    names, d = [], df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("text"))
    for name, c in find(F.col("text")):
        d = d.withColumn(name, c)
        names.append(name)
    d = d.withColumn("found", F.concat(*names[:4]))
    for name in names[4:]:
        d = d.withColumn("found", F.concat("found", _free(F.col(name), F.col("found"))))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(F.array_sort("found"), lambda x: F.struct(kinds[x["k"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), x["base"].alias("base")))
    return d.select(*[F.col("row")[c].alias(c) for c in df.columns if c != out], named.alias(out))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with each span, or each stretch of overlapping ones, replaced by the name of its first, longest one."""
    def masked(x: Column) -> Column:
        """x: spans in order. A span that starts after all before it have ended begins a stretch."""
        reach = scan(F.transform(x, lambda s: s["end"]), F.greatest)
        heads = let(reach, lambda r: F.filter(F.transform(x, lambda s, i: F.struct(s["start"].alias("start"), F.get(r, i).alias("after"), s["kind"].alias("kind"))), lambda s: s["start"] >= s["after"]))
        last = F.array_max(F.transform(x, lambda s: s["end"]))
        out = let(chunks(text), lambda c: F.concat(F.array_join(F.transform(heads, lambda s: F.concat(cut(c, s["after"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))), ""), cut(c, last, F.length(text))))
        return out

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("_longest"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, let(ordered, masked)).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, personal data in the text masked; a null text stays null."""
    d = with_spans(docs.select(F.struct(*docs.columns).alias("whole"), F.col(text).alias("text")))
    return d.select(*[mask(F.col("text"), F.col("spans")).alias(c) if c == text else F.col("whole")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """op9: counts and digest of the base spans, and all spans as a string, per document."""
    d = with_spans(docs.select("doc_id", "text"), "text", "found")
    base = F.filter("found", lambda x: x["base"])
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
                    F.round(F.array_max(F.transform("found", lambda x: x["score"])), 3).alias("top_score"))
