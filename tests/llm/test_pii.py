"""Personal data: base spans against Python's patterns, checksums, context and masking."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from chartline.llm import pii
from chartline.llm.common import tables


def luhn(s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def n(s):
    return len(re.sub("[^0-9]", "", s))


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= n(m) <= 19 and luhn(m)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= n(m) <= 15),
}


def brute(text):
    spans = [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]
    return [sum(s[0] == k for s in spans) for k in BASE], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), [f"{k}:{a}:{b}" for k, a, b in spans]


def agree(df):
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    rows = pii.report(df).collect()
    for r in rows:
        counts, digest, spans = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id]
        assert r.base_sha256 == digest, texts[r.doc_id]
        assert set(spans) <= set(r.spans.split(","))
    return rows


def test_tables(spark):
    assert sum(r.n_email + r.n_phone for r in agree(tables(spark, "/root/testdata/sf0.01", "documents"))) > 10


def test_random_strings(make_docs):
    rnd = random.Random(4)
    bits = ["a", "b.c", "@", "@x.y", ".", "1", "23", "255", "256", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+1", "(", ")", "😀", "é", "_", "%", "+", "1.2.3.4", "\n", "5500005555555559", "00"]
    agree(make_docs(*((i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))) for i in range(1500))))


CASES = [
    ("a@b.c_d@e.f g@h", ["email:0:5", "email:5:11"]), ("1.2.3.4.5.6.7.8", ["ip:0:7", "ip:8:15"]), ("999.1.1.1 0255.0.0.1", ["ip:10:20"]),
    ("é😀 x@y.z", ["email:3:8"]), ("4111 1111-1111 1111", ["card:0:19"]), ("4111111111111112", []), ("+1 (269) 555-3296", ["phone:0:17"]),
    ("+1 (269) 555-3296 4111111111111111", ["card:18:34", "phone:0:17"]), ("IBAN DE89370400440532013000 ok", ["iban:5:27"]), ("GB82 WEST 1234 5698 7654 32", ["iban:0:27"]),
    ("DE89370400440532013001", []), ("my ssn is 123-45-6789.", ["id:10:21"]), ("code 123-45-6789.", []), ("call 269-555-3296 now", ["phone:5:17"]), ("item 269-555-3296 now", []),
]


@pytest.fixture(scope="module")
def cases(make_docs):
    d = make_docs(*((i, t) for i, (t, _) in enumerate(CASES)))
    return {r.doc_id: r.spans for r in pii.report(d).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(cases, i):
    assert cases[i] == ",".join(CASES[i][1])


def test_context_raises_the_score(make_docs):
    rows = pii.with_spans(make_docs((1, "4111111111111111"), (2, "credit card 4111111111111111"))).orderBy("doc_id").collect()
    assert rows[0].spans[0].score < rows[1].spans[0].score <= 1


def test_long_runs_do_not_backtrack(make_docs):
    rows = pii.report(make_docs((1, "a" * 300_000), (2, "1" * 300_000), (3, "1 " * 100_000), (4, "+1" + "(" * 100_000), (5, "x@y.z " * 2_000))).collect()
    assert {r.doc_id: r.n_email for r in rows} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 2_000}
    agree(make_docs((5, "x@y.z " * 2_000), (6, "a" * 2_000 + "@b.c")))


def test_masking(make_docs, odd_docs, no_docs, clashing):
    got = {r.doc_id: r.text for r in pii.redact(make_docs((1, "mail x@y.z, call +1 (269) 555-3296!"), (2, None), (3, "none"), (4, "+12345678@x.yz 😀 1.2.3.4"))).collect()}
    assert got == {1: "mail [EMAIL], call [PHONE]!", 2: None, 3: "none", 4: "[EMAIL] 😀 [IP]"}
    assert pii.redact(odd_docs).columns == odd_docs.columns and pii.redact(odd_docs).count() == odd_docs.count()
    assert pii.redact(no_docs).count() == 0 and pii.report(no_docs).count() == 0
    assert pii.redact(clashing).where("spans = 'own'").count() == 3


def test_no_python_in_the_plan(spark):
    plan = pii.report(tables(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_checksums(spark):
    d = spark.createDataFrame([("79927398713", "GB82WEST12345698765432"), ("79927398710", "GB82WEST12345698765431"), ("", "")], "a string, b string")
    assert [tuple(r) for r in d.select(F.coalesce(pii.luhn(F.col("a")), F.lit(False)), pii.mod97(F.col("b"))).collect()][:2] == [(True, True), (False, False)]


def test_scan_and_cut(spark):
    for n in (0, 1, 63, 64, 65, 5000):
        xs = [(i * 7919) % 31 for i in range(n)]
        d = spark.createDataFrame([(xs,)], "xs array<int>")
        add, top = d.select(pii.scan(F.col("xs"), lambda a, b: a + b), pii.scan(F.col("xs"), F.greatest)).first()
        assert add == [sum(xs[:i]) for i in range(n)] and top == [max([0, *xs[:i]]) for i in range(n)]
    text = "".join(chr(97 + i % 26) if i % 7 else "😀\n"[i % 2] for i in range(2000))
    d = spark.createDataFrame([(text, a, b) for a, b in ((0, 0), (0, 2000), (511, 513), (512, 1024), (1999, 2000), (100, 1700), (2000, 2000), (1990, 2100))], "t string, a int, b int")
    for r in d.select("a", "b", pii.cut(pii.chunks(F.col("t")), F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == text[r.a:r.b]


def test_cost_does_not_grow_with_spans_times_length(make_docs):
    """A hundred thousand spans in one text."""
    text = " ".join(f"a{i}@b.co" if i % 2 else f"call 555 123-{i % 9000 + 1000} 10.0.{i % 256}.{i % 200}" for i in range(80_000))
    began = time.monotonic()
    r = pii.report(make_docs((1, text))).first()
    assert r.n_email == 40_000 and r.n_ip == 40_000 and r.spans.count(",") + 1 >= 100_000
    masked = pii.redact(make_docs((1, text))).first().text
    assert masked.count("[EMAIL]") == 40_000 and "@" not in masked
    assert time.monotonic() - began < 120
