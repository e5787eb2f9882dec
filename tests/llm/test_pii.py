import hashlib
import random
import re

from pyspark.sql import functions as F

from lodestone.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def hard_texts():
    rng = random.Random(5)
    pieces = ["a@b.co", "_x@y.z", "é", "😀", " ", "-", ".", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "999.1.1.1", ".5.6.7.8", "+1 (017) 555-7713 ", "0", "12", "\n", "@", "x@-..", "+49 30", "a..b@c.d..e", "%", "007.0255.1.1", "5500-0000-0000-0004"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    return [*texts, "", None, "x" * 3000, "1" * 3000, "a." * 1500 + "@b", "a@" + "b." * 3000 + "c", "4111 1111 1111 1111, " * 700]


def test_base_spans_equal_the_patterns_read_plainly(spark):
    texts = hard_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii_spans] for r in pii.find_spans(df).collect()}
    for i, t in enumerate(texts):
        assert [s for s in rows[i] if s[0] in pii.BASE_KINDS] == base_spans(t or ""), t[:200]


def test_query_on_documents(spark, sf):
    rows = pii.op3_pii(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        expected = base_spans(texts[r.doc_id])
        assert r.base_sha256 == digest(expected)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in expected) for k in pii.BASE_KINDS)
        assert [x for x in r.spans.split(",") if x and x.split(":")[0] in pii.BASE_KINDS] == [f"{k}:{s}:{e}" for k, s, e in expected]


def test_method_confirms_and_scores(spark):
    texts = ["iban DE89370400440532013000 ok", "DE89370400440532013001", "ssn 078-05-1120", "078-05-1120", "pay by card 4111111111111111", "4111111111111111"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = [r.pii_spans for r in pii.find_spans(df).orderBy("doc_id").collect()]
    assert [[s.kind for s in r] for r in rows] == [["iban"], [], ["ssn"], [], ["card"], ["card"]]
    assert rows[4][0].score > rows[5][0].score


def test_redaction_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x a@b.co y 4111111111111111", "k"), (2, None, "k"), (3, "plain", None), (4, "+4111111111111111 z", "s")], "doc_id long, text string, kind string")
    rows = {r.doc_id: (r.text, r.kind) for r in pii.redact(pii.find_spans(df)).collect()}
    assert rows == {1: ("x <EMAIL> y <CARD>", "k"), 2: (None, "k"), 3: ("plain", None), 4: ("+<CARD> z", "s")}
    assert pii.find_spans(df.limit(0)).where(F.size("pii_spans") >= 0).count() == 0


def test_very_long_texts_stay_linear(spark):
    texts = ["x" * 400_000 + "@", "1" * 400_000, "a." * 200_000 + "@b", "a@" + "b." * 100_000 + "c", "+" * 100_000, "1." * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [len(r.pii_spans) for r in pii.find_spans(df).orderBy("doc_id").collect()] == [0, 0, 0, 1, 0, 50_000 // 2]


def test_account_numbers_end_where_their_country_says(spark):
    cases = {
        "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": ["DE89 3704 0044 0532 0130 00"],
        "DE89370400440532013000 2024": ["DE89370400440532013000"],
        "GB82WEST12345698765432 I paid": ["GB82WEST12345698765432"],
        "TO AB12 DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 NOW": ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"],
        "DE89370400440532013000X": [],
        "é" * 300 + " NO9386011117947, " + "x" * 300: ["NO9386011117947"],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    rows = pii.find_spans(df).orderBy("doc_id").collect()
    assert [[r.text[s.start : s.end] for s in r.pii_spans if s.kind == "iban"] for r in rows] == list(cases.values())
    assert pii.redact(pii.find_spans(df)).where("doc_id = 1").first().text == "<IBAN> 2024"


def test_context_reaches_over_other_hits(spark):
    texts = ["SSN: 123-45-6789, 234-56-7890", "x" * 250 + " SSN: 123-45-6789, 000-11-2222, 234-56-7890 " + "y" * 600, "SSN" + " " * 60 + "123-45-6789", "234-56-7890 " + "z" * 20 + " ssn"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.find_spans(df).orderBy("doc_id").collect()
    assert [[(r.text[s.start : s.end], s.score) for s in r.pii_spans] for r in rows] == [[("123-45-6789", 0.85), ("234-56-7890", 0.85)]] * 2 + [[], [("234-56-7890", 0.85)]]
