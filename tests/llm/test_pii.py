import re

from tests.llm.oracle import same
from tributary.llm import pii

CASES = [
    None,
    "",
    "write to jo.e+x@mail.example.org, a@b, a@b.c_d@e.f.g or é@x.yy 😀 z@q.w",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3 10.0.0.1.",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4111111111111111 7 4111 1111 1111 1111",
    "tel +49 (30) 123-456-78 +1 2 +123456789012345678 + 12345678901 +1.2.3.4.5.6.7.8.9.0)",
    "iban DE89370400440532013000 and GB82 WEST 1234 5698 7654 32, not DE89370400440532013001",
    "ssn 123-45-6789 but 987-65-4321" + " x" * 40 + " 123-45-6780",
    "4" * 100_000 + " a" * 50_000 + "@" + "b.c" * 30_000 + "\n" + "+1" + " " * 50_000 + "2",
    "mail a@b.co+4930123456789 4111111111111111@x.yz",
]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute(text):
    text = text or ""
    out = []
    checks = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    for n, (pattern, ok) in enumerate(checks):
        out += [(m.start(), n, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out)


def frame(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)] + [(3, CASES[3], "x"), (None, CASES[2], None)], "doc_id long, text string, spans string")


def test_base_spans(spark):
    got = pii.find_pii(frame(spark)).collect()
    assert len(got) == len(CASES) + 2
    for r in got:
        if r.id != 8:  # of the very long text only the places are compared, plain matching takes too long
            assert [(x.start, x.kind, x.end) for x in r.spans if x.kind < pii.BASE] == brute(CASES[2] if r.id is None else CASES[r.id]), r.id
    long_ = next(r for r in got if r.id == 8)
    assert ["email"] == [pii.NAMES[x.kind] for x in long_.spans]


def test_checksums_and_context(spark):
    got = {r.id: [(pii.NAMES[x.kind], CASES[r.id][x.start : x.end], x.score) for x in r.spans] for r in pii.find_pii(frame(spark)).collect() if r.id is not None}
    assert [x[1] for x in got[6] if x[0] == "iban"] == ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]
    assert [x[1] for x in got[7]] == ["123-45-6789", "987-65-4321"]  # the third has no word nearby
    assert got[4][0][2] == 1.0


def test_redaction(spark):
    df = frame(spark)
    got = pii.redact(df)
    assert got.columns == df.columns and got.count() == df.count()
    text = {r.doc_id: r.text for r in got.collect() if r.doc_id is not None}
    assert text[0] is None and text[1] == ""
    assert text[2] == "write to [EMAIL], a@b, [EMAIL][EMAIL] or é@x.yy 😀 [EMAIL]"
    assert text[9].startswith("mail [EMAIL]") and "4111" not in text[9]
    assert pii.find_pii(got).where("exists(spans, x -> x.kind = 2)").count() == 0


def test_sf_against_brute_force_and_sql(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    for r in pii.find_pii(df).collect():
        assert [(x.start, x.kind, x.end) for x in r.spans if x.kind < pii.BASE] == brute(text[r.id])
    same(spark, pii.op7_pii, pii.SQL)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(df).collect() == [] and pii.redact(df).collect() == []


def told(spark, *texts):
    out = {r.id: r.spans for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [[(pii.NAMES[x.kind], t[x.start : x.end], x.score) for x in out[i]] for i, t in enumerate(texts)]


def test_context_is_whole_words_on_both_sides(spark):
    card = "4111111111111111"
    got = told(
        spark,
        f"the hotel discarded {card}",
        f"card {card}",
        f"{card} is my credit line",
        f"cards: {card}",
        f"{card} {'x' * 60} card",
        "the hotel is +49 30 1234567 89",
        "+49 30 1234567 89 (mobile)",
        f"a description of 10.1.2.3 and {card}",
        f"card {card}, {card}",  # past one other match
    )
    assert [[s for _, _, s in x] for x in got] == [[0.7], [1.0], [1.0], [1.0], [0.7], [0.6], [0.9], [0.5, 0.7], [1.0, 1.0]]


def test_an_iban_before_capital_words(spark):
    got = told(spark, "BE68 5390 0754 7034 BIC KREDBEBB", "DE89370400440532013000EUR", "XX68539007547034", "NO9386011117947 OSLO", "BE68 5390 0754 7035 BIC")
    assert [[(k, t) for k, t, _ in x if k == "iban"] for x in got] == [[("iban", "BE68 5390 0754 7034")], [("iban", "DE89370400440532013000")], [], [("iban", "NO9386011117947")], []]
