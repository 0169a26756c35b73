import datetime
import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import privacy, validators
from quillspark.operators import fuzzy

TODAY = datetime.date(2025, 6, 30)
FREQUENCIES = ["Monthly", "Quarterly", "Half-Yearly", "Yearly", "As & when presented"]

CASES = [
    ("pan", "ABCPK1234Q", True, "ABCPK1234Q", False),
    ("pan", "abcpk 1234 q", True, "ABCPK1234Q", False),
    ("pan", "ABCPKI234Q", True, "ABCPK1234Q", True),
    ("pan", "PQRDX1234Z", False, "PQRDX1234Z", False),
    ("pan", "ABCPK123Q", False, None, None),
    ("ifsc", "HDFC0001234", True, "HDFC0001234", False),
    ("ifsc", "HDFCO001234", True, "HDFC0001234", True),
    ("ifsc", "HDFC1001234", False, "HDFC1001234", False),
    ("account", "0012345678", True, "0012345678", False),
    ("account", "12345678", False, "12345678", False),
    ("account", "1234x56789", False, None, None),
    ("digits", "1 2-3", True, "123", False),
    ("amount", "Rs. 75,000/-", True, "75000", False),
    ("amount", "₹ 1,234.50", True, "1234.50", False),
    ("amount", "12.345", False, "12.345", False),
    ("date", "8/2/2030", True, "2030-02-08", False),
    ("date", "31/02/2020", False, None, False),
    ("date", "12 April 1990", True, "1990-04-12", False),
    ("date", "05 Jul 2001", True, "2001-07-05", False),
    ("date", "O1/O2/199O", True, "1990-02-01", True),
    ("date", "01021990", True, "1990-02-01", False),
    ("date", "01/01/1899", False, "1899-01-01", False),
    ("date_past", "01/01/30", True, "1930-01-01", False),
    ("date_past", "01/01/2030", False, "2030-01-01", False),
    ("date_past", "1 - 1 - 69", True, "1969-01-01", False),
    ("date_form", "01/01/1999", False, "1999-01-01", False),
    ("date_form", "30/06/2026", True, "2026-06-30", False),
    ("date_form", "01/07/2026", False, "2026-07-01", False),
    ("dl", "MH14 2011 0062821", True, "MH14 2011 0062821", False),
    ("dl", "XX14 2011 0062821", False, "XX14 2011 0062821", False),
    ("dl", "MH14 1911 0062821", False, "MH14 1911 0062821", False),
    ("passport", "K1234567", True, "K1234567", False),
    ("passport", "KI234567", True, "K1234567", True),
    ("passport", "K123456", False, "K123456", False),
    ("name", "  Ann   B. ", True, "Ann B", False),
    ("name", "R2D2", False, None, False),
    ("name", "...", False, None, False),
    ("place", "New-Town, N.", True, "New-Town, N", False),
    ("place", "Town 5", False, None, False),
    ("text", " a  b., ", None, "a b", False),
    ("address", "1 Road\nTown 411001", True, "1 Road, Town 411001", False),
    ("address", "1 Road Town", False, None, False),
    ("checkbox", "Yearly", True, "Yearly", False),
    ("checkbox", "half-yearly", True, "Half-Yearly", False),
    ("checkbox", "Monthly; Yearly", False, "Monthly; Yearly", False),
    ("checkbox", "never", False, "never", False),
    ("unheard of", " x ", None, "x", False),
    ("mrz2", "L898902C36UTO7408122F1204159ZE184226B<<<<<10", True, "L898902C36UTO7408122F1204159ZE184226B<<<<<10", False),
    ("mrz2", "L898902C46UTO7408122F1204159ZE184226B<<<<<10", False, None, False),
    ("mrz2", "short", False, "SHORT", False),
]


def test_validators(spark):
    rows = [(i, c[0], c[1]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, validator string, value string")
    v = validators.validate(F.col("validator"), F.col("value"), F.array(*map(F.lit, FREQUENCIES)), F.lit(TODAY))
    for r in df.select("i", v.alias("v")).collect():
        name, value, passed, normalized, coerced = CASES[r.i]
        assert r.v.passed == passed, (name, value, r.v)
        assert normalized is None or r.v.normalized == normalized, (name, value, r.v)
        assert coerced is None or r.v.coerced == coerced, (name, value, r.v)


def verhoeff(digits):
    c = 0
    for i, ch in enumerate(reversed(digits)):
        c = validators.VERHOEFF_D[c][validators.VERHOEFF_P[i % 8][int(ch)]]
    return c == 0


def test_verhoeff_and_a_leap_day(spark):
    codes = [str(234567890000 + 37 * i) for i in range(200)]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select("c", validators.aadhaar(F.col("c")).alias("v")).collect()
    assert [r.v.passed for r in got] == [verhoeff(r.c) for r in got] and any(r.v.passed for r in got)
    leap = spark.range(1).select(validators.date_value(F.lit("01/03/2028"), "date_form", F.lit(datetime.date(2028, 2, 29))).alias("v")).first().v
    assert leap.passed


def test_amount_words_and_zone_dates(spark):
    words = {"Fifty thousand only": 50_000, "one lakh and twenty": 100_020, "two crore three lakhs four hundred five": 20_300_405, "hundred": 100, "": None, "only": None, "ten bananas": None}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", validators.words_to_number(F.col("w")).alias("n")).collect()
    assert {r.w: r.n for r in got} == words
    row = spark.range(1).select(validators.mrz_date(F.lit("300101"), True, F.lit(TODAY)).alias("a"), validators.mrz_date(F.lit("300101"), False, F.lit(TODAY)).alias("b"), validators.mrz_date(F.lit("991332"), True, F.lit(TODAY)).alias("c"), validators.mrz_date(F.lit("990101"), False, F.lit(TODAY)).alias("d")).first()
    assert tuple(row) == ("1930-01-01", "2030-01-01", None, "2099-01-01")


def mask(text, visible=4):
    at = [i for i, c in enumerate(text) if c.isalnum()]
    if len(at) <= visible:
        return "•" * len(text)
    return "".join(c if not c.isalnum() or i in at[-visible:] else "•" for i, c in enumerate(text))


def test_masks(spark):
    texts = ["1234 5678 9012", "AB-1", "", "ÀB12-34 x5", "K1234567", "a b c d e"]
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", privacy.mask_value(F.col("t")).alias("m"), privacy.mask_field(F.lit("pan_number"), F.col("t")).alias("f"), privacy.mask_field(F.lit("place"), F.col("t")).alias("p")).collect()
    for r in got:
        assert r.m == r.f == ("" if r.t is None else mask(r.t)) and r.p == (r.t or "")
    text = "card 1234 5678 9012 and acct40012345678, word, 12/03/1985 abcdefg 75,000 X1234Y9"
    out = spark.range(1).select(privacy.mask_numbers_in_text(F.lit(text)).alias("t")).first().t
    assert out == "card •••• •••• 9012 and •••••••••••5678, word, 12/03/1985 abcdefg 75,000 •••34Y9".replace("•••••••••••5678", mask("acct40012345678"))


def test_scrubbing(spark):
    text = "call +91 98765 43210 or a.b@c.org about ABCPK1234Q, HDFC0001234, 2345 6789 0123, 400123456789 today"
    row = spark.range(1).select(privacy.scrub_pii(F.lit(text)).alias("s"), privacy.contains_pii(F.lit(text)).alias("c")).first()
    assert row.c and "[redacted]" in row.s and not any(x in row.s for x in ("98765", "@", "ABCPK", "HDFC", "6789"))
    assert spark.range(1).select(~privacy.contains_pii(privacy.scrub_pii(F.lit(text)))).first()[0]
    assert spark.range(1).select(privacy.duration_seconds(F.lit("37s"))).first()[0] == 37
    assert "<redacted>" in spark.range(1).select(privacy.redact_secrets(F.lit("bad sk-abcdefghijk12\nmore"))).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.text("ABC1", min_size=1, max_size=6), st.text("ABC1", min_size=0, max_size=14))
def test_window_ratio(key, text):
    n = len(key)
    want = 1.0 if key in text else round(max(difflib.SequenceMatcher(None, text[i : i + n], key).ratio() for i in range(max(1, len(text) - n + 1))), 3)
    assert fuzzy.best_window_ratio(key, text) == want


def test_support_and_labels(spark):
    df = spark.createDataFrame([("AB12", "x a.b 12 y"), ("AB12", "ab13"), ("AB12", None), ("AB12", " . ")], "k string, t string")
    assert [r.s for r in df.select(fuzzy.ocr_support(F.col("k"), F.col("t")).alias("s")).collect()] == [1.0, 0.75, None, None]
    words = [("f", 1, w, 10 + 50 * i, 20 + 30 * line, 40, 12, 1, 1, line) for line, ws in enumerate([["Some", "title"], ["Date", "of", "Blrth:", "01"]]) for i, w in enumerate(ws)]
    found = fuzzy.find_labels(spark.createDataFrame(words, "sha1 string, page_no int, text string, left int, top int, width int, height int, block int, par int, line int"), ["Date of Birth", "Address"]).collect()
    assert [(r.label, r.x0, r.y0, r.x1, r.y1) for r in found] == [("Date of Birth", 10, 50, 150, 62)]


def test_regions(spark):
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    lit = lambda b: F.lit(None).cast(box) if b is None else F.struct(*[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), b, strict=True)])
    numbers = lambda b: F.array(*[F.lit(float(x)) for x in b])
    pick = lambda b, a, l: spark.range(1).select(fuzzy.choose_region(numbers(b) if b else F.lit(None).cast("array<double>"), lit(a), lit(l), F.lit(1000), F.lit(1000), F.lit("name")).alias("r")).first().r
    assert pick([100, 100, 300, 130], None, (40, 100, 90, 130)).proximity == 1.0
    assert pick([100, 100, 300, 130], None, (40, 900, 90, 930)).proximity == 0.5
    assert pick(None, (10, 10, 50, 50), (1, 1, 2, 2)).proximity == 0.8 and pick(None, None, None).proximity == 0.0
    assert "y0, x0" in pick([100, 400, 120, 900], None, None).described and pick([5, 5, 5, 9], None, None).region is None
    text = spark.range(1).select(fuzzy.value_after_label(F.lit("DL No: MH14\nother"), F.array(F.lit("DL No")), F.lit("dl")).alias("v"), fuzzy.value_after_label(F.lit("P<INDX<<<\nK12 34<<<<"), F.array(F.lit("x")), F.lit("mrz2")).alias("z")).first()
    assert text.v == "MH14" and text.z == "K1234<<<<"


@pytest.mark.parametrize(("value", "want"), [("-5", "-005"), ("7", "0007"), ("12345", "12345"), ("+12", "+012")])
def test_zfill(spark, value, want):
    from quillspark.operators import tabular

    assert spark.range(1).select(tabular.zfill(F.lit(value), 4)).first()[0] == want
