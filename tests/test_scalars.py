from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import jsonfix
from tallyforge.functions import scalars as S


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_numbers(spark):
    raw = ["1,234.50", "$1,234.50", "₹ 4,50,000.00", "-5", "9%", "INV-1001", "", "-", ".", "-.", "1.2.3", "5-3", "abc", None, "0", " 12 "]
    assert one(spark, raw, S.to_number) == [1234.5, 1234.5, 450000.0, -5.0, 9.0, -1001.0, None, None, None, None, None, None, None, None, 0.0, 12.0]
    assert one(spark, ["-3", "2 x", "1.2.3", ""], S.to_unsigned) == [3.0, 2.0, None, None]
    assert one(spark, ["a 1,000.50 b 7.891 9", "none", None], S.amounts) == [[1000.5, 7.89], [], None]
    assert one(spark, ["Total 4,50,000.00", "x, y", "n", "5."], S.last_figure) == ["450000.00", "", None, "5."]


def test_dates(spark):
    raw = ["20-Jul-2026", "20/07/2026", "2026-07-20", "20-07-2026", "July 20, 2026", "20 July 2026", "20 Jul 2026", "Jul 20, 2026", "20/07/26"]
    assert one(spark, raw, S.iso_date) == ["2026-07-20"] * 9
    assert one(spark, [*raw, "20-Jul-26", "20-07-26"], S.dmy_date) == ["20-Jul-2026"] * 11
    assert one(spark, ["soon", "", None, "1/2/70"], S.iso_date) == ["soon", None, None, "1970-02-01"]
    assert one(spark, ["nope", "", None], S.dmy_date) == ["nope", "", None]
    assert one(spark, ["20-07-2026", "20/07/26"], S.rule_date) == [datetime.date(2026, 7, 20), None]


def test_identifiers(spark):
    raw = ["INV-1001", "9876543210", "12", "20-Jul-26", "Dated", "12345", "#77", "", None]
    assert one(spark, raw, S.invoice_number_confidence) == [0.95, 0.1, 0.2, 0.05, 0.1, 0.75, 0.6, 0.0, 0.0]
    assert one(spark, ["PO-5501", "dated", "abc", "01/02/2026", "#1", ""], S.order_number_confidence) == [0.9, 0.05, 0.1, 0.05, 0.6, 0.0]


def test_texts(spark):
    assert one(spark, ["A\x00B\x01\tC"], S.clean_text) == ["A-B\tC"]
    assert one(spark, ["(Total:)", "Rate %"], S.norm_label) == ["total", "rate"]
    assert one(spark, ["[?ACME?] Ltd", "[??x??]", "plain"], S.strip_doubt) == ["ACME Ltd", "x", "plain"]
    assert one(spark, ["key sk-abcdefgh123 x", "api_key = zz", "Bearer abc", "fine"], S.scrub) == ["key [REDACTED] x", "[REDACTED]", "[REDACTED]", "fine"]
    assert one(spark, ["sk-1234567890", "short", "", None], S.mask_key) == ["sk-…890", "…", "(none)", "(none)"]
    assert one(spark, ["a/b\\c<d>.pdf", ""], S.safe_filename) == ["b_c_d_.pdf", "file.pdf"]
    assert one(spark, ["a & <b>"], S.xml_escape) == ["a &amp; &lt;b&gt;"]
    assert one(spark, ["Grand Total", "Totally", "n/a", "", "Discounted chair", "Discount 5%"], S.is_summary_row) == [True, False, True, True, False, True]
    assert one(spark, ["1,234.50", "4,50,000.00", "12", "12.5", "₹9.00"], S.is_amount) == [True, False, True, True, True]


@pytest.mark.parametrize(
    ("text", "clean", "n"),
    [
        ("mail a.b@c.de now", "mail [EMAIL] now", 1), ("IBAN DE89370400440532013000", "IBAN [IBAN]", 1), ("A/c No: 1234567", "Account: [ACCOUNT]", 1), ("card 4111 1111 1111 1111", "card [CARD]", 1),
        ("call +49 30 1234 5678", "call [PHONE]", 1), ("Total 1,234.50 on 2 June", "Total 1,234.50 on 2 June", 0),
    ],
)
def test_redaction(spark, text, clean, n):
    df = spark.createDataFrame([(text,)], "v string")
    out, count = S.redact(F.col("v"))
    assert tuple(df.select(out, count).first()) == (clean, n)


def test_json_repair(spark):
    raw = ['{"a": 1}', '```json\n{"a": [1, 2]}\n```', 'Sure: {"a": {"b": "c', '{"a": [1, 2', '{"a": 1, "b": tru', "nothing", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, raw string")
    got = [r.json for r in jsonfix.parse_json(df, "raw").orderBy("i").collect()]
    assert got[0] == '{"a": 1}' and got[1] == '{"a": [1, 2]}' and got[2] == '{"a": {"b": "c"}}' and got[3] == '{"a": [1, 2]}' and got[4] == '{"a": 1}' and got[5:] == [None, None]
