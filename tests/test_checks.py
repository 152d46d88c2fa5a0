from __future__ import annotations

import datetime
import re

import pytest

from tallyforge.operators import checks

INV = "doc_id string, vendor string, invoice_number string, invoice_date string, po_number string, subtotal double, tax double, total double, line_sum double, n_lines int"
FULL = ("d", "ACME", "INV-1001", "2026-06-01", "PO-5501", 100.0, 18.0, 118.0, 100.0, 2)


def with_(**changes):
    names = [c.split()[0] for c in INV.split(", ")]
    return tuple(changes.get(n, v) for n, v in zip(names, FULL))


@pytest.mark.parametrize(
    ("changes", "notes", "confidence"),
    [
        ({}, [], 1.0), ({"invoice_number": None}, ["Missing invoice number"], 0.85), ({"invoice_date": ""}, ["Missing invoice date"], 0.85), ({"total": None, "tax": None}, ["Missing total"], 0.85),
        ({"line_sum": 90.0}, ["Line items sum to 90.00, expected 100.00 / 118.00"], 0.75), ({"line_sum": 118.0}, [], 1.0), ({"n_lines": 0, "line_sum": None}, [], 1.0),
        ({"total": 120.0}, ["Subtotal 100.00 + tax 18.00 != total 120.00"], 0.75), ({"tax": None}, [], 1.0),
        ({"invoice_number": None, "invoice_date": None, "total": None, "subtotal": None, "tax": None, "n_lines": 0, "line_sum": None}, ["Missing invoice number", "Missing invoice date", "Missing total"], 0.55),
        ({"total": 118.02}, [], 1.0), ({"total": 118.03}, ["Subtotal 100.00 + tax 18.00 != total 118.03"], 0.75),
    ],
)
def test_validation(spark, changes, notes, confidence):
    r = checks.validate(spark.createDataFrame([with_(**changes)], INV)).first()
    assert r.validation_notes == notes and r.validation_ok == (not notes) and r.confidence == confidence
    if changes == {"tax": None}:
        assert float(r.tax) == 18.0


@pytest.mark.parametrize(
    ("lines", "status", "total"),
    [
        (["Sub Total 100.00", "Grand Total: 118.00"], "OK", 118.0), (["Subtotal 100.00", "TOTAL 118.80"], "OK", 118.8), (["Sub Total 100.00", "Invoice Total 500.00"], "REVIEW", 500.0), (["no figures"], "REVIEW", None),
        (["Grand total", "grand total 1.00 118.00", "taxable value 100.00"], "OK", 118.0),
    ],
)
def test_reconciliation(spark, lines, status, total):
    printed = checks.printed_figures(spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc_id string, line_no int, text string"))
    r = checks.reconcile(checks.validate(spark.createDataFrame([FULL], INV)), printed).first()
    assert r.status == status and (r.printed_total is None if total is None else float(r.printed_total) == total)


RULES = INV + ", extra map<string,string>, lines array<map<string,string>>"
DAY = datetime.date(2026, 7, 1)


def failures(spark, profile, changes=None, extra=None, lines=None):
    row = (*with_(**(changes or {})), extra or {}, [{"description": "Widget", "quantity": "1", "rate": "5"}] if lines is None else lines)
    return checks.apply_rules(spark.createDataFrame([row], RULES), profile, DAY).first().rule_failures


def test_rules(spark):
    assert failures(spark, {}) == []
    assert failures(spark, {}, {"invoice_number": None, "invoice_date": None, "total": None}) == ["missing required field 'invoice_date'", "missing an identifier - need one of: invoice_number / bill_number / order_number / receipt_number", "no invoice total found"]
    assert failures(spark, {}, {"invoice_number": None}, {"Order_Number": "7"}) == []
    assert failures(spark, {}, lines=[]) == ["line items are missing 'description'", "no line items were extracted"]
    assert failures(spark, {"max_total": 100, "min_total": 500}) == ["total 118.00 exceeds the approval threshold 100.00", "total 118.00 is below the minimum 500.00"]
    assert failures(spark, {"date_max_age_days": 10}) == ["invoice is older than 10 days (dated 2026-06-01)"]
    assert failures(spark, {}, {"invoice_date": "2026-08-01"}) == ["invoice date 2026-08-01 is in the future"]
    assert failures(spark, {}, {"invoice_date": "someday"}) == ["invoice date 'someday' couldn't be understood"]
    assert failures(spark, {"regex": {"po_number": r"PO-\d{3}"}}) == ["'po_number' (PO-5501) doesn't match the expected format"]
    assert failures(spark, {"allowed_tax_rates": [5, 18]}, lines=[{"description": "a", "tax_rate": "18"}, {"description": "b", "gst_pct": "7"}]) == ["line 2: tax rate 7.0% is not an allowed rate"]
    strict = failures(spark, checks.STRICT, extra={"company": "x"})
    assert "no regulatory details found (HSN/SAC, PAN, CIN, place of supply...)" not in strict  # 'pan' is in 'company'
    assert "no customer / 'bill to' details found" in strict and "no tax breakup found - expected CGST + SGST, or IGST" in strict
    assert failures(spark, checks.STRICT, extra={"bill_to": "B", "GSTIN": "1", "pan": "2", "igst": "3"}) == []


BATCH = "source_file string, vendor string, invoice_number string, file_hash string, batch_pos long"
PAST = "source_file string, vendor string, invoice_number string, file_hash string, processed_at string, history_seq long"


def test_duplicates(spark):
    batch = [("a", "V", "1", "h1", 0), ("b", "v ", " 1", "h2", 1), ("c", "V", "9", "h1", 2), ("d", "W", None, "", 3), ("e", "W", None, None, 4), ("f", "X", "5", "h9", 5), ("g", "Y", "6", "h7", 6), ("i", "v", "1", "h2", 7)]
    past = [("old", "x", "5", "hh", "2025", 2), ("older", "X", "5", "hx", "2024", 1), ("file", "Z", "0", "h7", "2023", 3)]
    got = {r.source_file: (r.duplicate_of, r.duplicate_note) for r in checks.check_duplicates(spark.createDataFrame(batch, BATCH), spark.createDataFrame(past, PAST)).collect()}
    assert got["a"] == got["d"] == got["e"] == ("", "")
    assert got["b"] == ("a", "same vendor & invoice number in this batch") and got["c"] == ("a", "identical file already in this batch") and got["i"] == ("b", "identical file already in this batch")
    assert got["f"] == ("older", "invoice 5 from X already processed on 2024") and got["g"] == ("file", "identical file processed on 2023")


def test_line_maths_and_sums(spark):
    rows = spark.createDataFrame([("3", "50", "300"), ("2", "100", "200"), ("2", "", "1"), ("1", "5", "0")], "quantity string, rate string, taxable_value string")
    assert [r.math_mismatch for r in checks.line_maths(rows).collect()] == [True, False, False, False]
    lines = spark.createDataFrame([("a", 1.1, 2.2), ("a", None, 1.0)], "d string, x double, y double")
    r = checks.derive_totals(lines, ["d"], {"subtotal": "x", "total": "y"}, {"tax": ("total", "subtotal")}).first()
    assert (float(r.subtotal), float(r.total), float(r.tax)) == (1.1, 3.2, 2.1)


def test_bills_are_shuffled_by_order_alone(spark, tmp_path):
    from tallyforge.plans import bills

    tables = {
        "lineitem": spark.createDataFrame([(1, 1, 1, 1, 2.0, 10.0, 0.0, 0.1), (1, 1, 1, 2, 1.0, 5.0, 0.0, 0.1), (1, 2, 2, 3, 1.0, 7.0, 0.0, 0.0)], "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
        "orders": spark.createDataFrame([(1, 8, datetime.date(1995, 1, 1))], "o_orderkey long, o_custkey long, o_orderdate date"),
        "supplier": spark.createDataFrame([(1, "S1"), (2, "S2")], "s_suppkey long, s_name string"), "customer": spark.createDataFrame([(9, "C")], "c_custkey long, c_name string"),
    }
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    out = bills.bills(spark, str(tmp_path))
    assert {(r.doc_id, r.vendor, r.bill_to, r.n_lines, float(r.line_sum)) for r in out.collect()} == {("INV-1-1", "S1", None, 2, 15.0), ("INV-1-2", "S2", None, 1, 7.0)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bills.bills(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"hashpartitioning\((\w+)#", plan)
    assert sorted(keys) == ["c_custkey", "l_orderkey", "o_custkey", "o_orderkey"]
