"""Filling of gaps looks at each line of a text once."""

from __future__ import annotations

from tallyforge.operators import pages

GIVEN = "doc_id string, vendor string, invoice_number string, invoice_date string, po_number string, subtotal decimal(18,2), tax decimal(18,2), total decimal(18,2), text string"


def test_lines_are_split_once_and_gaps_filled_as_before(spark):
    text = "Tax Invoice\nSome Traders  Invoice No: A-77\nPO No: P/5 of  5-Mar-2024\n\n \nSub Total: 1,000.00\nGrand Total USD 1,180.50"
    rows = [("a", None, None, "", None, None, None, None, text), ("b", "Kept", "N-1", " 2024-03-07 ", "P", None, None, None, "Receipt\r\nTotal 5.00\rBlue House"), ("c", "", None, None, None, None, None, None, "Invoice of\nBlue House"), ("d", None, None, None, None, None, None, None, None)]
    out = pages.fallback_fields(spark.createDataFrame(rows, GIVEN))
    got = {r.doc_id: tuple(None if v is None else str(v) for v in r[1:8]) for r in out.collect()}
    assert got == {
        "a": ("Some Traders", "A-77", "05-Mar-2024", "P/5", "1000.00", "180.50", "1180.50"), "b": ("Kept", "N-1", "07-Mar-2024", "P", None, None, "5.00"),
        "c": ("Blue House", None, None, None, None, None, None), "d": ("", None, None, None, None, None, None),
    }
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(coalesce(text") == 1
    assert "(?:pvt" not in out._jdf.queryExecution().optimizedPlan().toString()
