from __future__ import annotations

import json
import random

import pytest

from tallyforge.operators import candidates, templates
from tests import plain_templates as plain
from tests.plain_templates import Word
from tests.test_documents import TEMPLATE, invoice, line

WORDS = "doc_id string, template_id string, page_no int, word_no int, text string, x0 double, x1 double, top double"


def frame(spark, docs):
    """(doc_id, template_id, words) -> a table of words."""
    return spark.createDataFrame([(d, t, 1, i, *w) for d, t, words in docs for i, w in enumerate(words)], WORDS)


def alike(got, want):
    if isinstance(want, (int, float)):
        return got is not None and float(got) == pytest.approx(want, abs=1e-9)
    return (got or None) == (want or None)


def held(spark, docs, known):
    """The relations give what the plain reader gives."""
    got = {(r.doc_id, r.template_id): r for r in templates.extract_documents(frame(spark, docs), known).collect()}
    assert set(got) == {(d, t) for d, t, w in docs if w}
    for d, t, words in docs:
        if not words:
            continue
        header, items = plain.extract(words, known[t]) if t in known else ({}, [])
        r = got[d, t]
        assert set(r.header) == set(header), (d, t)
        for k, v in header.items():
            assert alike(r.header[k], v), (d, t, k, r.header[k], v, [w for w in words])
        assert len(r.items) == len(items), (d, t, r.items, items, words)
        for a, b in zip(r.items, items):
            assert set(a) == set(b) and all(alike(a[k], b[k]) for k in b), (d, t, a, b)
    return got


def test_fields_and_wrapped_rows(spark):
    plain_columns = [{"name": "description", "header": "Description"}, {"name": "quantity", "header": "Qty", "type": "number"}, {"name": "rate", "header": "Rate", "type": "number"}, {"name": "amount", "header": "Amount", "type": "money"}]
    known = {"bands": TEMPLATE, "headers": TEMPLATE | {"line_items": {"header_anchor": "Description", "end_anchor": "Subtotal", "columns": plain_columns}}}
    got = held(spark, [("a", "bands", invoice()), ("a", "headers", invoice()), ("b", "none", invoice()), ("c", "bands", [])], known)
    header, items = got["a", "bands"].header, got["a", "bands"].items
    assert header["invoice_number"] == "INV-77" and header["invoice_date"] == "2026-06-12" and float(header["total"]) == 89.1 and float(header["line_total"]) == 81.0
    assert [(r["description"], float(r["amount"])) for r in items] == [("Blue chair with arms", 60.0), ("Lamp", 21.0)]
    assert [r["amount"] and float(r["amount"]) for r in got["a", "headers"].items] == [60.0, None, 21.0]
    plan = templates.extract_documents(frame(spark, [("a", "bands", invoice())]), known)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan.replace("PythonRDD", "")


def scattered(rng):
    """Words on wavering lines, labels among them, so that every way of a rule is met."""
    said = ["Total", "Grand", "Total:", "No", "Date", "Qty", "Amount", "Item", ":", "-", "x1", "12.50", "7", "1,200.00", "03/04/2025", "blue", "chair", "end", "%", "Ünit"]
    out, top = [], 10.0
    for _ in range(rng.randrange(1, 14)):
        top += rng.choice([2.0, 2.6, 3.0, 3.4, 4.0, 5.5, 9.0, 14.0])
        x = rng.choice([20.0, 50.0, 61.0])
        for _ in range(rng.randrange(1, 7)):
            w = rng.choice(said)
            out.append(Word(w, x, x + 5.0 * len(w), top + rng.choice([0.0, 0.0, 0.0, 0.4, 0.5, -0.5, 1.5])))
            x += 5.0 * len(w) + rng.choice([3.0, 3.0, 12.0, 40.0, 60.0])
    rng.shuffle(out)
    return out


def test_random_pages_against_the_plain_reader(spark):
    fields = {
        "right": {"anchor": "Total"}, "second": {"anchor": "total", "occurrence": 2, "type": "money"}, "last": {"anchor": "Grand Total", "occurrence": "last"}, "few": {"anchor": "No", "max_words": 2}, "wide": {"anchor": "Date", "gap": 5, "type": "date"},
        "nth": {"anchor": "Amount", "nth": 1}, "late": {"anchor": "Total", "nth": 2, "occurrence": "last"}, "sum": {"anchor": "Total", "sum_nth": [1, 2, 9]}, "below": {"anchor": "Qty", "below": True}, "two": {"anchor": "Item", "below": 2, "x_tol": 60, "gap": 20, "max_words": 2, "type": "number"},
        "before": {"anchor": "Total", "before": 2}, "none": {"anchor": "nowhere at all"}, "sign": {"anchor": "Total :"},
    }
    columns = [{"name": "description", "type": "text", "x_min": 0, "x_max": 70}, {"name": "code", "type": "text", "x_min": 70, "x_max": 110}, {"name": "quantity", "type": "number", "x_min": 110, "x_max": 170}, {"name": "amount", "type": "money", "x_min": 170, "x_max": 400}]
    known = {
        "bands": {"vendor": "V", "fields": fields, "line_items": {"header_anchor": "Item", "end_anchor": "end", "start_offset": 1, "end_offset": 0, "row_tol": 3, "columns": columns, "derive_totals": {"lines": {"sum": "amount"}, "codes": {"sum": "code"}, "rest": {"diff": ["sum", "lines"]}}}},
        "open": {"fields": {}, "line_items": {"header_anchor": "Qty", "header_occurrence": "last", "end_anchor": "Total", "end_occurrence": 2, "columns": columns}},
        "headers": {"fields": {"x": {"anchor": "-"}}, "line_items": {"header_anchor": "Amount", "end_anchor": "end", "columns": [{"name": "description", "header": "Item"}, {"name": "quantity", "header": "Qty each", "type": "number"}, {"name": "amount", "header": "Amount", "type": "money"}, {"name": "day", "header": "Date", "type": "date"}]}},
        "layouts": {"vendor": "base", "fields": fields, "variants": [{"identify": {"keyword": "BLUE chair"}, "vendor": "first"}, {"identify": {"keyword": "7"}, "fields": {"right": {"anchor": "No"}}}]},
    }
    rng = random.Random(11)
    held(spark, [(f"d{i}", t, scattered(rng)) for i in range(60) for t in known], known)


def test_templates_as_a_table_and_checks(spark):
    docs = frame(spark, [("a", "t", invoice())])
    table = spark.createDataFrame([("t", json.dumps(TEMPLATE)), ("u", "not json")], "template_id string, template string")
    a, b = templates.extract_documents(docs, table).collect()[0], templates.extract_documents(docs, {"t": TEMPLATE}).collect()[0]
    assert a.header == b.header and a.items == b.items
    assert templates.extract_documents(docs.limit(0), {"t": TEMPLATE}).collect() == []
    with pytest.raises(ValueError, match="counts from 1"):
        templates.checked({"fields": {"x": {"anchor": "x", "occurrence": 0}}})
    with pytest.raises(ValueError, match="one name"):
        templates.checked({"line_items": {"columns": [{"name": "a"}, {"name": "a"}]}})


def test_derived_totals_come_in_order_of_need(spark):
    derive = {"due": {"diff": ["net", "paid"]}, "net": {"diff": ["gross", "tax"]}, "gross": {"sum": "amount"}, "paid": {"diff": ["net", "zero"]}, "tax": {"diff": ["tax", "zero"]}}
    base = TEMPLATE["line_items"]
    fields = {"tax": {"anchor": "Tax", "nth": 1}}
    first = {k: derive[k] for k in ("gross", "tax", "net", "paid", "due")}
    known = {"a": {"fields": fields, "line_items": base | {"derive_totals": derive}}, "b": {"fields": fields, "line_items": base | {"derive_totals": first}}}
    rows = templates.extract_documents(frame(spark, [("d", "a", invoice()), ("d", "b", invoice())]), known).collect()
    for r in rows:
        assert {k: float(r.header[k]) for k in derive} == {"due": 0.0, "net": 72.9, "gross": 81.0, "paid": 72.9, "tax": 8.1}
    with pytest.raises(ValueError, match="need each other: (a <- b <- a|b <- a <- b)"):
        templates.checked({"line_items": {"derive_totals": {"a": {"diff": ["b", "x"]}, "b": {"diff": ["a", "x"]}}}})


def test_field_candidates(spark):
    page = [*line(10, (20, "Invoice No: INV-2024-7"), (300, "Date:"), (400, "12/06/2025")), *line(30, (20, "Reference"), (75, "AB-1234")), *line(50, (20, "Sub Total"), (200, "81.00"), (260, "9.00")), *line(70, (300, "Order Ref")), *line(82, (302, "PO-77881")), *line(100, (20, "some ordinary words of prose"))]
    lines = templates.text_lines(frame(spark, [("a", "t", page), ("b", "t", line(5, (20, ":"), (200, "Total:"))), ("c", "t", line(5, (20, "A x:"), (100, "B:"), (200, "9.50")))]))
    got = {}
    for r in candidates.field_candidates(lines).orderBy("line_no", "kind", "x0").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.anchor, r.value, r.nth, r.below))
    assert got["a"] == [(0, "Invoice No", "INV-2024-7", None, None), (0, "Date", "12/06/2025", None, None), (1, "Reference", "AB-1234", None, None), (2, "Sub Total", "81.00", 1, None), (2, "Sub Total", "9.00", 2, None), (3, "Order Ref", "PO-77881", None, 1)]
    # a colon alone has no label, but takes what follows; a label that is taken as a value is none
    assert got.get("b", []) == []
    assert got["c"] == [(0, "A x", "B:", None, None), (2, "A x: B", "9.50", 1, None)]
