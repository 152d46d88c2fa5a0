from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import jsonfix
from tallyforge.operators import infer, pages
from tests.test_documents import invoice, line

WORDS = "doc_id string, page_no int, word_no int, text string, x0 double, x1 double, top double"


def words(spark, **docs):
    return spark.createDataFrame([(d, 1, i, *w) for d, ws in docs.items() for i, w in enumerate(ws)], WORDS)


def flat(*rows):
    return [w for r in rows for w in r]


@pytest.fixture(scope="module")
def sample(spark):
    stacked = flat(
        line(20, (50, "Invoice No: S-1"), (300, "Date: 05/06/2024")), line(96, (420, "Taxable")), line(100, (50, "Particulars"), (250, "Qty"), (330, "HSN")), line(104, (420, "Value"), (500, "Total")),
        line(130, (50, "Chair"), (250, "2"), (330, "9401"), (420, "60.00"), (500, "70.80")), line(142, (50, "with very long arms and wheels below it all")), line(160, (50, "Lamp"), (250, "1"), (330, "9405"), (420, "20.00"), (500, "23.60")),
        line(200, (50, "Grand Total"), (500, "94.40")),
    )
    bare = flat(line(10, (50, "Invoice No: B-1")), line(20, (50, "hello there")))
    return words(spark, plain=invoice(), stacked=stacked, bare=bare)


def test_lines_and_header_bands(sample):
    lines = infer.text_lines(sample)
    got = {(r.doc_id, r.line): r for r in lines.collect()}
    assert got["plain", 2].text == "description qty rate amount" and got["plain", 2].score == 5 and not got["plain", 2].figure
    band = {r.doc_id: r for r in infer.header_band(lines).collect()}
    assert band.keys() == {"plain", "stacked"} and band["plain"].end == "subtotal" and band["plain"].stop == 200
    assert band["stacked"].end == "grand total" and band["stacked"].stop == 200 and band["stacked"].above == 0


def test_columns_are_named_and_parted(sample):
    lines = infer.text_lines(sample)
    band = infer.header_band(lines)
    seeds = infer.seed_columns(lines, band)
    named = {r.doc_id: [s["name"] for s in r.seeds] for r in seeds.collect()}
    assert named == {"plain": ["description", "quantity", "unit_price", "taxable_value"], "stacked": ["description", "quantity", "hsn_sac", "taxable_value", "total"]}
    got = {r.doc_id: r.columns for r in infer.column_bands(sample, seeds, band).collect()}
    assert [c["name"] for c in got["plain"]] == ["description", "quantity", "unit_price", "amount"]
    assert [c["type"] for c in got["stacked"]] == ["text", "number", "text", "money", "money"]
    for columns in got.values():
        assert all(a["x_max"] <= b["x_min"] + 1e-6 and a["x_min"] < a["x_max"] for a, b in zip(columns, columns[1:]))


def test_templates_are_verified(sample):
    got = {r.doc_id: r for r in infer.infer_templates(sample, "ACME").collect()}
    assert {d: r.status for d, r in got.items()} == {"plain": "OK", "stacked": "OK", "bare": "REVIEW"}
    # without a number and a date no invoice is in order
    undated = infer.infer_templates(sample.where("doc_id = 'stacked' and top > 20"), "ACME").first()
    assert undated.status == "REVIEW" and json.loads(undated.template)["line_items"] == json.loads(got["stacked"].template)["line_items"]
    stacked, bare = json.loads(got["stacked"].template), json.loads(got["bare"].template)
    assert stacked["vendor"] == "ACME" and stacked["line_items"]["end_anchor"] == "Grand Total" and stacked["line_items"]["header_anchor"] == "Particulars"
    assert "line_items" not in bare and bare["fields"]["invoice_number"] == {"anchor": "Invoice No", "type": "text"}


def test_candidates_and_fields(spark):
    ws = flat(line(10, (50, "Invoice No: A-7"), (300, "Invoice Date"), (400, "05/06/2024")), line(30, (50, "PO Number"), (300, "Bill To")), line(42, (50, "PO-99"), (300, "Blue Ltd")), line(60, (50, "Net Payable 12.50")))
    lines = infer.text_lines(words(spark, d=ws))
    found = {(r.said, r.value, r.how.gap, r.how.below) for r in infer.label_candidates(lines).collect()}
    assert {("invoice no", "A-7", None, None), ("invoice date", "05/06/2024", 200.0, None), ("po number", "PO-99", None, 1), ("bill to", "Blue Ltd", None, 1), ("net payable", "12.50", None, None)} <= found
    fields = infer.inferred_fields(lines).collect()[0].fields
    assert {k: (v.anchor, v.type) for k, v in fields.items()} == {"invoice_number": ("Invoice No", "text"), "invoice_date": ("Invoice Date", "date"), "po_number": ("PO Number", "text"), "bill_to": ("Bill To", "text"), "total": ("Net Payable", "money")}
    assert infer.infer_templates(words(spark, d=ws).limit(0)).count() == 0


@pytest.mark.parametrize("names, want", [
    (["description", "taxable_value", "cgst", "total"], {"subtotal": ("taxable_value", None), "cgst": ("cgst", None), "total": ("total", None), "tax": (None, ["total", "subtotal"])}),
    (["description", "amount"], {"subtotal": ("amount", None)}), (["description"], {}), (["total"], {"total": ("total", None)}),
])
def test_derived(spark, names, want):
    got = spark.range(1).select(infer.derived(F.array(*map(F.lit, names))).alias("d")).collect()[0].d
    assert {k: (v["sum"], v["diff"]) for k, v in got.items()} == want


@pytest.mark.parametrize("text, want", [
    ('{"a": 1} and more {', {"a": 1}), ('{"a": 1,, "b": 2,}', {"a": 1, "b": 2}), ('{"a": [1, {"b": 2], "c": 3}', {"a": [1, {"b": 2}], "c": 3}), ('{"a":', {}), ('{"a', {}), ('{"a": "x\\', {"a": "x"}), ('{"k": "two\nlines"}', {"k": "two\nlines"}),
    ('{"a": 007}', {"a": 7.0}), ("[[[[", [[[[]]]]), ('{"a": -1.5e3, "b": nul', {"a": -1500.0}), ('{1: 2}', {}), ("}", None), ("", None), (None, None),
])
def test_the_reader_keeps_what_it_has(text, want):
    got = jsonfix.repair(text)
    assert (None if got is None else json.loads(got)) == want


def test_deep_and_long_answers_end():
    assert jsonfix.repair("[" * 100_000).count("[") == jsonfix.DEPTH
    assert len(jsonfix.repair('{"a": "' + "x" * 2_000_000)) > 2_000_000
    assert jsonfix.repair('{"a": {"b": {"c": 1' + "}" * 50_000) == '{"a": {"b": {"c": 1}}}'


def test_many_keywords_match_alike(spark, monkeypatch):
    texts = ["The Apache License and more", "gnu general words", "public general gnu license", "nothing", None, "abcxyz licence", "foo bar"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = spark.createDataFrame([("a", 1, "Apache License"), ("b", 2, "GNU General Public"), ("c", 3, " "), ("d", 4, None), ("e", 5, "xyz"), ("f", 6, "apache"), ("g", 7, "foo foo")], "template_id string, ord int, keyword string")
    want = sorted(map(tuple, pages.match_templates(docs, keys).collect()))
    assert [r[1] for r in want] == ["a", None, "b", None, None, "e", "g"]
    monkeypatch.setattr(pages, "MOST_KEYWORDS", 2)
    assert sorted(map(tuple, pages.match_templates(docs, keys).collect())) == want
