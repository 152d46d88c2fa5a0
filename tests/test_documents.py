from __future__ import annotations

import io
import json
import zipfile

import pytest

from tallyforge.operators import documents, exports, infer, pages, tables, templates
from tallyforge.sinks import files
from tallyforge.sources import readers
from tallyforge.streaming import inbox
from tests.plain_templates import Word

WORDS = "doc_id string, page_no int, word_no int, text string, x0 double, top double"


def line(top, *cells):
    """Words of a line: (x, text) cells; words of a cell stand close together."""
    out = []
    for x, text in cells:
        for w in text.split():
            out.append(Word(w, float(x), float(x + 5 * len(w)), float(top)))
            x += 5 * len(w) + 3
    return out


def invoice():
    rows = [line(10, (50, "ACME Supplies Ltd")), line(40, (50, "Invoice No: INV-77"), (300, "Date: 12/06/2026"))]
    rows += [line(100, (50, "Description"), (250, "Qty"), (320, "Rate"), (420, "Amount"))]
    rows += [line(120, (50, "Blue chair"), (250, "2"), (320, "30.00"), (420, "60.00")), line(132, (50, "with arms")), line(150, (50, "Lamp"), (250, "1"), (320, "21.00"), (420, "21.00"))]
    rows += [line(200, (320, "Subtotal"), (420, "81.00")), line(215, (320, "Tax"), (420, "8.10")), line(230, (320, "Grand Total"), (420, "89.10"))]
    return [w for r in rows for w in r]


TEMPLATE = {
    "vendor": "ACME",
    "fields": {"invoice_number": {"anchor": "Invoice No"}, "invoice_date": {"anchor": "Date", "type": "date"}, "subtotal": {"anchor": "Subtotal", "type": "money", "gap": 200}, "total": {"anchor": "Grand Total", "nth": 1}, "first_qty": {"anchor": "Qty", "below": 1, "type": "number"}, "who": {"anchor": "Ltd", "before": 2}},
    "line_items": {"header_anchor": "Description", "end_anchor": "Subtotal", "columns": [{"name": "description", "type": "text", "x_min": 20, "x_max": 240}, {"name": "quantity", "type": "number", "x_min": 240, "x_max": 300}, {"name": "unit_price", "type": "money", "x_min": 300, "x_max": 400}, {"name": "amount", "type": "money", "x_min": 400, "x_max": 500}], "derive_totals": {"line_total": {"sum": "amount"}, "tax": {"diff": ["total", "line_total"]}}},
}


def test_extraction_over_a_table_of_words(spark):
    rows = [(d, 1, i, *w) for d in ("a", "b") for i, w in enumerate(invoice())]
    words = spark.createDataFrame([(d, p, i, t, x0, x1, top, "acme") for d, p, i, t, x0, x1, top in rows], "doc_id string, page_no int, word_no int, text string, x0 double, x1 double, top double, template_id string")
    got = templates.to_invoices(templates.extract_documents(words, {"acme": TEMPLATE})).collect()
    assert {(r.doc_id, r.invoice_number, r.total, float(r.line_sum), r.n_lines) for r in got} == {("a", "INV-77", 89.1, 81.0, 2), ("b", "INV-77", 89.1, 81.0, 2)}
    assert got[0].extra["who"] == "ACME Supplies"
    status = infer.infer_templates(words.drop("template_id")).collect()
    assert {r.status for r in status} == {"OK"}
    template = json.loads(status[0].template)
    assert [c["name"] for c in template["line_items"]["columns"]] == ["description", "quantity", "unit_price", "amount"] or template["line_items"]["columns"][-1]["name"] in ("total", "amount")


def test_two_page_table_without_second_header(spark):
    rows = [("d", 1, 0, "Description", 10.0, 10.0), ("d", 1, 1, "Amount", 200.0, 10.0), ("d", 1, 2, "Widget", 10.0, 30.0), ("d", 1, 3, "60.00", 200.0, 30.0), ("d", 1, 4, "Gadget", 12.0, 50.0), ("d", 1, 5, "40.00", 198.0, 50.0)]
    rows += [("d", 2, 0, "Gizmo", 10.0, 10.0), ("d", 2, 1, "30.00", 200.0, 10.0), ("d", 2, 2, "Total", 10.0, 30.0), ("d", 2, 3, "130.00", 200.0, 30.0), ("d", 2, 4, "Doohickey", 10.0, 50.0), ("d", 2, 5, "10.00", 200.0, 50.0), ("d", 2, 6, "extra", 10.0, 70.0)]
    got = tables.read_tables(spark.createDataFrame(rows, WORDS)).orderBy("row_no").collect()
    assert [(r.cols["description"], r.cols["amount"]) for r in got] == [("Widget", "60.00"), ("Gadget", "40.00"), ("Gizmo", "30.00"), ("Doohickey extra", "10.00")]


def test_table_repairs(spark):
    rows = spark.createDataFrame([("d", 1, {"description": "A", "unit": "84713010", "hsn": "", "cgst_rate": "9"}), ("d", 2, {"description": "B exempt", "cgst_rate": "9", "amount": "1"})], "doc_id string, row_no int, cols map<string,string>")
    got = [r.cols for r in tables.fix_exempt(tables.fix_hsn(rows)).orderBy("row_no").collect()]
    assert got[0]["hsn"] == "84713010" and got[0]["unit"] == "" and got[0]["cgst_rate"] == "9" and got[1]["cgst_rate"] == "0"


ANSWER = {"vendor": "ACME", "invoice_number": "INV-5", "po_number": "dated", "invoice_date": "2026-06-01", "currency": "INR", "cgst": "9", "sgst": "9", "subtotal": "100.00", "total": 118, "taxes": [{"name": "CGST", "rate": 9, "amount": 9}, {"name": "SGST", "amount": 9}], "line_items": [{"description": "Widget", "quantity": 2, "unit_price": 50, "amount": 100}, {"description": "Grand Total", "amount": 118}]}


def test_answers_become_invoices_and_retry_keeps_the_better(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    bad = json.dumps(ANSWER | {"total": 200, "line_items": []})

    def model(prompt):
        return json.dumps(ANSWER) if "CORRECTION" in prompt or prompt == "good" else bad if prompt == "bad" else "no json"

    texts = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "odd")], "doc_id string, prompt string")
    got = {r.doc_id: r for r in documents.extract_with_model(texts, model).collect()}
    for d in "12":
        r = got[d]
        assert (r.invoice_number, r.po_number, float(r.tax), float(r.total), r.n_lines, r.validation_ok) == ("INV-5", None, 18.0, 118.0, 1, True)
        assert r.extra == {"currency": "INR", "CGST": "9.00", "SGST": "9.00"} and r.lines[0]["amount"] == "100.0"
    assert got["3"].total is not None or got["3"].vendor == ""


def test_ocr_text_and_vendor(spark):
    p = spark.createDataFrame([("a", 1, "word " * 40), ("a", 2, "x" * 200), ("b", 1, "")], "doc_id string, page_no int, text string")
    boxes = spark.createDataFrame([("b", 1, 1, "sure", 0.9), ("b", 1, 2, "maybe", 0.45), ("b", 1, 3, "no", 0.2)], "doc_id string, page_no int, seq int, text string, conf double")
    got = {r.doc_id: r for r in pages.ocr_text(p, boxes).collect()}
    assert not got["a"].ocr_used and got["a"].ocr_confidence == 1.0 and got["b"].text == "sure\n[?maybe?]" and got["b"].ocr_confidence == 0.675
    d = spark.createDataFrame([(1, "Tax Invoice\nAcme Trading  Pvt Ltd  Invoice No 5\nrest"), (2, "invoice\nto from\nPlain Name\n12345"), (3, "")], "doc_id int, text string")
    assert {r.doc_id: r.vendor_guess for r in pages.guess_vendor(d).collect()} == {1: "Acme Trading Pvt Ltd", 2: "Plain Name", 3: ""}


def test_fallback_fields_stay_with_their_row(spark):
    columns = "doc_id string, vendor string, invoice_number string, invoice_date string, po_number string, subtotal double, tax double, total double, text string"
    text = "Tax Invoice\nAcme Pvt Ltd  Invoice No: N-7\nPO No: P/9 of 2024-03-05\nSub Total: 100.00\nno figure in this total\nGrand Total USD 118.00"
    rows = [("a", None, None, None, None, None, None, None, text), ("b", "V", "K", "05/01/2024", "P", 1.0, 2.0, 3.0, None), ("a", None, None, "x", None, None, None, None, "Total 5.00")]
    out = pages.fallback_fields(spark.createDataFrame(rows, columns))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(r.doc_id, r.vendor, r.invoice_number, r.invoice_date, r.po_number, *(x if x is None else float(x) for x in (r.subtotal, r.tax, r.total))) for r in out.collect()]
    assert got == [("a", "Acme Pvt Ltd", "N-7", "05-Mar-2024", "P/9", 100.0, 18.0, 118.0), ("b", "V", "K", "05-Jan-2024", "P", 1.0, 2.0, 3.0), ("a", "", None, "x", None, None, None, 5.0)]


INV = "doc_id string, source_file string, vendor string, invoice_number string, invoice_date string, po_number string, subtotal double, tax double, total double, extra map<string,string>, batch_pos long, confidence double, validation_ok boolean, validation_notes array<string>, rule_failures array<string>, duplicate_note string, file_hash string"


def test_exports_and_sinks(spark, tmp_path):
    rows = [("a", "a.pdf", "A & B", "1", "2026-06-01", None, 100.0, 18.0, 118.0, {"CGST": "9", "SGST": "9", "_x": "1"}, 0, 1.0, True, [], [], "", "h"), ("b", "b.pdf", None, None, None, None, None, None, None, {"pnr": "Z"}, 1, 0.5, False, ["bad", "worse"], [], "", "")]
    inv = spark.createDataFrame(rows, INV)
    ledger = {(r.doc_id, r.ledger, float(r.amount)) for r in exports.ledger_entries(inv).collect()}
    assert ledger == {("a", "A & B", 118.0), ("a", "Purchase Accounts", -100.0), ("a", "CGST", -9.0), ("a", "SGST", -9.0), ("b", "Unknown Supplier", 0.0), ("b", "Purchase Accounts", 0.0)}
    xml = {r.doc_id: r.xml for r in exports.vouchers(inv).collect()}
    assert "<DATE>20260601</DATE>" in xml["a"] and "A &amp; B" in xml["a"]
    wide = exports.wide_invoices(inv)
    assert wide.columns == [*exports.BASE_COLUMNS, "CGST", "SGST", "pnr", *exports.TAIL_COLUMNS] and wide.where("vendor is null").first().validation_notes == "bad; worse"
    lines = spark.createDataFrame([("a", 1, {"description": "w", "amount": "5"})], "doc_id string, pos int, cols map<string,string>")
    assert {(r.doc_id, r.amount, r.currency) for r in exports.bill_rows(inv, lines).collect()} == {("a", "5", "INR"), ("b", "", "INR")}
    book = zipfile.ZipFile(io.BytesIO(files.workbook({"Invoices": (wide, "validation_ok"), "Lines": (exports.wide_lines(lines.withColumn("batch_pos", lines.pos)), None)})))
    assert "Line" in book.read("xl/workbook.xml").decode() and "bad; worse" in book.read("xl/worksheets/sheet1.xml").decode()
    files.append_history(inv, str(tmp_path / "h"), "2026-01-01")
    files.append_history(inv, str(tmp_path / "h"), "2026-01-02", 10)
    assert readers.read_history(spark, str(tmp_path / "h")).count() == 4
    files.write_csv_pair(wide, exports.bill_rows(inv, lines), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv/invoices"), header=True).count() == 2


def test_admission_and_templates(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.PDF").write_bytes(b"nope")
    (tmp_path / "c.txt").write_bytes(b"%PDF")
    good, bad = readers.admit(readers.read_folder(spark, str(tmp_path)))
    assert [r.path.endswith("a.pdf") for r in good.collect()] == [True] and "missing PDF signature" in bad.first().reason
    parser = lambda data: [{"page_no": p, "text": f"w{p}", "x0": 1.0, "x1": 2.0, "top": 5.0, "bottom": 9.0, "page_height": 100.0} for p in (1, 2)]
    assert sorted(r.top for r in readers.read_words(good, parser).collect()) == [5.0, 105.0]
    t = readers.load_templates({"x": "vendor: X\nidentify: {keyword: Acme Ltd}\nvariants:\n- {vendor: Y, identify: {keyword: Beta}}\n", "bad": "- 1"})
    assert [r.keyword for r in readers.template_keywords(spark, t).collect()] == ["Acme Ltd", "Beta"]
    assert readers.Settings.load({"max_file_mb": 3, "other": 1}).max_file_mb == 3


def test_stream_sees_what_earlier_batches_appended(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = {"source_file": "a", "vendor": "V", "invoice_number": "1", "invoice_date": "2026-01-01", "subtotal": 1.0, "tax": 0.0, "total": 1.0, "line_sum": 1.0, "n_lines": 1, "file_hash": "h", "arrived": "2026-01-01T00:00:00"}
    paths = [str(tmp_path / x) for x in ("hist", "out", "chk")]
    for i in range(2):
        (folder / f"{i}.json").write_text(json.dumps(row | {"source_file": f"f{i}"}))
        inbox.start(inbox.read_inbox(spark, str(folder)), *paths).awaitTermination()
    got = {r.source_file: r.duplicate_note for r in spark.read.parquet(paths[1]).collect()}
    assert got == {"f0": "", "f1": "identical file processed on 2026-01-01 00:00:00"}


def test_template_folder_outputs_and_batches(spark, tmp_path):
    folder = str(tmp_path / "templates")
    readers.save_template(spark, folder, "ACME Ltd", "vendor: ACME\nfields: {}\n")
    readers.save_template(spark, folder, "b", "- no mapping\n")
    assert readers.read_templates(spark, folder) == {"acme_ltd": {"vendor": "ACME", "fields": {}}}
    assert readers.delete_template(spark, folder, "ACME Ltd") and not readers.delete_template(spark, folder, "ACME Ltd")
    for name, n in (("b.csv", 2048), ("a.xlsx", 512), ("c.txt", 9)):
        (tmp_path / name).write_bytes(b"x" * n)
    assert [tuple(r) for r in readers.list_outputs(spark, str(tmp_path)).collect()] == [("a.xlsx", 0.5), ("b.csv", 2.0)]
    files_ = spark.createDataFrame([(f"{i}.pdf",) for i in range(3)], "path string")
    readers.check_batch(files_, 3)
    with pytest.raises(ValueError):
        readers.check_batch(files_, 2)
    history = spark.createDataFrame([(i, f"v{i}") for i in range(9)], "history_seq long, vendor string")
    assert [r.history_seq for r in readers.history_tail(history, 2).collect()] == [8, 7]
