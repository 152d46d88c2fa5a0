"""Registered queries see texts to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import exports, pages
from tallyforge.plans import more_queries, queries


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_scrub_text_sees_the_whole_turn(spark, tmp_path):
    long = "api_key = abc123 " + "word " * 300 + "sk-abcdefgh99 end"
    sf = put(spark, tmp_path, "conversations", [(7, 0, "user", long), (8, 1, "user", "Hi there"), (9, 0, "user", None)], "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in queries.scrub_text(spark, sf).collect()}
    assert got[7].scrubbed == "[REDACTED] " + "word " * 300 + "[REDACTED] end [REDACTED] [REDACTED] [REDACTED]"
    assert got[7].slug == "api_key_abc123_" + "word_" * 300 + "sk_abcdefgh99_end"
    assert got[8].slug == "hi_there" and got[8].scrubbed == "Hi there [REDACTED] [REDACTED] [REDACTED]"


def test_ai_guard_redacts_whole_texts(spark, tmp_path):
    words = "word " * 300
    mail = f"{words}a.b@example.com end"
    sf = put(spark, tmp_path, "documents", [(1, mail), (3, mail), (4, "word " * 12_001), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in more_queries.ai_guard(spark, sf).collect()}
    assert (got[1].prepared, got[1].note) == (f"{words}[EMAIL] end", "redacted 1 personal/banking identifier(s)")
    assert (got[3].prepared, got[3].note) == (mail, "")  # a local model
    assert (len(got[4].prepared), got[4].note) == (60_000, "truncated to 60000 characters")
    small = pages.guard(spark.createDataFrame([("mail a@b.cd now",)], "text string"), F.lit("https://api.example.com"), cap=9).collect()[0]
    assert (small.prepared, small.note) == ("mail [EMA", "redacted 1 personal/banking identifier(s); truncated to 9 characters")


def test_labels_pages_and_rows_of_whole_texts(spark, tmp_path):
    head, tail = "Some words before " * 5, "a & b <c> Total:"
    texts = {0: head + tail, 1: "short", 2: "", 3: "n" * 45 + " " + "m" * 45, 4: "x" * 100}
    sf = put(spark, tmp_path, "documents", [(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    labels = {r.doc_id: r for r in queries.clean_labels(spark, sf).collect()}
    assert labels[0].label == f"{head}a & b <c> total".lower() and labels[0].xml == f"{head}a &amp; b &lt;c&gt; Total:"
    assert labels[0].undoubted == head + tail and labels[0].filename == f"{head}a & b _c_ Total_.pdf"
    flag = more_queries.scanned_flag(spark, sf).collect()
    assert [(r.n_content, r.n_pages, r.scanned) for r in flag] == [(sum(c.isalnum() for t in texts.values() for c in t), 5, False)]
    source = {r.page_no: r.page_source for r in more_queries.page_source(spark, sf).collect()}
    assert source == {1: "native", 2: "ocr", 3: "ocr", 4: "native", 5: "native"}
    merged = {r.doc_id: r.description for r in more_queries.continuation_merge(spark, sf).collect()}
    assert merged["0"] == head + tail and merged["3"] == texts[3]


def test_bill_export_has_all_lines(spark):
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = more_queries.bill_export_rows(spark, sf)
    assert got.where("pos is not null").count() == lines.count() == got.count()


def test_bill_without_lines_is_one_empty_row(spark):
    bills = more_queries._invoices(spark, "/root/testdata/sf0.001").limit(1)
    none = spark.createDataFrame([], "doc_id string, pos int, cols map<string,string>")
    rows = exports.bill_rows(bills, none).collect()
    assert len(rows) == 1 and rows[0].item_description == "" and rows[0].amount == ""
