"""Registered queries on text, tables of words and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import exports, pages, tables
from tallyforge.plans.bills import bill_lines, bills, table
from tallyforge.sinks import files
from tallyforge.sinks.files import audit_tail as tail


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages: five in a row make a document."""
    return table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 5).cast("string").alias("doc_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("page_no"), "text", F.col("n_chars").cast("double").alias("height"))


def scanned_flag(spark, sf):
    return pages.scanned(_docs(spark, sf)).select("doc_id", F.col("n_content").cast("long").alias("n_content"), "n_pages", "scanned")


def page_source(spark, sf):
    return pages.page_source(_docs(spark, sf)).select("doc_id", "page_no", "page_source")


def ocr_tag(spark, sf):
    e = table(spark, sf, "events")
    boxes = e.select((F.col("user_id") % 50).cast("string").alias("doc_id"), (F.col("event_id") % 7).cast("int").alias("page_no"), F.col("event_id").alias("seq"), F.concat(F.lit(" "), "event_type").alias("text"), (F.pmod(F.floor(F.col("value") * 7), F.lit(100)) / 100 * F.when(F.col("user_id") % 50 % 3 == 0, 0.3).otherwise(1.0)).alias("conf"))
    return pages.tag_boxes(boxes)


def page_offset(spark, sf):
    return pages.page_offsets(_docs(spark, sf).select("doc_id", "page_no", "height"))


def text_line_scan(spark, sf):
    return pages.text_lines(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"), F.sum(F.length("text")).alias("n_chars"))


def vendor_guess(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Tax Invoice\nsl no qty rate\n"), F.initcap("source"), F.lit("  Trading  Pvt Ltd   Invoice No 12\n"), "text")).otherwise(F.col("text")).alias("text"))
    return pages.guess_vendor(d)


KEYWORDS = (("t_licence", "Apache License"), ("t_gnu", "GNU General Public License"), ("t_words", "reserved rights all"), ("t_the", "then the"), ("t_de", "und der"))


def template_match(spark, sf):
    keys = spark.createDataFrame([(t, i, k) for i, (t, k) in enumerate(KEYWORDS)], "template_id string, ord int, keyword string")
    return pages.match_templates(table(spark, sf, "documents"), keys)


def summary_block(spark, sf):
    li = bill_lines(spark, sf)
    text = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("Sub Total "), F.col("amount").cast("string"))).when(F.col("pos") % 4 == 1, F.concat(F.lit("CGST @ 9% "), F.col("tax_amount").cast("string"))).when(F.col("pos") % 4 == 2, F.concat(F.lit("GRAND TOTAL: INR "), F.format_number("price", 2))).otherwise(F.concat(F.lit("Rounding n/a "), F.col("quantity").cast("int")))
    lines = li.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 4).cast("int").alias("page_no"), (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("pos")).alias("line_no"), text.alias("text"))
    out = pages.financial_summary(lines)
    return out.select("doc_id", "subtotal", "cgst", "round_off", "grand_total")


def fallback_values(spark, sf):
    t = F.concat(F.lit("Invoice no: A-"), "doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit("/7 Purchase Order PO-")).otherwise(F.lit(" Your Order # ")), F.col("n_chars"), F.lit(" dated 2024-0"), F.col("doc_id") % 9 + 1, F.lit("-11 "))
    return table(spark, sf, "documents").select("doc_id", pages.first_match(t, pages.NUMBER_LABELS).alias("number"), pages.first_match(t, pages.ORDER_LABELS).alias("po"), pages.first_match(t, pages.DATE_LABELS).alias("dated"))


def _words(spark, sf):
    li = bill_lines(spark, sf)
    x = F.pmod(F.col("l_partkey") * 37 + F.col("pos") * 11, F.lit(500)).cast("double")
    return li.select("doc_id", F.col("pos").cast("int").alias("word_no"), F.concat(F.lit("t"), F.col("l_suppkey") % 3).alias("template_id"), F.col("l_partkey").alias("part"), x.alias("x0"), (x + 20 + F.col("quantity")).alias("x1"), F.col("amount").alias("amount"))


def _columns(spark):
    rows = [(f"t{t}", i, f"c{i}", 100.0 * i - 10 * t, 100.0 * (i + 1) - 10 * t - (15 if i == 2 else 0)) for t in range(3) for i in range(5)]
    return spark.createDataFrame(rows, "template_id string, ord int, name string, x_min double, x_max double")


def nearest_band(spark, sf):
    return tables.to_bands(_words(spark, sf), _columns(spark), ["doc_id", "word_no", "part", "x0", "x1"])


def nearest_header(spark, sf):
    heads = _columns(spark).select("template_id", "ord", "name", F.col("x_min").alias("hx"))
    return tables.to_nearest(_words(spark, sf), heads, "template_id", ["doc_id", "word_no", "part", "x0"])


def midpoint_columns(spark, sf):
    """The header words of every statement, with bounds halfway between them."""
    from tallyforge.plans.document_queries import statements  # which imports this module

    w = statements(spark, sf).where("top = 60").select("doc_id", F.col("text").alias("name"), "x0")
    return tables.midpoint_bounds(w, ["doc_id"])


def gap_columns(spark, sf):
    return tables.gap_boundaries(_words(spark, sf), ["doc_id"]).select("doc_id", F.array_join(F.transform("boundaries", lambda b: b.cast("string")), ",").alias("boundaries"))


def carry_forward(spark, sf):
    """Pages without a header take the one before: events as pages, clicks as those with a header."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page_no"), "event_type", "value")
    heads = e.where("event_type = 'click'").select("doc_id", "page_no", F.lit(0).cast("long").alias("header_line"), F.col("value").alias("header"))
    return tables.carry_headers(e, heads).select("doc_id", F.col("page_no").alias("event_id"), F.col("header").alias("carried"))


def continuation_merge(spark, sf):
    lines = pages.text_lines(table(spark, sf, "documents"))
    rows = lines.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("line_no").alias("row_no"), F.create_map(F.lit("description"), F.col("text"), F.lit("amount"), F.when(F.length("text") % 3 == 0, F.length("text").cast("string")).otherwise("")).alias("cols"))
    return tables.merge_continuations(rows).select("doc_id", "row_no", F.try_element_at("cols", F.lit("description")).alias("description"), F.try_element_at("cols", F.lit("amount")).alias("amount"))


def total_rows(spark, sf):
    li = bill_lines(spark, sf).select("doc_id", F.concat_ws("-", F.col("pos"), F.col("l_partkey"), F.col("amount")).alias("pos"), F.col("l_partkey").cast("string").alias("description"), "amount", "tax_amount")
    one = li.groupBy("doc_id", "pos", "description").agg(F.max("amount").alias("amount"), F.max("tax_amount").alias("tax_amount"))
    return exports.with_totals(one, "doc_id", "pos", "description", ("amount", "tax_amount"))


def _invoices(spark, sf):
    extra = F.when(F.col("l_suppkey") % 2 == 0, F.create_map(F.lit("CGST"), (F.col("tax_sum") / 2).cast("decimal(18,2)").cast("string"), F.lit("sgst"), (F.col("tax_sum") / 2).cast("decimal(18,2)").cast("string"), F.lit("_hash"), F.lit("x"))).otherwise(F.create_map(F.lit("currency"), F.lit("USD")))
    return bills(spark, sf).withColumns({"extra": extra, "po_number": F.lit(None).cast("string")})


def ledger_entries(spark, sf):
    return exports.ledger_entries(_invoices(spark, sf))


def bill_export_rows(spark, sf):
    cols = F.create_map(F.lit("description"), F.col("l_partkey").cast("string"), F.lit("quantity"), F.col("quantity").cast("int").cast("string"), F.lit("unit_price"), F.col("price").cast("string"), F.lit("amount"), F.col("amount").cast("string"), F.lit("tax_amount"), F.when(F.col("pos") % 2 == 0, F.col("tax_amount").cast("string")))
    rows = bill_lines(spark, sf).select("doc_id", F.col("pos").cast("int").alias("pos"), cols.alias("cols"))
    return exports.bill_rows(_invoices(spark, sf), rows)


def json_export(spark, sf):
    inv = _invoices(spark, sf).select("doc_id", "vendor", "invoice_number", F.col("total").cast("string").alias("total"))
    return exports.to_json(inv)


def audit_tail(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("user"))
    return tail(e, 300)


def audit_events(spark, sf):
    """How often two kinds of events are in the log."""
    e = table(spark, sf, "events")
    log = e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.when(F.col("event_id") % 7 == 0, "error").otherwise("ok").alias("outcome"))
    return files.audit_counts(log, ("click", "purchase"))


def props_json(spark, sf):
    v = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", v.isNotNull().alias("readable"))


def ai_guard(spark, sf):
    url = F.when(F.col("doc_id") % 3 == 0, F.lit("http://localhost:11434")).otherwise(F.lit("https://api.example.com"))
    return pages.guard(table(spark, sf, "documents").select("doc_id", "text"), url).select("doc_id", "allowed", "prepared", "note")


MORE = (
    scanned_flag, page_source, ocr_tag, page_offset, text_line_scan, vendor_guess, template_match, summary_block, fallback_values, nearest_band, nearest_header, midpoint_columns, gap_columns,
    carry_forward, continuation_merge, total_rows, ledger_entries, bill_export_rows, json_export, audit_tail, audit_events, props_json, ai_guard,
)
