"""The registered queries: each applies operators to the driver's tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import checks
from tallyforge.plans.bills import bill_lines, bills, table

#: The day on which rules look at dates.
AS_OF = datetime.date(1998, 6, 1)
#: A limit above the longest text.
ALL = 2**31 - 1


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    return checks.validate(bills(spark, sf))


def validate_bills(spark, sf):
    return _validated(spark, sf).select("doc_id", "tax", "validation_ok", "confidence", F.concat_ws("; ", "validation_notes").alias("notes"))


def validation_status(spark, sf):
    """Counts of bills by outcome: the smallest real answer."""
    return _validated(spark, sf).groupBy("validation_ok", "confidence").agg(F.count("*").alias("n"), F.sum("total").cast("decimal(18,2)").alias("total"))


def _printed_lines(spark, sf):
    """What the documents print: a subtotal, a tax line and a total, off by nothing, 0.80 or 50."""
    k = F.col("l_orderkey") % 4
    total = F.col("line_sum") + F.col("tax_sum") + F.when(k == 1, F.lit("0.80")).when(k == 0, F.lit("50.00")).otherwise(F.lit("0.00")).cast("decimal(18,2)")
    text = lambda label, v: F.concat(F.lit(label), v.cast("decimal(18,2)").cast("string"))
    lines = F.array(F.lit("Invoice"), text("Sub Total: ", F.col("line_sum")), text("Total tax ", F.col("tax_sum")), F.when(F.col("l_orderkey") % 9 != 0, text("Grand Total USD ", total)).otherwise(text("TOTAL ", total)))
    return bills(spark, sf).select("doc_id", F.posexplode(lines).alias("line_no", "text"))


def printed_totals(spark, sf):
    return checks.printed_figures(_printed_lines(spark, sf))


def reconcile_bills(spark, sf):
    out = checks.reconcile(_validated(spark, sf), checks.printed_figures(_printed_lines(spark, sf)))
    return out.select("doc_id", "printed_total", "printed_subtotal", "printed_tax", "line_items_sum", "total_match", "subtotal_match", "tax_match", "lines_reconcile", "status", "notes")


def _rule_input(spark, sf):
    df = bills(spark, sf)
    one = F.create_map(F.lit("description"), F.lit("goods"), F.lit("quantity"), F.col("n_lines").cast("string"), F.lit("unit_price"), F.col("line_sum").cast("string"), F.lit("tax_rate"), F.col("max_rate").cast("string"))
    extra = F.when(F.col("l_suppkey") % 3 == 0, F.create_map(F.lit("Bill_To"), F.col("bill_to"), F.lit("GSTIN"), F.lit("X1"))).otherwise(F.create_map(F.lit("cgst"), F.col("tax_sum").cast("string"), F.lit("sgst"), F.col("tax_sum").cast("string")))
    return df.withColumns({"lines": F.array(one), "extra": extra, "template_id": F.concat(F.lit("v"), F.col("l_suppkey") % 2)})


def rules_default(spark, sf):
    return checks.apply_rules(_rule_input(spark, sf), {"max_total": 50000, "min_total": 1000, "date_max_age_days": 2000}, AS_OF).select("doc_id", F.concat_ws("; ", "rule_failures").alias("failures"))


def rules_strict(spark, sf):
    return checks.apply_rules(_rule_input(spark, sf), checks.STRICT, AS_OF).select("doc_id", F.concat_ws("; ", "rule_failures").alias("failures"))


def rules_by_vendor(spark, sf):
    out = checks.apply_vendor_rules(_rule_input(spark, sf), {"v1": {"require_total": False, "require_subtotal": True, "regex": {"invoice_number": r"INV-\d{1,3}-\d+"}}}, AS_OF)
    return out.select("doc_id", F.concat_ws("; ", "rule_failures").alias("failures"))


def _batch(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("source_file"), F.col("source").alias("vendor"), F.concat(F.lit("N "), F.col("doc_id") % 997).alias("invoice_number"),
        F.substring(F.sha2("text", 256), 1, 16).alias("file_hash"), F.col("doc_id").alias("batch_pos"),
    )


def dup_in_batch(spark, sf):
    none = _batch(spark, sf).limit(0).withColumns({"processed_at": F.lit(""), "history_seq": F.col("batch_pos")})
    return checks.check_duplicates(_batch(spark, sf), none).select("source_file", "file_hash", "duplicate_of", "duplicate_note")


def dup_vs_history(spark, sf):
    bill = bills(spark, sf).select("source_file", "vendor", "invoice_number", F.substring(F.sha2(F.concat_ws("|", "vendor", F.col("total").cast("string")), 256), 1, 16).alias("file_hash"), "invoice_date", "l_orderkey", "l_suppkey")
    pos = F.col("l_orderkey") * 100000 + F.col("l_suppkey")
    old = bill.where("invoice_date < '1995-01-01'").select("source_file", "vendor", "invoice_number", "file_hash", F.col("invoice_date").alias("processed_at"), pos.alias("history_seq"))
    new = bill.where("invoice_date >= '1995-01-01' or invoice_date is null").select("source_file", "vendor", F.col("invoice_number"), "file_hash", pos.alias("batch_pos"))
    return checks.check_duplicates(new, old).select("source_file", "duplicate_of", "duplicate_note")


def line_math(spark, sf):
    rows = bill_lines(spark, sf).select("doc_id", "pos", "l_partkey", F.col("quantity").cast("decimal(18,2)").cast("string").alias("quantity"), (F.floor(F.col("price").cast("double") * 100 / F.col("quantity")) / 100).cast("decimal(18,2)").cast("string").alias("rate"), F.when(F.col("pos") % 3 == 0, F.col("amount")).otherwise(F.col("price")).cast("string").alias("taxable_value"))
    return checks.line_maths(rows)


def derive_totals(spark, sf):
    rows = bill_lines(spark, sf).withColumn("gross", (F.col("amount") + F.col("tax_amount")).cast("decimal(18,2)"))
    return checks.derive_totals(rows, ["doc_id"], {"subtotal": "amount", "total": "gross"}, {"tax": ("total", "subtotal")})


def batch_kpis(spark, sf):
    df = checks.apply_rules(checks.validate(_rule_input(spark, sf)), {}, AS_OF)
    return checks.batch_kpis(df.withColumns({"duplicate_note": F.when(F.col("l_orderkey") % 7 == 0, "x").otherwise(""), "ocr_used": F.col("l_suppkey") % 5 == 0}))


# -- scalars


def parse_number(spark, sf):
    t = F.col("text")
    raw = F.concat(F.lit("Rs. "), F.col("doc_id") * 1237, F.lit(",5"), F.col("n_chars") % 10, F.when(F.col("doc_id") % 3 == 0, ".75").when(F.col("doc_id") % 3 == 1, "-").otherwise(".1.2"))
    return table(spark, sf, "documents").select("doc_id", S.to_number(raw).alias("n"), S.to_unsigned(raw).alias("u"), F.size(S.amounts(t)).alias("n_amounts"), S.last_figure(t).alias("last_figure"))


def normalize_dates(spark, sf):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 9
    raw = (
        F.when(k == 0, F.date_format(d, "dd-MMM-yyyy")).when(k == 1, F.date_format(d, "d/M/yyyy")).when(k == 2, F.date_format(d, "MMMM d, yyyy")).when(k == 3, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 4, F.date_format(d, "dd MMM yyyy")).when(k == 5, F.date_format(d, "d-M-yyyy")).when(k == 6, F.concat(F.lit("on "), F.date_format(d, "dd-MM-yyyy"))).when(k == 7, "").otherwise(F.date_format(d, "dd/MM/yy"))
    )
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", S.iso_date(F.col("raw")).alias("iso"), S.dmy_date(F.col("raw")).alias("dmy"), S.rule_date(F.col("raw")).alias("rule_date"))


def id_confidence(spark, sf):
    k, n = F.col("o_orderkey") % 8, F.col("o_orderkey").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit(" INV-"), n)).when(k == 1, n).when(k == 2, F.concat(F.lit("98"), F.lpad(n, 9, "7"))).when(k == 3, F.date_format("o_orderdate", "dd-MMM-yy"))
        .when(k == 4, F.col("o_orderpriority")).when(k == 5, F.lit("Dated")).when(k == 6, F.lit("")).otherwise(F.concat(F.lit("#"), n))
    )
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", F.trim("raw").alias("cleaned"), S.invoice_number_confidence(F.col("raw")).alias("invoice_confidence"), S.order_number_confidence(F.col("raw")).alias("order_confidence"))


def scrub_text(spark, sf):
    raw = F.concat(F.col("text"), F.lit(" api_key = zz"), F.col("conv_id"), F.lit(" Bearer abc sk-"), F.col("conv_id"), F.lit("12345678"))
    return table(spark, sf, "conversations").select("conv_id", "turn", S.scrub(raw, ALL).alias("scrubbed"), S.mask_key(F.col("text")).alias("masked"), S.slugify(F.col("text")).alias("slug"))


def redact(spark, sf):
    return S.redacted(table(spark, sf, "documents").select("doc_id", "text"), "text", "redacted", "n_redacted").select("doc_id", "redacted", "n_redacted")


def clean_labels(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", S.norm_label(t).alias("label"), S.norm_header(t).alias("header"), S.strip_doubt(F.concat(F.lit("[?"), t, F.lit("?]"))).alias("undoubted"), S.xml_escape(t).alias("xml"), S.safe_filename(F.concat(F.lit("in/"), t, F.lit(".pdf"))).alias("filename"))


def summary_filter(spark, sf):
    d = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("Grand Total "), F.col("p_name"))).when(F.col("p_partkey") % 6 == 1, F.lit(" N/A")).when(F.col("p_partkey") % 6 == 2, F.concat(F.lit("Totally "), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", S.is_summary_row(d).alias("is_summary"), d.rlike(S.SUMMARY_LINE).alias("is_summary_line"))


CHECKS = (
    validate_bills, validation_status, printed_totals, reconcile_bills, rules_default, rules_strict, rules_by_vendor, dup_in_batch, dup_vs_history, line_math, derive_totals, batch_kpis,
    parse_number, normalize_dates, id_confidence, scrub_text, redact, clean_labels, summary_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tallyforge.plans.document_queries import DOCUMENTS
    from tallyforge.plans.more_queries import MORE
    from tallyforge.plans.table_queries import TABLES

    return {f.__name__: f for f in (*CHECKS, *MORE, *DOCUMENTS, *TABLES)}
