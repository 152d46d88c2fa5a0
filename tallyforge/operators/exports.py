"""Shapes in which results leave: totals rows, ledger entries, bill rows, JSON, wide sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import xml_escape

BASE_COLUMNS = ("source_file", "vendor", "invoice_number", "invoice_date", "po_number", "subtotal", "tax", "total")
TAIL_COLUMNS = ("confidence", "validation_ok", "validation_notes", "rule_failures", "duplicate_note")
TAXES = ("cgst", "sgst", "igst", "cess", "vat")


def with_totals(lines: DataFrame, doc: str, pos: str, label: str, sums: tuple[str, ...]) -> DataFrame:
    """Lines and, for each document that has any, a TOTAL row; is_total is 0 or 1. One pass, grouping sets.

    ``pos`` tells the lines of a document apart.
    """
    keep = [c for c in lines.columns if c not in (doc, pos, label, *sums)]
    view = lines.select(doc, pos, label, *keep, *sums)
    view.createOrReplaceTempView("_lines_with_totals")
    spark = lines.sparkSession
    rest = "".join(f", CASE WHEN grouping({pos}) = 0 THEN first({c}) END AS {c}" for c in keep)
    total = "".join(f", CASE WHEN grouping({pos}) = 0 THEN first({c}) ELSE round(sum({c}), 2) END AS {c}" for c in sums)
    return spark.sql(
        f"SELECT {doc}, {pos}, CASE WHEN grouping({pos}) = 1 THEN 'TOTAL' ELSE first({label}) END AS {label}{rest}{total}, cast(grouping({pos}) AS int) AS is_total "
        f"FROM _lines_with_totals GROUP BY GROUPING SETS (({doc}, {pos}), ({doc}))"
    )


def tax_components(invoices: DataFrame) -> Column:
    """The tax entries of ``extra`` (map of text), whatever their case, as upper-case name -> amount."""
    named = F.map_filter("extra", lambda k, v: F.lower(k).isin(*TAXES) & v.try_cast("double").isNotNull())
    return F.transform(F.map_entries(named), lambda e: F.struct(F.upper(e["key"]).alias("name"), e["value"].try_cast("decimal(18,2)").alias("amount")))


def ledger_entries(invoices: DataFrame) -> DataFrame:
    """Three rows or more an invoice: the party's credit, the purchase's debit, a debit per tax component."""
    zero = F.lit(0).cast("decimal(18,2)")
    total = F.coalesce(F.col("total").cast("decimal(18,2)"), zero)
    entry = lambda name, positive, amount: F.struct(name.alias("ledger"), F.lit(positive).alias("deemed_positive"), amount.cast("decimal(18,2)").alias("amount"))
    parts = tax_components(invoices) if "extra" in invoices.columns else F.array().cast("array<struct<name:string,amount:decimal(18,2)>>")
    parts = F.coalesce(parts, F.array().cast("array<struct<name:string,amount:decimal(18,2)>>"))
    single = F.when(F.coalesce(F.col("tax"), F.lit(0)) != 0, F.array(entry(F.lit("Input Tax"), "Yes", -F.col("tax")))).otherwise(F.array().cast("array<struct<ledger:string,deemed_positive:string,amount:decimal(18,2)>>"))
    taxes = F.when(F.size(parts) > 0, F.transform(parts, lambda t: entry(t["name"], "Yes", -t["amount"]))).otherwise(single)
    vendor = F.coalesce(F.nullif("vendor", F.lit("")), F.lit("Unknown Supplier"))
    every = F.concat(F.array(entry(vendor, "No", total), entry(F.lit("Purchase Accounts"), "Yes", -F.coalesce(F.col("subtotal").cast("decimal(18,2)"), total))), taxes)
    return invoices.select("doc_id", F.posexplode(every).alias("entry_no", "e")).select("doc_id", "entry_no", "e.*")


def vouchers(invoices: DataFrame) -> DataFrame:
    """(doc_id, xml): one purchase voucher an invoice. The date is written from a real date where it is one."""
    entries = ledger_entries(invoices).withColumn("x", F.concat(
        F.lit("<ALLLEDGERENTRIES.LIST><LEDGERNAME>"), xml_escape(F.col("ledger")), F.lit("</LEDGERNAME><ISDEEMEDPOSITIVE>"), F.col("deemed_positive"), F.lit("</ISDEEMEDPOSITIVE><AMOUNT>"), F.col("amount").cast("string"), F.lit("</AMOUNT></ALLLEDGERENTRIES.LIST>"),
    ))
    joined = entries.groupBy(F.col("doc_id").alias("_d")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "x"))), lambda e: e["x"]), "\n").alias("_x"))
    number = xml_escape(F.coalesce("invoice_number", F.lit("")))
    date = F.coalesce(F.date_format(F.try_to_timestamp("invoice_date", F.lit("yyyy-MM-dd")), "yyyyMMdd"), F.date_format(F.try_to_timestamp("invoice_date", F.lit("dd-MMM-yyyy")), "yyyyMMdd"), F.replace(F.coalesce("invoice_date", F.lit("")), F.lit("-"), F.lit("")))
    body = F.concat(
        F.lit('<TALLYMESSAGE xmlns:UDF="TallyUDF"><VOUCHER VCHTYPE="Purchase" ACTION="Create" OBJVIEW="Invoice Voucher View"><DATE>'), date, F.lit("</DATE><REFERENCE>"), number, F.lit("</REFERENCE><VOUCHERTYPENAME>Purchase</VOUCHERTYPENAME><VOUCHERNUMBER>"), number,
        F.lit("</VOUCHERNUMBER><PARTYLEDGERNAME>"), xml_escape(F.coalesce(F.nullif("vendor", F.lit("")), F.lit("Unknown Supplier"))), F.lit("</PARTYLEDGERNAME><PERSISTEDVIEW>Invoice Voucher View</PERSISTEDVIEW>"), F.col("_x"), F.lit("</VOUCHER></TALLYMESSAGE>"),
    )
    return invoices.join(joined, F.col("doc_id") == F.col("_d")).select("doc_id", body.alias("xml"))


def bill_rows(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """One row a line with the header repeated, one row for invoices without lines; 14 columns.

    lines: doc_id, pos, cols (map of text). A key that is there wins even if its value is null.
    """
    held = lines.select(F.col("doc_id").alias("_d"), "pos", "cols")
    df = invoices.join(held, F.col("doc_id") == F.col("_d"), "left")
    c = F.coalesce("cols", F.create_map().cast("map<string,string>"))
    text = lambda v: F.coalesce(v.cast("string"), F.lit(""))
    get = lambda a, b=None: F.when(F.map_contains_key(c, F.lit(a)), F.try_element_at(c, F.lit(a))).otherwise(F.try_element_at(c, F.lit(b)) if b else F.lit(None).cast("string"))
    extra = lambda k, d: F.when(F.map_contains_key(F.coalesce("extra", F.create_map().cast("map<string,string>")), F.lit(k)), F.try_element_at("extra", F.lit(k))).otherwise(F.lit(d))
    return df.select(
        "doc_id", "pos", text(F.col("invoice_number")).alias("bill_no"), text(F.col("vendor")).alias("supplier"), text(F.col("invoice_date")).alias("bill_date"), text(extra("due_date", "")).alias("due_date"), text(F.col("po_number")).alias("po_number"),
        text(get("description")).alias("item_description"), text(get("quantity")).alias("qty"), text(get("rate", "unit_price")).alias("rate"), text(get("taxable_value", "amount")).alias("amount"), text(get("tax_amount", "cgst")).alias("tax_amount"),
        text(F.col("subtotal")).alias("bill_subtotal"), text(F.col("tax")).alias("bill_tax"), text(F.col("total")).alias("bill_total"), text(extra("currency", "INR")).alias("currency"),
    )


def to_json(invoices: DataFrame) -> DataFrame:
    """(doc_id, json): nulls are kept, keys that begin with ``_`` are not."""
    fields = [F.col(c) for c in invoices.columns if c != "extra" and not c.startswith("_")]
    if "extra" in invoices.columns:
        fields.append(F.map_filter("extra", lambda k, v: ~F.startswith(k, F.lit("_"))).alias("extra"))
        fields.append(F.map_from_entries(tax_components(invoices)).alias("taxes"))
    return invoices.select("doc_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def key_order(invoices: DataFrame, entries: str = "extra", order: str = "batch_pos") -> list[str]:
    """Names of a map column in the order of first sight. One row a name comes to the driver."""
    keys = invoices.select(order, F.posexplode(F.map_keys(entries)).alias("place", "key")).where("not startswith(key, '_')")
    first = keys.groupBy("key").agg(F.min(F.struct(order, "place")).alias("at")).orderBy("at", "key")
    return [r.key for r in first.collect()]


def wide_invoices(invoices: DataFrame, order: str = "batch_pos") -> DataFrame:
    """Base columns, one column a name in ``extra``, tail columns. A name in extra shadows a base column."""
    keys = key_order(invoices, "extra", order)
    entry = lambda k: F.try_element_at("extra", F.lit(k))

    def value(c: str) -> Column:
        if c == "validation_ok":
            return F.when(F.col(c), "OK").otherwise("CHECK").alias(c)
        if c in ("validation_notes", "rule_failures"):
            return F.array_join(c, "; ").alias(c)
        own = F.col(c).cast("string")
        return (F.when(F.map_contains_key("extra", F.lit(c)), entry(c)).otherwise(own) if c in keys else own).alias(c)

    extra = [entry(k).alias(k) for k in keys if k not in (*BASE_COLUMNS, *TAIL_COLUMNS)]
    return invoices.select(*(value(c) for c in BASE_COLUMNS), *extra, *(value(c) for c in TAIL_COLUMNS))


def wide_lines(lines: DataFrame, order: str = "batch_pos") -> DataFrame:
    """(…, cols map) -> one column a name, description first."""
    keys = key_order(lines, "cols", order)
    keys = ["description"] * ("description" in keys) + [k for k in keys if k != "description"]
    return lines.select(*(c for c in lines.columns if c != "cols"), *(F.try_element_at("cols", F.lit(k)).alias(k) for k in keys))


def summable(columns: list[dict], explicit: list[str] | None = None) -> list[str]:
    """Line columns whose sum means something: money, but neither per unit nor a percentage."""
    if explicit is not None:
        return list(explicit)
    unit = {"rate", "unit_price", "price", "unit_rate", "mrp", "unit_cost"}
    return [c["name"] for c in columns if c.get("type") == "money" and c["name"].lower() not in unit and not any(x in c["name"].lower() for x in ("pct", "percent"))]
