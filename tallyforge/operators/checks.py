"""Checks of invoices: arithmetic, printed totals, business rules, duplicates, line maths.

Every check is one projection or one join over whole tables of invoices. Three-valued logic is kept: what
cannot be compared is null, and only false fails.
"""

from __future__ import annotations

import datetime
import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalars import amounts, duplicate_key, rule_date, to_unsigned

#: Slack of sums within an invoice, and against printed figures.
TOLERANCE, PRINTED_TOLERANCE = "0.02", "1.5"
D = "decimal(18,2)"


def _listed(*notes: Column) -> Column:
    return F.array_compact(F.array(*notes))


def validate(invoices: DataFrame) -> DataFrame:
    """Adds tax (inferred if it was missing), validation_notes, validation_ok, confidence.

    Needs invoice_number, invoice_date, subtotal, tax, total, line_sum, n_lines.
    """
    sub, total, lines = (F.col(c).cast(D) for c in ("subtotal", "total", "line_sum"))
    tax = F.coalesce(F.col("tax").cast(D), (total - sub).cast(D))
    near = lambda a, b: F.abs(a - b) <= F.lit(TOLERANCE).cast("decimal(4,2)")
    missing = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit("Missing " + c.replace("_", " "))) for c in ("invoice_number", "invoice_date", "total")]
    shown = F.concat_ws(" / ", sub.cast("string"), total.cast("string"))
    fits = F.coalesce(near(lines, sub), F.lit(False)) | F.coalesce(near(lines, total), F.lit(False))
    bad_lines = F.when((F.col("n_lines") > 0) & (sub.isNotNull() | total.isNotNull()) & ~fits, F.concat(F.lit("Line items sum to "), lines.cast("string"), F.lit(", expected "), shown))
    zero = F.coalesce(tax, F.lit(0).cast(D))
    bad_sum = F.when(~near(sub + zero, total), F.concat(F.lit("Subtotal "), sub.cast("string"), F.lit(" + tax "), zero.cast("string"), F.lit(" != total "), total.cast("string")))
    lost = sum((F.when(m.isNotNull(), 15).otherwise(0) for m in missing), F.lit(0)) + F.when(bad_lines.isNotNull(), 25).otherwise(0) + F.when(bad_sum.isNotNull(), 25).otherwise(0)
    notes = _listed(*missing, bad_lines, bad_sum)
    return invoices.withColumns({"validation_notes": notes, "validation_ok": F.size(notes) == 0, "confidence": F.greatest(100 - lost, F.lit(0)) / 100.0, "tax": tax})


# -- printed figures

#: Labels of printed totals.
TOTAL_LABELS = ("invoice total", "grand total", "total payable", "amount payable", "total due", "net payable", "total amount", "balance due")
NOT_TOTAL = ("sub total", "subtotal", "taxable", "tax", "before")
SUBTOTAL_LABELS = ("sub total", "subtotal", "taxable value", "taxable amount", "total before tax", "amount before tax", "net amount", "net total", "total (excl")


def _has(text: Column, labels: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for label in labels:
        out = out | F.contains(text, F.lit(label))
    return out


def printed_figures(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, text) -> printed_total, printed_subtotal per document.

    A figure is the rightmost amount of the first line that has the label and an amount.
    """
    low, last = F.lower("text"), F.try_element_at(amounts(F.col("text")), F.lit(-1))
    rows = lines.where(F.trim("text") != "").select("doc_id", "line_no", low.alias("low"), last.alias("v"))
    first = lambda when: F.min_by("v", F.when(when & F.col("v").isNotNull(), F.col("line_no")))
    plain = _has(F.col("low"), ("total",)) & ~_has(F.col("low"), NOT_TOTAL)
    return rows.groupBy("doc_id").agg(
        first(_has(F.col("low"), TOTAL_LABELS)).alias("_specific"), first(plain).alias("_plain"), first(_has(F.col("low"), SUBTOTAL_LABELS)).alias("printed_subtotal"),
    ).select("doc_id", F.coalesce("_specific", "_plain").cast(D).alias("printed_total"), F.col("printed_subtotal").cast(D).alias("printed_subtotal"))


def printed_amounts(lines: Column) -> Column:
    """An array of lines -> those with an amount: their text in lower case, and the rightmost amount."""
    rows = F.transform(lines, lambda s: F.struct(s.alias("s"), F.try_element_at(amounts(s), F.lit(-1)).alias("v")))
    return F.transform(F.filter(rows, lambda r: r["v"].isNotNull()), lambda r: F.struct(F.lower(r["s"]).alias("low"), r["v"].alias("v")))


def _first_printed(rows: str, when) -> Column:
    return F.get(F.filter(rows, lambda r: when(r["low"])), F.lit(0))["v"].cast(D)


def printed_total(rows: str) -> Column:
    """As ``printed_figures`` finds it, over ``printed_amounts`` of one document."""
    return F.coalesce(_first_printed(rows, lambda s: _has(s, TOTAL_LABELS)), _first_printed(rows, lambda s: _has(s, ("total",)) & ~_has(s, NOT_TOTAL)))


def printed_subtotal(rows: str) -> Column:
    return _first_printed(rows, lambda s: _has(s, SUBTOTAL_LABELS))


def reconcile(invoices: DataFrame, printed: DataFrame) -> DataFrame:
    """Validated invoices against printed figures: a row per invoice with matches, status and notes."""
    ours = invoices.select(*invoices.columns)
    df = ours.join(printed.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    slack = F.lit(PRINTED_TOLERANCE).cast("decimal(4,1)")
    near = lambda a, b: F.abs(a - b) <= slack
    total, sub, tax = (F.col(c).cast(D) for c in ("total", "subtotal", "tax"))
    lines = F.when(F.col("n_lines") > 0, F.coalesce(F.col("line_sum").cast(D), F.lit(0).cast(D)))
    pt, ps = F.col("printed_total"), F.col("printed_subtotal")
    df = df.withColumns({
        "printed_tax": (pt - ps).cast(D), "extracted_total": total, "extracted_subtotal": sub, "extracted_tax": tax, "line_items_sum": lines,
        "total_match": near(pt, total), "subtotal_match": near(ps, sub), "tax_match": near((pt - ps).cast(D), tax),
        "lines_reconcile": F.when(lines.isNotNull() & (pt.isNotNull() | ps.isNotNull()), F.coalesce(near(lines, pt), F.lit(False)) | F.coalesce(near(lines, ps), F.lit(False))),
    })
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    notes = _listed(
        F.when(pt.isNull(), F.lit("couldn't find a printed grand total to compare against")),
        F.when(~F.col("total_match"), F.concat(F.lit("extracted total "), s("extracted_total"), F.lit(" != printed "), s("printed_total"), F.lit(" (diff "), (total - pt).cast(D).cast("string"), F.lit(")"))),
        F.when(~F.col("subtotal_match"), F.concat(F.lit("extracted subtotal "), s("extracted_subtotal"), F.lit(" != printed "), s("printed_subtotal"))),
        F.when(~F.col("lines_reconcile"), F.concat(F.lit("sum of line totals "), s("line_items_sum"), F.lit(" matches neither printed subtotal ("), s("printed_subtotal"), F.lit(") nor total ("), s("printed_total"), F.lit(") - a line may be missing or misread"))),
        F.when(~F.col("validation_ok"), F.lit("failed internal arithmetic check")),
    )
    failed = F.coalesce(~F.col("total_match"), F.lit(False)) | F.coalesce(~F.col("subtotal_match"), F.lit(False)) | F.coalesce(~F.col("lines_reconcile"), F.lit(False))
    return df.withColumns({"status": F.when(pt.isNotNull() & ~failed & F.col("validation_ok"), "OK").otherwise("REVIEW"), "notes": F.concat_ws("; ", notes)})


# -- business rules

#: Names under which invoices carry the same thing, on the header and on lines.
ALIASES = {
    "invoice_number": ("invoice_number", "bill_number", "order_number", "receipt_number", "bill_no", "order_no", "invoice_no", "voucher_number"),
    "bill_from": ("vendor", "supplier", "supplier_name", "bill_from", "seller", "store", "merchant", "supplier_gstin", "supplier_address"),
    "bill_to": ("bill_to", "billed_to", "customer", "customer_name", "buyer", "ship_to", "consignee", "customer_gstin", "recipient"),
    "tax_id": ("supplier_gstin", "gstin", "gst_number", "customer_gstin", "vat_number", "tax_id", "tin", "abn", "ein"),
    "regulatory": ("hsn_sac", "pan", "cin", "place_of_supply", "state_code", "reverse_charge", "irn", "eway_bill", "lut"),
    "cgst": ("cgst", "cgst_amount", "cgst_amt"), "sgst": ("sgst", "sgst_amount", "sgst_amt", "utgst"), "igst": ("igst", "igst_amount", "igst_amt"),
}
LINE_ALIASES = {
    "description": ("description", "particulars", "item", "details", "product"), "quantity": ("quantity", "qty", "units", "nos"),
    "unit_rate": ("unit_rate", "rate", "unit_price", "price", "mrp", "unit_cost"), "amount": ("amount", "total", "line_total", "taxable_value", "value"),
}
RATE_KEYS = ("gst_pct", "tax_rate", "igst_pct", "rate_pct", "gst_rate")
#: Profiles. A profile overlays the default key by key.
DEFAULT = {
    "required": ["invoice_date"], "require_any": [["invoice_number", "bill_number", "order_number", "receipt_number"]], "require_bill_from": True, "require_bill_to": False,
    "require_tax_id": False, "require_regulatory": False, "require_line_fields": ["description"], "require_tax_breakup": False, "require_subtotal": False, "require_total": True,
    "regex": {}, "max_total": None, "min_total": None, "date_not_future": True, "date_max_age_days": None, "allowed_tax_rates": None, "require_line_items": True,
}
STRICT = {
    "required": ["invoice_date"], "require_any": [["invoice_number", "bill_number", "order_number"]], "require_bill_from": True, "require_bill_to": True, "require_tax_id": True,
    "require_regulatory": True, "require_line_fields": ["description", "quantity", "unit_rate"], "require_tax_breakup": True, "require_subtotal": True, "require_total": True,
    "allowed_tax_rates": [0, 0.25, 3, 5, 12, 18, 28],
}
LIGHT = {
    "required": [], "require_any": [["invoice_number", "bill_number", "order_number", "receipt_number"]], "require_bill_from": True, "require_line_fields": ["description"],
    "require_total": True, "require_line_items": True, "date_not_future": True,
}
CORE = ("vendor", "invoice_number", "invoice_date", "po_number", "subtotal", "tax", "total", "cgst", "sgst", "igst", "taxable_value", "source_file")


#: A profile as a row; ``require_any`` holds groups of which one name is enough.
PROFILE = (
    "struct<required:array<string>,require_any:array<array<string>>,require_bill_from:boolean,require_bill_to:boolean,require_tax_id:boolean,require_regulatory:boolean,"
    "require_line_fields:array<string>,require_tax_breakup:boolean,require_subtotal:boolean,require_total:boolean,regex:map<string,string>,max_total:double,min_total:double,"
    "date_not_future:boolean,date_max_age_days:int,allowed_tax_rates:array<double>,require_line_items:boolean>"
)


def _present(value: Column) -> Column:
    return value.isNotNull() & (value.cast("string") != "")


def _named(invoices: DataFrame) -> DataFrame:
    """Adds what the rules look at, once for all of them: _own (name, value) of columns, then of ``extra`` whatever its
    case; _names of these; _inner, the names in ``extra`` and on lines as one text."""
    own = [F.struct(F.lit(c).alias("key"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("value")) for c in CORE if c in invoices.columns]
    own = F.filter(F.array(*own), lambda e: e["value"].isNotNull())
    inner = F.array().cast("array<string>")
    if "extra" in invoices.columns:
        extra = F.transform(F.filter(F.map_entries(F.coalesce("extra", F.create_map().cast("map<string,string>"))), lambda e: _present(e["value"])), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].cast("string").alias("value")))
        own = F.concat(own, extra)
        inner = F.filter(F.transform(extra, lambda e: e["key"]), lambda k: ~F.startswith(k, F.lit("_")))
    if "lines" in invoices.columns:
        on_lines = F.flatten(F.transform(F.coalesce("lines", F.array().cast("array<map<string,string>>")), lambda line: F.transform(F.filter(F.map_entries(line), lambda e: _present(e["value"])), lambda e: F.lower(e["key"]))))
        inner = F.concat(inner, F.array_distinct(on_lines))
    df = invoices.withColumns({"_own": own, "_inner": F.array_join(inner, "\n")})
    return df.withColumn("_names", F.transform("_own", lambda e: e["key"]))


def _alias(group: str) -> Column:
    names = ALIASES[group]
    return F.arrays_overlap("_names", F.array(*map(F.lit, names))) | _has(F.col("_inner"), names)


def _every_line(names: Column) -> Column:
    """Each line says something under one of the names."""
    said = lambda line, n: F.coalesce(~F.trim(F.try_element_at(line, n)).isin("", "None"), F.lit(False))
    return F.coalesce((F.size("lines") > 0) & F.forall("lines", lambda line: F.exists(names, lambda n: said(line, n))), F.lit(False))


def overlay(*profiles: dict[str, Any]) -> dict[str, Any]:
    """The default with profiles on top; a key that a profile sets is replaced whole."""
    out = dict(DEFAULT)
    for p in profiles:
        out.update(p or {})
    return out


def _failures(p: Column, as_of: datetime.date) -> Column:
    """What fails by profile ``p`` (see PROFILE), in the order of the checks; over the columns of ``_named``."""
    flag = lambda name, bad, text: F.when(p[name] & bad, F.lit(text) if isinstance(text, str) else text)
    value = lambda name: F.try_element_at(F.filter("_own", lambda e: e["key"] == name), F.lit(1))["value"]
    lines = F.create_map(*(x for k, names in LINE_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, names)))))
    missing = F.transform(F.filter(p["required"], lambda f: ~F.array_contains("_names", f)), lambda f: F.concat(F.lit("missing required field '"), f, F.lit("'")))
    no_id = F.transform(F.filter(p["require_any"], lambda g: ~F.arrays_overlap("_names", g)), lambda g: F.concat(F.lit("missing an identifier - need one of: "), F.array_join(g, " / ")))
    no_cell = F.filter(p["require_line_fields"], lambda c: ~_every_line(F.coalesce(F.try_element_at(lines, c), F.array(c))))
    odd = F.filter(F.map_entries(p["regex"]), lambda e: value(e["key"]).isNotNull() & ~F.rlike(F.trim(value(e["key"])), F.concat(F.lit("^(?:"), e["value"], F.lit(")$"))))
    total, shown = F.col("total"), F.format_number(F.col("total"), 2)
    d, today = F.col("_day"), F.lit(as_of)

    def rate(line: Column) -> Column:
        cell = lambda k: F.try_element_at(line, F.lit(k)).try_cast("double")
        return F.coalesce(*(F.when(~F.array_contains(p["allowed_tax_rates"], cell(k)), cell(k)) for k in RATE_KEYS))

    rates = F.transform("lines", lambda line, i: F.when(rate(line).isNotNull(), F.concat(F.lit("line "), (i + 1).cast("string"), F.lit(": tax rate "), rate(line).cast("string"), F.lit("% is not an allowed rate"))))
    return F.concat(
        missing, no_id,
        _listed(
            flag("require_bill_from", ~_alias("bill_from"), "no supplier / 'bill from' details found"), flag("require_bill_to", ~_alias("bill_to"), "no customer / 'bill to' details found"),
            flag("require_tax_id", ~_alias("tax_id"), "no GST/VAT/tax registration number found"), flag("require_regulatory", ~_alias("regulatory"), "no regulatory details found (HSN/SAC, PAN, CIN, place of supply...)"),
        ),
        F.transform(no_cell, lambda c: F.concat(F.lit("line items are missing '"), c, F.lit("'"))),
        _listed(
            flag("require_tax_breakup", ~((_alias("cgst") & _alias("sgst")) | _alias("igst")), "no tax breakup found - expected CGST + SGST, or IGST"),
            flag("require_subtotal", F.col("subtotal").isNull(), "no sub total found"), flag("require_total", total.isNull(), "no invoice total found"),
        ),
        F.transform(odd, lambda e: F.concat(F.lit("'"), e["key"], F.lit("' ("), value(e["key"]), F.lit(") doesn't match the expected format"))),
        _listed(
            F.when(total > p["max_total"], F.concat(F.lit("total "), shown, F.lit(" exceeds the approval threshold "), F.format_number(p["max_total"], 2))),
            F.when(total < p["min_total"], F.concat(F.lit("total "), shown, F.lit(" is below the minimum "), F.format_number(p["min_total"], 2))),
            flag("date_not_future", d > today, F.concat(F.lit("invoice date "), d.cast("string"), F.lit(" is in the future"))),
            F.when(F.datediff(today, d) > p["date_max_age_days"], F.concat(F.lit("invoice is older than "), p["date_max_age_days"].cast("string"), F.lit(" days (dated "), d.cast("string"), F.lit(")"))),
            F.when(d.isNull() & _present(F.col("invoice_date")), F.concat(F.lit("invoice date '"), F.col("invoice_date"), F.lit("' couldn't be understood"))),
            flag("require_line_items", F.coalesce(F.size("lines"), F.lit(0)) <= 0, "no line items were extracted"),
        ),
        F.when(F.size(p["allowed_tax_rates"]) > 0, F.array_compact(F.coalesce(rates, F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>")),
    )


def _row(p: dict[str, Any]) -> tuple:
    """A profile as a row of PROFILE."""
    number = lambda k, kind: None if p[k] is None else kind(p[k])
    return (
        list(p["required"] or []), [list(g) for g in p["require_any"] or []], *(bool(p[f"require_{k}"]) for k in ("bill_from", "bill_to", "tax_id", "regulatory")), list(p["require_line_fields"] or []),
        *(bool(p[f"require_{k}"]) for k in ("tax_breakup", "subtotal", "total")), dict(p["regex"] or {}), number("max_total", float), number("min_total", float), bool(p["date_not_future"]),
        number("date_max_age_days", int), [float(x) for x in p["allowed_tax_rates"] or []], bool(p["require_line_items"]),
    )


def _judged(invoices: DataFrame, profiles: dict[str, dict[str, Any]], default: dict[str, Any], key: Column, as_of: datetime.date) -> DataFrame:
    """Profiles are rows, joined by key; the default is a constant. One set of checks serves all."""
    named = _named(invoices).withColumn("_profile", F.lit(None).cast(PROFILE))
    if profiles:
        known = invoices.sparkSession.createDataFrame([(name, _row(p)) for name, p in sorted(profiles.items())], f"_key string, _own_profile {PROFILE}")
        known = F.broadcast(known) if len(profiles) <= 50_000 else known  # a kilobyte a row
        named = named.join(known, key == F.col("_key"), "left").withColumn("_profile", F.col("_own_profile"))
    names = re.findall(r"(\w+):", PROFILE)
    other = F.from_json(F.lit(json.dumps(dict(zip(names, _row(default))))), PROFILE)
    # a column of its own: five checks look at the day, each would read it by all formats again
    judged = named.withColumns({"_profile": F.coalesce("_profile", other), "_day": rule_date(F.col("invoice_date"))})
    return judged.withColumn("rule_failures", _failures(F.col("_profile"), as_of)).select(*invoices.columns, "rule_failures")


def apply_rules(invoices: DataFrame, profile: dict[str, Any], as_of: datetime.date) -> DataFrame:
    """Adds rule_failures, in the order of the checks. ``lines`` is an array of maps, ``extra`` a map of text.

    ``as_of`` is a parameter, so that reruns agree.
    """
    return _judged(invoices, {}, overlay(profile), F.lit(None).cast("string"), as_of)


def apply_vendor_rules(invoices: DataFrame, profiles: dict[str, dict[str, Any]], as_of: datetime.date, key: str = "template_id", default: dict[str, Any] | None = None) -> DataFrame:
    """Each row by its vendor's profile over the default."""
    return _judged(invoices, {n: overlay(default, p) for n, p in profiles.items()}, overlay(default), F.col(key), as_of)


# -- duplicates


def check_duplicates(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Adds duplicate_of and duplicate_note.

    batch: source_file, vendor, invoice_number, file_hash, batch_pos (the order of arrival). history: the
    same without batch_pos, with processed_at and history_seq. Within the batch the first occurrence is
    found by a minimum per key, which is summed before the shuffle: a key with a third of all rows is no
    large task, and the joins that bring it back can be split. Of history only rows whose key the batch has are summed: a
    semi join drops the others where they are read if the batch is small, and shares the exchange of the sums if not.
    """
    df = batch.withColumns({"_key": duplicate_key(F.col("vendor"), F.col("invoice_number")), "_hash": F.coalesce("file_hash", F.lit(""))})
    first = lambda c, name: df.where(F.col(c) != "").groupBy(F.col(c).alias(f"_k{name}")).agg(F.min_by("source_file", "batch_pos").alias(f"_of{name}"), F.min("batch_pos").alias(f"_at{name}"), F.max("batch_pos").alias("_last")).where(F.col("_last") > F.col(f"_at{name}")).drop("_last")
    past = history.withColumns({"_pk": duplicate_key(F.col("vendor"), F.col("invoice_number")), "_ph": F.coalesce("file_hash", F.lit(""))})
    asked = lambda c, own: past.where(F.col(c) != "").join(df.where(F.col(own) != "").select(F.col(own).alias("_asked")).distinct(), F.col(c) == F.col("_asked"), "left_semi")
    old = lambda c, own, name: asked(c, own).groupBy(F.col(c).alias(f"_o{name}")).agg(F.min_by(F.struct("source_file", "processed_at"), "history_seq").alias(f"_h{name}"))
    # a key's joins follow each other, so rows are dealt once a key; of the first key only what the second needs goes on
    df = df.join(first("_key", "k"), F.col("_key") == F.col("_kk"), "left").join(old("_pk", "_key", "k"), F.col("_key") == F.col("_ok"), "left")
    own = F.col("_atk") < F.col("batch_pos")
    df = df.select(*batch.columns, "_hash", F.when(own, F.col("_ofk")).alias("_ofk"), own.alias("_own"), F.when(~F.coalesce(own, F.lit(False)), F.col("_hk")).alias("_hk"))
    df = df.join(first("_hash", "h"), F.col("_hash") == F.col("_kh"), "left").join(old("_ph", "_hash", "h"), F.col("_hash") == F.col("_oh"), "left")
    cases = (
        (F.col("_ath") < F.col("batch_pos"), F.col("_ofh"), F.lit("identical file already in this batch")),
        (F.col("_own"), F.col("_ofk"), F.lit("same vendor & invoice number in this batch")),
        (F.col("_hh").isNotNull(), F.col("_hh.source_file"), F.concat(F.lit("identical file processed on "), F.coalesce("_hh.processed_at", F.lit("")))),
        (F.col("_hk").isNotNull(), F.col("_hk.source_file"), F.concat(F.lit("invoice "), F.coalesce("invoice_number", F.lit("None")), F.lit(" from "), F.coalesce("vendor", F.lit("None")), F.lit(" already processed on "), F.coalesce("_hk.processed_at", F.lit("")))),
    )
    of, note = F.lit(""), F.lit("")
    for when, whom, why in reversed(cases):
        of, note = F.when(when, whom).otherwise(of), F.when(when, why).otherwise(note)
    return df.select(*batch.columns, of.alias("duplicate_of"), note.alias("duplicate_note"))


# -- line maths


def line_maths(rows: DataFrame, quantity: str = "quantity", rate: str = "rate", taxable: str = "taxable_value") -> DataFrame:
    """Adds math_mismatch: quantity times rate is more than 2 % off a positive taxable value."""
    q, r, t = (to_unsigned(F.col(c)) for c in (quantity, rate, taxable))
    return rows.withColumn("math_mismatch", F.coalesce((t > 0) & (F.abs(q * r - t) / F.when(t > 0, t) > 0.02), F.lit(False)))


# -- sums


def derive_totals(lines: DataFrame, by: list[str], sums: dict[str, str], diffs: dict[str, tuple[str, str]]) -> DataFrame:
    """Header values from lines: column sums (0 where there is nothing), then differences in the order given."""
    out = lines.groupBy(*by).agg(*(F.round(F.coalesce(F.sum(F.col(c).cast(D)), F.lit(0)), 2).cast(D).alias(f) for f, c in sums.items()))
    for f, (a, b) in diffs.items():
        out = out.withColumn(f, (F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))).cast(D))
    return out


def batch_kpis(invoices: DataFrame) -> DataFrame:
    flag = lambda c, name: F.count_if(c).alias(name)
    return invoices.agg(
        F.count("*").alias("extracted"), flag(~F.col("validation_ok"), "arithmetic_issues"), flag(F.size("rule_failures") > 0, "rule_failures"),
        flag(F.col("duplicate_note") != "", "duplicates"), flag(F.col("ocr_used"), "ocr_used"),
    )


def first_in_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows numbered within their key by arrival (for keys known to be small; see check_duplicates otherwise)."""
    return batch.withColumn("seen", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
