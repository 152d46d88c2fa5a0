"""Scalar functions as Column expressions: numbers, dates, identifiers, text.

All of them are built-in expressions, so they stay inside generated code and fold into whatever plan
uses them. Casts are ``try_`` casts: what cannot be read is null.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- numbers


#: Fixed value: texts of which digits, dot and minus make a number.
NUMBER = r"^[^0-9.\-]*+(?:-[^0-9.\-]*+)?(?:[0-9][^.\-]*+(?:\.[^.\-]*+)?|\.[^0-9.\-]*+[0-9][^.\-]*+)$"


def to_number(text: Column) -> Column:
    """Everything but digits, dot and minus is dropped; what is then no number is null, and not tried: a failing cast costs an exception."""
    s = text.cast("string")
    return F.when(s.rlike(NUMBER), F.regexp_replace(s, r"[^0-9.\-]", "").try_cast("double"))


def to_unsigned(text: Column) -> Column:
    """Digits and dot only: the sign is lost on purpose (quantities and rates in table cells)."""
    return F.regexp_replace(text.cast("string"), r"[^\d.]", "").try_cast("double")


def amounts(text: Column) -> Column:
    """All numbers with two decimals, as doubles, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*\.\d{2}"), F.lit(0)), lambda m: F.replace(m, F.lit(","), F.lit("")).cast("double"))


def last_figure(text: Column) -> Column:
    """The last run of digits and commas with an optional fraction, commas removed, as text."""
    return F.replace(F.try_element_at(F.regexp_extract_all(text, F.lit(r"[\d,]+\.?\d*"), F.lit(0)), F.lit(-1)), F.lit(","), F.lit(""))


def money(value: Column) -> Column:
    return value.cast("decimal(18,2)")


# -- dates

#: The accepted spellings, in order. Single letters accept one or two digits.
ISO_FORMATS = ("d-MMM-yyyy", "d-MMMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "yyyy-M-d", "MMM d, yyyy", "MMMM d, yyyy")
DMY_FORMATS = ("d-MMM-yy", "d-MMM-yyyy", "d/M/yyyy", "d/M/yy", "yyyy-M-d", "d-M-yyyy", "d-M-yy", "MMMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MMM d, yyyy")
RULE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy")


def _shape(fmt: str) -> str:
    """What texts of a format look like: digits for d, M, y, letters for MMM and MMMM."""
    out = re.sub(r"[.]", r"\\.", fmt)
    for part, pattern in (("MMMM", r"\\p{L}+"), ("MMM", r"\\p{L}+"), ("yyyy", "Y"), ("yy", r"[0-9]{2}"), ("M", "[0-9]{1,2}"), ("d", "[0-9]{1,2}"), ("Y", "[0-9]{4}")):
        out = re.sub(rf"(?<![a-zA-Z]){part}(?![a-zA-Z])", pattern, out)
    return f"^{out}$"


def one_spaced(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def parse_date(text: Column, formats: tuple[str, ...], spaced: bool = False) -> Column:
    """The first format that reads the text; two-digit years from 69 on belong to the last century.

    A text that is ``one_spaced`` already is ``spaced``: it is not cleaned again for every format.
    """
    s = text if spaced else one_spaced(text)

    def one(fmt: str) -> Column:
        # a text of another shape is not tried: a failing parser costs an exception
        d = F.when(s.rlike(_shape(fmt)), F.try_to_timestamp(s, F.lit(fmt))).cast("date")
        return d if fmt.count("y") != 2 else F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)

    return F.coalesce(*map(one, formats))


def iso_date(text: Column, spaced: Column | None = None) -> Column:
    """``yyyy-MM-dd``, or the trimmed text where no format reads it; empty is null. ``spaced``: a column that holds the text ``one_spaced``."""
    parsed = parse_date(text, ISO_FORMATS) if spaced is None else parse_date(spaced, ISO_FORMATS, True)
    return F.when(F.length(text) > 0, F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.trim(text)))


def dmy_date(text: Column, spaced: Column | None = None) -> Column:
    """``dd-MMM-yyyy``, or the trimmed text."""
    parsed = parse_date(text, DMY_FORMATS) if spaced is None else parse_date(spaced, DMY_FORMATS, True)
    return F.when(F.length(text) > 0, F.coalesce(F.date_format(parsed, "dd-MMM-yyyy"), F.trim(text))).otherwise(text)


def rule_date(text: Column) -> Column:
    return parse_date(text, RULE_FORMATS)


# -- text


def clean_text(text: Column) -> Column:
    """NUL becomes a hyphen; other control characters but the tab go."""
    return F.regexp_replace(F.translate(text, "\x00", "-"), r"[\x00-\x08\x0A-\x1F]", "")


def norm_label(text: Column) -> Column:
    """Lower case without punctuation around."""
    return F.btrim(F.lower(text), F.lit(":.,;-()[]% "))


def norm_header(text: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(F.lower(text), "[^a-z0-9%/ ]", " "), F.lit("  "), F.lit(" ")))


#: Fixed value: an amount as a whole token, with groups of three digits.
AMOUNT_TOKEN = r"^[₹$€£]?\d{1,3}(,\d{3})*(\.\d{1,2})?$|^[₹$€£]?\d+\.\d{1,2}$"


def is_amount(token: Column) -> Column:
    return F.trim(token).rlike(AMOUNT_TOKEN)


def strip_doubt(text: Column) -> Column:
    """Removes the marks of uncertain reading, ``[?text?]`` and ``[??text??]``."""
    return F.trim(F.regexp_replace(text, r"\[?\?+([^?\]]*)\?+\]?", "$1"))


def strip_page_marks(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)---\s*PAGE\s*\d+\s*---", ""), r"===.*?===", ""))


#: Fixed value: what a log must never show.
SECRET = r"(?i)(sk-[A-Za-z0-9\-_]{8,}|AIza[A-Za-z0-9\-_]{35}|api[_-]?key\s*[:=]\s*\S+|Bearer\s+\S+)"


def scrub(text: Column, limit: int = 500) -> Column:
    return F.substring(F.regexp_replace(text, SECRET, "[REDACTED]"), 1, limit)


#: Personal and banking identifiers, in the order in which they are replaced.
PERSONAL = (
    (r"[\w.+-]+@[\w-]+\.[\w.]+", "[EMAIL]"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "[IBAN]"),
    (r"(?i)\b(?:A/?c|Account|Acct)\.?\s*(?:No\.?|Number)?\s*[:\-]?\s*(\d{6,})", "Account: [ACCOUNT]"),
    (r"\b(?:\d[ -]?){12,18}\d\b", "[CARD]"),
    (r"(?<!\d)(\+?\d[\d\-\s()]{8,}\d)(?!\d)", "[PHONE]"),
)


def redact(text: Column) -> tuple[Column, Column]:
    """The text without identifiers, and how many were replaced; each pattern sees the work of the ones before."""
    found = F.lit(0)
    for pattern, mark in PERSONAL:
        found = found + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, mark)
    return text, found


def redacted(df: DataFrame, column: str, to: str, count: str) -> DataFrame:
    """``redact`` as columns ``to`` and ``count``: a stage for each pattern, so that none is matched again for the next."""
    df = df.withColumns({to: F.col(column), count: F.lit(0)})
    for pattern, mark in PERSONAL:
        df = df.withColumns({count: F.col(count) + F.regexp_count(to, F.lit(pattern)), to: F.regexp_replace(to, pattern, mark)})
    return df


def mask_key(key: Column) -> Column:
    return (
        F.when(key.isNull() | (key == ""), "(none)")
        .when(F.length(key) > 10, F.concat(F.substring(key, 1, 3), F.lit("…"), F.right(key, F.lit(3)))).otherwise("…")
    )


def slugify(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def safe_filename(name: Column) -> Column:
    base = F.replace(F.substring_index(name, "/", -1), F.lit("\\"), F.lit("_"))
    clean = F.substring(F.regexp_replace(base, r'[<>:"|?*\x00-\x1f]', "_"), 1, 180)
    return F.when(clean == "", "file.pdf").otherwise(clean)


def xml_escape(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")), text)


def title_header(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def duplicate_key(vendor: Column, number: Column) -> Column:
    """Vendor and number, folded; empty where there is no number."""
    n = F.replace(F.lower(F.trim(F.coalesce(number.cast("string"), F.lit("")))), F.lit(" "), F.lit(""))
    return F.when(n == "", "").otherwise(F.concat(F.lower(F.trim(F.coalesce(vendor.cast("string"), F.lit("")))), F.lit("|"), n))


def is_local(url: Column, hints: tuple[str, ...] = ("localhost", "127.0.0.1", "0.0.0.0", "host.docker.internal")) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(url, F.lit(h)) for h in hints)), F.lit(False))


# -- identifiers

#: What dates, mobile numbers, plain words and numbers look like where a number is expected.
_DATE_LIKE = r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$|^\d{1,2}[-/][A-Za-z]{3}[-/]\d{2,4}$"
_MOBILE, _FEW_DIGITS, _DIGITS = r"^[6-9]\d{9,}$", r"^\d{1,2}$", r"^\d{3,9}$"
_WORDS, _SHORT_WORD = r"^[A-Za-z\s]+$", r"^[A-Za-z]{1,4}$"
_IDENTIFIER, _ORDER = r"^[A-Za-z0-9][A-Za-z0-9/_\-]{2,}$", r"^[A-Za-z0-9][A-Za-z0-9/_\-\s]{1,}$"
#: Labels that get mistaken for an order number.
NOT_AN_ORDER = ("dated", "date", "tel", "telno", "tel no", "phone", "mobile", "reference", "ref", "gstin", "pan", "cin", "challan", "receiver", "buyer", "vendor", "supplier", "party")


def invoice_number_confidence(value: Column) -> Column:
    """How far a text can be trusted as an invoice number; the first rule that fits counts."""
    s = F.trim(value)
    return (
        F.when(value.isNull() | (value == ""), 0.0).when(F.replace(s, F.lit(" "), F.lit("")).rlike(_MOBILE), 0.1)
        .when(s.rlike(_FEW_DIGITS), 0.2).when(s.rlike(_DATE_LIKE), 0.05).when(s.rlike(_WORDS) & (F.length(s) < 20), 0.1)
        .when(s.rlike(_DIGITS), 0.75).when(s.rlike(_IDENTIFIER), 0.95).otherwise(0.6)
    )


def order_number_confidence(value: Column) -> Column:
    s = F.trim(value)
    return (
        F.when(value.isNull() | (value == ""), 0.0).when(F.lower(s).isin(*NOT_AN_ORDER), 0.05).when(s.rlike(_SHORT_WORD), 0.1)
        .when(s.rlike(_DATE_LIKE), 0.05).when(s.rlike(_ORDER), 0.9).otherwise(0.6)
    )


# -- row filters

#: How the description of a summary row starts.
SUMMARY_ROW = (
    r"(?i)^\s*(total|grand\s*total|sub\s*total|subtotal|taxable\s*value|tax\s*total|tax\s*amount|round\s*off|rounding|cgst|sgst|igst|gst|vat|cess|surcharge|"
    r"freight|shipping|handling|delivery\s*charges?|discount|less\s*discount|trade\s*discount|advance|amount\s*paid|balance\s*due|amount\s*payable|"
    r"net\s*(?:total|amount|payable)|invoice\s*(?:total|value|amount)|amount\s*in\s*words|rupees|rs\.?)\b"
)
SUMMARY_LINE = r"(?i)^\s*(total|grand total|subtotal|sub total|taxable value|cgst|sgst|igst|gst|vat|round off|discount|freight|amount in words|rupees|rs\.?)\b"


def is_summary_row(description: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(description, F.lit(""))))
    return s.rlike(SUMMARY_ROW) | s.isin("", "-", "n/a", "none")


def token_budget(rows: Column, cap: int) -> Column:
    return F.least(F.greatest(((rows * 200 + 1500) * 1.2).cast("int"), F.lit(4096)), F.lit(cap))


def typed(text: Column, kind: Column) -> dict[str, Column]:
    """Projection by declared type: number_value, date_value, text_value."""
    return {
        "number_value": F.when(kind.isin("money", "number"), to_number(text)),
        "date_value": F.when(kind == "date", iso_date(text)),
        "text_value": F.when(~kind.isin("money", "number", "date"), F.nullif(text, F.lit(""))),
    }
