"""Invoices from a language model's JSON: mapping, score, one retry of those that fail.

The model is a callable that the caller brings (text -> text). Only documents whose arithmetic fails are
sent again; the better of the two answers stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions.jsonfix import parse_json
from tallyforge.operators.checks import validate

TAXES = "array<struct<name:string,rate:string,amount:string>>"
LINE_ITEMS = "array<struct<description:string,hsn_sac:string,quantity:string,unit_price:string,tax_rate:string,tax_amount:string,amount:string>>"
ANSWER = (
    "vendor string, invoice_number string, invoice_date string, po_number string, currency string, cgst string, sgst string, igst string, taxable_value string, subtotal string, total string, "
    f"taxes {TAXES}, line_items {LINE_ITEMS}"
)
D = "decimal(18,2)"
CELLS = ("quantity", "unit_price", "tax_rate", "tax_amount", "amount")


def _text(c: Column) -> Column:
    return F.nullif(S.strip_doubt(F.trim(c)), F.lit(""))


def from_answers(answers: DataFrame, column: str = "raw") -> DataFrame:
    """(doc_id, raw) -> one invoice a row. Unreadable answers give an invoice with nothing in it."""
    df = parse_json(answers, column).withColumn("_a", F.from_json("json", ANSWER))
    a = lambda k: F.col(f"_a.{k}")
    # texts and figures first, each once: what follows reads them several times
    tax = F.transform(a("taxes"), lambda t: F.struct(F.trim(F.coalesce(F.nullif(t["name"], F.lit("")), F.lit("tax"))).alias("name"), S.to_number(t["amount"]).cast(D).alias("amount")))
    df = df.withColumns({
        **{f"_{k}": S.strip_doubt(F.trim(a(k))) for k in ("vendor", "invoice_number", "po_number", "invoice_date", "currency")},
        **{k: S.to_number(a(k)).cast(D) for k in ("subtotal", "total", "cgst", "sgst", "igst", "taxable_value")},
        "_taxes": F.filter(F.coalesce(tax, F.array().cast("array<struct<name:string,amount:decimal(18,2)>>")), lambda t: t["amount"].isNotNull()),
    })
    said = lambda k: F.nullif(F.col(f"_{k}"), F.lit(""))
    tax_sum = F.aggregate("_taxes", F.lit(0).cast(D), lambda acc, t: (acc + t["amount"]).cast(D))
    gst = sum((F.coalesce(k, F.lit(0).cast(D)) for k in ("cgst", "sgst", "igst")), F.lit(0).cast(D)).cast(D)
    rows = F.filter(F.coalesce(a("line_items"), F.array().cast(LINE_ITEMS)), lambda r: ~S.is_summary_row(S.strip_doubt(F.coalesce(r["description"], F.lit("")))))

    def cols(r: Column) -> Column:
        pairs = [F.struct(F.lit("description").alias("k"), S.strip_doubt(r["description"]).alias("v")), F.struct(F.lit("hsn_sac").alias("k"), _text(r["hsn_sac"]).alias("v"))]
        pairs += [F.struct(F.lit(c).alias("k"), S.to_number(r[c]).cast("string").alias("v")) for c in CELLS]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))

    start = F.when(said("currency").isNotNull(), F.create_map(F.lit("currency"), F.trim(a("currency")))).otherwise(F.create_map().cast("map<string,string>"))

    def put(taken: Column, t: Column) -> Column:
        """A tax whose name is taken goes by ``<name>_amount``; the last of these stays."""
        value = t["amount"].cast("string")
        key = F.when(F.map_contains_key(taken, t["name"]), F.concat(t["name"], F.lit("_amount"))).otherwise(t["name"])
        put_at = lambda key: F.when(F.map_contains_key(taken, key), F.transform_values(taken, lambda k, v: F.when(k == key, value).otherwise(v))).otherwise(F.map_concat(taken, F.create_map(key, value)))
        return F.get(F.transform(F.array(key), put_at), F.lit(0))

    line_sum = F.aggregate("lines", F.lit(0).cast(D), lambda acc, m: (acc + F.coalesce(F.try_element_at(m, F.lit("amount")).try_cast(D), F.lit(0).cast(D))).cast(D))
    df = df.withColumns({
        "vendor": F.coalesce("_vendor", F.lit("")), "invoice_number": said("invoice_number"), "po_number": said("po_number"), "invoice_date": said("invoice_date"),
        "tax": F.when(gst > 0, gst).when(F.size("_taxes") > 0, tax_sum).otherwise((F.col("total") - F.col("subtotal")).cast(D)),
        "extra": F.aggregate("_taxes", start, put), "lines": F.transform(rows, cols),
    })
    df = df.withColumns({
        "invoice_number": F.when(S.invoice_number_confidence(F.col("invoice_number")) >= 0.4, F.col("invoice_number")), "po_number": F.when(S.order_number_confidence(F.col("po_number")) >= 0.4, F.col("po_number")),
        "n_lines": F.size("lines"), "line_sum": line_sum,
    })
    made = ("vendor", "invoice_number", "po_number", "invoice_date", "subtotal", "total", "cgst", "sgst", "igst", "taxable_value", "tax", "extra", "lines", "n_lines", "line_sum")
    return df.select(*(c for c in answers.columns if c not in (column, *made)), *made)


#: A note with one of these means that the sums are in doubt.
MATH_WORDS = ("sum", "math", "mismatch", "subtotal", "total", "tax", "!=")


def math_failure(invoices: DataFrame) -> Column:
    return F.exists("validation_notes", lambda n: F.lower(n).rlike("|".join(MATH_WORDS)))


def answer_score() -> Column:
    return F.when(F.col("validation_ok"), 10).otherwise(0) - F.size("validation_notes") + F.when(F.col("total").isNotNull(), 2).otherwise(0) + F.when(F.col("subtotal").isNotNull(), 1).otherwise(0) + F.col("n_lines")


def ask(texts: DataFrame, model: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """(doc_id, prompt) -> (doc_id, raw). The callable is shipped once a task; equal prompts of a batch are asked once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known = {p: model(p) for p in dict.fromkeys(frame[prompt])}
            yield pd.DataFrame({"doc_id": frame["doc_id"], "raw": frame[prompt].map(known)})

    return texts.select("doc_id", prompt).mapInPandas(run, "doc_id string, raw string")


def retry_hint() -> Column:
    """What to tell the model about its first answer; begins with CORRECTION."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return F.concat(
        F.lit("CORRECTION: the figures you gave do not add up.\n"), F.array_join(F.transform("validation_notes", lambda n: F.concat(F.lit("* "), n)), "\n"),
        F.lit("\nYou read subtotal "), value("subtotal"), F.lit(", tax "), value("tax"), F.lit(" and total "), value("total"),
        F.lit(".\nRead the document once more. The rows have to add up to the subtotal, and subtotal and tax to the total."),
    )


def extract_with_model(texts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(doc_id, prompt) -> invoices: ask, map, validate; ask once more where the sums fail; keep the better.

    The first answers are written before they are read twice, so the model is not asked again for them.
    """
    first = ask(texts, model).checkpoint()
    one = validate(from_answers(first)).withColumn("_try", F.lit(0))
    failing = one.where(math_failure(one)).select(F.col("doc_id").alias("_d"), retry_hint().alias("_hint"))
    again = texts.join(failing, F.col("doc_id") == F.col("_d")).select("doc_id", F.concat("prompt", F.lit("\n\n"), "_hint").alias("prompt"))
    two = validate(from_answers(ask(again, model).checkpoint())).withColumn("_try", F.lit(1))
    both = one.unionByName(two).withColumn("_rank", F.struct(answer_score().alias("score"), (-F.col("_try")).alias("earlier")))
    names = [c for c in both.columns if c != "_rank"]
    best = both.groupBy(F.col("doc_id").alias("_k")).agg(F.max_by(F.struct(*names), "_rank").alias("b"))
    return best.select("b.*").drop("_try")
