"""Rows and columns from placed words: the set-oriented part of reading tables.

Joins to columns always carry the template as an equality, with the geometric condition as the rest, so
they are hash joins to a small table; nearest and backward matches keep one row a word by ``min_by``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalars import SUMMARY_LINE


def group_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Adds line_key: words whose height rounds (half to even) to the same multiple of the tolerance."""
    return words.withColumn("line_key", F.rint(F.col("top") / tolerance).cast("long"))


def to_bands(words: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Words with the column whose band holds their centre, else their left edge; the first by ord wins.

    words: keys, template_id, x0, x1, ...; columns: template_id, ord, name, x_min, x_max.
    """
    mid = (F.col("x0") + F.col("x1")) / 2
    inside = lambda x: (F.col("x_min") <= x) & (x < F.col("x_max"))
    cols = columns.withColumnRenamed("template_id", "_t")
    hits = words.join(cols, (F.col("template_id") == F.col("_t")) & (inside(mid) | inside(F.col("x0"))))
    return hits.groupBy(*keys).agg(F.min_by("name", F.struct(F.when(inside(mid), 0).otherwise(1), F.col("ord"))).alias("column"))


def midpoint_bounds(headers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, x0) of located headers -> lo, hi halfway to the neighbours, open at the ends."""
    w = Window.partitionBy(*keys).orderBy("x0", "name")
    return headers.withColumns({"lo": F.coalesce((F.lag("x0").over(w) + F.col("x0")) / 2, F.lit(-1e9)), "hi": F.coalesce((F.col("x0") + F.lead("x0").over(w)) / 2, F.lit(1e9))})


def to_nearest(words: DataFrame, headers: DataFrame, on: str, keys: list[str]) -> DataFrame:
    """Each word's nearest header by left edge; ties go to the smaller ord. headers: on, ord, name, hx."""
    h = headers.withColumnRenamed(on, "_on")
    return words.join(h, F.col(on) == F.col("_on")).groupBy(*keys).agg(F.min_by("name", F.struct(F.abs(F.col("hx") - F.col("x0")), F.col("ord"))).alias("column"))


def to_boundary(x: Column, boundaries: Column) -> Column:
    """Backward match: index of the last boundary that is not right of x, 0 if all are."""
    return F.greatest(F.size(F.filter(boundaries, lambda b: b <= x)) - 1, F.lit(0))


def gap_boundaries(words: DataFrame, keys: list[str], least: float = 20.0) -> DataFrame:
    """Column starts where left edges, rounded to ten, jump by ``least`` or more."""
    at = words.select(*keys, (F.rint(F.col("x0") / 10) * 10).cast("long").alias("x")).distinct()
    w = Window.partitionBy(*keys).orderBy("x")
    starts = at.withColumn("_gap", F.col("x") - F.lag("x").over(w)).where(F.col("_gap").isNull() | (F.col("_gap") >= least))
    return starts.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("boundaries"))


def cells(words: DataFrame, line_keys: list[str], gap: float = 18.0) -> DataFrame:
    """Adds cell_no: a new cell wherever the space to the word before exceeds ``gap``."""
    w = Window.partitionBy(*line_keys).orderBy("x0", "x1")
    broke = F.when(F.col("x0") - F.lag("x1").over(w) > gap, 1).otherwise(0)
    return words.withColumn("_b", broke).withColumn("cell_no", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_b")


#: Words that head the columns of item tables.
HEADER_WORDS = {
    "description": ("description", "particulars", "item", "product", "goods", "details", "name", "narration"), "hsn": ("hsn", "sac", "hsn/sac", "hsn code"),
    "quantity": ("qty", "quantity", "nos", "pcs", "units", "qnty"), "unit": ("unit", "uom", "u/m"), "rate": ("rate", "price", "unit price", "unit rate", "mrp"),
    "discount": ("discount", "disc", "disc%", "discount%"), "taxable_value": ("taxable", "taxable value", "assessable", "basic amount"), "cgst_rate": ("cgst%", "cgst rate"),
    "sgst_rate": ("sgst%", "sgst rate"), "igst_rate": ("igst%", "igst rate"), "amount": ("amount", "total", "value", "line total", "net amount", "total amount"),
}


def _named(word: Column) -> Column:
    """The columns that a word may head, as bits in their order."""
    named = (reduce(lambda a, b: a | b, (F.startswith(word, F.lit(x)) for x in aliases)) for aliases in HEADER_WORDS.values())
    return reduce(lambda a, b: a + b, (F.when(n, 1 << i).otherwise(0) for i, n in enumerate(named)))


def page_lines(words: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(doc_id, page_no, line_key, w, heads, starts): words of each line by place; the columns that it names, as bits; where columns of the page start.

    Left edges, rounded to ten, start a column where they jump by 20 or more; each start is in one line.
    """
    x = (F.rint(F.col("x0") / 10) * 10).cast("long")
    jump = F.col("_x") - F.lag("_x").over(Window.partitionBy("doc_id", "page_no").orderBy("_x"))
    df = group_lines(words.where("doc_id is not null and page_no is not null"), tolerance).withColumns({"_x": x, "_n": _named(F.lower(F.trim("text")))})
    df = df.withColumn("_start", F.when(jump.isNull() | (jump >= 20), F.col("_x")))
    return df.groupBy("doc_id", "page_no", "line_key").agg(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text", "_n"))).alias("w"), F.bit_or("_n").alias("heads"), F.collect_list("_start").alias("starts"))


def _header(lines: DataFrame) -> DataFrame:
    """Adds ``header``, the columns by left edge that hold on the line's page, and ``header_line`` if they are the page's own.

    The line with most different column words is a page's header, the first of those; it needs two. Pages without one have the last before.
    """
    score = F.bit_count("heads")
    at = lambda i: F.transform(F.filter("w", lambda w: w["_n"].bitwiseAND(1 << i) != 0), lambda w: w["x0"])
    cols = F.array_sort(F.filter(F.array(*(F.when(F.col("heads").bitwiseAND(1 << i) != 0, F.struct(F.array_min(at(i)).alias("x0"), F.lit(i).alias("ord"), F.lit(n).alias("name"))) for i, n in enumerate(HEADER_WORDS))), lambda c: c.isNotNull()))
    page, down = Window.partitionBy("doc_id", "page_no"), Window.partitionBy("doc_id").orderBy("page_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.max_by(F.struct("line_key", "_cols"), F.when(score >= 2, F.struct(score, -F.col("line_key")))).over(page)
    df = lines.withColumn("_cols", F.when(score >= 2, cols)).withColumn("_own", own)
    return df.withColumns({"header_line": F.col("_own.line_key"), "header": F.last("_own._cols", ignorenulls=True).over(down)}).drop("_cols", "_own")


def carry_headers(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """Pages with the header that holds there: their own, else the last one before; pages before any go."""
    h = headers.select(F.col("doc_id").alias("_d"), F.col("page_no").alias("_p"), "header_line", "header")
    df = pages.select("doc_id", "page_no").distinct().join(h, (F.col("doc_id") == F.col("_d")) & (F.col("page_no") == F.col("_p")), "left")
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("header", F.last("header", ignorenulls=True).over(w)).where("header is not null").select("doc_id", "page_no", "header_line", "header")


def _cells_of(names: Column, name: Callable[[Column], Column]) -> Column:
    """The line's words as a map by column; every column of ``names`` is there, empty if unused."""
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter("w", lambda w: name(w) == n), lambda w: w["text"]), " ")))


def read_tables(words: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Words of pages -> table rows as maps, by nearest header, carried over pages, with the three repairs.

    words: doc_id, page_no, word_no, text, x0, top. Result: doc_id, row_no, cols (map), in reading order.
    Documents without any such row get columns col_0, col_1, ... from gaps between left edges, on pages with two or more. All is done where the
    words of a document lie: lines are read once, and what holds for their page or document comes by windows.
    """
    df = _header(page_lines(words, tolerance))
    nearest = lambda w: F.array_min(F.transform("header", lambda h: F.struct(F.abs(h["x0"] - w["x0"]).alias("d"), h["ord"].alias("ord"), h["name"].alias("name"))))["name"]
    below = F.col("header").isNotNull() & (F.col("header_line").isNull() | (F.col("line_key") > F.col("header_line")))
    df = df.withColumn("cols", F.when(below, _cells_of(F.transform("header", lambda h: h["name"]), nearest)))
    text = F.array_join(F.transform("w", lambda w: w["text"]), " ")
    df = df.withColumn("_row", F.coalesce(F.col("cols").isNotNull() & ~text.rlike(SUMMARY_LINE) & (_cell("description") != ""), F.lit(False)))
    df = df.withColumn("_any", F.max("_row").over(Window.partitionBy("doc_id"))).withColumn("boundaries", F.when(~F.col("_any"), F.array_sort(F.flatten(F.collect_list("starts").over(Window.partitionBy("doc_id", "page_no"))))))
    place = lambda i: F.concat(F.lit("col_"), i.cast("string"))
    gaps = _cells_of(F.transform("boundaries", lambda b, i: place(i)), lambda w: place(to_boundary(w["x0"], F.col("boundaries"))))
    rows = df.where(F.col("_row") | (~F.col("_any") & (F.size("boundaries") >= 2))).withColumn("cols", F.when(F.col("_any"), F.col("cols")).otherwise(gaps))
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_key")
    return fix_exempt(fix_hsn(merge_continuations(rows.select("doc_id", F.row_number().over(order).alias("row_no"), "cols"))))


NUMERIC_CELLS = ("quantity", "rate", "amount", "taxable_value", "cgst_rate", "sgst_rate", "igst_rate", "discount")


def _cell(name: str) -> Column:
    return F.coalesce(F.trim(F.try_element_at("cols", F.lit(name))), F.lit(""))


def merge_continuations(rows: DataFrame) -> DataFrame:
    """A described row without figures continues the row before: its description is appended.

    Rows are told apart by a running count of those that start an item (gaps and islands).
    """
    w = Window.partitionBy("doc_id").orderBy("row_no")
    empty = reduce(lambda a, b: a & b, (_cell(n) == "" for n in NUMERIC_CELLS))
    starts = F.when((F.row_number().over(w) > 1) & (_cell("description") != "") & empty, 0).otherwise(1)
    df = rows.withColumn("_s", starts).withColumn("_g", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", _cell("description").alias("d")))), lambda x: x["d"]), " ")
    merged = df.groupBy("doc_id", "_g").agg(F.min("row_no").alias("row_no"), F.min_by("cols", "row_no").alias("cols"), parts.alias("_d"), F.count("*").alias("_n"))
    return merged.select("doc_id", "row_no", F.when(F.col("_n") > 1, F.transform_values("cols", lambda k, v: F.when(k == "description", F.trim(F.col("_d"))).otherwise(v))).otherwise(F.col("cols")).alias("cols"))


#: Cells that never hold a tariff code, and cells with tax.
NOT_HSN = ("quantity", "description", "rate", "unit_price", "amount", "total", "cgst", "sgst", "igst", "total_amount", "net_amount", "gross_amount", "tax_amount")
TAX_CELLS = ("cgst_rate", "sgst_rate", "igst_rate", "cgst_amount", "sgst_amount", "igst_amount")


def fix_hsn(rows: DataFrame) -> DataFrame:
    """A tariff code (4 to 8 digits) in the wrong cell moves to an empty ``hsn``; the first in cell order."""
    found = F.try_element_at(F.filter(F.map_entries("cols"), lambda e: ~e["key"].isin(*NOT_HSN, "hsn") & F.trim(e["value"]).rlike(r"^\d{4,8}$")), F.lit(1))
    df = rows.withColumn("_f", F.when(_cell("hsn") == "", found))
    moved = F.transform_values("cols", lambda k, v: F.when(k == F.col("_f.key"), F.lit("")).when(k == "hsn", F.trim(F.col("_f.value"))).otherwise(v))
    added = F.map_from_entries(F.concat(F.map_entries(moved), F.when(F.map_contains_key("cols", F.lit("hsn")), F.array().cast("array<struct<key:string,value:string>>")).otherwise(F.array(F.struct(F.lit("hsn").alias("key"), F.trim(F.col("_f.value")).alias("value"))))))
    return df.withColumn("cols", F.when(F.col("_f").isNotNull(), added).otherwise(F.col("cols"))).drop("_f")


def fix_exempt(rows: DataFrame) -> DataFrame:
    """Rows that say exempt, nil or zero rated have their tax cells set to 0."""
    said = F.array_join(F.map_values("cols"), " ").rlike(r"(?i)\b(exempt|nil|nil\s?rated|0\s?%|zero\s?rated)\b")
    return rows.withColumn("cols", F.when(said, F.transform_values("cols", lambda k, v: F.when(k.isin(*TAX_CELLS), F.lit("0")).otherwise(v))).otherwise(F.col("cols")))
