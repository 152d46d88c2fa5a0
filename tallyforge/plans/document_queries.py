"""Registered queries that read documents made of words or answers, and results as people change them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions.register import register
from tallyforge.operators import checks, documents, edits, exports, tables, templates
from tallyforge.plans.bills import bills, table
from tallyforge.plans.more_queries import _invoices, _words
from tallyforge.sources import readers

TEMPLATE = {
    "vendor": "Orders Inc",
    "fields": {"invoice_number": {"anchor": "Statement No", "max_words": 1}, "total": {"anchor": "Grand Total", "nth": 1, "occurrence": "last"}, "first_amount": {"anchor": "Amount", "below": 1, "type": "money"}},
    "line_items": {
        "header_anchor": "Description", "end_anchor": "Grand Total", "start_offset": 4, "end_offset": 4,
        "columns": [{"name": "description", "type": "text", "x_min": 20, "x_max": 250}, {"name": "amount", "type": "money", "x_min": 250, "x_max": 500}], "derive_totals": {"subtotal": {"sum": "amount"}, "tax": {"diff": ["total", "subtotal"]}},
    },
}


#: Orders of one task: more orders make more tasks, not larger ones.
SHARE = 50_000


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Words of one statement per customer with orders: a number, a table of the orders, a total.

    Narrow orders go to their statement once, in as many parts as there are shares of them; words are made where their statement lies, and
    what is done by doc_id goes on there.
    """
    o = table(spark, sf, "orders")
    parts = max(2 * spark.sparkContext.defaultParallelism, 1 + o.count() // SHARE)  # counted from the files' footers
    o = o.select(F.col("o_custkey").cast("string").alias("doc_id"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price")).repartition(parts, "doc_id")
    own = Window.partitionBy("doc_id")
    rows = o.withColumns({"i": F.row_number().over(own.orderBy("o_orderkey")), "c": F.count("*").over(own), "s": F.sum("price").over(own)})
    word = lambda no, text, x, top: F.struct(no.cast("int").alias("word_no"), text.cast("string").alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + 30)).alias("x1"), top.cast("double").alias("top"))
    lit = lambda i, t, x, y: word(F.lit(i), F.lit(t), x, F.lit(y))
    at, n = F.col("i") * 12 + 60, F.lit(10) + F.col("i") * 3
    body = F.array(word(n, F.lit("order"), 50, at), word(n + 1, F.concat(F.lit("#"), "o_orderkey"), 90, at), word(n + 2, F.col("price"), 300, at))
    at, n = F.col("c") * 12 + 90, F.lit(20) + F.col("c") * 3
    frame = F.array(
        lit(0, "Statement", 50, 10), lit(1, "No", 90, 10), lit(2, ":", 122, 10), word(F.lit(3), F.concat(F.lit("C-"), "doc_id"), 130, F.lit(10)), lit(4, "Description", 50, 60), lit(5, "Amount", 300, 60),
        word(n, F.lit("Grand"), 200, at), word(n + 1, F.lit("Total"), 235, at), word(n + 2, F.col("s"), 300, at),
    )
    return rows.select("doc_id", F.explode(F.when(F.col("i") == 1, F.concat(body, frame)).otherwise(body)).alias("w")).select("doc_id", F.lit(1).alias("page_no"), "w.*")


def template_extract(spark, sf):
    words = statements(spark, sf).withColumn("template_id", F.lit("orders"))
    out = templates.to_invoices(templates.extract_documents(words, {"orders": TEMPLATE}))
    return out.select("doc_id", "vendor", "invoice_number", F.round("total", 2).alias("total"), F.round("subtotal", 2).alias("subtotal"), "tax", "n_lines", F.col("line_sum").cast("double").alias("line_sum"), F.try_element_at("extra", F.lit("first_amount")).cast("double").alias("first_amount"))


def table_read(spark, sf):
    rows = tables.read_tables(statements(spark, sf))
    return rows.select("doc_id", F.try_element_at("cols", F.lit("description")).alias("description"), F.try_element_at("cols", F.lit("amount")).alias("amount"))


def word_lines(spark, sf):
    lined = tables.group_lines(statements(spark, sf), 5.0)
    return lined.groupBy("doc_id", "line_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"]), " ").alias("line"))


def gap_cells(spark, sf):
    return tables.cells(_words(spark, sf).select("doc_id", "word_no", "part", "x0", "x1", "amount").withColumn("x0", F.col("x0") + F.col("part") / 100000).distinct(), ["doc_id"], 18.0).select("doc_id", "word_no", "part", "cell_no")


def model_answers(spark, sf):
    """Invoices from answers in the model's shape, made from bills."""
    item = F.struct(F.lit("goods").alias("description"), F.col("n_lines").alias("quantity"), F.col("line_sum").alias("amount"))
    total = F.struct(F.lit("Grand Total").alias("description"), F.lit(None).cast("long").alias("quantity"), F.col("total").alias("amount"))
    tax = F.struct(F.lit("VAT").alias("name"), F.col("tax_sum").alias("amount"))
    k = F.col("l_orderkey") % 3
    answer = F.to_json(F.struct("vendor", "invoice_number", F.lit("dated").alias("po_number"), "invoice_date", F.when(k == 0, F.concat(F.lit("INR "), F.col("tax_sum"))).alias("cgst"), "subtotal", "total", F.when(k == 1, F.array(tax)).alias("taxes"), F.array(item, total).alias("line_items")))
    raw = bills(spark, sf).select("doc_id", F.concat(F.lit("```json\n"), answer, F.lit("\n```")).alias("raw"))
    return documents.from_answers(raw).select("doc_id", "vendor", "invoice_number", "po_number", "tax", "total", "n_lines", "line_sum")


def answer_scores(spark, sf):
    df = checks.validate(bills(spark, sf))
    return df.select("doc_id", documents.answer_score().cast("long").alias("score"), documents.math_failure(df).alias("math_failure"))


def edit_override(spark, sf):
    inv = bills(spark, sf).select("doc_id", "l_suppkey", "vendor", "invoice_number", "total")
    change = inv.where("l_suppkey > 50").select("doc_id", F.when(F.col("l_suppkey") % 2 == 0, "").otherwise(F.upper("vendor")).alias("vendor"), F.when(F.col("l_suppkey") % 3 == 0, "abc").otherwise(F.col("l_suppkey").cast("string")).alias("total"))
    return edits.apply_edits(inv, change)


def nearest_click(spark, sf):
    w = statements(spark, sf)
    boxes = w.select("doc_id", F.col("word_no").alias("box_id"), "x0", "top", "x1", (F.col("top") + 9).alias("bottom"))
    clicks = w.select("doc_id").distinct().select("doc_id", F.lit(1).alias("click_id"), F.lit(285.0).alias("x"), (F.col("doc_id").cast("long") % 200 + 20).cast("double").alias("y"))
    return edits.pick_boxes(clicks, boxes)


def wide_export(spark, sf):
    inv = _invoices(spark, sf).withColumns({"batch_pos": F.col("l_orderkey") * 100000 + F.col("l_suppkey"), "confidence": F.lit(1.0), "validation_ok": F.col("total").isNotNull(), "validation_notes": F.array(F.lit("a"), F.lit("b")), "rule_failures": F.array().cast("array<string>"), "duplicate_note": F.lit("")})
    return exports.wide_invoices(inv).select("source_file", "vendor", "total", "validation_ok", "validation_notes", F.col("CGST").alias("cgst"), "sgst", "currency")


def file_identity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return d.select("doc_id", readers.file_hash(F.col("content")).alias("file_hash"), F.length("content").cast("long").alias("n_bytes"))


def admission(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("in/"), "doc_id", F.lit(".pdf")).alias("path"), F.length(F.encode("text", "UTF-8")).cast("long").alias("n"), F.encode(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), "text")).otherwise(F.col("text")), "UTF-8").alias("content"))
    good, bad = readers.admit(d.withColumn("length", F.col("n") * 1024).drop("n"), 5)
    return good.select("path", F.lit("").alias("reason")).unionByName(bad.select("path", "reason"))


def typed_projection(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "money").when(F.col("o_orderkey") % 4 == 1, "date").when(F.col("o_orderkey") % 4 == 2, "number").otherwise("text").alias("kind"), F.when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.concat(F.lit("Rs "), F.col("o_orderkey"))).alias("raw"))
    return d.select("o_orderkey", *(c.alias(n) for n, c in S.typed(F.col("raw"), F.col("kind")).items()))


def sql_functions(spark, sf):
    register(spark)
    table(spark, sf, "part").createOrReplaceTempView("_tf_part")
    return spark.sql("SELECT p_partkey, tf_to_number(concat('Rs ', p_retailprice, '/x')) AS n, tf_slugify(p_name) AS slug, tf_duplicate_key(p_brand, concat(' ', p_size, ' A')) AS k, tf_is_amount(cast(p_size AS STRING)) AS amount FROM _tf_part")


def overlap_candidates(spark, sf):
    """Boxes in chains, some of which touch: what covers them decides, and what is left out covers nothing."""
    w = _words(spark, sf).select("doc_id", F.lit(0).alias("line_no"), (F.col("part") % 4).cast("int").alias("kind"), (F.col("x0") + F.col("part") % 7).alias("x0"), (F.col("x1") + F.col("part") % 5).alias("x1")).distinct()
    return edits.without_overlaps(w).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("x0").alias("sum_x0"))


def overlap_chains(spark, sf):
    """The lines of an order as boxes that reach into their neighbours, or just touch them."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("double").alias("q"), F.min("l_partkey").alias("p"))
    box = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("line_no"), (F.col("p") % 3).cast("int").alias("kind"), (F.col("l_linenumber") * 10.0).alias("x0"), (F.col("l_linenumber") * 10.0 + F.when(F.col("q") > 25, 10.0).otherwise(F.col("q") % 9)).alias("x1"), "l_linenumber")
    return edits.without_overlaps(box, "l_linenumber").select("doc_id", "kind", "x0", "x1", "l_linenumber")


def tax_names(spark, sf):
    """Answers with several taxes of one name, and one called like another field."""
    tax = lambda name, amount: F.struct(F.lit(name).alias("name"), amount.cast("string").alias("amount"))
    b = bills(spark, sf).where("tax_sum is not null")
    taxes = F.array(tax("VAT", F.col("tax_sum")), tax(" VAT", F.lit("1.25")), tax("currency", F.lit("5")), tax("VAT", F.lit("no figure")), tax("VAT", F.col("n_lines")), tax(None, F.lit("0.5")))
    raw = b.select("doc_id", F.to_json(F.struct("vendor", F.lit("INR").alias("currency"), taxes.alias("taxes"))).alias("raw"))
    of = lambda k: F.try_element_at("extra", F.lit(k)).alias(k)
    return documents.from_answers(raw).select("doc_id", F.size("extra").alias("n_extra"), of("currency"), of("VAT"), of("VAT_amount"), of("currency_amount"), of("tax"), F.col("tax").alias("tax_sum"))


DOCUMENTS = (template_extract, table_read, word_lines, gap_cells, model_answers, answer_scores, edit_override, nearest_click, wide_export, file_identity, admission, typed_projection, sql_functions, overlap_candidates, overlap_chains, tax_names)
