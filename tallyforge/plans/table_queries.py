"""Registered queries on tables over pages, templates of other styles, repairs, inference, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import jsonfix, tables as table_functions
from tallyforge.functions import scalars as S
from tallyforge.operators import calls, candidates, checks, edits, engines, exports, infer, pages, prompts, tables, templates
from tallyforge.plans.bills import bill_lines, bills, table
from tallyforge.plans.document_queries import statements
from tallyforge.sinks import files
from tallyforge.sources import page_source, readers
from tallyforge.sources.readers import shared_folder


#: Tasks that write files; each has its share of the documents, however they are stored.
WRITERS = 64


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def json_repair(spark, sf):
    """Answers that break off, in the ways models break off."""
    k, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"id": '), n, F.lit(', "tags": ["'), "event_type", F.lit('", "x'))).when(k == 1, F.concat(F.lit('Sure! ```json {"id": '), n, F.lit(', "tags": [], "of": {"a": 1}} as asked')))
        .when(k == 2, F.concat(F.lit('<think>{</think>{"id": '), n, F.lit(', "done": tru'))).when(k == 3, F.concat(F.lit('{"id": '), n, F.lit("}"))).otherwise(F.lit("no answer"))
    )
    return jsonfix.parse_json(table(spark, sf, "events").select("event_id", raw.alias("raw")), "raw").select("event_id", "json")


def _dated(words):
    """The statements with a number and a date, without which no invoice is in order; they come with the statement's first word, where it lies."""
    cell = lambda no, text, x: F.struct(F.lit(900_000 + no).alias("word_no"), text.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + 30)).alias("x1"), F.lit(25.0).alias("top"))
    said = (("Invoice", 50), ("No", 90), (":", 122), (None, 155), ("Date", 300), (":", 332), ("05/01/2024", 365))
    head = F.array(*(cell(i, F.lit(t) if t else F.concat(F.lit("INV-"), "doc_id"), x) for i, (t, x) in enumerate(said)))
    own = F.array(F.struct("word_no", "text", "x0", "x1", "top"))
    return words.select("doc_id", "page_no", F.explode(F.when(F.col("word_no") == 0, F.concat(own, head)).otherwise(own)).alias("w")).select("doc_id", "page_no", "w.*")


def infer_template(spark, sf):
    """Templates of the statements, from their words alone."""
    out = infer.infer_templates(_dated(statements(spark, sf))).withColumn("t", F.from_json("template", "line_items struct<header_anchor:string,end_anchor:string,columns:array<struct<name:string,x_min:double,x_max:double,type:string>>>, fields map<string,struct<anchor:string>>"))
    columns = F.array_join(F.transform("t.line_items.columns", lambda c: F.concat_ws(":", c["name"], c["type"], c["x_min"].cast("string"), c["x_max"].cast("string"))), ",")
    return out.select("doc_id", "status", "t.line_items.header_anchor", "t.line_items.end_anchor", columns.alias("columns"), F.try_element_at("t.fields", F.lit("total"))["anchor"].alias("total_anchor"))


def infer_layouts(spark, sf):
    """Statements as they are, with amounts printed so low that only looser rows read them, and with a total that does not agree."""
    k, amount = F.col("doc_id").cast("long") % 3, F.col("x0") == 300
    words = _dated(statements(spark, sf)).withColumn("_last", F.max("top").over(Window.partitionBy("doc_id")))
    low = (k == 1) & amount & (F.col("top") > 60) & (F.col("top") < F.col("_last"))
    wrong = (k == 2) & amount & (F.col("top") == F.col("_last"))
    words = words.withColumns({"top": F.when(low, F.col("top") + 7).otherwise(F.col("top")), "text": F.when(wrong, (F.col("text").try_cast("decimal(18,2)") + 100).cast("string")).otherwise(F.col("text"))})
    out = infer.infer_templates(words.drop("_last"))
    return out.select("doc_id", "status", F.get_json_object("template", "$.line_items.row_tol").cast("double").alias("row_tol"))


def _numbered(spark, sf):
    """The statements' words with the number of their order (0: the head, null: the total)."""
    return statements(spark, sf).withColumn("i", F.when(F.col("x0").isin(200, 235) | ((F.col("x0") == 300) & (F.col("word_no") % 3 == 1)), F.lit(None)).when(F.col("word_no") < 10, 0).otherwise(F.floor((F.col("word_no") - 10) / 3)).cast("long"))


def carried_table(spark, sf):
    """Tables whose second page has no header of its own."""
    words = statements(spark, sf).withColumns({"page_no": F.when(F.col("top") >= 110, 2).otherwise(1), "top": F.when(F.col("top") >= 110, F.col("top") - 100).otherwise(F.col("top"))})
    rows = tables.read_tables(words)
    return rows.select("doc_id", F.try_element_at("cols", F.lit("description")).alias("description"), F.try_element_at("cols", F.lit("amount")).alias("amount"))


def positional_table(spark, sf):
    """Rows of words without any header."""
    words = statements(spark, sf).where("word_no >= 10 and x0 not in (200, 235)")
    words = words.withColumn("_bottom", F.max("top").over(Window.partitionBy("doc_id"))).where("top < _bottom").drop("_bottom")
    return tables.read_tables(words).select("doc_id", *(F.try_element_at("cols", F.lit(f"col_{i}")).alias(f"col_{i}") for i in range(3)))


def _three_ways(words, ways):
    """The same statements in three layouts; the document's key says which."""
    k = F.col("doc_id").cast("long") % 3
    parts = [way(words.where(k == i)).withColumn("template_id", F.lit(f"t{i}")) for i, way in enumerate(ways)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _item_columns(out, *numbers):
    rows = out.select("doc_id", "header", F.explode("items").alias("r"))
    return rows.select("doc_id", "header", F.try_element_at("r", F.lit("description")).alias("description"), F.try_element_at("r", F.lit("amount")).cast("double").alias("amount"), *numbers)


def header_table(spark, sf):
    """Tables under header lines: as they are; with columns swapped and other names; on a shifted page whose first words are a line above."""
    fields = {"label": {"anchor": "Total", "before": 1}, "sum": {"anchor": "Grand Total", "sum_nth": [1, 1]}}
    rules = lambda first, second, end: {"header_anchor": first, "end_anchor": end, "columns": [{"name": "description", "header": first}, {"name": "amount", "header": second, "type": "money"}]}
    known = {
        "t0": {"fields": fields, "line_items": rules("Description", "Amount", "Grand Total")},
        "t1": {"fields": fields, "line_items": rules("Particulars", "Sum", "Grand Total")},
        "t2": {"fields": fields, "line_items": rules("Description", "Amount", "Grand")},
    }
    left = F.col("x0") >= 300
    swapped = lambda w: w.withColumns({"text": F.when(F.col("text") == "Description", "Particulars").when(F.col("text") == "Amount", "Sum").otherwise(F.col("text")), "x0": F.when((F.col("x0") < 200), F.col("x0") + 400).otherwise(F.col("x0")), "x1": F.when(F.col("x0") < 200, F.col("x1") + 400).otherwise(F.col("x1"))})
    shifted = lambda w: w.withColumns({"top": F.col("top") * 1.5 + 7, "x0": F.col("x0") + F.when(left, 40).otherwise(15), "x1": F.col("x1") + F.when(left, 40).otherwise(15)})
    out = templates.extract_documents(_three_ways(statements(spark, sf), (lambda w: w, swapped, shifted)), known)
    return _item_columns(out, F.col("header.label").alias("label"), F.round(F.col("header.sum").cast("double"), 2).alias("double_total")).drop("header")


def wrapped_table(spark, sf):
    """Descriptions that go on in a line of their own: below their figures, above them, and on both sides."""
    table_ = {"header_anchor": "Description", "end_anchor": "Grand Total", "start_offset": 4, "end_offset": 4, "row_tol": 2, "columns": [{"name": "description", "type": "text", "x_min": 20, "x_max": 250}, {"name": "amount", "type": "money", "x_min": 250, "x_max": 500}]}
    words = statements(spark, sf)

    def wrapped(*pieces):
        def way(w):
            more = [w.where("text = 'order'").select("doc_id", "page_no", (F.col("word_no") + no).alias("word_no"), F.lit(text).alias("text"), "x0", "x1", (F.col("top") + dy).alias("top")) for no, text, dy in pieces]
            for m in more:
                w = w.unionByName(m)
            return w

        return way

    ways = (wrapped((100_000, "paid", 4)), wrapped((100_000, "new", -4)), wrapped((100_000, "new", -4), (200_000, "paid", 4)))
    out = templates.extract_documents(_three_ways(words, ways), {f"t{i}": {"line_items": table_} for i in range(3)})
    return _item_columns(out).drop("header")


def derived_chain(spark, sf):
    """Differences that need each other, named in an order in which none can be taken at once; a layout by its keyword, values below labels."""
    table_ = {"header_anchor": "Description", "end_anchor": "Grand Total", "columns": [{"name": "description", "header": "Description"}, {"name": "amount", "header": "Amount", "type": "money"}]}
    derive = {"due": {"diff": ["net", "paid"]}, "net": {"diff": ["gross", "discount"]}, "gross": {"sum": "amount"}, "paid": {"diff": ["gross", "net"]}}
    template = {
        "vendor": "base", "fields": {"discount": {"anchor": "Grand Total", "nth": 1}, "first": {"anchor": "Amount", "below": True, "type": "money"}},
        "variants": [{"identify": {"keyword": "no such text"}, "vendor": "never"}, {"identify": {"keyword": "STATEMENT no"}, "vendor": "by keyword", "line_items": table_ | {"derive_totals": derive}}],
    }
    h = templates.extract_documents(statements(spark, sf).withColumn("template_id", F.lit("t")), {"t": template}).select("doc_id", "header")
    return h.select("doc_id", F.col("header.vendor").alias("vendor"), *(F.round(F.col(f"header.{c}").cast("double"), 2).alias(c) for c in ("first", "gross", "net", "paid", "due")))


def field_candidates(spark, sf):
    """What may be a field of a statement: its number behind a colon, behind a gap, below its label; amounts behind their labels."""
    number = F.startswith("text", F.lit("C-"))
    below = lambda w: w.withColumns({"x0": F.when(number, 60.0).otherwise(F.col("x0")), "x1": F.when(number, 90.0).otherwise(F.col("x1")), "top": F.when(number, 22.0).otherwise(F.col("top"))})
    words = _three_ways(statements(spark, sf), (lambda w: w, lambda w: w.where("text <> ':'"), below))
    return candidates.field_candidates(templates.text_lines(words)).drop("line_no")


def _document_files(spark, sf):
    """The documents as a file each, in some folders; every line of a text is a page. Where they are."""
    path = _scratch(spark, "files")
    # by doc_id, not by folder: all tasks write alike
    page_source.write_texts(table(spark, sf, "documents").select("doc_id", F.translate("text", "\f\n", " \f").alias("text")).repartition(WRITERS, "doc_id"), path)
    page_source.register(spark)
    return path


def _file_words(spark, sf):
    words = spark.read.format("tallyforge_words").option("path", _document_files(spark, sf)).option("suffix", ".txt").load()
    return words.withColumn("doc_id", F.regexp_extract("doc_id", r"doc_id=(\d+)", 1).cast("long"))


def file_words(spark, sf):
    """Words of files through the data source: counted per document, with the last page that has any and the heights of its pages."""
    w = _file_words(spark, sf).groupBy("doc_id")
    return w.agg(F.count("*").alias("n_words"), F.max("page_no").cast("long").alias("last_page"), F.sum(F.length("text")).alias("n_chars"), F.max("x1").alias("widest"))


def first_page_words(spark, sf):
    """The words of the first page of each file; the filter reaches the parser."""
    w = _file_words(spark, sf).where("page_no = 1").groupBy("doc_id")
    return w.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ").alias("words"))


def sql_fields(spark, sf):
    """``Label: value`` lines of the documents by a table function in SQL; every fifth document gets some."""
    table_functions.register_tables(spark)
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Invoice No:  A-"), "doc_id", F.lit("\n: none\n12:30\r\nDatum : heute \nEmpty:\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    table(spark, sf, "documents").select("doc_id", t.alias("text")).createOrReplaceTempView("_tf_documents")
    return spark.sql("SELECT d.doc_id, f.line_no, f.label, f.value FROM _tf_documents d, LATERAL tf_fields(d.text) f")


def sql_cells(spark, sf):
    """Cells of the statements' lines by a table function over partitions."""
    table_functions.register_tables(spark)
    statements(spark, sf).select("doc_id", F.col("top").cast("int").alias("line_no"), "text", "x0", "x1").createOrReplaceTempView("_tf_words")
    return spark.sql("SELECT * FROM tf_cells(TABLE(SELECT * FROM _tf_words) PARTITION BY doc_id ORDER BY (line_no, x0))")


def model_calls(spark, sf):
    """Turns of the conversations as prompts of a service that refuses options in turn, times out, fails, or does not answer in JSON."""

    def service(prompt: str, way: dict) -> str:
        kind = int(prompt[0])
        if kind == 1 and "max_tokens" in way or kind == 2 and {"max_tokens", "max_completion_tokens"} & way.keys() or kind == 3 and "extra_body" in way:
            raise ValueError("unsupported parameter")
        if kind == 4:
            raise TimeoutError("600 s")
        if kind == 5:
            raise RuntimeError("quota")
        if kind == 6:
            return " "
        return "Sure, in a moment." if kind == 7 and not prompt.endswith(calls.FIRMER) else '{"ok": true}'

    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(((F.col("conv_id") + F.col("turn")) % 8).cast("string"), F.lit(" "), "conv_id", F.lit("/"), "turn", F.lit(" "), F.coalesce("text", F.lit(""))).alias("prompt"), calls.token_budget(F.col("turn") * 10, "").alias("tokens"))
    return calls.ask_model(turns, service, "http://localhost:8000/v1", tokens="tokens").drop("prompt")


def hsn_and_exempt(spark, sf):
    """Misplaced tariff codes and exempt rows."""
    k = F.col("p_partkey")
    cols = F.create_map(
        F.lit("description"), F.when(k % 5 == 0, F.concat("p_name", F.lit(" nil rated"))).otherwise(F.col("p_name")), F.lit("unit"), F.when(k % 3 == 0, (k % 9000 + 1000).cast("string")).otherwise("pcs"),
        F.lit("hsn"), F.when(k % 2 == 0, "8471").otherwise(""), F.lit("cgst_rate"), F.lit("9"),
    )
    rows = tables.fix_exempt(tables.fix_hsn(table(spark, sf, "part").select(k.cast("string").alias("doc_id"), F.lit(1).alias("row_no"), cols.alias("cols"))))
    return rows.select("doc_id", *(F.try_element_at("cols", F.lit(c)).alias(c) for c in ("unit", "hsn", "cgst_rate")))


TARGETS = (("subtotal", "Taxable Amount"), ("cgst", "Central Tax"), ("sgst", "UTGST"), ("igst", "Integrated GST"), ("total_tax", "Total GST"), ("round_off", "Rounding"), ("grand_total", "Net Payable"), ("discount", "Less Discount"))


def summary_targets(spark, sf):
    """All eight labels of a summary block, of which the last two of three pages count."""
    label = F.element_at(F.array(*(F.lit(t) for _, t in TARGETS)), (F.col("pos") + 1).cast("int"))
    lines = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("line_no"))
    lines = lines.select("doc_id", (F.floor(F.col("line_no") / 8) + 1).cast("int").alias("page_no"), "line_no", (F.col("line_no") % 8).alias("pos")).where("(doc_id + pos) % 5 <> 0 or page_no <> 2")
    return pages.financial_summary(lines.withColumn("text", F.concat(label, F.lit(" 18 % : "), F.format_number(F.col("doc_id") * 10 + F.col("line_no"), 2))))


def fallback_fill(spark, sf):
    """Invoices with gaps that their text fills."""
    b, k = bills(spark, sf), F.col("l_orderkey") % 3
    text = F.concat(F.lit("Tax Invoice\n"), "vendor", F.lit(" Trading Pvt Ltd  Invoice No: N-"), "l_orderkey", F.lit("\nPO No: P/"), "l_suppkey", F.lit(" of 2024-03-05\nSub Total: "), F.col("line_sum").cast("string"), F.lit("\nGrand Total USD "), (F.col("line_sum") + F.col("tax_sum")).cast("decimal(18,2)").cast("string"))
    gaps = b.select("doc_id", F.when(k == 0, F.col("vendor")).alias("vendor"), F.when(k == 1, F.lit("KEPT-1")).alias("invoice_number"), F.lit(None).cast("string").alias("invoice_date"), F.lit(None).cast("string").alias("po_number"), F.when(k == 2, F.col("subtotal")).alias("subtotal"), F.lit(None).cast("decimal(18,2)").alias("tax"), F.when(k == 0, F.col("total")).alias("total"), text.alias("text"))
    return pages.fallback_fields(gaps).drop("text")


def value_labels(spark, sf):
    """The label of every amount of the statements: the words left of it."""
    words = statements(spark, sf).select("doc_id", F.col("top").cast("int").alias("line_no"), "x0", "text", "word_no")
    values = words.where("x0 = 300 and word_no >= 10").select("doc_id", F.col("word_no").alias("value_id"), "line_no", "x0")
    return edits.labels_for(values, words)


def backward_match(spark, sf):
    b = F.array(F.lit(0.0), F.lit(100.0), F.lit(250.0), F.lit(900.0))
    return table(spark, sf, "events").select("event_id", tables.to_boundary(F.col("value"), b).alias("column"))


def table_row_count(spark, sf):
    per_order = bill_lines(spark, sf).groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n_rows"))
    return pages.table_rows(per_order.select(F.col("l_suppkey").alias("doc_id"), "n_rows"))


def ocr_mix(spark, sf):
    """Documents of native and scanned pages: text in page order and the boxes' mean confidence."""
    e = table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("doc_id"), (F.col("user_id") % 3).cast("int").alias("page_no"), F.col("event_id").alias("seq"), "event_type")
    native = e.select("doc_id", "page_no").distinct().withColumn("text", F.when(F.col("page_no") == 0, F.repeat(F.lit("native text "), F.lit(30))).otherwise(F.lit("--- PAGE 1 ---")))
    boxes = e.select("doc_id", "page_no", "seq", F.col("event_type").alias("text"), F.when(F.col("seq") % 2 == 0, 0.75).otherwise(0.5).alias("conf"))
    return pages.ocr_text(native, boxes).select("doc_id", F.md5("text").alias("text_md5"), "ocr_used", "ocr_confidence")


def ocr_fallbacks(spark, sf):
    """Scanned pages by an engine that each worker builds once: some it can't read, some give nothing, so native text stays."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_no"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("--- PAGE 1 ---"), F.left("source", F.lit(5)))).otherwise(F.concat("text", F.repeat(F.lit(" native"), F.lit(9)))).alias("text"), F.encode(F.concat(F.col("doc_id") % 3, F.lit("scan of "), "doc_id"), "UTF-8").alias("image"))

    def make():
        def read(image: bytes) -> list[tuple[str, float]]:
            if image[:1] == b"0":
                raise ValueError("no image")
            return [(image[1:].decode(), 0.75), ("end", 0.25)] if image[:1] == b"1" else []

        return read

    boxes = engines.recognise(d.where("cast(doc_id as long) % 2 = 0"), make, "ocr_fallbacks")
    return pages.ocr_text(d.drop("image"), boxes).select("doc_id", F.md5("text").alias("text_md5"), "ocr_used", "ocr_confidence")


def wide_line_columns(spark, sf):
    cols = F.when(F.col("pos") % 2 == 0, F.create_map(F.lit("qty"), F.col("quantity").cast("int").cast("string"), F.lit("description"), F.col("l_partkey").cast("string"))).otherwise(F.create_map(F.lit("description"), F.col("l_partkey").cast("string"), F.lit("rate"), F.col("price").cast("string")))
    rows = bill_lines(spark, sf).select("doc_id", "pos", "l_partkey", (F.col("l_orderkey") * 100 + F.col("pos")).alias("batch_pos"), cols.alias("cols"))
    return exports.wide_lines(rows).drop("batch_pos")


def text_cleanup(spark, sf):
    t = F.concat(F.lit("a\x00b\x07\t--- page 7 ---"), "text", F.lit("=== end === x"))
    return table(spark, sf, "documents").select("doc_id", S.clean_text(t).alias("cleaned"), S.strip_page_marks(t).alias("unmarked"), S.token_budget(F.col("n_chars"), 200_000).alias("budget"), S.title_header(F.concat("source", F.lit("_total_amount"))).alias("title"))


def history_batches(spark, sf):
    """Two batches appended to a history again and again, merged, read back."""
    path = _scratch(spark, "history")
    b = bills(spark, sf).withColumns({"batch_pos": F.col("l_orderkey") * 1000 + F.col("l_suppkey"), "file_hash": F.col("vendor"), "validation_ok": F.col("total").isNotNull()})
    for day, part in (("2024-01-01", b.where("total is not null")), ("2024-01-02", b.where("total is null"))):
        for _ in range(2):  # the second time changes nothing
            files.append_history(part, path, day, 10)
    files.compact_history(spark, path)
    files.append_history(part, path, day, 10)  # nor does it after they were merged
    return readers.read_history(spark, path)


def audit_log(spark, sf):
    """Details are scrubbed on their way into the log; a compacted log keeps the newest."""
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("timestamp"), F.col("event_type").alias("event"), F.concat(F.lit("api_key="), F.col("user_id"), F.lit(" by "), "event_type").alias("detail"), F.col("user_id").cast("string").alias("user"), F.lit("ok").alias("outcome"))
    path = _scratch(spark, "audit")
    for k in (0, 1, 0):
        files.append_audit(rows.where(f"seq % 2 = {k}"), path, f"half {k}")
    files.compact_audit(spark, path, 500)
    return readers.read_audit(spark, path).select("seq", "event", "detail", "user")


def scanned_states(spark, sf):
    """Files that are fine, encrypted, broken, or have no pages."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 7
    state = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.when(k == 1, "encrypted").when(k == 2, "error").otherwise("ok").alias("state"))
    return pages.scanned_files(state, d.where("doc_id % 7 <> 3").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_no"), "text"))


def layout_text(spark, sf):
    """Pages with tables by two strategies, of which the first that finds any counts."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("page_no"), F.col("o_orderkey").alias("row_no"), "o_orderstatus")
    rows = o.select("doc_id", "page_no", (F.col("row_no") % 3).cast("int").alias("strategy"), F.lit(1).alias("table_no"), "row_no", F.when(F.col("row_no") % 5 == 0, F.array(F.lit(" "), F.lit(None))).otherwise(F.array(F.concat(F.lit(" n\n"), "row_no"), F.col("o_orderstatus"))).alias("cells"))
    page = o.select("doc_id", "page_no").distinct().withColumn("text", F.concat(F.lit("page of "), "doc_id"))
    return prompts.layout_text(page, rows)


def prompt_parts(spark, sf):
    """The summary block of a prompt, and whether the prompt has to be compact."""
    d = table(spark, sf, "documents")
    has = lambda k: F.when(F.col("doc_id") % k == 0, F.col("n_chars").cast("string"))
    df = d.select("doc_id", "text", *(has(k).alias(name) for k, name in zip((2, 3, 5, 7, 11, 13, 17, 19), pages.SUMMARY_LABELS)))
    url = F.when(F.col("doc_id") % 2 == 0, "https://api.openai.com/v1").otherwise("http://localhost:11434")
    return df.select("doc_id", prompts.summary_text().alias("summary"), prompts.compact_prompt(url, F.col("text")).alias("compact"))


def written_templates(spark, sf):
    """Templates that a model writes; every answer to a long statement is no template."""

    def model(prompt: str) -> str:
        words = prompt.count("\n") - 2
        return "I cannot." if words > 40 else f"```yaml\nvendor: V\nfields:\n  total:\n    anchor: Grand Total\nwords: {words}\n```"

    return prompts.generate_templates(statements(spark, sf), model)


def history_tail(spark, sf):
    b = bills(spark, sf).select((F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("history_seq"), "vendor", "invoice_number")
    return readers.history_tail(b, 200)


def arrival_order(spark, sf):
    """How many documents of the same text came before each."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    return checks.first_in_batch(d, "key", "doc_id").select("doc_id", "seen")


TABLES = (
    json_repair, infer_template, infer_layouts, carried_table, positional_table, header_table, wrapped_table, derived_chain, field_candidates, file_words, first_page_words, sql_fields, sql_cells, model_calls, hsn_and_exempt, summary_targets, fallback_fill, value_labels, backward_match, table_row_count, ocr_mix, ocr_fallbacks,
    wide_line_columns, text_cleanup, history_batches, audit_log, scanned_states, layout_text, prompt_parts, written_templates, history_tail, arrival_order,
)
