"""Operators on pages and lines of text: reading quality, labelled values, vendor detection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators.checks import SUBTOTAL_LABELS, TOTAL_LABELS, printed_amounts, printed_figures, printed_subtotal, printed_total

#: Fixed value: what ends a line.
LINE_END = r"\r\n|\r|\n"

__all__ = ["SUBTOTAL_LABELS", "TOTAL_LABELS", "printed_figures"]


def text_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, text) of the lines that are not blank."""
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, LINE_END)).alias("line_no", "text")).where(F.trim("text") != "")


def content_length(text: Column) -> Column:
    """Letters and digits of a page, without page marks and control characters."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(?i)---\s*PAGE\s*\d+\s*---", ""), r"===\s*.*?\s*===", "")
    return F.length(F.regexp_replace(clean, "[^a-zA-Z0-9]", ""))


def scanned(pages: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, page_no, text) -> whether a document is scanned: too few characters over all its pages."""
    return pages.groupBy("doc_id").agg(F.sum(content_length(F.coalesce("text", F.lit("")))).alias("n_content"), F.count("*").alias("n_pages")).withColumn("scanned", F.col("n_content") < least * F.col("n_pages"))


def scanned_files(files: DataFrame, pages: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, state) with state ok, encrypted or error, and their pages -> (doc_id, scanned).

    An encrypted file counts as native, one that cannot be read or has no pages as scanned.
    """
    judged = scanned(pages, least).select(F.col("doc_id").alias("_d"), F.col("scanned").alias("_s"))
    flag = F.when(F.col("state") == "encrypted", False).when(F.col("state") == "error", True).otherwise(F.coalesce("_s", F.lit(True)))
    return files.join(judged, F.col("doc_id") == F.col("_d"), "left").select("doc_id", flag.alias("scanned"))


def page_source(pages: DataFrame, least: int = 50) -> DataFrame:
    """Each page's source: native where it has text enough and its document is not scanned, else ocr."""
    whole = Window.partitionBy("doc_id")
    n = content_length(F.coalesce("text", F.lit("")))
    flag = F.sum(n).over(whole) < least * F.count("*").over(whole)
    return pages.withColumn("page_source", F.when((n >= least) & ~flag, "native").otherwise("ocr"))


def tag_boxes(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, page_no, seq, text, conf) -> accepted boxes with their text, marked by how sure it is.

    Boxes from 0.4 up count; a page that would keep none keeps those over 0.1.
    """
    t = F.trim("text")
    kept = (t != "") & ((F.col("conf") >= least) | (F.col("conf") >= 0.4))
    page = Window.partitionBy("doc_id", "page_no")
    df = boxes.withColumn("_any", F.max(F.when(kept, 1).otherwise(0)).over(page) == 1)
    tagged = F.when(F.col("conf") >= least, t).when(F.col("conf") >= 0.4, F.concat(F.lit("[?"), t, F.lit("?]"))).otherwise(F.concat(F.lit("[??"), t, F.lit("??]")))
    return df.where((F.col("_any") & kept) | (~F.col("_any") & (t != "") & (F.col("conf") > 0.1))).select("doc_id", "page_no", "seq", tagged.alias("tagged"), "conf")


def unmarked(text: Column) -> Column:
    """What is left of a text without the marks of pages and sections."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)---\s*PAGE\s*\d+\s*---", ""), r"===\s*\S.*?\s*===", ""))


def ocr_text(pages: DataFrame, boxes: DataFrame, least: float = 0.5, enabled: bool = True) -> DataFrame:
    """A row per document: pages' text in order, whether boxes were used, and their mean confidence.

    Native text alone, with confidence 1, where recognition is switched off, where any of a document's boxes has a ``problem``
    (see ``engines.recognise``), or where nothing but marks came out.
    """
    native = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    if not enabled:
        return pages.groupBy("doc_id").agg(native.alias("text"), F.lit(False).alias("ocr_used"), F.lit(1.0).alias("ocr_confidence"))
    faulty = F.col("problem").isNotNull() if "problem" in boxes.columns else F.lit(False)
    failed = boxes.where(faulty).select(F.col("doc_id").alias("_f")).distinct()
    tagged = tag_boxes(boxes.where(~faulty), least)
    by_page = tagged.groupBy(F.col("doc_id").alias("_d"), F.col("page_no").alias("_p")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tagged"))), lambda x: x["tagged"]), "\n").alias("boxed"), F.sum("conf").alias("_sum"), F.count("*").alias("_n"),
    )
    df = page_source(pages).join(by_page, (F.col("doc_id") == F.col("_d")) & (F.col("page_no") == F.col("_p")), "left")
    use = F.col("page_source") == "ocr"
    df = df.withColumns({"_t": F.when(use, F.coalesce("boxed", F.lit(""))).otherwise(F.col("text")), "_s": F.when(use, F.col("_sum")), "_c": F.when(use, F.col("_n"))})
    n = F.coalesce(F.sum("_c"), F.lit(0))
    read = df.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "_t"))), lambda x: x["_t"]), "\n\n").alias("_text"), native.alias("_native"), F.max(use).alias("_used"),
        F.round(F.when(n > 0, F.sum("_s") / n).when(F.max(use), 0.0).otherwise(1.0), 4).alias("_conf"),
    )
    good = F.col("_f").isNull() & (unmarked(F.col("_text")) != "")
    read = read.join(failed, F.col("doc_id") == F.col("_f"), "left")
    return read.select("doc_id", F.when(good, F.col("_text")).otherwise(F.col("_native")).alias("text"), (good & F.col("_used")).alias("ocr_used"), F.when(good, F.col("_conf")).otherwise(1.0).alias("ocr_confidence"))


def page_offsets(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, height) -> offset: the heights of the pages before."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum("height").over(before), F.lit(0.0)))


def table_rows(tables: DataFrame) -> DataFrame:
    """(doc_id, n_rows) per table -> rows of all tables but their headers."""
    return tables.groupBy("doc_id").agg(F.sum(F.greatest(F.col("n_rows") - 1, F.lit(0))).alias("n_table_rows"))


# -- vendors

#: What company names end with, what no vendor line starts with, what headers consist of.
SUFFIXES = ("pvt ltd", "private limited", "limited", " ltd", " llp", " inc", " llc", " gmbh", " corp", " corporation", " co.", " company", " enterprises", " technologies", " solutions", " systems", " industries", " traders")
SKIPPED = ("tax invoice", "invoice", "bill", "receipt", "original for", "duplicate for", "triplicate", "credit note", "debit note", "proforma")
HEADERISH = ("customer", "order", "size", "pickup", "time", "qty", "qty.", "item", "items", "price", "subtotal", "total", "amount", "description", "date", "bill", "ship", "to", "from", "sl", "no", "hsn", "sac", "rate", "tax")
LABEL_TAIL = r"(?i)\s+(invoice\s*(no|number|date)|bill\s*(no|number|date)|receipt\s*no|date|gstin|po\s*number|order\s*ref|tax\s*invoice)\b.*$"


def _any(holds, text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words, as ``holds`` has it; words that another is part of need not be tried."""
    least = [w for w in words if not any(o != w and o in w and (holds is F.contains or w.startswith(o)) for o in words)]
    return reduce(lambda a, b: a | b, (holds(text, F.lit(w)) for w in least))


def with_vendor_guess(docs: DataFrame, lines: Column | None = None) -> DataFrame:
    """Adds vendor_guess: the line of ``text`` that looks like a supplier's name, or ''.

    First a line among the first 25 with a company suffix, without the label that may follow; then a plain
    line among the first 15. ``lines`` are those of the text, where they are known; without any nothing is guessed.
    """
    split = F.split("text", LINE_END) if lines is None else lines
    lines = F.filter(F.transform(split, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    # lower case once a line: a lambda's expressions are not shared
    lowered = F.transform(F.slice(F.coalesce(lines, F.array().cast("array<string>")), 1, 25), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    df = docs.withColumn("_lines", lowered)

    def unfit(x: Column) -> Column:
        hits = F.size(F.filter(F.split(x["low"], " "), lambda t: F.btrim(t, F.lit(":.")).isin(*HEADERISH)))
        return _any(F.startswith, x["low"], SKIPPED) | ((hits >= 2) & (hits >= F.size(F.split(x["low"], " ")) / 2))

    cleaned = F.transform(F.filter("_lines", lambda x: _any(F.contains, x["low"], SUFFIXES) & ~unfit(x)), lambda x: F.btrim(F.regexp_replace(x["s"], LABEL_TAIL, ""), F.lit(" -|,")))
    one = F.get(F.filter(cleaned, lambda s: (F.length(s) > 3) & (F.length(s) <= 70)), F.lit(0))
    plain = F.filter(F.slice("_lines", 1, 15), lambda x: (F.length(x["s"]) >= 4) & (F.length(x["s"]) <= 70) & ~F.contains(x["s"], F.lit(":")) & ~x["s"].rlike(r"\d{2,}") & ~unfit(x))
    return df.withColumn("vendor_guess", F.coalesce(one, F.get(plain, F.lit(0))["s"], F.lit(""))).drop("_lines")


def guess_vendor(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, vendor_guess)."""
    return with_vendor_guess(docs.select("doc_id", "text")).select("doc_id", "vendor_guess")


#: So many keywords become one expression; more are looked for by one automaton in a pass over each text.
MOST_KEYWORDS = 500


def loose_words(keyword: str) -> list[str]:
    """The words that stand for a keyword which isn't in a text as a whole: those of three letters or more, if there are two, be they equal."""
    words = [w for w in re.split(r"\W+", keyword) if len(w) > 2]
    return words if len(words) > 1 else []


def _match_many(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """As ``match_templates``, with one automaton of all keywords and their words in every Python worker."""
    known = []
    for r in keywords.orderBy("ord").toLocalIterator():
        kw = (r.keyword or "").lower().strip()
        if kw:
            known.append((int(r.ord), r.template_id, r.keyword, kw, set(loose_words(kw))))
    shared = docs.sparkSession.sparkContext.broadcast(known)  # the configuration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, by_word = ahocorasick.Automaton(), {}
        for i, (*_, kw, words) in enumerate(shared.value):
            for w in {kw} | words:
                by_word.setdefault(w, set()).add(i)
                machine.add_word(w, w)
        machine.make_automaton()
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = {w for _, w in machine.iter((text.as_py() or "").lower())}
                best = None
                for i in {i for w in found for i in by_word[w]}:
                    place, template, keyword, kw, words = shared.value[i]
                    score = 1.0 if kw in found else 0.85 if words and words <= found else 0.0
                    if score and (best is None or (score, -place) > best[0]):
                        best = (score, -place), template, keyword
                out.append((best[1], best[2], best[0][0]) if best else (None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64())))], ["doc_id", "template_id", "keyword", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, template_id string, keyword string, score double")


def match_templates(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, text) against (template_id, ord, keyword): the best template of each document.

    1.0 for a keyword inside the text, 0.85 if all its words of three letters or more are, two at least;
    ties go to the smaller ord. The join has no equality, so keywords (configuration, a row per template)
    are collected to one array and every document is scored where it lies: no shuffle, no nested loop.
    """
    rows = keywords.orderBy("ord").limit(MOST_KEYWORDS + 1).collect()
    if len(rows) > MOST_KEYWORDS:
        return _match_many(docs, keywords)
    low = F.lower(F.coalesce("text", F.lit("")))
    known = []
    for r in rows:
        kw = (r.keyword or "").lower().strip()
        if not kw:
            continue
        loose = reduce(lambda a, b: a & b, (F.contains(F.col("_low"), F.lit(w)) for w in loose_words(kw)), F.lit(bool(loose_words(kw))))
        score = F.when(F.contains(F.col("_low"), F.lit(kw)), 1.0).when(loose, 0.85).otherwise(0.0)
        known.append(F.struct(score.alias("score"), F.lit(-int(r.ord)).alias("place"), F.lit(r.template_id).alias("template_id"), F.lit(r.keyword).alias("keyword")))
    none = F.lit(None).cast("struct<score:double,place:int,template_id:string,keyword:string>")
    best = F.array_max(F.array(*known)) if known else none
    df = docs.withColumn("_low", low).select("doc_id", best.alias("_b")).withColumn("_b", F.when(F.col("_b.score") > 0, F.col("_b")))
    return df.select("doc_id", F.col("_b.template_id").alias("template_id"), F.col("_b.keyword").alias("keyword"), F.col("_b.score").alias("score"))


# -- labelled values in text

#: Where numbers, orders and dates stand, in the order in which they are tried.
NUMBER_LABELS = (
    r"(?i)order\s*(?:number|no\.?|#)\s*[:\-]?\s*([A-Za-z0-9][\w\-/]{2,})", r"(?i)invoice\s*(?:number|no\.?|#)\s*[:\-]?\s*([A-Za-z0-9][\w\-/]{2,})", r"(?i)bill\s*(?:number|no\.?|#)\s*[:\-]?\s*([A-Za-z0-9][\w\-/]{2,})",
    r"(?i)receipt\s*(?:number|no\.?|#)\s*[:\-]?\s*([A-Za-z0-9][\w\-/]{2,})",
)
ORDER_LABELS = (
    r"(?i)(?:PO|P\.O\.)\s*(?:Number|No\.?|#)\s*[:\-]?\s*([A-Z0-9\-/]+)", r"(?i)Purchase\s*Order\s*(?:No\.?|Number|#)?\s*[:\-]?\s*([A-Z0-9\-/]+)", r"(?i)Order\s*(?:Ref|Reference|No\.?)\s*[:\-]?\s*([A-Z0-9\-/]+)",
    r"(?i)Buyer\s*Order\s*(?:No\.?|#)?\s*[:\-]?\s*([A-Z0-9\-/]+)", r"(?i)(?:Reference|Ref)\s*(?:No\.?|Number|#)\s*[:\-]?\s*([A-Z0-9\-/]+)", r"(?i)Customer\s*PO\s*[:\-]?\s*([A-Z0-9\-/]+)", r"(?i)Your\s*Order\s*(?:No\.?|#)?\s*[:\-]?\s*([A-Za-z0-9\-/]+)",
)
DATE_LABELS = (r"\b(\d{4}-\d{2}-\d{2})\b", r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", r"\b(\d{1,2}[-\s][A-Za-z]{3,9}[-,\s]\s*\d{4})\b", r"\b([A-Za-z]{3,9}\s+\d{1,2},\s*\d{4})\b")


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def fallback_fields(invoices: DataFrame) -> DataFrame:
    """Fills what is missing from the document's ``text``: number, order, date, totals, tax, vendor.

    Every row is filled from its own text, where it lies: nothing is shuffled. What is looked at more than once is a column of its
    own first: a date within a date within an expression would be looked for again for every format of both.
    """
    t = F.coalesce("text", F.lit(""))
    lacks = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    df = invoices.withColumns({"_found": F.when(lacks("invoice_date"), first_match(t, DATE_LABELS)), "_split": F.split(t, LINE_END)})
    df = df.withColumns({"_spaced": S.one_spaced(F.col("_found")), "_printed": printed_amounts(F.col("_split"))})
    df = df.withColumn("_given", F.coalesce(F.nullif("invoice_date", F.lit("")), S.iso_date(F.col("_found"), F.col("_spaced")))).withColumn("_spaced", S.one_spaced(F.col("_given")))
    # a vendor is only guessed where there is none
    df = with_vendor_guess(df, F.when(lacks("vendor"), F.col("_split"))).withColumns({
        "invoice_number": F.coalesce(F.nullif("invoice_number", F.lit("")), first_match(t, NUMBER_LABELS)), "po_number": F.coalesce("po_number", first_match(t, ORDER_LABELS)), "invoice_date": S.dmy_date(F.col("_given"), F.col("_spaced")),
    })
    d = "decimal(18,2)"
    df = df.withColumns({"total": F.coalesce(F.col("total").cast(d), printed_total("_printed")), "subtotal": F.coalesce(F.col("subtotal").cast(d), printed_subtotal("_printed")), "vendor": F.coalesce(F.nullif("vendor", F.lit("")), "vendor_guess")})
    return df.withColumn("tax", F.coalesce(F.col("tax").cast(d), (F.col("total") - F.col("subtotal")).cast(d))).select(*invoices.columns)


#: Labels of the summary block.
SUMMARY_LABELS = {
    "subtotal": ("subtotal", "sub total", "taxable value", "taxable amount", "assessable value", "basic amount", "total before tax"), "cgst": ("cgst", "central gst", "central tax"),
    "sgst": ("sgst", "state gst", "state tax", "utgst"), "igst": ("igst", "integrated gst", "integrated tax"), "total_tax": ("total tax", "tax amount", "total gst", "gst amount"),
    "round_off": ("round off", "rounding", "round-off"), "grand_total": ("grand total", "total amount", "net amount", "invoice total", "amount payable", "total payable", "net payable"),
    "discount": ("discount", "total discount", "less discount"),
}


def financial_summary(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, text) -> a column per label: the last figure of the first line that has it.

    Only the last two pages count.
    """
    last = Window.partitionBy("doc_id")
    low, figure = F.lower("text"), S.last_figure(F.col("text"))
    df = lines.withColumn("_last", F.max("page_no").over(last)).where("page_no > _last - 2").withColumns({"_low": low, "_v": figure})
    has = lambda labels: reduce(lambda a, b: a | b, (F.contains("_low", F.lit(x)) for x in labels))
    return df.groupBy("doc_id").agg(*(F.min_by("_v", F.when(has(labels) & F.col("_v").isNotNull(), F.struct("page_no", "line_no"))).alias(field) for field, labels in SUMMARY_LABELS.items()))


def guard(texts: DataFrame, url: Column, allow_cloud: bool = True, redact: bool = True, cap: int = 60_000) -> DataFrame:
    """What may be sent to a model: allowed, prepared text, note. Hints belong into the text before this."""
    local = S.is_local(url)
    names = texts.columns
    clean, n = next(f"_clean{i}" for i in range(99) if f"_clean{i}" not in names), next(f"_found{i}" for i in range(99) if f"_found{i}" not in names)
    texts = S.redacted(texts, "text", clean, n) if redact else texts.withColumns({clean: F.col("text"), n: F.lit(0)})
    prepared = F.when(local, F.col("text")).otherwise(F.col(clean))
    count = F.when(local, 0).otherwise(F.col(n))
    allowed = local | F.lit(allow_cloud)
    notes = F.concat_ws("; ", F.when(count > 0, F.concat(F.lit("redacted "), count.cast("string"), F.lit(" personal/banking identifier(s)"))), F.when(F.length(prepared) > cap, F.lit(f"truncated to {cap} characters")))
    return texts.select(
        *names, allowed.alias("allowed"), F.when(allowed, F.substring(prepared, 1, cap)).otherwise("").alias("prepared"),
        F.when(allowed, notes).otherwise("Cloud AI is disabled in Security settings. Use a local model (Ollama) or re-enable cloud AI.").alias("note"),
    )
