"""What a model is sent and what comes back: page text with tables, summary block, prompt size, templates."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.pages import SUMMARY_LABELS

#: Marks in page text, and labels of the summary block.
PAGE_MARK, TABLES_MARK, TEXT_MARK = "--- PAGE {} ---", "=== STRUCTURED TABLES ===", "=== RAW PAGE TEXT ==="
SUMMARY_NAMES = {
    "subtotal": "Subtotal / Taxable Value", "cgst": "CGST", "sgst": "SGST", "igst": "IGST", "total_tax": "Total Tax", "round_off": "Round Off", "grand_total": "Grand Total", "discount": "Discount",
}
#: Hosts with room for long prompts, tokens of input from which others get the compact one, words of a dump.
ROOMY, TIGHT_TOKENS, DUMP_WORDS = ("api.openai.com", "generativelanguage.googleapis.com"), 2500, 400


def first_strategy(rows: DataFrame) -> DataFrame:
    """Table rows found by several strategies (strategy: its place in the order of trial) -> those of each page's first that found any."""
    first = rows.groupBy(F.col("doc_id").alias("_d"), F.col("page_no").alias("_p")).agg(F.min("strategy").alias("_s"))
    same = (F.col("doc_id") == F.col("_d")) & (F.col("page_no") == F.col("_p")) & (F.col("strategy") == F.col("_s"))
    return rows.join(first, same, "left_semi")


def layout_text(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) and table rows (doc_id, page_no, strategy, table_no, row_no, cells) -> (doc_id, text).

    A page shows its tables, rows with cells joined by `` | `` and blank ones left out, then its own text.
    """
    clean = F.transform("cells", lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))
    full = first_strategy(rows).withColumn("_c", clean)
    lines = full.groupBy("doc_id", "page_no", "table_no").agg(F.array_sort(F.collect_list(F.when(F.exists("_c", lambda c: c != ""), F.struct("row_no", F.array_join("_c", " | ").alias("line"))))).alias("l"))
    body = F.concat(F.array(F.concat(F.lit("[Table "), F.col("table_no").cast("string"), F.lit("]"))), F.transform("l", lambda x: x["line"]))
    tables = lines.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("table_no", body.alias("lines")))).alias("t"))
    found = tables.select(F.col("doc_id").alias("_d"), F.col("page_no").alias("_p"), F.concat(F.array(F.lit(TABLES_MARK)), F.flatten(F.transform("t", lambda x: x["lines"])), F.array(F.lit(""))).alias("_t"))
    joined = pages.join(found, (F.col("doc_id") == F.col("_d")) & (F.col("page_no") == F.col("_p")), "left")
    before, after = PAGE_MARK.split("{}")
    page = F.array_join(F.concat(F.array(F.concat(F.lit(before), F.col("page_no").cast("string"), F.lit(after))), F.coalesce("_t", F.array().cast("array<string>")), F.array(F.lit(TEXT_MARK), F.coalesce("text", F.lit("")))), "\n")
    every = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", page.alias("page")))).alias("p"))
    return every.select("doc_id", F.array_join(F.transform("p", lambda x: x["page"]), "\n").alias("text"))


def summary_text() -> Column:
    """The figures of ``financial_summary`` as lines of a prompt; empty where there are none."""
    lines = F.array_compact(F.array(*(F.concat(F.lit(f"  {SUMMARY_NAMES[k]}: "), F.col(k)) for k in SUMMARY_LABELS)))
    return F.when(F.size(lines) > 0, F.concat(F.lit("Figures printed at the end of the document:\n"), F.array_join(lines, "\n"))).otherwise("")


def compact_prompt(url: Column, text: Column) -> Column:
    """Whether the short instructions are due: a host without much room, and a long text (four characters a token)."""
    roomy = F.coalesce(F.contains(url, F.lit(ROOMY[0])) | F.contains(url, F.lit(ROOMY[1])), F.lit(False))
    return ~roomy & (F.floor(F.length(text) / 4) > TIGHT_TOKENS)


def word_dump(words: DataFrame, most: int = DUMP_WORDS) -> DataFrame:
    """(doc_id, dump): the first words of a document with their places, a line each."""
    line = F.concat_ws(" ", F.round("x0", 0).cast("int"), F.round("top", 0).cast("int"), F.col("text"))
    held = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "word_no", line.alias("line")))).alias("w"))
    return held.select("doc_id", F.array_join(F.transform(F.slice("w", 1, most), lambda w: w["line"]), "\n").alias("dump"))


def generate_templates(words: DataFrame, model: Callable[[str], str], vendor: str = "") -> DataFrame:
    """(doc_id, template json or null, problem): templates that a model writes as YAML from a dump of the words."""
    asked = word_dump(words)

    def read(answer: str) -> tuple[str | None, str]:
        text = re.sub(r"^```[a-zA-Z]*\n|```$", "", answer.strip()).strip()
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError:
            found = None
        return (json.dumps(found, ensure_ascii=False), "") if isinstance(found, dict) and "fields" in found else (None, "no template in the answer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [read(model(f"Vendor: {vendor}\nWords as x, y, text:\n{dump}\nAnswer with the template as YAML, nothing else.")) for dump in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["doc_id", "template", "problem"])

    return asked.mapInArrow(run, "doc_id string, template string, problem string")
