"""Writers: CSV pair, workbook, voucher file, append-only history and audit tables."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xml.sax.saxutils import escape

from tallyforge.functions.scalars import scrub
from tallyforge.sinks.ledger import Ledger

HISTORY = "history_seq long, processed_at string, source_file string, vendor string, invoice_number string, invoice_date string, total string, file_hash string, status string"
AUDIT = "seq long, timestamp string, event string, detail string, user string, outcome string"
#: A workbook is one file made on the driver; larger results belong into CSV or Parquet.
MOST_SHEET_ROWS = 1_000_000


def write_csv_pair(invoices: DataFrame, lines: DataFrame, folder: str) -> None:
    """Folders ``invoices`` and ``line_items`` of CSV parts with headers."""
    invoices.write.mode("overwrite").csv(f"{folder}/invoices", header=True)
    lines.write.mode("overwrite").csv(f"{folder}/line_items", header=True)


def _cell(ref: str, value: object, style: int) -> str:
    s = f' s="{style}"' if style else ""
    if value is None:
        return f'<c r="{ref}"{s}/>'
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c r="{ref}" t="inlineStr"{s}><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f'<c r="{ref}"{s}><v>{value}</v></c>'


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet(df: DataFrame, flag: str | None) -> str:
    rows = df.limit(MOST_SHEET_ROWS + 1).collect()
    if len(rows) > MOST_SHEET_ROWS:
        raise ValueError("too many rows for a sheet; write CSV or Parquet instead")
    names = df.columns
    out = ['<row r="1">' + "".join(_cell(f"{_letters(i)}1", n.replace("_", " ").title(), 1) for i, n in enumerate(names, 1)) + "</row>"]
    for at, r in enumerate(rows, 2):
        style = 2 if flag and r[flag] in ("CHECK", "REVIEW", "TOTAL", 1) else 0
        out.append(f'<row r="{at}">' + "".join(_cell(f"{_letters(i)}{at}", r[n], style) for i, n in enumerate(names, 1)) + "</row>")
    return '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(out) + "</sheetData></worksheet>"


def workbook(sheets: dict[str, tuple[DataFrame, str | None]]) -> bytes:
    """An XLSX file; each sheet is (rows, name of the column that shades a row). Written with the standard library."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="rs" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        fill = lambda c: f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>'
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill("DDE6F0")}{fill("FBE4D5")}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf fillId="3" applyFill="1"/></cellXfs></styleSheet>')
        for i, (df, flag) in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(df, flag))
    return data.getvalue()


def write_vouchers(vouchers: DataFrame, folder: str, company: str = "") -> None:
    """Text parts of vouchers; each part is a whole envelope, so parts can be imported one by one."""
    name = f"<STATICVARIABLES><SVCURRENTCOMPANY>{escape(company)}</SVCURRENTCOMPANY></STATICVARIABLES>" if company else ""
    head = f"<ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER><BODY><IMPORTDATA><REQUESTDESC><REPORTNAME>Vouchers</REPORTNAME>{name}</REQUESTDESC><REQUESTDATA>"
    tail = "</REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>"
    vouchers.select(F.concat(F.lit(head), F.col("xml"), F.lit(tail)).alias("value")).write.mode("overwrite").text(folder)


def append_history(invoices: DataFrame, path: str, processed_at: str, start: int = 0, batch: str | None = None) -> bool:
    """Appends a batch; batch_pos gives the order. The caller says when, so reruns agree.

    A batch is known by its name, which follows from time and start where none is given: appending it again changes
    nothing, and gives False.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = invoices.select(
        (F.col("batch_pos") + start).cast("long").alias("history_seq"), F.lit(processed_at).alias("processed_at"), "source_file", "vendor", text("invoice_number"), text("invoice_date"), text("total"), text("file_hash"),
        F.when(F.col("validation_ok"), "OK").otherwise("REVIEW").alias("status"),
    )
    return Ledger(invoices.sparkSession, path, HISTORY).append(rows, batch or f"{processed_at}-{start}")


def compact_history(spark: SparkSession, path: str) -> None:
    """All batches in one entry; it may be broken off at any time."""
    Ledger(spark, path, HISTORY).compact()


def clear_history(spark: SparkSession, path: str) -> None:
    Ledger(spark, path, HISTORY).clear()


def append_audit(events: DataFrame, path: str, batch: str) -> bool:
    """(seq, timestamp, event, detail, user, outcome): details are scrubbed before they are written. A batch of a known name changes nothing."""
    return Ledger(events.sparkSession, path, AUDIT).append(events.withColumn("detail", scrub(F.col("detail"))), batch)


def audit_tail(audit: DataFrame, n: int = 300, events: tuple[str, ...] = ()) -> DataFrame:
    """The last ``n`` events, of the given kinds if any, newest first: a bounded top-k, no full sort."""
    return (audit.where(F.col("event").isin(*events)) if events else audit).orderBy(F.desc("seq")).limit(n)


def audit_counts(audit: DataFrame, events: tuple[str, ...] = ()) -> DataFrame:
    """(event, n, first_seq, last_seq, failures) of the given kinds, or of all, most frequent first; sums travel, not rows."""
    kept = audit.where(F.col("event").isin(*events)) if events else audit
    return kept.groupBy("event").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_if(F.col("outcome") != "ok").alias("failures")).orderBy(F.desc("n"), "event")


def compact_audit(spark: SparkSession, path: str, most: int = 20_000) -> None:
    """Keeps the newest ``most`` events, in one entry; it may be broken off at any time."""
    Ledger(spark, path, AUDIT).compact(newest=("seq", most))


def clear_audit(spark: SparkSession, path: str) -> None:
    Ledger(spark, path, AUDIT).clear()
