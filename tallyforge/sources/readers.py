"""Readers: folders of files, history and audit tables, configuration, optional plug-ins.

PDF readers, character recognition and language models are callables that the caller brings; the engine
works on tables of words, pages and boxes.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields
from urllib.parse import unquote

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalars import clean_text
from tallyforge.sinks.files import AUDIT, HISTORY
from tallyforge.sinks.ledger import Ledger

WORDS = "doc_id string, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double, page_height double"


@dataclass(frozen=True)
class Settings:
    """Limits and switches; ``load`` takes only known keys from a mapping and keeps the rest at their defaults."""

    allow_cloud_ai: bool = True
    redact_before_ai: bool = False
    max_ai_chars: int = 60_000
    max_file_mb: int = 25
    max_batch_files: int = 100
    audit_log_enabled: bool = True
    audit_log_max_rows: int = 20_000
    ocr_enabled: bool = True
    ocr_dpi: int = 300
    ocr_min_chars: int = 50
    ocr_min_confidence: float = 0.5

    @classmethod
    def load(cls, found: dict | None) -> Settings:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (found or {}).items() if k in known and v is not None})


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate files that driver and executors share, from ``spark.checkpoint.dir``; a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="tallyforge-"))
    return (found or spark.sparkContext.getCheckpointDir()).rstrip("/")


def read_folder(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF,Pdf}") -> DataFrame:
    """(path, modificationTime, length, content) of the files; content is only read if it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def folder_names(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF,Pdf}") -> DataFrame:
    """(path, length) of the files, in order of their names; contents are neither read nor sorted."""
    return read_folder(spark, path, pattern).select("path", "length").orderBy(F.substring_index("path", "/", -1), "path")


def admit(files: DataFrame, limit_mb: int = 25) -> tuple[DataFrame, DataFrame]:
    """Files within the limit that begin with the PDF signature, and the others with a reason."""
    name = F.substring_index("path", "/", -1)
    too_large = F.col("length") > limit_mb * 1024 * 1024
    signed = F.coalesce(F.substring("content", 1, 4) == F.lit(b"%PDF"), F.lit(False))
    why = F.when(too_large, F.concat(name, F.lit(f" is larger than the {limit_mb} MB limit."))).when(~signed, F.concat(name, F.lit(" is not a valid PDF (missing PDF signature).")))
    marked = files.withColumn("reason", why)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").drop("content")


def check_batch(files: DataFrame, most: int = 100) -> None:
    """Refuses a batch of more than ``most`` files; at most one more is counted."""
    if files.select("path").limit(most + 1).count() > most:
        raise ValueError(f"Too many files at once (limit {most}).")


def list_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(name, kb) of the workbooks and CSV files in a folder, by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,csv,XLSX,CSV}").load(path)
    return found.select(F.substring_index("path", "/", -1).alias("name"), F.round(F.col("length") / 1024, 1).alias("kb")).orderBy("name")


def read_templates(spark: SparkSession, path: str) -> dict[str, dict]:
    """Templates of a folder of YAML files by their names without ending: configuration, a few files."""
    found = spark.read.option("pathGlobFilter", "*.{yaml,yml}").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return load_templates({re.sub(r"\.ya?ml$", "", unquote(r.path.rsplit("/", 1)[-1])): r.value for r in found.collect()})


def _file(spark: SparkSession, folder: str, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{safe_id(name)}.yaml")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_template(spark: SparkSession, folder: str, name: str, text: str) -> str:
    """Writes one template, over an older one of its name; the name is made safe."""
    path, fs = _file(spark, folder, name)
    out = fs.create(path, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return path.toString()


def delete_template(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether there was one to delete."""
    path, fs = _file(spark, folder, name)
    return bool(fs.delete(path, False))


def history_tail(history: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` invoices, newest first: a bounded top-k."""
    return history.orderBy(F.desc("history_seq")).limit(n)


def file_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def read_words(files: DataFrame, parser: Callable[[bytes], list[dict]]) -> DataFrame:
    """Words of all pages by a parser plug-in (bytes -> dicts of page_no, text, x0, x1, top, bottom, page_height).

    Heights become global to the document: each page starts where the ones before end.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = [{"doc_id": path, "word_no": i, **w} for i, w in enumerate(parser(bytes(content)))]
                if rows:
                    yield pd.DataFrame(rows)[[c.split()[0] for c in WORDS.split(", ")]]

    return globalise(files.select("path", "content").mapInPandas(run, WORDS).withColumn("text", clean_text(F.col("text"))))


def globalise(words: DataFrame) -> DataFrame:
    """Adds the heights of the pages before to top and bottom."""
    pages = words.select("doc_id", "page_no", "page_height").distinct()
    from tallyforge.operators.pages import page_offsets

    offset = page_offsets(pages.withColumnRenamed("page_height", "height")).select(F.col("doc_id").alias("_d"), F.col("page_no").alias("_p"), "offset")
    df = words.join(offset, (F.col("doc_id") == F.col("_d")) & (F.col("page_no") == F.col("_p")))
    return df.withColumns({"top": F.col("top") + F.col("offset"), "bottom": F.col("bottom") + F.col("offset")}).drop("_d", "_p", "offset")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return Ledger(spark, path, HISTORY).read()


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return Ledger(spark, path, AUDIT).read()


def load_templates(texts: dict[str, str]) -> dict[str, dict]:
    """Template id -> definition from YAML texts, sorted by id; what is no mapping is left out."""
    found = {k: yaml.safe_load(v) for k, v in sorted(texts.items())}
    return {k: v for k, v in found.items() if isinstance(v, dict)}


def template_keywords(spark: SparkSession, templates: dict[str, dict]) -> DataFrame:
    """(template_id, ord, keyword, variant_vendor): a template's own keyword, then its variants'."""
    rows = []
    for name, t in templates.items():
        words = [((t.get("identify") or {}).get("keyword"), None)] + [((v.get("identify") or {}).get("keyword"), v.get("vendor")) for v in t.get("variants") or []]
        rows += [(name, kw, vendor) for kw, vendor in words if kw]
    return spark.createDataFrame([(n, i, kw, v) for i, (n, kw, v) in enumerate(rows)], "template_id string, ord int, keyword string, variant_vendor string")


def load_rules(text: str) -> tuple[dict, dict[str, dict]]:
    """(default profile, vendor profiles) from YAML; a flat file is a default profile."""
    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        return {}, {}
    if data and not {"default", "vendors"} & data.keys():
        return data, {}
    return data.get("default") or {}, data.get("vendors") or {}


def save_rules(default: dict, vendors: dict[str, dict]) -> str:
    return yaml.safe_dump({"default": default, "vendors": vendors}, sort_keys=False, allow_unicode=True)


def change_rules(text: str, rules: dict | None, vendor: str | None = None) -> str:
    """The rules' YAML with one profile replaced: a vendor's, or the default; None deletes a vendor's."""
    default, vendors = load_rules(text)
    if vendor is None:
        return save_rules(rules or {}, vendors)
    kept = {k: v for k, v in vendors.items() if k != vendor}
    return save_rules(default, kept if rules is None else kept | {vendor: rules})


def save_settings(settings: Settings) -> str:
    return yaml.safe_dump(asdict(settings), sort_keys=False)


def load_settings(text: str | None) -> Settings:
    found = yaml.safe_load(text) if text else None
    return Settings.load(found if isinstance(found, dict) else None)


def safe_id(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")
