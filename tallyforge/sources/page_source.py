"""A data source of words: files of documents, read page by page by a parser plug-in.

    register(spark)
    spark.read.format("tallyforge_words").option("path", folder).option("parser", "module:function").load()

The driver lists the folders directly below the path, never the files in them: folders are dealt to ``partitions`` tasks, and each
task lists and reads its own. Filters on the page number go down to the parser, which is told the last page that is wanted,
so first pages are read without parsing the rest.

A parser is a function (bytes, last page or None) -> pages, each (page number, page height, words), a word being (text, x0, x1, top,
bottom). ``text_pages`` reads plain text. Files are read through pyarrow's file systems. A file that its parser refuses is one
row with the page number 0 and the reason as its text: it does not end the job.
"""

from __future__ import annotations

import importlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "doc_id string, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double, page_height double"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Rows handed on at a time; plain text: points a character, points a line.
ROWS, CHAR, LINE = 10_000, 5.0, 12.0

Page = tuple[int, float, Iterable[tuple[str, float, float, float, float]]]


def text_pages(content: bytes, last: int | None) -> Iterator[Page]:
    """Plain text: pages end at form feeds, lines at line feeds, words are placed by their characters."""
    start = 0
    for no in range(1, content.count(b"\f") + 2):
        if last is not None and no > last:
            return
        end = content.find(b"\f", start)
        page = content[start : end if end >= 0 else len(content)].decode("utf-8", "replace")
        start = end + 1
        lines = page.split("\n")
        yield no, LINE * len(lines), ((m.group(), m.start() * CHAR, m.end() * CHAR, k * LINE, (k + 1) * LINE) for k, line in enumerate(lines) for m in re.finditer(r"[^\x20\x09-\x0D]+", line))


def _uri(path: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", path)


def write_texts(texts: DataFrame, path: str, folders: int = 32) -> None:
    """(doc_id, text): a file for each row, in folders by doc_id. Tasks create the files themselves, so no commit moves them one by
    one on the driver; a task that runs again writes the same names."""
    path = _uri(path)
    system, root = pafs.FileSystem.from_uri(path)
    for k in range(folders):
        system.create_dir(f"{root}/folder={k}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(path)
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{root}/folder={zlib.crc32(str(doc).encode()) % folders}/doc_id={doc}-{task}-{n}.txt") as f:
                    f.write(f"{text or ''}\n".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    texts.select("doc_id", "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()


class Folders(InputPartition):
    """Folders that one task lists and reads, and files directly below the path."""

    def __init__(self, folders: list[str], files: list[str]):
        self.folders, self.files = folders, files


class WordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = _uri(options["path"])
        self.parser, self.suffix = options.get("parser", f"{__name__}:text_pages"), options.get("suffix", "")
        self.n, self.last = int(options.get("partitions", 64)), None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes upper limits of the page number; the filters stay for Spark, as a page above may still come from a parser."""
        for f in filters:
            most = None
            if f.__class__ in (EqualTo, LessThan, LessThanOrEqual, In) and f.attribute == ("page_no",):
                most = max(f.value, default=0) if isinstance(f, In) else f.value - 1 if isinstance(f, LessThan) else f.value
            if most is not None:
                self.last = most if self.last is None else min(self.last, most)
            yield f

    def _system(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[InputPartition]:
        system, root = self._system()
        folders, files = [], []
        for x in system.get_file_info(pafs.FileSelector(root, recursive=False)):
            if x.base_name[:1] not in "._":
                (folders if x.type == pafs.FileType.Directory else files).append(x.path)
        dealt = [Folders(sorted(folders)[i :: self.n], sorted(files)[i :: self.n]) for i in range(self.n)]
        return [p for p in dealt if p.folders or p.files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        module, _, name = self.parser.partition(":")
        parse = getattr(importlib.import_module(module), name)
        rows: list[tuple[Any, ...]] = []
        for path in self._files(system, partition):
            with system.open_input_stream(path) as f:
                content = f.read()
            rows += self._words(path, content, parse)
            while len(rows) >= ROWS:
                yield self._batch(rows[:ROWS])
                rows = rows[ROWS:]
        if rows:
            yield self._batch(rows)

    def _files(self, system: pafs.FileSystem, partition: InputPartition) -> Iterator[str]:
        root = len(self._system()[1])
        listed = (sorted(x.path for x in system.get_file_info(pafs.FileSelector(folder, recursive=True)) if x.type == pafs.FileType.File) for folder in partition.folders)
        for paths in (partition.files, *listed):
            yield from (p for p in paths if p.endswith(self.suffix) and not any(part[0] in "._" for part in p[root:].split("/") if part))

    def _words(self, path: str, content: bytes, parse) -> Iterator[tuple]:
        n = 0
        try:
            for page, height, words in parse(content, self.last):
                for text, x0, x1, top, bottom in words:
                    yield path, page, n, text, x0, x1, top, bottom, height
                    n += 1
        except Exception as e:  # noqa: BLE001  the plug-in's
            yield path, 0, n, f"{type(e).__name__}: {e}"[:300], None, None, None, None, None

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _NAMES)


class WordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tallyforge_words"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WordReader:
        return WordReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WordSource)
