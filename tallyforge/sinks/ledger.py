"""Append-only tables of batches: each batch counts once, however often it is appended; compaction can be broken off.

A ledger is a folder of entries. An entry is written by one Spark job, whose ``_SUCCESS`` mark commits it:

    batch=<id>          the rows of a batch; appending a committed batch again changes nothing
    merged=<n>-<k>      rows of k entries in one, with the list of their names under ``_replaces``

Readers take committed entries and leave out those that a committed merged entry replaces, so it does not matter whether a compaction ended
before, between or after its steps. Folders of replaced entries are deleted by the next compaction that ends. The driver lists
entries, as many as there were appends since the last compaction. One compaction runs at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Entries stay and are read for long: they are packed closer than what passes through.
PACKED = "zstd"


class Ledger:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._fs(name)
        return bool(fs.exists(path))

    def _committed(self) -> list[str]:
        fs, path = self._fs("")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if re.match("(batch|merged)=", n) and self._exists(f"{n}/_SUCCESS"))

    def _replaced(self, committed: list[str]) -> set[str]:
        gone: set[str] = set()
        for n in committed:
            if n.startswith("merged="):
                gone |= {r.value for r in self.spark.read.text(f"{self.path}/{n}/_replaces").collect()}
        return gone

    def entries(self) -> list[str]:
        """The names of the entries that count."""
        committed = self._committed()
        gone = self._replaced(committed)
        return [n for n in committed if n not in gone]

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Writes the rows as one batch; False if the batch is there already, merged or not."""
        name = f"batch={re.sub(r'[^A-Za-z0-9_.-]', '_', batch)}"
        committed = self._committed()
        if name in committed or name in self._replaced(committed):
            return False
        # what a broken append has left is written over
        rows.write.mode("overwrite").option("compression", PACKED).parquet(f"{self.path}/{name}")
        return True

    def read(self) -> DataFrame:
        found = self.entries()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in found))

    def clear(self) -> None:
        fs, path = self._fs("")
        fs.delete(path, True)

    def compact(self, keep: Column | None = None, newest: tuple[str, int] | None = None) -> str | None:
        """One entry in place of all: of rows that ``keep``, or of the ``newest`` (column, how many).

        Batches that were merged stay known, as an append of one of them has to change nothing.
        """
        committed = self._committed()
        gone = self._replaced(committed)
        live = [n for n in committed if n not in gone]
        if len(live) < 2 and keep is None and newest is None or not live:
            return None
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in live))
        rows = rows if keep is None else rows.where(keep)
        rows = rows if newest is None else rows.orderBy(F.desc(newest[0])).limit(newest[1])
        serial = 1 + max((int(n[7:].split("-")[0]) for n in [*committed, *gone] if n.startswith("merged=")), default=0)
        name = f"merged={serial:08d}-{len(live)}"
        # the list first: an entry without rows and mark is none, and rows are never without the list
        fs, path = self._fs(name)
        fs.delete(path, True)
        self.spark.createDataFrame([(n,) for n in sorted({*live, *gone})], "value string").coalesce(1).write.text(f"{self.path}/_lists/{name}")
        rows.write.mode("overwrite").option("compression", PACKED).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{self.path}/{name}")
        fs.rename(self._fs(f"_lists/{name}")[1], self._fs(f"{name}/_replaces")[1])
        fs.create(self._fs(f"{name}/_SUCCESS")[1], True).close()
        for n in live:
            fs.delete(self._fs(n)[1], True)
        return name
