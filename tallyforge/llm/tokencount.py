"""Token counts as delta-maintained rollups.

A change is a row (sign, text, lang, source): +1 for an insert, -1 for a delete; a revised document is one
of each. Every batch of changes becomes one small table of signed sums by source, language and tokenizer
version, under its own batch id. Totals are the sums over all batches, so deletes and late revisions need
no recount of what did not change. A batch id counts once, however often it is committed. ``compact`` folds
batches into one table that remembers their ids.

Counting happens where the text lies; a task hands on one row for each (source, language) it has seen.

Defined results: null and empty texts count as a document with no characters, words or tokens; null
sources and languages are groups of their own; repeated rows count each; extra columns are ignored; an
empty batch is a batch; a change without a sign changes nothing. Texts are counted whole. Totals whose every
count is zero are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import Workspace, small

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}"
COUNTS = ("n_docs", "n_chars", "n_words", "n_tokens")
SCHEMA = "source string, lang string, version string, n_docs long, n_chars long, n_words long, n_tokens long"

_built: dict[str, object] = {}


class Tokenizer:
    """A byte-pair vocabulary read on the driver; workers get its bytes and build it once."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.data = f.read()
        self.version = hashlib.sha256(self.data + PATTERN.encode()).hexdigest()[:12]

    def encoding(self):
        if self.version not in _built:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
            _built[self.version] = tiktoken.Encoding(self.version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _built[self.version]


def count_changes(changes: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(sign, text, lang, source) -> signed sums by source, lang and the tokenizer's version."""
    shared = changes.sparkSession.sparkContext.broadcast(tokenizer)  # the vocabulary file, a megabyte or so

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encoding().encode_ordinary
        sums: dict[tuple, list[int]] = {}
        for batch in batches:
            for sign, text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
                if sign is None:
                    continue
                text = text or ""
                own = sums.setdefault((source, lang), [0, 0, 0, 0])
                for i, n in enumerate((1, len(text), len(text.encode("utf-8", "surrogatepass").split()), len(encode(text)))):
                    own[i] += sign * n
        rows = [(*key, shared.value.version, *n) for key, n in sums.items()]
        kinds = [pa.string()] * 3 + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    partial = changes.select(F.col("sign").cast("int"), "text", "lang", "source").mapInArrow(run, SCHEMA)
    return partial.groupBy("source", "lang", "version").agg(*(F.sum(c).alias(c) for c in COUNTS))


class Rollup:
    """Signed batches in one folder.

    ``batch=<id>`` holds the sums of a batch, ``compacted=<id>`` those of all tables that it replaces, with
    the ids of the batches in them. A table counts from its success mark on; one that another replaces counts
    no more, whether it is deleted yet or not. So a commit or a compaction that fails at any point, or is
    repeated, changes no total twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = SCHEMA + ", name string, members array<string>, replaces array<string>"

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], self.schema)

    def tables(self) -> dict[str, set[str]]:
        """Names of the tables that count, and the ids of the batches in each.

        Batches are listed; one job reads what all compacted tables hold, none if there are none.
        """
        fs, root = self._fs()
        if not fs.exists(root):
            return {}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        names = [n for n in names if n.startswith(("batch=", "compacted=")) and fs.exists(path(f"{self.path}/{n}/_SUCCESS"))]
        found = {n: {unquote(n.removeprefix("batch="))} for n in names if n.startswith("batch=")}
        replaced: set[str] = set()
        for r in self._read([n for n in names if n.startswith("compacted=")]).where("members is not null").select("name", "members", "replaces").collect():
            found[r.name] = {*r.members}
            replaced |= {*r.replaces}
        return {n: m for n, m in found.items() if n not in replaced}

    def batches(self) -> set[str]:
        """Ids of all batches committed so far."""
        return set().union(*self.tables().values())

    def _write(self, sums: DataFrame, name: str, members: list[str], replaces: list[str]) -> None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("members", "array<string>"), ("replaces", "array<string>"))]
        mark = self.spark.range(1, numPartitions=1).select(
            *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "version")), *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.lit(name).alias("name"), F.array(*map(F.lit, members)).alias("members"),
            F.array(*map(F.lit, replaces)).cast("array<string>").alias("replaces"),
        )
        sums.select("*", *none).unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def commit(self, batch_id: str, changes: DataFrame, tokenizer: Tokenizer) -> bool:
        """Adds a batch; one that is committed already, or part of a compacted table, is left as it is."""
        if batch_id in self.batches():
            return False
        self._write(count_changes(changes, tokenizer), f"batch={quote(batch_id, safe='')}", [batch_id], [])
        return True

    def totals(self) -> DataFrame:
        rows = self._read(sorted(self.tables())).where("members is null")
        return rows.groupBy("source", "lang", "version").agg(*(F.sum(c).alias(c) for c in COUNTS)).where(" or ".join(f"{c} <> 0" for c in COUNTS))

    def compact(self, name: str) -> None:
        """One table for all batches so far, under a name that was never used; it is written whole before they go."""
        old = self.tables()
        members = sorted(set().union(*old.values()))
        new = f"compacted={quote(name, safe='')}"
        fs, _ = self._fs()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if name in members or fs.exists(path(f"{self.path}/{new}")):
            raise ValueError(f"{name!r} is in use")
        self._write(self.totals(), new, members, sorted(old))
        for table_ in old:
            fs.delete(path(f"{self.path}/{table_}"), True)


def revised(docs: DataFrame) -> DataFrame:
    """Changes (sign, text, lang, source) that mask e-mail addresses: a delete and an insert for each document with one."""
    some = docs.where(F.contains("text", F.lit("@")) & F.col("text").rlike(EMAIL))
    both = F.array(F.struct(F.lit(-1).alias("sign"), F.col("text")), F.struct(F.lit(1).alias("sign"), F.regexp_replace("text", EMAIL, "[EMAIL]").alias("text")))
    return some.select(F.explode(both).alias("c"), "lang", "source").select("c.sign", "c.text", "lang", "source")


def op1(docs: DataFrame, labels: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Totals after three batches: all documents come in, toxic ones are withdrawn, texts with e-mail addresses are revised.

    A document is withdrawn if any label of its doc_id says so, and not revised then. Every batch is
    committed twice and counts once.
    """
    spark = docs.sparkSession
    rollup, tokenizer = Rollup(spark, f"{Workspace(spark, 'tokens').root}"), Tokenizer(path)
    docs = docs.select("doc_id", "text", "lang", "source")
    space = Workspace(spark, "takedown")
    toxic = space.save(labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct())
    which = small(toxic, 1_000_000), F.col("doc_id") == F.col("_id")
    batches = {
        "load-1": docs.select(F.lit(1).alias("sign"), "text", "lang", "source"),
        "takedown-1": docs.join(*which, "left_semi").select(F.lit(-1).alias("sign"), "text", "lang", "source"),
        "revision-1": revised(docs.join(*which, "left_anti")),
    }
    for _ in range(2):
        for batch_id, changes in batches.items():
            rollup.commit(batch_id, changes, tokenizer)
    rollup.compact("night-1")
    return rollup.totals()
