"""What several operators share: table access, durable intermediate tables, word splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every byte that is no digit, ASCII letter (after lower-casing) or part of a non-ASCII character
#: becomes a space; A-Z become a-z.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent in a local session, as in tests, a folder of our own is set. On a
    cluster a folder of the driver's machine would be of no use to the executors: that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Workspace:
    """Intermediate tables as Parquet in the shared folder.

    A written table cuts lineage and survives the loss of executors. ``drop`` deletes those that
    nothing reads any more; what a returned DataFrame reads has to stay.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            path = self.paths.pop(id(df), None)
            if path:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def private(name: str, *dfs: DataFrame) -> str:
    """``name``, or the first longer one that none of the tables has."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast if the (written) table has at most ``most`` rows; else a shuffled join serves.

    Callers choose ``most`` for the width of their rows, so that what is broadcast stays below some 64 MB.
    """
    return F.broadcast(df) if df.count() <= most else df


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEED = np.random.Generator(np.random.PCG64(11))
#: A random number for each byte, none for white space; and the base that counts its place in the word.
_BYTE = np.where(_SPACE, np.uint64(0), _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_BASE = int(_SEED.integers(0, 1 << 62)) * 2 + 1
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(_BASE, len(_powers), 1 << 64))
        _powers = np.concatenate((_powers, _powers * step))
    return _powers


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes.

    Hashes are polynomials over the bytes, scrambled; a word's hash depends on the word alone. Long texts
    are taken in pieces that end at white space, so memory stays bounded.
    """
    a = np.frombuffer(raw, np.uint8)
    piece = 1 << 20
    if len(a) > 2 * piece:
        parts, at = [], 0
        while at < len(raw):
            stop = min(at + piece, len(raw))
            while stop < len(raw) and not _SPACE[a[stop]]:
                stop += 1
            starts, ends, h = _hashed(a[at:stop])
            parts.append((starts + at, ends + at, h))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*parts))
    return _hashed(a)


def _hashed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = _SPACE[a]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    place = np.arange(len(a)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(a)]))))
    h = np.add.reduceat(_BYTE[a] * _power(int(place.max()) + 1)[place], starts)
    return starts, ends, mix64(h + (ends - starts).astype(np.uint64))
