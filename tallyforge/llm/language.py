"""Language identification by nearest centroids of TF-IDF vectors of character n-grams.

Texts become vectors over BUCKETS hashed 1- to 3-grams of their UTF-8 letters (logarithmic counts times
inverse document frequency, length one). Each language has several centroids, found by spherical k-means
on a bounded sample. A text gets the language of the centroid with the largest cosine; where even that is
further away than the language's own training texts ever lie, ``rejected`` says so.

Document frequencies come from all training rows; only the clustering is fitted on a sample, of at most
SAMPLE different rows a language, chosen by a hash of doc_id and text. Sampled texts are counted whole where
they lie; their counts come to the driver.

Defined results: null, empty and letterless texts are ``und`` with score 0. Without training rows every
text is ``und``. Ties between centroids go to the language first by code point. Rows with a null language
train nothing. Repeated rows count each in frequencies and once in the sample. Texts are taken whole, of any
length. Letters are what Unicode calls letters, so "² ½" has none. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
CENTROIDS = 4
#: Rows a language that the clusters are fitted on.
SAMPLE = 300
#: Share of a language's training texts that may lie beyond its rejection distance.
REJECT = 0.002

_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)
_LETTER = re.compile(r"[A-Za-z]")
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_SHIFT = np.uint32(32 - (BUCKETS - 1).bit_length())


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    c = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 0x20) | (c[:-1] != 0x20)))]  # one space between words
    one = c * _M1
    two = one[:-1] ^ (c[1:] * _M2)
    two += two << np.uint32(7)
    three = two[:-1] ^ (c[2:] * _M3)
    three += three >> np.uint32(11)
    code = np.concatenate((one * _M3 >> _SHIFT, two * _M1 >> _SHIFT, three * _M1 >> _SHIFT))
    return np.bincount(code, minlength=BUCKETS)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    owner: np.ndarray
    floor: np.ndarray  # the least cosine of each language that is no rejection

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        x = np.log1p(np.array(rows, np.float32)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        live = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for lo in range(0, len(live), 256):
            part = live[lo : lo + 256]
            cosine = self.vectors([counts(texts[i]) for i in part]) @ self.centroids.T
            best = cosine.argmax(1)
            for i, b, score in zip(part, best.tolist(), cosine.max(1).tolist()):
                own = int(self.owner[b])
                out[i] = (self.langs[own], min(max(float(score), 0.0), 1.0), bool(score < self.floor[own]))
        return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: for each bucket the number of texts it occurs in; bucket -1 counts texts."""
    df = np.zeros(BUCKETS, np.int64)
    n = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if has_letter(text):
                df += counts(text) > 0
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["bucket", "n"])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts."""
    centres = [x.mean(0)]
    for _ in range(1, min(k, len(x))):
        centres.append(x[np.max(x @ np.array(centres).T, axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, text) -> (lang, h, bucket numbers, counts) of texts with a letter."""
    for batch in batches:
        out: list[tuple] = []
        for lang, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            if has_letter(text):
                c = counts(text)
                at = np.flatnonzero(c)
                out.append((lang, h, at.astype(np.uint16).tobytes(), c[at].astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "h", "at", "c"])


def train(rows: DataFrame, k: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """Fit on (doc_id, text, lang): frequencies of all rows, clusters of a bounded sample of each language."""
    rows = rows.where("lang is not null")
    df, n = np.zeros(BUCKETS), 0
    for r in rows.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            n = r.n
        else:
            df[r.bucket] = r.n
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    hashed = rows.where(F.length("text") > 0).select("lang", F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1 << 32)).alias("h"), "text")
    sizes = {r.lang: r.n for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    by_lang: dict[str, list[np.ndarray]] = {}
    if sizes:
        # a hash below its language's threshold: some 1.5 samples a language, never a whole language in one place
        span = float(1 << 32)
        edge = F.create_map(*(x for lang, m in sorted(sizes.items()) for x in (F.lit(lang), F.lit(span if m <= 2 * sample else 1.5 * sample / m * span))))
        picked = hashed.where(F.col("h").cast("double") <= F.element_at(edge, F.col("lang"))).mapInArrow(_sampled, "lang string, h long, at binary, c binary")
        # repeated rows are one: they never fill a language's sample
        once = picked.groupBy("lang", "h").agg(F.min(F.struct("at", "c")).alias("x")).select("lang", "h", "x.*")
        for r in once.orderBy("h", "lang").limit(4 * sample * len(sizes)).toLocalIterator():
            if len(own := by_lang.setdefault(r.lang, [])) < sample:
                full = np.zeros(BUCKETS, np.float32)
                full[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.c, np.uint32)
                own.append(full)
    model = Model(idf, np.zeros((0, BUCKETS), np.float32), [], np.zeros(0, int), np.zeros(0))
    centroids, owner, floor = [], [], []
    for lang in sorted(x for x in by_lang if by_lang[x]):
        x = model.vectors(by_lang[lang])
        c = _kmeans(x, k)
        centroids.append(c)
        owner += [len(model.langs)] * len(c)
        floor.append(float(np.quantile((x @ c.T).max(1), REJECT)) * 0.8)
        model.langs.append(lang)
    if centroids:
        model.centroids, model.owner, model.floor = np.concatenate(centroids).astype(np.float32), np.array(owner), np.array(floor)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def op4(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
