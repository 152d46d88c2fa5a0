"""Substring dedup by paragraph MinHash banding.

A paragraph is a piece of a line: sentences are taken together until one of SENTENCE words or more ends.
The rule looks at nothing before, so a passage that stands in the middle of other text is cut into the
same pieces everywhere (but for its first and last). A paragraph of more than LONG words is also cut where a
pair of words has the least hash among those up to NEAR words away; this depends on these words alone, so a
passage without sentence ends, or within a longer sentence, has the same pieces in any surroundings.

1. Every paragraph of five words or more gets a hash and minima over its five-word shingles, ROWS a band.
2. Paragraphs that occur once and collide with none go first, by counts summed before the shuffle. Different
   ones that collide in a band are joined, verified by exact Jaccard similarity, and linked (see ``near``);
   clusters are the components. Pieces of long paragraphs match what is equal to them; a word that differs
   costs the piece it is in.
3. The first occurrence of a cluster, by doc_id and place, stays. Others are removed where neighbouring ones
   make up RUN words or more, so stock phrases and short lines stay. What a piece matches in its own kept
   paragraph is no repetition.

Defined results: null and empty texts have no paragraphs; a text without line or sentence ends is one
paragraph with its pieces (none where the same few words, NEAR at most, recur on and on); rows with a null doc_id are left alone; a paragraph repeated within a document is removed like
any other; rows that repeat a doc_id with its text count as one document, and with another text as another,
cut at its own places. Extra columns of any name pass through ``remove``. Texts are taken whole, in linear
time. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Workspace, hashed_words, mix64, small
from tallyforge.llm.near import SMALL, SMALL_KEYS, NearLinks, signed
from tallyforge.llm.sketch import windows

SHINGLE = 5
#: Two paragraphs of similarity 0.8 miss all bands with probability (1 - 0.8**2 * 63 / 64)**7 = 9e-4.
ROWS, BANDS = 2, 7
SENTENCE = 6
RUN = 15
LONG, NEAR = 16, 4

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _raw(text: str | None) -> bytes:
    """Lower-cased bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _key(raw: bytes) -> int:
    """Tells the texts of one doc_id apart."""
    return signed(xxhash.xxh3_64_intdigest(raw))


def paragraphs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes, and the first and last + 1 word of every paragraph."""
    words = hashed_words(raw)
    n = len(words[0])
    if not n:
        return words[2], np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.frombuffer(raw, np.uint8)
    line = np.cumsum(a == 10)[words[0]]
    line_end = np.append(line[1:] != line[:-1], True)
    sentence_end = _ENDS[a[words[1] - 1]]
    stops, sentence = [], 0
    at = np.flatnonzero(line_end | sentence_end)
    for i, new_line in zip((at + 1).tolist(), line_end[at].tolist()):
        if new_line or i - sentence >= SENTENCE:
            stops.append(i)
        sentence = i
    stop = np.array(stops, np.int64)
    return words[2], np.concatenate(([0], stop[:-1])), stop


def signatures(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the paragraphs of five words or more: start, stop, hash, keys of the bands (n, BANDS)."""
    keep = stop - start >= SHINGLE
    start, stop = start[keep], stop[keep]
    if not len(start):
        return start, stop, np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64)
    x = (windows(h, SHINGLE) >> np.uint64(32)).astype(np.uint32)
    # shingles of paragraph i are those at start[i] .. stop[i] - SHINGLE; every other slice of reduceat is its own
    edges = np.stack([start, stop - SHINGLE + 1], 1).ravel()
    x = np.append(x, x[-1:])  # the last edge may be the end
    low = [np.minimum.reduceat(x * a + b, edges)[::2].astype(np.uint64) for a, b in zip(_A, _B)]
    keys = [mix64((low[2 * i] << np.uint64(32) | low[2 * i + 1]) + salt) for i, salt in enumerate(np.arange(BANDS, dtype=np.uint64) * _STEP)]
    return start, stop, _hashes(h, start, stop), np.stack(keys, 1).view(np.int64)


def pieces(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pieces of five words or more of the paragraphs of more than LONG words: start, stop, hash."""
    return _pieces(*paragraphs(_raw(text)))


def _pieces(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep = stop - start > LONG
    start, stop, n = start[keep], stop[keep], len(h)
    if not len(start):
        return start, stop, np.zeros(0, np.int64)
    far = np.full(NEAR, np.iinfo(np.uint64).max)
    pair = np.concatenate((far, mix64(h + np.concatenate((h[:1], h[:-1])) * _STEP), far))
    low = pair[NEAR : NEAR + n]
    least = np.ones(n, bool)
    for d in range(1, NEAR + 1):
        least &= (low < pair[NEAR - d : NEAR - d + n]) & (low <= pair[NEAR + d : NEAR + d + n])
    edge = np.zeros(n + 1, np.int64)
    edge[start] += 1
    edge[stop] -= 1
    within = np.cumsum(edge[:n]) > 0
    at = np.unique(np.concatenate((np.flatnonzero(least & within), start, stop)))
    a, b = at[:-1], at[1:]
    keep = within[a] & (b - a >= SHINGLE) & ~(np.isin(a, start) & np.isin(b, stop))
    a, b = a[keep], b[keep]
    return a, b, _hashes(h, a, b) if len(a) else np.zeros(0, np.int64)


def _hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of stretches of words that follow one another."""
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(*_spread(start, stop, len(h)))
    order = np.add.reduceat(np.append(mix64(h + place * _STEP), np.uint64(0)), np.stack([start, stop], 1).ravel())[::2]
    return mix64(order + (stop - start).astype(np.uint64)).view(np.int64)


def _spread(start: np.ndarray, stop: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and repeats that give each word the start of its paragraph (of kept ones; any number elsewhere)."""
    edges = np.concatenate(([0], start, [n]))
    return np.concatenate(([0], start)).astype(np.uint64), np.diff(edges)


def _spans(docs: DataFrame) -> DataFrame:
    """(id, text) -> a row for each paragraph and piece: doc, key, h, start, stop, reach, bands (null for pieces).

    ``key`` tells the texts of one doc_id apart; ``reach`` is the start of the next paragraph, after which
    a stretch goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, own, hs, starts, stops, reaches, keys, some = [], [], [], [], [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = _raw(text.as_py())
                    words, first, last = paragraphs(raw)
                    start, stop, h, bands = signatures(words, first, last)
                    if len(h):
                        a, b, piece = _pieces(words, first, last)
                        reach = np.append(start[1:], stop[-1:])
                        at = np.minimum(np.searchsorted(stop, b), len(stop) - 1)
                        ids.append(np.full(len(h) + len(a), doc))
                        own.append(np.full(len(h) + len(a), _key(raw)))
                        hs += [h, piece]
                        starts += [start.astype(np.int32), a.astype(np.int32)]
                        stops += [stop.astype(np.int32), b.astype(np.int32)]
                        reaches += [reach.astype(np.int32), np.where(stop[at] == b, reach[at], b).astype(np.int32)]
                        keys.append(bands.ravel())
                        some += [np.ones(len(h), bool), np.zeros(len(a), bool)]
                if ids:
                    there = np.concatenate(some)
                    ends = np.concatenate(([0], np.cumsum(there) * BANDS)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~there, False)), pa.array(np.concatenate(keys)))
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in (ids, own, hs, starts, stops, reaches)), lists], ["doc", "key", "h", "start", "stop", "reach", "bands"])

    return docs.mapInArrow(run, "doc long, key long, h long, start int, stop int, reach int, bands array<long>")


class ParagraphLinks(NearLinks):
    """Candidates are verified without an estimate; an item is its paragraph's hash."""

    def __init__(self, space: Workspace):
        super().__init__(space, SHINGLE)

    def _likely(self, pairs: DataFrame, classes: DataFrame | None) -> DataFrame:
        return pairs.withColumn("est", F.lit(1.0))

    def _sets(self, full: DataFrame, likely: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Those of all members of buckets: the texts are read once."""
        return self.space.save(fetch(self.space.save(full.select("id").distinct())))

    def _dealt(self, members: DataFrame, sets: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """A bucket may hold thousands of paragraphs that share a phrase and little else.

        So members of open buckets are dealt anew, by their rarest shingles: two sets of similarity s share
        one of the first n - ceil(s * n) + 1 elements of each in any common order. Nothing is lost by this.
        """
        num, den = self.num, self.den
        comp = self.space.save(members.groupBy(F.col("id").alias("_id")).agg(F.max("comp").alias("comp")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    packed = batch.column(1).to_pylist()
                    ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(p) // 8 for p in packed])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.frombuffer(b"".join(packed), np.int64))], ["id", "x"])

        own = sets.join(small(comp, SMALL), F.col("id") == F.col("_id")).select("id", "s")
        each = self.space.save(own.mapInArrow(run, "id long, x long"))
        often = each.groupBy(F.col("x").alias("_x")).agg(F.count("*").alias("c"))
        ranked = each.join(often, F.col("x") == F.col("_x")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("s"))
        first = F.size("s") - F.ceil(F.size("s") * F.lit(num) / F.lit(den)).cast("int") + 1
        dealt = ranked.select("id", F.explode(F.slice("s", F.lit(1), first)).alias("e")).where("e.c > 1")
        dealt = self.space.save(dealt.join(small(comp, SMALL), F.col("_id") == F.col("id")).select(F.col("e.x").alias("band"), "id", "comp"))
        open_ = self.space.save(dealt.groupBy(F.col("band").alias("_band")).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("_band"))
        self.space.drop(each)
        return self.space.save(dealt.join(small(open_, SMALL), F.col("band") == F.col("_band")).select("band", "id", "comp")), sets


def clusters(docs: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """The paragraphs and pieces (see ``_spans``) that may be repeated, and (h, cluster, keep_doc, keep_key, keep_start, keep_stop) of those that occur twice or more, alike or nearly."""
    items = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    each = space.save(_spans(items))
    near = ParagraphLinks(space)
    bands = each.where("bands is not null").select(F.col("h").alias("id"), F.explode("bands").alias("band"))
    full = near.shared(bands)
    # rows that repeat a document count here, and are told apart below
    again = each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    wanted = space.save(again.union(full.select("id")).distinct().withColumnRenamed("h", "_h"))
    place = F.struct("doc", "key", "start", "stop")
    # all that is looked at from here on
    met = space.save(each.join(small(wanted, SMALL_KEYS), F.col("h") == F.col("_h")).select("doc", "key", "h", "start", "stop", "reach"))
    space.drop(each)
    classes = space.save(met.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")))

    def fetch(ids: DataFrame) -> DataFrame:
        """(id, s): each paragraph is cut out of the document where it occurs first."""
        want = classes.join(small(ids.select(F.col("id").alias("_id")), SMALL), F.col("h") == F.col("_id"))
        by_doc = space.save(want.groupBy(F.col("first.doc").alias("_owner"), F.col("first.key").alias("_key")).agg(F.collect_list(F.struct(F.col("h"), F.col("first.start").alias("start"), F.col("first.stop").alias("stop"))).alias("wanted")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids_, sets = [], []
                for text, key, wanted_ in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])):
                    raw = _raw(text.as_py())
                    if _key(raw) == key:  # of several texts under one doc_id, the right one
                        x = windows(hashed_words(raw)[2], SHINGLE)
                        ids_ += [w["h"] for w in wanted_]
                        sets += [np.unique(x[w["start"] : w["stop"] - SHINGLE + 1]).tobytes() for w in wanted_]
                yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(sets, pa.binary())], ["id", "s"])

        # a row of by_doc is as wide as a document has such paragraphs; it is broadcast while all have few
        total = want.count()
        by_doc = F.broadcast(by_doc) if total <= SMALL else by_doc
        found = space.save(items.join(by_doc, F.col("id") == F.col("_owner")).select("text", "_key", "wanted").mapInArrow(run, "id long, s binary"))
        return found.dropDuplicates(["id"]) if found.count() > total else found

    _, comp = near.run(full, None, fetch)
    named = classes.join(comp, F.col("h") == F.col("id"), "left").select("h", "first", (F.col("first") != F.col("last")).alias("twice"), F.coalesce("comp", "h").alias("cluster"), F.col("comp").isNotNull().alias("linked"))
    named = space.save(named.where("twice or linked"))
    keep = named.groupBy(F.col("cluster").alias("_c")).agg(F.min("first").alias("keep"))
    found = named.join(keep, F.col("cluster") == F.col("_c")).select("h", "cluster", *(F.col(f"keep.{c}").alias(f"keep_{c}") for c in ("doc", "key", "start", "stop")))
    return met, space.save(found)


def _stretches(docs: DataFrame, run: int) -> DataFrame:
    """(doc, key, start_word, end_word, keep_docs, clusters): the stretches to remove, by doc_id and text."""
    space = Workspace(docs.sparkSession, "substring")
    met, found = clusters(docs, space)
    spans = met.select("doc", "key", F.col("h").alias("_h"), "start", "stop", "reach")
    kept = (F.col("doc") == F.col("keep_doc")) & (F.col("key") == F.col("keep_key")) & (F.col("start") < F.col("keep_stop"))
    extra = spans.join(small(found, SMALL // 2), F.col("_h") == F.col("h")).where(~kept)
    extra = extra.select("doc", "key", "start", "stop", "reach", "keep_doc", "cluster").distinct()
    by_doc = Window.partitionBy("doc", "key").orderBy("start", "stop")
    before = F.max("reach").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = extra.withColumn("_new", F.when(F.col("start") <= before, 0).otherwise(1))
    island = fresh.withColumn("_i", F.sum("_new").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy("doc", "key", "_i").agg(
        F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.array_sort(F.collect_set("keep_doc")).alias("keep_docs"), F.array_sort(F.collect_set("cluster")).alias("clusters"),
    ).where(F.col("end_word") - F.col("start_word") >= run)


def removals(docs: DataFrame, run: int = RUN) -> DataFrame:
    """A row for each stretch of text to remove: doc_id, start_word, end_word, n_words, keep_docs, clusters, text_key.

    Words are those between white space, counted from 0. ``keep_docs`` lists the documents where the
    paragraphs stay. ``text_key`` tells the texts of one doc_id apart.
    """
    found = _stretches(docs, run)
    return found.select(F.col("doc").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"), "keep_docs", "clusters", F.col("key").alias("text_key"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given stretches of words; what stands around them stays."""
    out, last, n, at = [], 0, 0, 0
    places = _WORD.finditer(text)
    for a, b in sorted(spans):
        while n <= a:
            at, n = next(places).span(), n + 1
        out.append(text[last : at[0]])
        while n < b:
            at, n = next(places).span(), n + 1
        last = at[1]
    return "".join([*out, text[last:]])


def remove(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``docs`` without repeated passages, all columns and rows kept; n_chars, if there, follows the text."""
    gone = _stretches(docs, run).groupBy("doc").agg(F.collect_list(F.struct("key", "start_word", "end_word")).alias("spans"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    joined = docs.select(row.alias("row")).join(gone, F.col("row.doc_id").cast("long") == F.col("doc"), "left").select("row", "spans")
    names, schema = docs.columns, docs.schema
    place = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts, new = columns[place].to_pylist(), []
            for text, spans in zip(texts, batch.column(1).to_pylist()):
                own = _key(_raw(text)) if spans else None
                mine = [(s["start_word"], s["end_word"]) for s in spans or () if s["key"] == own]
                new.append(cut(text, mine) if mine else text)
            columns[place] = pa.array(new, columns[place].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([n if t is x else len(x) for n, t, x in zip(columns[at].to_pylist(), texts, new)]).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(work, schema)
