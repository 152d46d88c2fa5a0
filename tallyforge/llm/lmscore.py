"""Language-model scores of texts from a log-frequency Bloom filter of n-gram counts.

Counts of words and word pairs are summed over the whole corpus, quantised to levels 1 + floor(log_b c), and each
n-gram enters a Bloom filter once for each level up to its own. A count is read back by probing level after level
until one is missing; it stands for the mean count of the n-grams of that level. The probability of a word is that of
the pair, smoothed towards the word's own (a Dirichlet prior of weight ``prior``), which is smoothed by one:

    P(w | h) = (c(h w) + prior * P(w)) / (c(h) + prior),   P(w) = (c(w) + 1) / (N + V + 1)

Pairs are probed only if both words are known. Counting is one shuffle of packed, partly summed blocks, dealt by hash;
each group of hashes fills its own segment of the filter, so segments are made independently. Up to ``most_bytes`` of
segments are broadcast at a time; a larger filter is probed part after part, one pass over the documents each, with the
levels found so far carried along. Exact counts of the most frequent words (``most_words`` at most) are broadcast for
the base score; all other words are joined by hash. Neither bound changes a result, but for float rounding of the base.

Words are known by 64-bit hashes: among a billion different words some two of them would be taken for one with probability 0.03.

Defined cases. A null or empty text is the end token alone. Repeated rows are scored, and count, each. Other columns are
ignored. Without training texts every probability is 1, so scores are 0. A text is split as a whole; documents are
taken in blocks of BLOCK bytes of text, one text at least.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Workspace, hashed_words, mix64

#: Bytes of text taken at a time (arrays over its tokens take some twenty times as much), and bytes of text for each group of hashes.
BLOCK, SHARE = 1 << 22, 1 << 22
#: Base of the levels, bits of filter an entry, bits set for it, levels at most.
BASE, BITS, PROBES, LEVELS = 1.5, 12, 5, 100
#: Bytes of filter broadcast at a time, and words whose exact counts are broadcast (16 bytes each).
MOST_BYTES, MOST_WORDS = 1 << 27, 1 << 20
#: Weight of the word's own probability against the counts of its history.
PRIOR = 200.0
_END = 0x9E3779B97F4A7C15
_EDGES = np.array([0.0] + [BASE**j for j in range(1, LEVELS)])
WORD, PAIR = 0, 1
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_b c), and 0 for 0."""
    return np.searchsorted(_EDGES, counts + 1e-9, side="right") * (counts > 0)


def _give_back() -> None:
    """Returns freed memory to the system: Arrow's, and that of NumPy, which the C library keeps for a worker's next task."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different tokens (the end first), the tokens of all texts as places therein, and each text's first token.

    A text's tokens are its lower-cased words and one end.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[full]
    words = flat.filter(pa.array(full)).dictionary_encode()
    names = words.dictionary.cast(pa.large_string())
    hashes = hashed_words(b" ".join(x.encode("utf-8", "surrogatepass") for x in names.to_pylist()))[2]
    n = np.bincount(owner, minlength=len(texts)) + 1
    starts = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
    out = np.zeros(int(n.sum()), np.int32)
    place = np.ones(len(out), bool)
    place[starts + n - 1] = False
    out[place] = words.indices.to_numpy(zero_copy_only=False) + 1
    return np.concatenate(([_END], hashes)).astype(np.uint64), out, starts


def _pairs(tokens: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """For each token (history, token) as one number below n * n; the history of a text's first token is an end."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = 0
    return before.astype(np.int64) * n + tokens


def _pair_hash(pairs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    n = len(hashes)
    return mix64(mix64(hashes[pairs // n] + np.uint64(0x51ED270B)) * np.uint64(3) + hashes[pairs % n])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _blocks(batch.column(0)):
                hashes, tokens, starts = _tokens(texts)
                pairs, times = np.unique(_pairs(tokens, starts, len(hashes)), return_counts=True)
                out = []
                for kind, h, c in ((WORD, hashes, np.bincount(tokens, minlength=len(hashes))), (PAIR, _pair_hash(pairs, hashes), times)):
                    at = _bucket(h, buckets)
                    order = np.argsort(at, kind="stable")
                    at, h, c = at[order], h[order], c[order].astype(np.int64)
                    edge = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
                    out += [(int(at[lo]), kind, h[lo:hi].tobytes(), c[lo:hi].astype(np.uint8).tobytes() if c[lo:hi].max() < 256 else c[lo:hi].tobytes()) for lo, hi in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "kind", "h", "c"])
                del out, pairs, times, tokens, hashes
                _give_back()

    return run


def _places(h: np.ndarray, level: int, cells: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of 64 bits within a segment of so many cells, and a number of which six bits each name a bit of the cell."""
    salt = np.uint64((level * 1_000_003 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (h ^ salt) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    cell = ((x >> np.uint64(32)) * np.asarray(cells, np.uint64) >> np.uint64(32)).astype(np.int64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return cell, x


def _bit(x: np.ndarray, probe: int) -> np.ndarray:
    return x >> np.uint64(58 - 6 * probe) & np.uint64(63)


_SEGMENT = "bucket long, segment binary, words binary, counts binary, tally array<long>"


def _segment(key: tuple, rows: pa.Table) -> pa.Table:
    """All n-grams of one group of hashes: their segment of the filter, the exact word counts, and n-grams and counts by kind and level."""
    bits, tally, kept = [], np.zeros((2, 2, LEVELS + 1), np.int64), (b"", b"")
    for kind in (WORD, PAIR):
        part = rows.filter(pc.equal(rows["kind"], kind))
        hs = [np.frombuffer(x.as_py(), np.uint64) for x in part["h"]]
        cs = [np.frombuffer(b, np.uint8 if len(b) == len(h) else np.int64).astype(np.int64) for h, b in zip(hs, (x.as_py() for x in part["c"]))]
        if not hs:
            continue
        h, at = np.unique(np.concatenate(hs), return_inverse=True)
        c = np.zeros(len(h), np.int64)
        np.add.at(c, at, np.concatenate(cs))
        level = level_of(c)
        tally[kind, 0] = np.bincount(level, minlength=LEVELS + 1)
        tally[kind, 1] = np.bincount(level, weights=c.astype(np.float64), minlength=LEVELS + 1).astype(np.int64)
        bits += [(h, level)]
        if kind == WORD:
            kept = h.tobytes(), c.tobytes()
    cells = max(1, -(-sum(int(level.sum()) for _, level in bits) * BITS // 64))
    full = np.zeros(cells * 64, bool)
    for h, level in bits:
        for j in range(1, int(level.max()) + 1):
            cell, x = _places(h[level >= j], j, cells)
            for probe in range(PROBES):
                full[cell * 64 + _bit(x, probe).astype(np.int64)] = True
    packed = np.packbits(full, bitorder="little").tobytes()
    del full, bits
    _give_back()
    return pa.table({"bucket": [key[0].as_py()], "segment": pa.array([packed], pa.binary()), "words": pa.array([kept[0]], pa.binary()), "counts": pa.array([kept[1]], pa.binary()), "tally": pa.array([tally.reshape(-1).tolist()], pa.list_(pa.int64()))})


@dataclass
class Part:
    """Consecutive segments of the filter: those of groups ``low`` to ``low + len(sizes) - 1``, in cells of 64 bits.

    A level of an n-gram sets PROBES bits of one cell, so a probe reads memory once.
    """

    low: int
    buckets: int
    sizes: np.ndarray
    cells: np.ndarray

    def __post_init__(self):
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level up to which all are in the filter; 0 for n-grams of other parts."""
        out = np.zeros(len(h), np.uint8)
        at = _bucket(h, self.buckets) - self.low
        live = np.flatnonzero((at >= 0) & (at < len(self.sizes)))
        h, size, start = h[live], self.sizes[at[live]], self.starts[at[live]]
        for j in range(1, LEVELS + 1):
            cell, x = _places(h, j, size)
            mask = np.zeros(len(h), np.uint64)
            for probe in range(PROBES):
                mask |= np.uint64(1) << _bit(x, probe)
            stay = self.cells[start + cell] & mask == mask
            live, h, size, start = live[stay], h[stay], size[stay], start[stay]
            if not len(live):
                break
            out[live] = j
        return out


@dataclass
class Model:
    """Segments and exact counts as a written table; the totals and what a level stands for."""

    table: DataFrame
    buckets: int
    tokens: int
    different: int
    means: np.ndarray  # by kind and level
    tally: np.ndarray  # n-grams by kind and level
    space: Workspace

    def parts(self, most_bytes: int) -> Iterator[Part]:
        """The filter in parts of at most so many bytes (one segment at least), in order."""
        sizes, data, low = [], bytearray(), 0
        for r in self.table.select("bucket", "segment").orderBy("bucket").toLocalIterator():
            if sizes and len(data) + len(r.segment) > most_bytes:
                yield Part(low, self.buckets, np.array(sizes, np.int64), np.frombuffer(data, np.uint64))
                sizes, data, low = [], bytearray(), low + len(sizes)
            while low + len(sizes) < r.bucket:  # groups without any n-gram
                sizes.append(1)
                data += bytes(8)
            sizes.append(len(r.segment) // 8)
            data += r.segment
        yield Part(low, self.buckets, np.array(sizes or [1], np.int64), np.frombuffer(data or bytes(8), np.uint64))

    def words(self, least: int = 1, below: int | None = None) -> DataFrame:
        """(h, c): exact counts of words, from ``least`` on and under ``below``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    h, c = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64)
                    own = (c >= least) & (c < below if below is not None else True)
                    yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(c[own])], ["h", "c"])

        return self.table.select("words", "counts").mapInArrow(run, "h long, c long")


def train(docs: DataFrame) -> Model:
    """Counts over all texts of ``docs``; the filter's segments and the exact word counts, written to the shared folder."""
    space = Workspace(docs.sparkSession, "lmscore")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-size // SHARE))
    counted = docs.select("text").mapInArrow(_counted(buckets), "bucket long, kind int, h binary, c binary")
    table = space.save(counted.groupBy("bucket").applyInArrow(_segment, _SEGMENT))
    sums = np.zeros(4 * (LEVELS + 1), np.int64)
    for r in table.select(F.posexplode("tally").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        sums[r.i] = r.n
    sums = sums.reshape(2, 2, LEVELS + 1)
    means = np.where(sums[:, 0] > 0, sums[:, 1] / np.maximum(sums[:, 0], 1), BASE ** (np.arange(LEVELS + 1) - 1.0))
    means[:, 0] = 0
    return Model(table, buckets, int(sums[WORD, 1].sum()), int(sums[WORD, 0].sum()), means, sums[:, 0], space)


def _first_level(model: Model, most_words: int) -> int:
    """The lowest level from which on there are at most so many words."""
    above = np.cumsum(model.tally[WORD][::-1])[::-1]
    return next(j for j in range(1, LEVELS + 2) if j > LEVELS or above[j] <= most_words)


def _probed(shared, alone: bool):
    """Tokens of a block of texts with the filter's levels: first tokens, hashes, tokens, and per token the word's and the pair's level.

    Pairs of unknown words are left out where the filter is ``alone``; elsewhere their words may be in another part.
    """

    def of(texts: pa.Array):
        hashes, tokens, starts = _tokens(texts)
        pairs, place = np.unique(_pairs(tokens, starts, len(hashes)), return_inverse=True)
        word = shared.value.levels(hashes)
        live = np.flatnonzero((word[pairs // len(hashes)] > 0) & (word[pairs % len(hashes)] > 0)) if alone else np.arange(len(pairs))
        pair = np.zeros(len(pairs), np.uint8)
        pair[live] = shared.value.levels(_pair_hash(pairs[live], hashes))
        return starts, hashes, tokens, word[tokens], pair[place]

    return of


def _log_probabilities(word: np.ndarray, pair: np.ndarray, starts: np.ndarray, ends: np.ndarray, means: np.ndarray, scale: float, prior: float) -> np.ndarray:
    """log10 P(w | h) of each token from levels; the history of a text's first token is an end."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[starts] = word[ends]
    history = means[WORD][before]
    both = np.where((word > 0) & (before > 0), np.minimum(means[PAIR][pair], history), 0.0)
    return np.log10((both + prior * (means[WORD][word] + 1.0) / scale) / (history + prior))


def score(docs: DataFrame, model: Model, prior: float = PRIOR, most_bytes: int = MOST_BYTES, most_words: int = MOST_WORDS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, base_score, score.

    ``score`` is the model's log10 probability of the text, ``base_score`` that of exact word counts smoothed by one.
    """
    sc, kind = docs.sparkSession.sparkContext, docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), F.lit(None).cast("binary").alias("levels"))
    parts = model.parts(most_bytes)
    part, n_parts = next(parts), 1
    for after in parts:  # the filter does not fit: levels found by this part are carried along
        earlier, rows = rows, model.space.save(rows.mapInArrow(_carry(_probed(sc.broadcast(part), False)), f"doc_id {kind}, text string, row long, levels binary"))
        model.space.drop(earlier)
        part, n_parts = after, n_parts + 1
    probe = _probed(sc.broadcast(part), n_parts == 1)

    least = _first_level(model, most_words)
    enough = 1 if least == 1 else int(np.ceil(_EDGES[min(least, LEVELS) - 1] - 1e-9)) if least <= LEVELS else 1 << 62
    top = model.words(enough).toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    exact = sc.broadcast((h[np.argsort(h)], top["c"].to_numpy()[np.argsort(h)]))
    whole, scale, means = enough == 1, float(model.tokens + model.different + 1), model.means

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_h, known_c = exact.value
        for batch in batches:
            for lo, texts in _blocks(batch.column(1)):
                starts, hashes, tokens, word, pair = probe(texts)
                n = np.diff(np.append(starts, len(tokens)))
                levels = batch.column(3).slice(lo, len(texts))
                if levels.null_count == 0:
                    word, pair = _merged(levels, starts, n, word, pair)
                at = np.searchsorted(known_h, hashes)
                hit = at < len(known_h)
                hit[hit] = known_h[at[hit]] == hashes[hit]
                c = np.zeros(len(hashes))
                c[hit] = known_c[at[hit]]
                rare = np.zeros(len(tokens), bool) if whole else ~hit[tokens]
                edge = np.concatenate(([0], np.cumsum(np.add.reduceat(rare.astype(np.int64), starts)))).astype(np.int32)
                p = _log_probabilities(word, pair, starts, starts + n - 1, means, scale, prior)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), batch.column(2).slice(lo, len(texts)), pa.array(n.astype(np.int64)), pa.array(np.add.reduceat(hit[tokens].astype(np.int64), starts)),
                     pa.array(np.add.reduceat(np.log10(c + 1.0)[tokens], starts)), pa.ListArray.from_arrays(pa.array(edge), pa.array(hashes[tokens[rare]].view(np.int64))), pa.array(np.add.reduceat(p, starts))],
                    ["doc_id", "row", "n_tokens", "n_known", "base", "rare", "score"],
                )
                del hashes, tokens, word, pair, at, hit, c, rare, p
                _give_back()

    out = rows.mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, n_known long, base double, rare array<long>, score double")
    if not whole:  # words without a broadcast count are joined; the written table keeps the numbers of rows
        out = model.space.save(out)
        counts = model.words(1, enough).select(F.col("h").alias("_h"), "c")
        rare = out.select(F.col("row").alias("_row"), F.explode("rare").alias("h")).join(counts, F.col("h") == F.col("_h"), "left")
        rare = rare.groupBy("_row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("_base"), F.count("c").alias("_known"))
        out = out.join(rare, F.col("row") == F.col("_row"), "left")
        out = out.withColumn("base", F.col("base") + F.coalesce("_base", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("_known", F.lit(0)))
    return out.select("doc_id", "n_tokens", "n_known", (F.col("base") - F.col("n_tokens") * float(np.log10(scale))).alias("base_score"), "score")


def _carry(probe):
    """Adds the levels that a part of the filter knows: of each text's tokens first the words', then the pairs'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _blocks(batch.column(1)):
                starts, _, tokens, word, pair = probe(texts)
                n = np.diff(np.append(starts, len(tokens)))
                levels = batch.column(3).slice(lo, len(texts))
                if levels.null_count == 0:
                    word, pair = _merged(levels, starts, n, word, pair)
                packed = [word[a : a + k].tobytes() + pair[a : a + k].tobytes() for a, k in zip(starts.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, len(texts)) for i in range(3)), pa.array(packed, pa.binary())], ["doc_id", "text", "row", "levels"])
                del tokens, word, pair, packed
                _give_back()

    return run


def _merged(levels: pa.Array, starts: np.ndarray, n: np.ndarray, word: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An n-gram is in one part of the filter; the others say 0."""
    word, pair = word.copy(), pair.copy()
    for a, k, b in zip(starts.tolist(), n.tolist(), levels):
        both = np.frombuffer(b.as_py(), np.uint8)
        np.maximum(word[a : a + k], both[:k], out=word[a : a + k])
        np.maximum(pair[a : a + k], both[k:], out=pair[a : a + k])
    return word, pair


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2


def op12(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
