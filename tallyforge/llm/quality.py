"""Quality rules: fixed text statistics, then a linear-chain conditional random field over lines.

Every line of a text gets a feature vector; a two-label chain (content, boilerplate) is decoded with
Viterbi; the share of words in content lines decides whether the document is kept.

Labels are known for documents, not for lines. Lines of good documents count as content. A line of a bad one
is boilerplate if its own features say so (by a model of single lines, learned from the documents'
labels), and such lines make up BAD_SHARE of the document's words at least, the likeliest first. So a bad
document's plain lines are content, and the chain learns where one kind follows the other.

Defined results: a null or empty text has no words and fails the base rules; a text whose lines are
all blank likewise. Repeated rows are judged alike, each on its own. Extra columns pass through
``keep_documents`` untouched; ``judge`` returns only its own columns, so names never clash. Texts are
measured whole, in linear time; memory is some hundred bytes a line. An empty table gives an empty result; with no labels, or labels of one class, the weights of ``PRIOR`` hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The field is fitted on so many chains of labelled documents, of so many lines at most; a longer document is several chains.
TRAIN_CHAINS, CHAIN_LINES = 2_000, 128
#: Words of a bad document that its boilerplate lines have in training, at least.
BAD_SHARE = 0.5
#: Least share of a kept document's words in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"

FEATURES = (
    "bias", "symbol_per_word", "shouted", "pipes", "repeats_word", "repeats_line", "digits", "short", "closed",
    "few_letters", "long_words",
)
#: Emission weights for boilerplate, and transition scores, where nothing can be learned.
PRIOR = (np.array([-2.0, 4.0, 4.0, 6.0, 6.0, 1.0, 2.0, 0.3, -0.3, 2.0, 1.0]), np.array([[0.5, -0.5], [-0.5, 0.5]]))

_CLASS = np.zeros(256, np.uint8)  # 1 white space, 2 upper case, 3 lower case, 4 digit, 5 symbol, 6 other ASCII, 7 in a non-ASCII character
_CLASS[:] = 6
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x61:0x7B] = 3
_CLASS[0x30:0x3A] = 4
_CLASS[[ord(c) for c in SYMBOLS]] = 5
_CLASS[0x80:0xC0] = 0  # continuation bytes: part of the character before
_CLASS[0xC0:] = 7


@dataclass
class Text:
    """One text's statistics; the per-line arrays cover lines that have a word."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    line_words: np.ndarray
    features: np.ndarray


def _repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window that occurs twice or more."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 20:
        key = (ids[:-2] << 40) | (ids[1:-1] << 20) | ids[2:]
    else:  # over a million different words: number the pairs first
        pair = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1]
        key = (pair[:-1].astype(np.int64) << 32) | ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(ids), bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def measure(text: str | None) -> Text:
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    ids: list[int] = []
    number: dict[bytes, int] = {}
    kept, starts, repeated, line_words, word_repeats = [], [], [], [], []
    at = dup = 0
    for line in lines:
        words = line.split()
        if words:
            again = line in seen
            dup += again
            seen.add(line)
            own = [number.setdefault(w, len(number)) for w in words]
            ids += own
            kept.append(len(line))
            starts.append(at)
            repeated.append(again)
            line_words.append(len(words))
            word_repeats.append(1 - len(set(own)) / len(own) if len(own) > 7 else 0.0)
        at += len(line) + 1
    if not kept:
        return Text(0, 0, int((_CLASS[np.frombuffer(raw, np.uint8)] == 5).sum()) if raw else 0, 0, 0, np.zeros(0, np.int64), np.zeros((0, len(FEATURES))))
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    first, last = np.array(starts), np.array(starts) + np.array(kept)
    nwords = np.array(line_words)

    def per_line(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return run[last] - run[first]

    symbols = per_line(kinds == 5)
    pipes = per_line(np.frombuffer(raw, np.uint8) == 0x7C)
    upper, lower, digits = per_line(kinds == 2), per_line(kinds == 3), per_line(kinds == 4)
    wide = per_line(kinds == 7)
    chars = np.maximum(per_line((kinds != 0) & (kinds != 1)), 1)
    ends = np.frombuffer(raw, np.uint8)[last - 1]
    features = np.empty((len(nwords), len(FEATURES)))
    for i, column in enumerate((
        1.0, np.minimum(symbols / nwords, 3), (upper > lower) & (upper >= 4), np.minimum(2 * pipes / nwords, 1), word_repeats, repeated,
        digits / chars, nwords < 4, np.isin(ends, (0x2E, 0x21, 0x3F, 0x22, 0x3A)), (upper + lower + wide) / chars < 0.6, chars / nwords > 12,
    )):
        features[:, i] = column
    return Text(
        len(ids), int(((kinds != 0) & (kinds != 1)).sum()), int((kinds == 5).sum()), dup,
        _repeat_words(np.array(ids, np.int64)), nwords, features,
    )


def viterbi(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best labels (1: boilerplate) where label 0 scores 0 and label 1 ``emission``; ties go to content."""
    (t00, t01), (t10, t11) = transition.tolist()
    a, b = 0.0, 0.0
    back = []
    for i, e in enumerate(emission.tolist()):
        if i == 0:
            a, b = 0.0, e
            continue
        stay, enter = (a + t00 >= b + t10), (b + t11 > a + t01)
        back.append((0 if stay else 1, 1 if enter else 0))
        a, b = (a + t00 if stay else b + t10), (b + t11 if enter else a + t01) + e
    labels = np.zeros(len(emission), np.int8)
    if len(emission):
        label = int(b > a)
        labels[-1] = label
        for i in range(len(back) - 1, -1, -1):
            label = back[i][label]
            labels[i] = label
    return labels


def fit(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.3, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights that maximise the labels' likelihood, by forward-backward gradients and Adam.

    ``chains`` holds (features, label of each line) per document.
    """
    chains = [c for c in chains if len(c[0])]
    if len({y for _, own in chains for y in own.tolist()}) < 2:
        return PRIOR
    chains = sorted(chains, key=lambda c: -len(c[0]))
    w, trans = np.zeros(chains[0][0].shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    data = _Stacked(chains)
    for step in range(1, rounds + 1):
        _, g_w, g_t = data.gradient(w, trans, ridge)
        g = np.concatenate([g_w, g_t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, trans = w + move[: len(w)], trans + move[len(w) :].reshape(2, 2)
    return w, trans


class _Stacked:
    """Chains, longest first, end to end; a step works on one line of every chain that is long enough."""

    def __init__(self, chains: list[tuple[np.ndarray, np.ndarray]]):
        self.lengths = np.array([len(x) for x, _ in chains])
        self.flat, self.gold = np.concatenate([x for x, _ in chains]), np.concatenate([y for _, y in chains]).astype(int)
        self.offset = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.live = [int((self.lengths > t).sum()) for t in range(self.lengths[0])]
        self.weight = 1 / len(chains) / self.lengths  # each chain weighs the same, whatever its number of lines
        self.seen = np.zeros((len(chains), 2, 2))
        for t in range(1, self.lengths[0]):
            k = self.live[t]
            at = self.offset[:k] + t
            np.add.at(self.seen, (np.arange(k), self.gold[at - 1], self.gold[at]), 1)

    def gradient(self, w: np.ndarray, trans: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
        """The weighted log-likelihood less the ridge, and its gradients."""
        e, offset, lengths, weight = self.flat @ w, self.offset, self.lengths, self.weight
        fwd = np.zeros((len(e), 2))
        for t, k in enumerate(self.live):
            at = offset[:k] + t
            if t:
                s = fwd[at - 1][:, :, None] + trans[None]
                fwd[at] = np.logaddexp(s[:, 0], s[:, 1])
            fwd[at, 1] += e[at]
        bwd = np.zeros_like(fwd)
        pair = np.zeros((len(lengths), 2, 2))
        z = np.logaddexp(fwd[offset + lengths - 1, 0], fwd[offset + lengths - 1, 1])
        for t in range(len(self.live) - 2, -1, -1):
            k = self.live[t + 1]
            at = offset[:k] + t
            onward = bwd[at + 1] + np.stack([np.zeros(k), e[at + 1]], 1)
            s = trans[None] + onward[:, None, :]
            bwd[at] = np.logaddexp(s[:, :, 0], s[:, :, 1])
            pair[:k] += np.exp(fwd[at][:, :, None] + s - z[:k, None, None])
        marginal = np.exp(fwd[:, 1] + bwd[:, 1] - np.repeat(z, lengths))
        each = np.repeat(weight, lengths)
        score = (each * self.gold * e).sum() + (self.seen * trans[None] * weight[:, None, None]).sum() - (weight * z).sum()
        g_w = self.flat.T @ (each * (self.gold - marginal)) - ridge * w
        g_t = ((self.seen - pair) * weight[:, None, None]).sum(0) - ridge * trans
        return float(score - ridge / 2 * ((w**2).sum() + (trans**2).sum())), g_w, g_t


def line_labels(documents: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, words of each line, bad) -> (features, label of each line)."""
    documents = [d for d in documents if len(d[0])]
    single = [(x[i : i + 1], np.array([bad])) for x, _, bad in documents for i in range(len(x))]
    w, _ = fit(single, rounds=80) if single else PRIOR
    out = []
    for x, words, bad in documents:
        label = np.zeros(len(x), int)
        if bad:
            e = x @ w
            order = np.argsort(-e, kind="stable")
            before = np.cumsum(words[order]) - words[order]
            label[order] = (e[order] > 0) | (before < BAD_SHARE * words.sum())
        out.append((x, label))
    return out


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_CHAINS, longest: int = CHAIN_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Fit on ``limit`` chains of at most ``longest`` lines of labelled documents, chosen by a hash; lines are measured where the texts lie."""
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality"))
        .where("_id is not null and _quality is not null")
        .orderBy(F.xxhash64("_id"), "_id", "_quality").limit(2 * limit)
    )
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # at most 2 * limit rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, text, quality in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                t = measure(text.as_py())
                for at in range(0, len(t.line_words), longest):
                    out.append((id_, at, quality, t.features[at : at + longest].astype(np.float32).tobytes(), t.line_words[at : at + longest].astype(np.int32).tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "at", "quality", "features", "words"])

    chains = rows.select(F.col("doc_id").cast("long"), "text", "_quality").mapInArrow(run, "doc_id long, at long, quality int, features binary, words binary")
    chains = chains.orderBy(F.xxhash64("doc_id", "at", F.lit(7)), "doc_id", "at", "quality", "features").limit(limit).collect()
    unpacked = [(np.frombuffer(r.features, np.float32).reshape(-1, len(FEATURES)).astype(float), np.frombuffer(r.words, np.int32), int(r.quality == 0)) for r in chains]
    return fit(line_labels(unpacked))


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_words long, n_lines long, n_boilerplate_lines long"
)


def _verdict(text: str | None, model: tuple[np.ndarray, np.ndarray], share: float) -> tuple:
    t = measure(text)
    failed = t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words
    labels = viterbi(t.features @ model[0], model[1])
    content = int(t.line_words[labels == 0].sum())
    return t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and content >= share * t.n_words, content, len(labels), int(labels.sum())


def _batches(model: tuple[np.ndarray, np.ndarray], share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            columns = list(zip(*(_verdict(t.as_py(), model, share) for t in texts))) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3
            names = [part.split()[0] for part in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return run


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], share: float = CONTENT_SHARE) -> DataFrame:
    """One row for each row of ``docs``: base statistics, the share of content, the verdict."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_batches(model, share), SCHEMA)


def keep_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. No shuffle: the verdict is made where the row lies."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_verdict(t.as_py(), model, share)[6] for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
