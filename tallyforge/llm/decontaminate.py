"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every word sequence of every item. A text streams through it word by word; at each
word it knows the longest match that ends there. A match of at least a window's length means that the
window occurs, and the state tells which items hold it. Items shorter than the window count as one
window of their own length.

Long stretches that cannot match are skipped: where two neighbouring words are no neighbours in any
item, no match goes over that point, so only runs of known neighbours as long as the shortest window
are streamed.

The automaton goes to every Python worker, so its size is bounded: items are dealt into shards of at
most SHARD_WORDS words, each with an automaton of its own. A single shard needs no shuffle. Several are
built, sent, matched and forgotten one after the other; only the rows that one hits are written, and united
by a number that the rows got once. A corpus is read once for each shard: a benchmark grows by the test,
not with the corpus.

Defined results: null, empty and wordless texts have no words and no hits; items without words match
nothing; repeated items each count; a null item_id is written as an empty string. Repeated documents are
judged alike. Texts are taken whole, in time that grows with their words and the windows they hold. Extra
columns of any name pass through ``decontaminate`` untouched; n_chars, if there, follows a cut text. An empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Workspace, alnum_words

WINDOW = 13
#: A document is contaminated if it is hit and hits make up at least this share of its words.
COVER = (1, 20)
#: Words of items in one automaton: about 100 MB at most.
SHARD_WORDS = 200_000


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.names = window, [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        seqs = [[self.number.setdefault(w, len(self.number)) for w in words] for _, words in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: For a state, the windows that end where it ends: (their length, the items that hold them).
        self.owners: list[dict[int, set[int]]] = [{} for _ in self.next]
        for n, seq in enumerate(seqs):
            if not seq:
                continue
            size, state, length = min(window, len(seq)), 0, 0
            for c in seq:
                state, length = self.next[state][c], length + 1
                if length >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    self.owners[at].setdefault(size, set()).add(n)
        # all windows that end at a state, its own first: each chain of links is walked once
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = sorted(self.owners[state])
            self.ends[state] = [*((size, state) for size in reversed(own)), *self.ends[self.link[state]]]
        self.shortest = min((min(window, len(s)) for s in seqs if s), default=0)
        pairs = {(a << 32) | b for s in seqs for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches [a, b) of known neighbours, long enough for the shortest window."""
        if len(ids) < self.shortest:
            return []
        known = ids >= 0
        if len(ids) > 1 and len(self.pairs):
            key = (ids[:-1] << 32) | ids[1:]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            joined = (self.pairs[at] == key) & known[:-1] & known[1:]
        else:
            joined = np.zeros(max(len(ids) - 1, 0), bool)
        cuts = np.flatnonzero(~joined) + 1
        a = np.concatenate(([0], cuts))
        b = np.concatenate((cuts, [len(ids)]))
        fit = (b - a >= self.shortest) & known[a]
        return list(zip(a[fit].tolist(), b[fit].tolist()))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Merged spans [a, b) of words inside windows, the items hit, the longest match."""
        if not self.shortest or len(words) < self.shortest:
            return [], set(), 0
        ids = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        longest = 0
        nxt, link, length = self.next, self.link, self.length
        for a, b in self._runs(ids):
            state = matched = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while state and c not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if c in nxt[state]:
                    state, matched = nxt[state][c], matched + 1
                else:
                    matched = 0
                longest = max(longest, matched)
                far = 0
                for size, at in self.ends[state]:
                    if size <= matched:
                        items |= self.owners[at][size]
                        far = max(far, size)
                if far:
                    start = i + 1 - far
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items, longest


def automata(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Iterator[Automaton]:
    """One automaton for each shard of items. Rows come to the driver one partition at a time."""
    rows: list[tuple[str, list[bytes]]] = []
    words = 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        own = alnum_words(r.text)
        if rows and words + len(own) > shard_words:
            yield Automaton(rows, window)
            rows, words = [], 0
        if own:
            rows.append((r.item_id or "", own))
            words += len(own)
    yield Automaton(rows, window)


RAW = "doc_id long, n_words long, spans array<int>, items array<string>, longest int"


def _hits(machine: Automaton, text: str | None) -> tuple[int, list[int], list[str], int]:
    words = alnum_words(text)
    spans, items, longest = machine.hits(words)
    return len(words), [x for s in spans for x in s], [machine.names[i] for i in sorted(items)], longest


KINDS = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32()]


def _match(docs: DataFrame, shared, key: str, only_hits: bool = False) -> DataFrame:
    """(key, text) -> (key, n_words, spans, items, longest) by one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            found = [_hits(machine, text.as_py()) for text in batch.column(1)]
            keys = batch.column(0)
            if only_hits:
                some = [bool(f[1]) or f[3] > 0 for f in found]
                keys, found = keys.filter(pa.array(some, pa.bool_())), [f for f, s in zip(found, some) if s]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([f[i] for f in found], k) for i, k in enumerate(KINDS))], [key, "n_words", "spans", "items", "longest"])

    return docs.select(key, "text").mapInArrow(run, RAW.replace("doc_id", key))


def _united(rows: DataFrame, machines: Iterator[Automaton], space: Workspace) -> DataFrame:
    """(_row, text) -> (_row, spans, items, longest) of the rows that any automaton hits; one automaton is alive at a time."""
    every: DataFrame | None = None
    for machine in machines:
        shared = rows.sparkSession.sparkContext.broadcast(machine)
        part = space.save(_match(rows, shared, "_row", only_hits=True))
        shared.destroy()
        every = part if every is None else every.union(part)
    together = every.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("_s"), F.flatten(F.collect_list("items")).alias("items"), F.max("longest").alias("longest"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[x for s in _merged(flat) for x in s] for flat in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, KINDS[1]), batch.column(2), batch.column(3)], ["_row", "spans", "items", "longest"])

    return space.save(together.mapInArrow(merge, "_row long, spans array<int>, items array<string>, longest int"))


def _merged(flat: list[int]) -> list[list[int]]:
    """Spans that neither overlap nor touch, from the flat ends of any."""
    merged: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def _shards(benchmark: DataFrame, window: int, shard_words: int) -> tuple[Automaton, Iterator[Automaton] | None]:
    """The first automaton, and an iterator over all if there are more."""
    found = automata(benchmark, window, shard_words)
    first, second = next(found), next(found, None)
    return first, None if second is None else itertools.chain((first, second), found)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, spans (flat list of word spans), items, longest match."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first, more = _shards(benchmark, window, shard_words)
    if more is None:
        return _match(ids, docs.sparkSession.sparkContext.broadcast(first), "doc_id")
    space = Workspace(docs.sparkSession, "decontaminate")
    rows = space.save(ids.withColumn("_row", F.monotonically_increasing_id()))
    hits = _united(rows, more, space).withColumnRenamed("_row", "_hit")
    counted = rows.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")).drop("text")
    joined = counted.join(hits, F.col("_row") == F.col("_hit"), "left")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return joined.select("doc_id", "n_words", F.coalesce("spans", empty("int")).alias("spans"), F.coalesce("items", empty("string")).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each row of ``docs`` with counts of words, hit words and items, and the verdict."""
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size("spans")), F.lit(0).cast("long"), lambda acc, i: acc + F.when(i % 2 == 0, F.element_at("spans", i)).otherwise(-F.element_at("spans", i)))
    counted = matches(docs, benchmark, window, shard_words).withColumn("n_hit", F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long")))
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (COVER[1] * F.col("n_hit") >= COVER[0] * F.col("n_words"))).alias("contaminated"),
    )


def _cut(text: str, spans: list[list[int]]) -> str:
    """``text`` without the word spans; what lies between words outside them stays."""
    out, last, n, at = [], 0, 0, (0, 0)
    places = _WORD.finditer(text)
    for a, b in spans:
        while n <= a:
            at, n = next(places).span(), n + 1
        out.append(text[last : at[0]])
        while n < b:
            at, n = next(places).span(), n + 1
        last = at[1]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept; with ``max_span``, spans of at least so many words are cut from the rest."""
    names, schema = docs.columns, docs.schema
    place = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None
    spark = docs.sparkSession
    first, more = _shards(benchmark, window, shard_words)
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    if more is None:
        only, current = spark.sparkContext.broadcast(first), docs.select(row)
    else:
        only, space = None, Workspace(spark, "decontaminate")
        rows = space.save(docs.select(F.monotonically_increasing_id().alias("_row"), row))
        hits = _united(rows.select("_row", F.col("row.text").alias("text")), more, space).select(F.col("_row").alias("_hit"), "spans")
        current = rows.join(hits, F.col("_row") == F.col("_hit"), "left").select("row", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            keep, new, changed = [], [], []
            spans = None if only else batch.column(1).to_pylist()
            for i, text in enumerate(columns[place]):
                text = text.as_py()
                # a single automaton matches and judges in one pass
                flat = _hits(only.value, text)[1] if only else spans[i] or []
                merged = _merged(flat)
                n = sum(b - a for a, b in merged)
                keep.append(not (n and COVER[1] * n >= COVER[0] * len(alnum_words(text))))
                long = [s for s in merged if max_span is not None and s[1] - s[0] >= max_span]
                new.append(_cut(text, long) if long else text)
                changed.append(bool(long))
            columns[place] = pa.array(new, columns[place].type)
            if counted is not None and any(changed):
                sizes = [len(t) if c else n for t, c, n in zip(new, changed, columns[counted].to_pylist())]
                columns[counted] = pa.array(sizes).cast(columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return current.mapInArrow(finish, schema)
