from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import lmscore

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b"\n"]


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        at, words = rng.randrange(400), []
        for _ in range(rng.randrange(2, 60)):
            at = (at * 7 + rng.choice([1, 1, 1, 2, rng.randrange(400)])) % 400
            words.append(vocabulary[at])
        out.append((i, " ".join(words)))
    return [*out, (1000, None), (1001, ""), (1002, " \t\n"), (1003, "W1\x0bw2\x0cW3"), (1003, "W1\x0bw2\x0cW3"), (None, "w5 ünseen Ünseen"), (1004, "nochnie gesehen")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def plain(train, rows, prior=lmscore.PRIOR):
    """Exact counts, and the model's formula on exact levels."""
    c, pairs = collections.Counter(), collections.Counter()
    for _, t in train:
        w = tokens(t)
        c.update(w)
        pairs.update(zip([b"\n", *w], w))
    n, v = sum(c.values()), len(c)
    level = lambda k: int(lmscore.level_of(np.array([k]))[0])
    mean = []
    for counts in (c, pairs):
        by = collections.defaultdict(list)
        for k in counts.values():
            by[level(k)].append(k)
        mean.append({j: sum(x) / len(x) for j, x in by.items()} | {0: 0.0})
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for h, x in zip([b"\n", *w], w):
            ch, cw = mean[0][level(c[h])], mean[0][level(c[x])]
            score += math.log10((min(mean[1][level(pairs[h, x])], ch) + prior * (cw + 1) / (n + v + 1)) / (ch + prior))
        out.append((i, len(w), sum(c[x] > 0 for x in w), base, score))
    return n, out


@pytest.mark.parametrize("bounds", [{}, {"most_words": 20}, {"most_words": 0, "most_bytes": 64}])
def test_scores_against_exact_counts(spark, bounds):
    rows = corpus()
    train = [r for r in rows if r[0] is None or r[0] % 5]
    model = lmscore.train(frame(spark, train).repartition(3))
    n, want = plain(train, rows)
    got = lmscore.score(frame(spark, rows).selectExpr("*", "1 as row", "2 as levels", "3 as h"), model, **bounds).collect()
    assert model.tokens == n and len(got) == len(rows)
    key = lambda x: (x[0] is None, x[0], x[1], x[3])
    off = 0
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9)
        assert g[4] == pytest.approx(w[4], rel=0.05)
        off += abs(g[4] - w[4]) / abs(w[4])
    assert off <= 0.005 * len(rows)  # the filter takes one n-gram in a hundred for a level too high


def test_filter_has_no_misses_and_few_false_hits(spark):
    rows = corpus()
    model = lmscore.train(frame(spark, rows))
    parts = list(model.parts(1 << 20))
    assert len(parts) == 1
    c = collections.Counter(w for _, t in rows for w in tokens(t)[:-1])
    words = list(c)
    h = lmscore.hashed_words(b" ".join(words))[2]
    levels, exact = parts[0].levels(h), lmscore.level_of(np.array([c[w] for w in words]))
    assert (levels >= exact).all() and (levels > exact).mean() < 0.04
    strange = np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2)
    assert (parts[0].levels(strange) > 0).mean() < 0.015
    many = list(model.parts(64))
    assert len(many) > 3 and (np.max([p.levels(h) for p in many], axis=0) == levels).all()


def test_held_out_texts_score_better_than_by_words(spark):
    rows = [(i, t) for i, t in corpus(600) if i is not None]
    got = lmscore.op12(frame(spark, rows)).collect()
    held = [r for r in got if r.held_out]
    assert held and len({r.train_tokens for r in got}) == 1
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, lmscore.op12(frame(spark, rows).repartition(5)).collect()), key=str)


def test_empty_tables_and_long_texts(spark):
    nothing = lmscore.train(frame(spark, []))
    assert lmscore.score(frame(spark, []), nothing).collect() == []
    assert [tuple(r) for r in lmscore.score(frame(spark, [(1, "a b")]), nothing).collect()] == [(1, 3, 0, 0.0, 0.0)]
    long = [(1, "lorem ipsum " * 300_000), (2, "x" * 3_000_000), (3, "lorem ipsum")]
    model = lmscore.train(frame(spark, long))
    n, want = plain(long, long)
    for g, w in zip(sorted(map(tuple, lmscore.score(frame(spark, long), model).collect())), want):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-6)


def test_blocks_split_between_texts(monkeypatch):
    monkeypatch.setattr(lmscore, "BLOCK", 10)
    texts = pa.array(["aaaa", None, "bbbb", "c" * 40, "", "dd"])
    blocks = [(lo, b.to_pylist()) for lo, b in lmscore._blocks(texts)]
    assert [x for _, b in blocks for x in b] == texts.to_pylist() and [lo for lo, _ in blocks] == [0, 3, 4]
