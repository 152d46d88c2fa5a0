from __future__ import annotations

import random

import numpy as np
import pytest

from tallyforge.llm import neardup, sketch, substring
from tallyforge.llm.common import Workspace
from tallyforge.llm.components import components

SCHEMA = "doc_id long, text string, n long, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def sets(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) > k else ({tuple(w)} if w else set())


def brute(rows, k):
    s = {i: sets(t, k) for i, t in rows}
    parent = {i: i for i in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in s}


def corpus(n=160, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split() if i % 2 else [rng.choice(words) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(0, 5) if i % 2 else 0):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "ONE"), (1005, "a b"), (1006, rows[3][1].upper())]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(900, i) for i in range(800, 860)] + [(i, i + 1) for i in range(400, 440)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()))
    assert got == {i: root(i) for i in parent}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_sketch_estimates_and_merges():
    s = sketch.SetSketch(5, 32)
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    a, b = pool[:1100], pool[200:1300]
    ra, rb = s.registers(a), s.registers(b)
    assert (sketch.merge(ra, rb) == s.registers(pool[:1300])).all()
    est = s.compare(np.array([1100]), ra[None], np.array([1100]), rb[None])[0]
    assert abs(est - 900 / 1300) < 0.12
    assert abs((ra == rb).mean() - 900 / 1300) < 0.12


@pytest.mark.parametrize("k", [2, 5])
def test_groups_match_brute_force(spark, k):
    rows = corpus()
    got = {r.doc_id: r for r in neardup.groups(frame(spark, rows), k=k).collect()}
    want = brute(rows, k)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets(dict(rows)[i], k)) and r.kept == (want[i] == i) for i, r in got.items())


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    from tallyforge.llm import near

    monkeypatch.setattr(near, "BLOCK", 4)
    monkeypatch.setattr(near, "BLOCK_ELEMENTS", 150)
    monkeypatch.setattr(near, "SMALL", 0)
    monkeypatch.setattr(near, "SMALL_KEYS", 0)
    monkeypatch.setattr(near, "GROUPS", 3)
    rows = corpus(240, 9)
    got = {r.doc_id: r.component_id for r in neardup.op2(frame(spark, rows)).collect()}
    assert got == brute(rows, 2)


def test_keep_one_and_odd_rows(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "x y z"), (None, "a b c d e f"), (8, None), (7, "q"), (7, "r s t")]
    d = frame(spark, rows)
    got = neardup.keep_one(d)
    assert got.columns == d.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(3, "a b c d e f"), (9, "x y z"), (None, "a b c d e f"), (8, None), (7, "q"), (7, "r s t")]))
    assert neardup.op2(d.limit(0)).count() == 0 and neardup.keep_one(d.limit(0)).count() == 0
    null = [r for r in neardup.op2(d).collect() if r.doc_id is None][0]
    assert null.component_id is None and null.kept


def test_one_id_with_several_texts(spark):
    long, other, near_ = " ".join(map(str, range(60))), " ".join(map(str, range(100, 160))), " ".join(map(str, range(59)))
    rows = [(1, long), (1, None), (1, ""), (2, near_), (2, other), (2, other), (3, other), (4, near_), (4, None), (None, other)]
    d = frame(spark, rows)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.groups(d, k=5).collect()))
    assert got == sorted([
        (False, 1, 56, 1, True), (False, 1, 0, 1, True), (False, 1, 0, 1, True), (False, 2, 55, 1, False), (False, 2, 56, 2, True), (False, 2, 56, 2, True),
        (False, 3, 56, 2, False), (False, 4, 55, 1, False), (False, 4, 0, 4, True), (True, 0, 56, None, True),
    ])
    kept = sorted(str((r.doc_id, r.text)) for r in neardup.keep_one(d).collect())
    assert kept == sorted(map(str, [(1, long), (1, None), (1, ""), (2, other), (4, None), (None, other)]))


def test_clashing_columns_pass_through(spark):
    extra = ["_rank", "_out", "_twice", "row", "h1", "h2", "rep", "n", "id", "band", "spans", "doc", "key", "component_id"]
    text = " ".join(f"{i}." for i in range(60))
    rows = [(1, text, *extra), (2, text, *extra), (2, text + " x", *extra), (2, text, *extra)]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    one = neardup.keep_one(d)
    assert one.columns == d.columns and [tuple(r) for r in one.collect()] == [rows[0]]
    cut = substring.remove(d)
    assert cut.columns == d.columns and sorted(len(r.text.split()) for r in cut.collect()) == [0, 0, 0, 60] and all(tuple(r)[2:] == tuple(extra) for r in cut.collect())


def test_substring_of_one_id_with_several_texts(spark):
    rng = random.Random(6)
    p, q = passage(rng, 60), passage(rng, 60)
    own = lambda i, n: [f"o{i}x{j}" + ("." if j % 8 == 7 else "") for j in range(n)]
    rows = [(1, " ".join(p)), (2, " ".join(own(2, 24) + p)), (2, " ".join(own(3, 16) + q)), (2, None), (3, " ".join(q + own(4, 24))), (2, " ".join(own(2, 24) + p))]
    d = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars int")
    got = substring.remove(d).collect()
    # up to four words at the end of a passage may be too few for a paragraph
    plain = sorted((r.doc_id, " ".join(w for w in (r.text or "").split() if w.startswith("o")), sum(w.startswith("p") for w in (r.text or "").split())) for r in got)
    o = lambda i, n: " ".join(own(i, n))
    want = sorted([(1, "", 60), (2, o(2, 24), 0), (2, o(2, 24), 0), (2, o(3, 16), 60), (2, "", 0), (3, o(4, 24), 0)])
    assert [x[:2] for x in plain] == [x[:2] for x in want] and all(b[2] <= a[2] <= b[2] + 4 for a, b in zip(plain, want))
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_removals_match_brute_force(spark):
    """Equal and near paragraphs (one a line), clustered and kept by a plain version."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    pool = [[rng.choice(words) for _ in range(rng.randint(15, 16))] for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(pool)) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(15, 16))]
            if rng.random() < 0.2:
                line[0] = rng.choice(words)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    lines = [(i, n, l, sets(l, 5)) for i, t in rows for n, l in enumerate(t.split("\n"))]
    near_ = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    cluster = list(range(len(lines)))
    for x in range(len(lines)):
        for y in range(x):
            if cluster[x] != cluster[y] and near_(lines[x][3], lines[y][3]):
                old = cluster[x]
                cluster = [cluster[y] if c == old else c for c in cluster]
    first = {}
    for x, c in enumerate(cluster):
        first.setdefault(c, x)
    want = {}
    for x, c in enumerate(cluster):
        if first[c] != x and sum(cluster.count(c) > 1 for c in [c]):
            want.setdefault(lines[x][0], set()).add(lines[x][1])
    starts = {i: [sum(len(l.split()) for l in t.split("\n")[:n]) for n in range(len(t.split("\n")) + 1)] for i, t in rows}
    gone = {i: {w for n in ns for w in range(starts[i][n], starts[i][n + 1])} for i, ns in want.items()}
    got: dict = {}
    for r in substring.removals(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == gone and len(gone) > 20


def passage(rng, n):
    out = []
    while len(out) < n:
        out += [f"p{rng.randrange(10**6)}" for _ in range(rng.randint(6, 11))]
        out[-1] += "."
    return out[:n]


def test_substring_finds_passages_anywhere(spark):
    rng = random.Random(2)
    shared = [passage(rng, 60) for _ in range(4)]
    rows = []
    for i in range(40):
        own = [f"o{i}x{j}" + ("." if j % 8 == 7 else "") for j in range(70)]
        at = rng.randrange(70)
        body = own[:at] + (shared[i % 4] if i < 20 else []) + own[at:]
        rows.append((i, " ".join(body)))
    rows += [(50, None), (51, ""), (None, " ".join(shared[0])), (52, "short. lines.\nshort. lines.")]
    near = list(shared[0])
    near[30] = "changed"
    rows.append((60, " ".join(f"n{j}" for j in range(9)) + ". " + " ".join(near)))
    d = frame(spark, rows)
    got = substring.removals(d).collect()
    assert {r.doc_id for r in got} == {*range(4, 20), 60}
    assert all(set(r.keep_docs) <= {r.doc_id % 4 if r.doc_id < 20 else 0} for r in got)
    cleaned = {r.doc_id: r.text for r in substring.remove(d).collect() if r.doc_id is not None}
    text = dict(rows)
    for i in range(4, 20):
        assert len(cleaned[i].split()) <= 70 + 26 and all(w in cleaned[i] for w in text[i].split() if w.startswith("o"))
    assert all(cleaned[i] == text[i] for i in [*range(4), *range(20, 40), 50, 51, 52])
    assert substring.removals(d.limit(0)).count() == 0


def test_passages_without_sentence_ends(spark):
    rng = random.Random(4)
    words = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    shared, twice, long = [words(50) for _ in range(6)], words(60), words(2000)
    rows = [(i, " ".join(words(40) + shared[i % 6] + words(35))) for i in range(18)]
    rows += [(30, " ".join(words(30) + twice + words(30) + twice)), (40, " ".join(long)), (41, " ".join(words(300) + long + words(300)))]
    sentences = " ".join(words(29) + ["end."] + words(29) + ["end."])
    rows += [(50, sentences), (51, " ".join(words(20)) + f" {sentences} " + " ".join(words(20)) + ".")]
    got = substring.removals(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {*range(6, 18), 30, 41, 51}
    text = {i: t.split() for i, t in rows}
    for r in got:
        cut = text[r.doc_id][r.start_word : r.end_word]
        kept = " ".join(text[r.keep_docs[0]])
        assert r.n_words >= 15 and " ".join(cut) in kept and r.keep_docs == [{30: 30, 41: 40, 51: 50}.get(r.doc_id, r.doc_id % 6)]
    assert [r.n_words > 1900 for r in got if r.doc_id == 41] == [True]
    found = 0
    for _ in range(300):  # a passage of 50 words in two surroundings
        p = words(50)
        one, two = ({h: b - a for a, b, h in zip(*substring.pieces(" ".join(words(30) + p + words(30))))} for _ in range(2))
        found += sum(n for h, n in one.items() if h in two) >= substring.RUN
    assert found >= 294


def test_near_paragraphs_are_linked(spark):
    rng = random.Random(8)
    line = [f"l{rng.randrange(10**6)}" for _ in range(70)]
    other = list(line)
    other[-1] = "end"
    got = substring.removals(frame(spark, [(1, " ".join(line)), (2, " ".join(other)), (3, " ".join(reversed(line)))])).collect()
    assert [(r.doc_id, r.n_words, r.keep_docs) for r in got] == [(2, 70, [1])]
