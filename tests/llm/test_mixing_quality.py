from __future__ import annotations

import collections

import numpy as np
import pytest

from tallyforge.llm import mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in done]
        if not open_:
            return done
        rest = total - sum(done.values())
        share = {s: w[s] * rest / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            return done | share
        done |= {s: float(most * sizes[s]) for s in over}


def test_targets_and_sizes(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(200)]
    rows += [(500 + i, "tiny", "a") for i in range(3)] + [(600, None, None), (601, "", None), (602, "x y", None), (602, "x y", None)]
    got = mixing.op8(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = brute_targets(size)
    source = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 8


def test_mixing_reruns_agree_and_empty(spark):
    d = docs(spark, [(i, "w " * (i % 9), f"s{i % 3}") for i in range(300)])
    a = sorted(map(tuple, mixing.op8(d).collect()))
    assert a == sorted(map(tuple, mixing.op8(d.repartition(7)).collect()))
    assert mixing.op8(d.limit(0)).collect() == []


def brute_stats(text):
    words = (text or "").split(" ") if False else [w for line in (text or "").split("\n") for w in line.replace("\t", " ").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = collections.Counter(windows)
    cover = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


@pytest.mark.parametrize("text", [None, "", "\n\n", "a b c a b c", "é\nü b\n\té x\né\né", "a b c d\n" * 40, "x " * 500, "ab | cd <b> 100% #x"])
def test_statistics(text):
    t = quality.measure(text)
    assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) == brute_stats(text)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in range(1, 9):
        e, tr = rng.normal(size=n), rng.normal(size=(2, 2))
        score = lambda y: sum(e[i] * y[i] for i in range(n)) + sum(tr[y[i], y[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        best = max(score([k >> i & 1 for i in range(n)]) for k in range(2**n))
        assert score(quality.viterbi(e, tr).tolist()) == pytest.approx(best)


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(3)
    chains = sorted(((rng.normal(size=(n, 3)), rng.integers(0, 2, n)) for n in (1, 4, 2, 5)), key=lambda c: -len(c[0]))
    data, w, trans = quality._Stacked(chains), rng.normal(size=3), rng.normal(size=(2, 2))
    value, g_w, g_t = data.gradient(w, trans, 0.1)
    want = 0.0
    for x, y in chains:  # all labellings of each chain
        score = lambda z: sum(x[i] @ w * z[i] for i in range(len(x))) + sum(trans[a, b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
        total = sum(np.exp(score([k >> i & 1 for i in range(len(x))])) for k in range(2 ** len(x)))
        want += (score(y.tolist()) - np.log(total)) / len(x) / len(chains)
    assert value == pytest.approx(want - 0.05 * ((w**2).sum() + (trans**2).sum()))
    for i in range(3):
        step = np.eye(3)[i] * 1e-5
        assert g_w[i] == pytest.approx((data.gradient(w + step, trans, 0.1)[0] - data.gradient(w - step, trans, 0.1)[0]) / 2e-5, abs=1e-6)
    for i in range(4):
        step = np.eye(4)[i].reshape(2, 2) * 1e-5
        assert g_t.ravel()[i] == pytest.approx((data.gradient(w, trans + step, 0.1)[0] - data.gradient(w, trans - step, 0.1)[0]) / 2e-5, abs=1e-6)


def test_plain_lines_of_bad_documents_are_content():
    prose = lambda i: " ".join(f"word{j}of{i}" for j in range(9)) + "."
    junk = lambda i: " | ".join(f"menu{j}of{i}" for j in range(12))
    good = ["\n".join(prose(i * 9 + j) for j in range(8)) for i in range(40)]
    bad = ["\n".join([prose(900 + i), *(junk(i * 9 + j) for j in range(6)), prose(950 + i)]) for i in range(20)]
    seen = [quality.measure(t) for t in good + bad]
    model = quality.fit(quality.line_labels([(t.features, t.line_words, int(i >= 40)) for i, t in enumerate(seen)]))
    labels = [quality.viterbi(t.features @ model[0], model[1]).tolist() for t in seen]
    assert labels == [[0] * 8] * 40 + [[0, *[1] * 6, 0]] * 20
    assert quality.line_labels([]) == []


def test_long_labelled_documents_are_used(spark):
    good = ["\n".join(f"A line of words number {i} and {j}, which ends well." for j in range(2000)) for i in range(4)]
    bad = ["\n".join(f"MENU{i} | HOME{j} | CART | LOGIN | #{j}" for j in range(2000)) for i in range(4)]
    d = docs(spark, [(i, t, "s") for i, t in enumerate(good + bad)])
    model = quality.train(d, spark.createDataFrame([(i, int(i < 4), 0) for i in range(8)], "doc_id long, quality int, toxic int"), limit=40)
    assert model is not quality.PRIOR and [r.kept for r in quality.judge(d, model).orderBy("doc_id").collect()] == [False] * 8  # few different windows
    assert [r.n_boilerplate_lines for r in quality.judge(d, model).orderBy("doc_id").collect()] == [0] * 4 + [2000] * 4


def test_rules_learn_and_keep_columns(spark):
    good = ["The ship went out to sea at dawn, and nobody on the shore saw it again until spring came. " * 4 + f"\nA note {i}." for i in range(30)]
    good = [" ".join(f"w{j}x{i}" for j in range(70)) + ".\nIt ended well." for i, _ in enumerate(good)]
    bad = [" | ".join(f"MENU{i}{j}" for j in range(70)) + "\n" for i in range(30)]
    d = docs(spark, [(i, t, "s") for i, t in enumerate(good + bad)] + [(99, None, "s"), (None, "short", "s")])
    d = d.selectExpr("*", "1 as kept", "2 as n_words")
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    got = {r.doc_id: r for r in quality.judge(d, model).collect()}
    assert all(got[i].kept == (i < 30) for i in range(60))
    assert got[99].n_words == 0 and got[99].base_failed and not got[99].kept and not got[None].kept
    kept = quality.keep_documents(d, model)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == list(range(30))
    assert quality.judge(d.limit(0), model).count() == 0
    assert quality.train(d, labels.limit(0)) is quality.PRIOR
