"""run() against a plain version of its five stages."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
from tallyforge.llm import mixing, quality, secrets
from tests.llm.test_dedup import brute
from tests.llm.test_mixing_quality import brute_stats, brute_targets
from tests.llm.test_scans import brute_report, brute_secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(rng):
    words = [f"word{i}" for i in range(3000)]
    prose = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(n // 4)) + "." for _ in range(4))
    items = [(i, " ".join(rng.choice(words) for _ in range(20 + 40 * (i == 2)))) for i in range(3)]
    texts = [prose(80) for _ in range(40)]
    texts += [" | ".join(f"MENU{rng.randrange(99)}" for _ in range(80)) for _ in range(12)] + ["too short", "", None]
    texts += [texts[3], texts[3].replace("word", "WORD"), " ".join([*texts[5].split()[:-1], "changed."])]
    texts += [prose(60) + "\n" + items[0][1] + ".", prose(3000) + "\n" + items[2][1] + " end.", prose(80) + ' token = "' + "0123456789abcdef" * 2 + '" end.']
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], items, [(i, int(i < 40), 0) for i in range(52)]


def content(text, model):
    t = quality.measure(text)
    e = t.features @ model[0]
    best = max(itertools.product((0, 1), repeat=len(e)), key=lambda y: (sum(e[i] for i in range(len(y)) if y[i]) + sum(model[1][a, b] for a, b in zip(y, y[1:])), [-v for v in y]))
    return sum(int(n) for n, y in zip(t.line_words, best) if not y)


def test_run_matches_plain_version(spark, tmp_path):
    docs, items, labels = make(random.Random(6))
    for name, rows, schema in (("documents", docs, DOCS), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = quality.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    kept = {}
    for i, t, *_ in docs:
        n, *_, repeats = brute_stats(t)
        if n >= 50 and 100 * repeats <= 50 * n and content(t, model) >= 0.5 * n:
            kept[i] = t
    assert {*range(40)} <= kept.keys() and not kept.keys() & {*range(40, 55)}
    comp = brute(list(kept.items()), 5)
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    assert not kept.keys() & {55, 56, 57}
    kept = {i: t for i, t in kept.items() if not brute_report(t, items)[4]}
    assert 58 not in kept and 59 in kept
    kept[59] = kept[59].replace(" " + items[2][1], " ").replace("\n" + items[2][1], "\n")
    for i, t in kept.items():
        for a, _, b in reversed(brute_secrets(t)[:1]):
            kept[i] = t[:a] + "[SECRET]" + t[max(x[2] for x in brute_secrets(t)) :]
    text = {r.doc_id: r.text for r in got}
    assert all(text[i] == kept[i] for i in text) and text.keys() <= kept.keys()
    source = {i: s for i, _, _, s, _ in docs}
    size = {}
    for i, t in kept.items():
        size[source[i]] = size.get(source[i], 0) + len(t.split())
    want, longest = brute_targets(size, mixing.WEIGHTS, mixing.MOST_COPIES), max(len(t.split()) for t in kept.values())
    for s in size:
        taken = sum(r.taken for r in got if source[r.doc_id] == s)
        assert abs(taken - want[s]) <= longest and all(r.taken == r.copies * r.size <= 3 * r.size for r in got)
    assert secrets.KINDS and sorted(map(tuple, got)) == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))


def test_empty_tables(spark, tmp_path):
    docs, items, labels = make(random.Random(6))
    for name, rows, schema in (("documents", docs, DOCS), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
