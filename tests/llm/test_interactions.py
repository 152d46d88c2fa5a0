from __future__ import annotations

import collections
import itertools
import random
import re

from tallyforge.llm import interactions

DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, x, *_ in docs if (x or "") == t and j is not None]
        fails = "".join(
            f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and bool(same) and i > min(same))) if bad
        )
        rows.append((lang or "", fails, i in good, i in toxic))
    out, removed_by = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                out[part, order, k + 1] = [len(left), len(removed), failing - len(removed), sum(r[1] == f for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                removed_by[part, f] += len(removed)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_against_a_simulation_of_all_orders(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "$", "x|y", "délta", "é"]
    docs = []
    for i in range(120):
        n = rng.choice([0, 3, 99, 100, 130])
        text = " ".join(f"{rng.choice(words)}{rng.randrange(400)}" if rng.random() < rng.choice([0.2, 0.95]) else "the" for _ in range(n))
        docs.append((i, rng.choice([text, text.lower(), docs[rng.randrange(i)][1] if i else text]), rng.choice(["en", "fr", None, ""]), "s", 0))
    docs += [(None, docs[5][1], "en", "s", 0), (5, docs[5][1], "fr", None, None), (200, None, None, None, None), (201, "", "en", None, 1), (7, docs[7][1], "en", "s", 0), (7, docs[7][1], "en", "s", 0)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as A", "2 as n", "'x' as part", "3 as good")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in interactions.op13(frame, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == brute(docs, labels)


def test_empty_tables_copies_and_long_texts(spark):
    none = spark.createDataFrame([], LABELS)
    assert interactions.op13(spark.createDataFrame([], DOCS), none).collect() == []
    long = "Wörter und mehr " * 200_000
    rows = [(i, "same text", "en", "s", 9) for i in range(500)] + [(900, long, "de", "s", 1), (901, long, "de", "s", 1)]
    got = {(r.part, r.filter_order, r.step): r for r in interactions.op13(spark.createDataFrame(rows, DOCS), none).collect()}
    assert got["en", "EABCD", 1].removed == 499 and got["en", "ABCDE", 1].removed == 500 and got["en", "ABCDE", 5].redundant == 499
    assert got["de", "BECDA", 1].removed == 2 and got["de", "ECDAB", 1].removed == 1 and len(got) == 1200
    # shares of a removal add up to all removals of all orders
    assert sum(got["en", "ABCDE", k].shapley for k in range(1, 6)) == 120 * 500
