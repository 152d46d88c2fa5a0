"""How filters interact: what each removes, what another would have removed as well, in any order of application.

Documents are counted once, as joint failures: for each set of filters, how many documents fail all of them (the
sum of the product of their flags). All else follows from these 2^n numbers a part by inclusion and exclusion: survivors
of a set of filters, removals of a step, unique failures, and Shapley values by Harsanyi dividends.

Defined cases. A null text is empty; a null part is the part ''. A document without an id has no smaller id, and is none to
others. Rows that repeat an id count as documents of their own; rows of the least id that has a text are no copies. Labels
of one document are united: one row with quality 1 (toxic 1) is enough; labels without an id or without a document
count for nothing. Parts are those of the documents, so an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGE = r"[\x20\x09-\x0D]+"


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, by filter."""
    words = F.filter(F.split(text, _EDGE), lambda w: w != "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 100, "B": 100 * different.cast("long") < 80 * n.cast("long"), "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def judged(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Groups of documents alike in all that counts: part, good, toxic, flags A to D, ``n`` documents, of which ``n_E`` are copies.

    Copies are found by least ids per text. Texts travel as digests, and rows of the same text, part and labels are
    summed before they meet, so a text that a third of all documents share makes no large group.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = conditions(F.col("_text"))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("_h"), *(c.cast("int").alias(k) for k, c in flags.items()))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    kind = ["_h", "part", *flags, "good", "toxic"]
    rows = rows.join(said, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "_h", "part", *flags, F.coalesce("_good", F.lit(0)).alias("good"), F.coalesce("_toxic", F.lit(0)).alias("toxic"))
    ids = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    has = F.col("doc_id").isNotNull()
    kinds = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(has, F.col("n"))).alias("_named"), F.min(F.when(has, F.struct("doc_id", "n"))).alias("_first"))
    least = kinds.groupBy(F.col("_h").alias("_text_h")).agg(F.min("_first.doc_id").alias("_least"))
    at_least = F.when(F.col("_first.doc_id") == F.col("_least"), F.col("_first.n")).otherwise(0)
    return kinds.join(least, F.col("_h") == F.col("_text_h")).select("part", "good", "toxic", *flags, "n", (F.coalesce("_named", F.lit(0)) - at_least).alias("n_E"))


def joint_failures(groups: DataFrame, filters: str = "ABCDE", counted: str = "E") -> DataFrame:
    """part -> arrays ``all``, ``good``, ``toxic``: at index S (a bit a filter) the documents that fail every filter of S.

    Flags are 0/1 columns named like the filters; ``counted`` is the one that differs within a group, as ``n_<filter>`` of ``n``.
    """

    def joint(mask: int) -> Column:
        names = [f for i, f in enumerate(filters) if mask >> i & 1]
        return reduce(lambda a, b: a * b, (F.col(f) for f in names if f != counted), F.col(f"n_{counted}" if counted in names else "n"))

    sums = [F.sum(w * joint(m)).cast("long").alias(f"{k}_{m}") for k, w in (("all", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic"))) for m in range(1 << len(filters))]
    out = groups.groupBy("part").agg(*sums)
    return out.select("part", *(F.array(*(F.col(f"{k}_{m}") for m in range(1 << len(filters)))).alias(k) for k in ("all", "good", "toxic")))


def _sum(sets: Column, of) -> Column:
    return F.aggregate(sets, F.lit(0).cast("long"), lambda acc, t: (acc + of(t)).cast("long"))


def audit(joint: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """Joint failures -> a row per part, order of the filters and step; see the module for the counts.

    kept, removed, good_lost and toxic_lost are alternating sums over the subsets of the filters so far; shapley is the sum of
    removals over all orders, n! times the filter's share |T|^-1 of each dividend (-1)^(|T|+1) J(T).
    """
    n, rounds = len(filters), math.factorial(len(filters))
    orders = F.explode(F.split(F.lit(",".join(map("".join, itertools.permutations(filters)))), ",")).alias("filter_order")
    steps = joint.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit = F.create_map(*(F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)))
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    before = F.aggregate(letters(F.substring("filter_order", F.lit(1), F.col("step") - 1)), F.lit(0), lambda acc, c: acc.bitwiseOR(bit[c]))
    steps = steps.withColumn("_own", bit[F.substring("filter_order", F.col("step"), F.lit(1))]).withColumn("_before", before)
    sets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    within = lambda mask: F.filter(sets, lambda t: t.bitwiseAND(mask) == t)
    sign = lambda t: F.when(F.bit_count(t) % 2 == 0, 1).otherwise(-1)
    at = lambda name, t: F.get(F.col(name), t)
    own, prior = F.col("_own"), F.col("_before")
    removed = lambda name, mask: _sum(within(mask), lambda t: sign(t) * at(name, t.bitwiseOR(own)))
    lost = removed("all", prior)
    dividends = _sum(F.filter(sets, lambda t: t.bitwiseAND(own) != 0), lambda t: -sign(t) * at("all", t) * (F.lit(rounds) / F.bit_count(t)).cast("long"))
    return steps.select(
        "part", "filter_order", "step", _sum(within(prior.bitwiseOR(own)), lambda t: sign(t) * at("all", t)).alias("kept"), lost.alias("removed"), (at("all", own) - lost).alias("redundant"),
        removed("all", F.lit((1 << n) - 1).bitwiseXOR(own)).alias("unique_fails"), removed("good", prior).alias("good_lost"), removed("toxic", prior).alias("toxic_lost"), dividends.alias("shapley"),
    )


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(joint_failures(judged(docs, labels)))
