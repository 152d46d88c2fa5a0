"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is divided among its documents in proportion to an inclusion weight, by length: longer
documents, of which the words hang together further, weigh more (LENGTHS). A document's expected number of
copies is min(MOST_COPIES, t * weight), where t is the number that makes the expected words of the source its
target. The whole part is certain; the rest p is an inclusion probability, which differs within a source.
Documents are ranked by their random odds over their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and
taken in that order up to the source's size of sample, in words. The random u comes from a hash of the
row's doc_id, text and the seed, so reruns and retried tasks agree.

No source is brought into one task: the rank axis is cut into bins, words are summed per bin (partial
sums on the map side), and the bin in which the sample ends is cut again, until what is left of it
is a sliver of 1 / BINS**2 of the source, which alone is ranked exactly. Only the targets, of which there is
one for each source, are reckoned in one task.

Defined results: a null or empty text has size 0 and is taken 0 words; null sources form one source,
the last; rows that agree in doc_id and text share a rank and are taken or left together. Texts are measured
whole. Extra columns of any name pass through ``select_documents``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Workspace, private

#: Weights of the sources, by code point of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used at most so many times over.
MOST_COPIES = 3
#: Inclusion weights of documents of so many words and more.
LENGTHS = ((0, 1), (64, 2), (1024, 3))
BINS = 4096
SEED = "mix-1"
#: u has so many bits, a whole number from 0 to 2**52 - 1.
BITS = 52


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A whole number of BITS bits from the row and the seed."""
    key = F.concat_ws("\x01", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> also target (words): shares by weight of all words, at most ``most`` sizes.

    Resharing the excess by weight until nobody is above ends at min(cap, level * weight); sources
    sorted by cap / weight reach their caps in that order, so a prefix sum finds the level. Only the
    one row per source goes through the windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")
    by_ratio = Window.orderBy(F.col("cap").cast("double") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    less = lambda c: F.sum(c).over(whole) - F.coalesce(F.sum(c).over(before), F.lit(0))
    return (
        sizes.withColumn("w", F.element_at(F.array(*(F.lit(x).cast("long") for x in weights)), place))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_w", less("w"))
        .withColumn("capped", F.col("cap").cast("double") * F.col("rest_w") <= F.col("w").cast("double") * F.col("rest"))
        .withColumn("level", F.first(F.when(~F.col("capped"), F.struct("rest", "rest_w")), ignorenulls=True).over(whole))
        .select(
            "source", "source_size",
            F.when(F.col("capped") | F.col("level").isNull(), F.col("cap").cast("double"))
            .otherwise((F.col("w").cast("double") * F.col("level.rest")) / F.col("level.rest_w")).alias("target"),
        )
    )


def length_class(size: Column) -> Column:
    """Index into LENGTHS, from 1."""
    return sum(((size >= F.lit(least)).cast("int") for least, _ in LENGTHS), F.lit(0))


def shares(goals: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(target, words: array of a source's words by length class) -> adds lam, the expected copies of each class.

    Heavier classes reach ``most`` first; t is what is left over the weighted words of the others.
    """
    word = lambda k: F.element_at("words", k + 1)
    weights = [w for _, w in LENGTHS]
    rest, full, t = F.col("target"), F.lit(True), F.lit(None).cast("double")
    capped: list[Column] = []
    for k in reversed(range(len(weights))):  # weights rise with length
        open_ = sum((F.lit(weights[j]).cast("long") * word(j) for j in range(k + 1)), F.lit(0).cast("long")).cast("double")
        own = full & (F.lit(most) * open_ <= F.lit(weights[k]) * rest)
        t = F.coalesce(t, F.when(full & ~own & (open_ > 0), F.try_divide(rest, open_)))
        capped.insert(0, own)
        rest, full = rest - F.lit(most) * word(k), own
    lam = [F.when(c | F.col("_t").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.lit(w) * F.col("_t"))) for c, w in zip(capped, weights)]
    return goals.withColumn("_t", t).withColumn("lam", F.array(*lam)).drop("_t")


def rank_of(u: Column, p: Column) -> Column:
    """A whole number that orders rows by (u / (1 - u)) / (p / (1 - p)) =: q: q / (1 + q) of 2**BITS. Null where p is 0."""
    x = (u + F.lit(0.5)) / F.lit(float(1 << BITS))
    return F.when(p > 0, F.floor(x * (1 - p) / (x * (1 - p) + (1 - x) * p) * F.lit(float(1 << BITS))))


def _cuts(ranked: DataFrame, keep) -> DataFrame:
    """(source, u, _doc, _hash, size, need), u the rank -> (_source, cut, first): the last rank of each source's sample; no row if it is empty.

    The sample ends with the row that brings its words nearest to ``need``: a row is in if the words
    before it and the words with it add up to at most 2 * need.
    """
    step = BITS - (BINS - 1).bit_length()
    rows = ranked.withColumn("_before", F.lit(0).cast("long"))
    for level in (1, 2):
        shift = BITS - level * (BITS - step)
        cells = rows.groupBy("source", F.shiftright("u", shift).alias("_cell")).agg(F.sum("size").alias("_words"), F.first("need").alias("need"), F.first("_before").alias("_before"))
        upto = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = (
            cells.withColumn("_end", F.col("_before") + F.sum("_words").over(upto)).where(F.col("_end") > F.col("need"))
            .groupBy("source").agg(F.min_by(F.struct("_cell", (F.col("_end") - F.col("_words")).alias("_start")), "_cell").alias("_at"))
            .select(F.col("source").alias("_s"), F.col("_at._cell").alias("_last"), F.col("_at._start").alias("_start"))
        )
        found = keep(last)
        rows = (
            rows.join(found, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("u", shift) == F.col("_last")))
            .select("source", "u", "_doc", "_hash", "size", "need", F.col("_start").alias("_before"))
        )
    # what is left lies in one cell of 2**-24 of the rank axis
    upto = Window.partitionBy("source").orderBy("u", "_doc", "_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tied = rows.groupBy("source", "u", "_doc", "_hash").agg(F.sum("size").alias("_words"), F.first("need").alias("need"), F.first("_before").alias("_before"))
    ends = tied.withColumn("_end", F.col("_before") + F.sum("_words").over(upto))
    inside = ends.select("source", F.struct("u", "_doc", "_hash").alias("_rank"), (2 * F.col("_end") - F.col("_words") <= 2 * F.col("need")).alias("_in"))
    # the sample holds every rank up to the last that is in; where none of the cell is, every rank below its first
    return inside.groupBy(F.col("source").alias("_source")).agg(
        F.max(F.when(F.col("_in"), F.col("_rank"))).alias("cut"), F.min("_rank").alias("first"),
    )


def _base(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"),
        uniform(F.col("doc_id"), F.col("text"), seed).alias("u"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), F.md5(F.coalesce("text", F.lit(""))).alias("_hash"),
    )


def _plan(base: DataFrame, space: Workspace, weights: tuple[int, ...], most: int) -> DataFrame:
    """Per source: source_size, target, whole copies and p by length class, and the cut of its sample.

    Small tables (a row per source) in files: Catalyst broadcasts them while their size allows it.
    """
    by_class = [F.sum(F.when(length_class(F.col("size")) == k + 1, F.col("size")).otherwise(F.lit(0))) for k in range(len(LENGTHS))]
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.array(*by_class).alias("words"))
    words = sizes.select(F.col("source").alias("_w"), "words")
    goals = targets(sizes.select("source", "source_size"), weights, most)
    goals = shares(goals.join(words, F.col("source").eqNullSafe(F.col("_w"))), most)
    floor = F.transform("lam", lambda x: F.floor(x))
    need = F.col("target") - F.aggregate(F.zip_with("whole", "words", lambda a, b: a * b), F.lit(0).cast("long"), lambda acc, x: acc + x)
    goals = space.save(goals.withColumns({"whole": floor, "p": F.transform("lam", lambda x: x - F.floor(x))}).select(F.col("source").alias("_source"), "source_size", "target", "whole", "p", need.alias("need")))
    joined = base.join(goals, base["source"].eqNullSafe(goals["_source"]))
    ranked = joined.withColumn("u", rank_of(F.col("u"), F.element_at("p", length_class(F.col("size"))))).where("u is not null and need > 0")
    cuts = space.save(_cuts(ranked.select("source", "u", "_doc", "_hash", "size", "need"), space.save))
    return space.save(goals.join(cuts.withColumnRenamed("_source", "_c"), F.col("_source").eqNullSafe(F.col("_c")), "left").drop("_c"))


def _copies(size: Column, u: Column, doc: Column, text_hash: Column) -> tuple[Column, Column]:
    """A row's copies and its rank, from the columns of ``_plan``."""
    k = length_class(size)
    rank = rank_of(u, F.element_at("p", k))
    key = F.struct(rank.alias("u"), doc.alias("_doc"), text_hash.alias("_hash"))
    drawn = F.when(F.col("cut").isNotNull(), key <= F.col("cut")).when(F.col("first").isNotNull(), key < F.col("first")).otherwise(F.col("need") > 0)
    return F.element_at("whole", k) + F.when(rank.isNotNull(), drawn.cast("long")).otherwise(F.lit(0)), rank


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, copies, taken, p, rank."""
    space = Workspace(docs.sparkSession, "mix")
    base = space.save(_base(docs, seed))
    plan = _plan(base, space, weights, most)
    copies, rank = _copies(F.col("size"), F.col("u"), F.col("_doc"), F.col("_hash"))
    return (
        base.join(plan, base["source"].eqNullSafe(plan["_source"])).withColumn("copies", copies)
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.element_at("p", length_class(F.col("size"))).alias("p"), rank.alias("rank"))
    )


def op8(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def select_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and size, copies, taken.

    Where ``docs`` has a column of such a name, the new one gets an underscore at its end. The draw depends
    on the row alone and on its source's numbers, so it is made where the row lies: no join by document.
    """
    space = Workspace(docs.sparkSession, "mix-select")
    plan = _plan(space.save(_base(docs, seed)), space, weights, most)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, *(c.alias(n) for c, n in ((size_of(F.col("text")), "size"), (uniform(F.col("doc_id"), F.col("text"), seed), "u"))))
    joined = rows.join(plan, F.col("row.source").eqNullSafe(F.col("_source")))
    copies, _ = _copies(F.col("size"), F.col("u"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("row.text", F.lit(""))))
    out = joined.withColumn("copies", copies).where("copies * size > 0")
    new = {"size": F.col("size"), "copies": F.col("copies"), "taken": F.col("copies") * F.col("size")}
    return out.select("row.*", *(c.alias(private(n, docs)) for n, c in new.items()))
