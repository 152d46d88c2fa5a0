"""MinHash near-duplicate detection with SetSketch registers.

Documents whose sets of 2-word shingles (by the contract of the query; ``k`` is a parameter, five words by
default) have a Jaccard similarity of 0.8 or more are linked; components get the least doc_id as their id.
See ``near`` for how links are found.

Defined results: null and empty texts have no shingles and are linked with nothing, not even one another;
a text of fewer words than a shingle is one shingle. Rows that repeat a doc_id are judged by their own
text, whatever the others hold. A row with a null doc_id is linked with nothing, has a null component and is
kept. Ties go to the least doc_id. Texts are taken whole; a long one costs its words in time and eight bytes
for each different shingle in memory. Extra columns of any name pass through ``keep_one``; ``groups`` returns
only its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Workspace, private, small
from tallyforge.llm.near import SMALL, NearLinks, signed
from tallyforge.llm.sketch import shingles_of


def _hash(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return signed(h >> 64), signed(h & (1 << 64) - 1)


def _classes(rows: DataFrame, space: Workspace) -> DataFrame:
    """(id, doc, h1, h2, n, regs): a row for each different set, with a 64-bit id of its own and its least doc_id.

    Copies collapse by partial minima: a class of a third of all rows is one row from each task. Should two
    sets get the same id, all are numbered anew.
    """
    live = rows.where("n > 0 and id is not null").withColumnRenamed("id", "doc")
    for seed in range(8):
        keyed = live.withColumn("id", F.xxhash64("h1", "h2", F.lit(seed)) if seed else F.col("h1"))
        found = space.save(keyed.groupBy("id").agg(
            F.min("doc").alias("doc"), F.min("h1").alias("h1"), F.min("h2").alias("h2"), F.first("n").alias("n"), F.first("regs").alias("regs"),
            ((F.min("h1") == F.max("h1")) & (F.min("h2") == F.max("h2"))).alias("alone"),
        ))
        if found.where(~F.col("alone")).isEmpty():
            return found.drop("alone")
        space.drop(found)
    raise RuntimeError("no ids without clashes")  # 64 bits failed eight times


def groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, and the class of its set (h1, h2).

    ``rep`` says whether the row's class is the one that stays for its component: that of the least
    (doc_id, h1, h2).
    """
    space = Workspace(docs.sparkSession, "neardup")
    near = NearLinks(space, k, num, den)
    items = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text"))
    rows = space.save(near.sketches(items))
    classes = _classes(rows, space)

    def fetch(ids: DataFrame) -> DataFrame:
        """The sets of classes, each made from the document where it is known to be."""
        wanted = space.save(ids.select(F.col("id").alias("_id")).join(classes.select("id", "doc", "h1", "h2"), F.col("_id") == F.col("id")).select("id", F.col("doc").alias("_doc"), "h1", "h2"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, bytes]] = []
                for text, id_, h1, h2 in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])):
                    s = shingles_of(text.as_py(), k)
                    if _hash(s) == (h1, h2):  # a doc_id may come with other texts
                        out.append((id_, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary()))], ["id", "s"])

        found = space.save(items.where("id is not null").withColumnRenamed("id", "_i").join(small(wanted, SMALL), F.col("_i") == F.col("_doc")).select("text", "id", "h1", "h2").mapInArrow(run, "id long, s binary"))
        return found.dropDuplicates(["id"]) if found.count() > wanted.count() else found

    full = near.shared(near.bands(classes))
    _, comp = near.run(full, classes.select("id", "n", "regs"), fetch)
    keyed = classes.select("id", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "doc")
    linked = space.save(keyed.join(comp.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select("_h1", "_h2", "doc", "comp"))
    first = space.save(linked.groupBy(F.col("comp").alias("_c")).agg(F.min(F.struct("doc", "_h1", "_h2")).alias("_first")))
    # only linked classes meet their component: the others have none in common
    named = linked.join(small(first, SMALL), F.col("comp") == F.col("_c")).select("_h1", "_h2", "_first")
    alone = keyed.join(comp.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left_anti").select("_h1", "_h2", F.struct("doc", "_h1", "_h2").alias("_first"))
    named = space.save(named.union(alone))
    some = (F.col("n") > 0) & F.col("id").isNotNull()
    light = rows.select("id", "n", "h1", "h2")
    judged = light.where(some).join(named, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("id", "n", "h1", "h2", "_first")
    out = judged.union(light.where(~some).withColumn("_first", F.lit(None).cast("struct<doc:long,_h1:long,_h2:long>")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("_first.doc", "id"))
    rep = F.coalesce(F.col("_first") == F.struct("id", "h1", "h2"), F.lit(True))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), "h1", "h2", rep.alias("rep"))


def op2(docs: DataFrame) -> DataFrame:
    return groups(docs, k=2).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns kept.

    The row of the least doc_id stays; where this one comes with several texts of the group, the one with
    the least hash of its set; of rows that repeat doc_id and set, the one with the least text. Every row
    is judged by its own text: a doc_id may stay with one text and go with another.
    """
    space = Workspace(docs.sparkSession, "keep-one")
    judged = space.save(groups(docs, k, num, den).where("doc_id is not null"))
    id_ = F.col("doc_id").cast("long")
    # a doc_id that comes once, or always with the same verdict to go, needs no look at the row's text
    by_doc = judged.groupBy("doc_id").agg(F.count("*").alias("c"), F.max("rep").alias("stays"))
    name = private("_id", docs)
    out = space.save(by_doc.where("not stays").select(F.col("doc_id").alias(name)))
    twice = space.save(by_doc.where("stays and c > 1").select(F.col("doc_id").alias(name)))
    rest = docs.join(small(out, SMALL), id_ == F.col(name), "left_anti")
    if twice.isEmpty():
        return rest
    single = rest.join(small(twice, SMALL), id_ == F.col(name), "left_anti")
    many = docs.join(small(twice, SMALL), id_ == F.col(name), "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # their rows again with the hashes of their sets; rows without a set each stay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field("text") if isinstance(batch.column(0), pa.StructArray) else pa.array([])
            sets = [shingles_of(t.as_py(), k) for t in texts]
            h = [_hash(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in h], pa.int64()) for i in (0, 1)), pa.array([len(s) > 0 for s in sets], pa.bool_())], ["row", "h1", "h2", "some"])

    hashed = space.save(many.mapInArrow(run, many.selectExpr("row", "0L as h1", "0L as h2", "true as some").schema))
    reps = judged.where("rep and n_shingles > 0").select(F.col("doc_id").alias("_d"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    there = hashed.where("some").join(reps, (F.col("row.doc_id").cast("long") == F.col("_d")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    chosen = there.groupBy("_d", "h1", "h2").agg(F.min_by("row", "row.text").alias("row")).select("row")
    return single.union(chosen.union(hashed.where("not some").select("row")).select("row.*"))
