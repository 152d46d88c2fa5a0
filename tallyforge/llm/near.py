"""Links between near-equal sets and their components, for any kind of text item.

1. Each item's shingle set becomes a SetSketch; items of equal sets form a class, which goes on alone.
2. Bands of registers give buckets. Buckets of one class go first, by a count that is summed before the
   shuffle. In every other bucket all members are paired with the least and the greatest id only (two
   stars), so a bucket of k members makes 2k pairs.
3. Register likelihood drops pairs that are surely below the threshold; the rest are verified on the
   full sets, each item's best pair first. What is connected already needs no more pairs.
4. Buckets that still hold more than one component are compared completely, across components only:
   blocks of members meet by their whole sets, and of the links only those that connect come out. Of
   buckets with the same members one is.

So no link between different components is lost beyond the recall of the bands (see ROWS, BANDS), and no
bucket is ever gathered in one task. Sets travel as sorted 64-bit hashes of their elements, made once from
the texts. Tables between the steps are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Workspace, small
from tallyforge.llm.components import components
from tallyforge.llm.sketch import SetSketch, shingles_of

#: Two sets of similarity 0.8 miss all bands with probability (1 - 0.8**5 * 63 / 64)**32 = 4e-6.
ROWS, BANDS = 5, 32
#: Standard errors of the estimate by which a pair may fall short before it is dropped unverified.
SLACK = 4.0
#: Tables of up to so many rows of a few numbers are broadcast (64 bytes each), or of one number; more are joined by a shuffle.
SMALL, SMALL_KEYS = 1_000_000, 2_000_000
#: Members that meet one another at once at most, and the elements that their sets have together on average.
BLOCK, BLOCK_ELEMENTS = 256, 500_000
#: A centre's members are dealt into so many groups.
GROUPS = 64


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class NearLinks:
    """Finds links between items with den * intersection >= num * union of their k-word shingle sets."""

    def __init__(self, space: Workspace, k: int, num: int = 80, den: int = 100, rows: int = ROWS, bands: int = BANDS):
        self.space, self.k, self.num, self.den = space, k, num, den
        self.sketch = SetSketch(rows, bands)
        j = num / den
        self.cut = j - SLACK * (j * (1 - j) / self.sketch.m) ** 0.5

    # -- sketches ---------------------------------------------------------------------------------

    def sketches(self, items: DataFrame) -> DataFrame:
        """(id, text) -> (id, n, h1, h2, regs): size of the set, its 128-bit hash, its registers (null if empty)."""
        k, sketch = self.k, self.sketch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: tuple[int, bytes] | None = None
            for batch in batches:
                out: list[list] = [[], [], [], []]
                for text in batch.column(1):
                    s = shingles_of(text.as_py(), k)
                    h = xxhash.xxh3_128_intdigest(s.tobytes())
                    if last is None or last[0] != h:  # runs of copies are sketched once
                        last = h, sketch.registers(s).tobytes()
                    for column, value in zip(out, (len(s), signed(h >> 64), signed(h & (1 << 64) - 1), last[1] if len(s) else None)):
                        column.append(value)
                kinds = [pa.int64()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], ["id", "n", "h1", "h2", "regs"])

        return items.select("id", "text").mapInArrow(run, "id long, n long, h1 long, h2 long, regs binary")

    # -- candidates -------------------------------------------------------------------------------

    def bands(self, classes: DataFrame) -> DataFrame:
        """(id, regs) -> (band, id), a row for each band."""
        sketch = self.sketch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids = batch.column(0).to_numpy(zero_copy_only=False)
                    regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), sketch.m)
                    keys = sketch.keys(regs)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, sketch.bands))], ["band", "id"])

        return classes.select("id", "regs").mapInArrow(run, "band long, id long")

    def shared(self, bands: DataFrame) -> DataFrame:
        """The different (band, id) of buckets with two ids or more.

        An id sets one bit of 64, chosen by id and band; a bucket of two bits has two ids. Two ids of a
        bucket choose the same bit with probability 1 / 64, in each band anew. The bits of a bucket are
        united before the shuffle, and one number a bucket is all that is shuffled.
        """
        bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(id, band), 64L) as int))")
        often = bands.groupBy(F.col("band").alias("_band")).agg(F.bit_or(bit).alias("bits")).where(F.bit_count("bits") > 1).select("_band")
        often = self.space.save(often)
        full = self.space.save(bands.join(small(often, SMALL_KEYS), F.col("band") == F.col("_band")).select("band", "id").distinct())
        self.space.drop(often)
        return full

    def _likely(self, pairs: DataFrame, classes: DataFrame | None) -> DataFrame:
        """Pairs (a, b) that may be links, with the estimate."""
        sketch, cut, num, den = self.sketch, self.cut, self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                r_a, r_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, sketch.m) for i in (4, 5))
                est = sketch.compare(n_a, r_a, n_b, r_b)
                keep = (est >= cut) & (den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est)], ["a", "b", "est"]).filter(pa.array(keep))

        side = lambda x: classes.select(F.col("id").alias(f"_{x}"), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))
        joined = pairs.join(side("b"), F.col("b") == F.col("_b")).join(side("a"), F.col("a") == F.col("_a"))
        return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long, est double")

    # -- verification -----------------------------------------------------------------------------

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links by their full sets, from ``sets`` (id, s).

        Members meet their centre a in GROUPS groups, so a centre of a million members is no single
        task; a group holds one set at a time besides the centre's. A group comes with one copy of the
        centre's set, and there are never more groups than members.
        """
        num, den = self.num, self.den
        pairs = self.space.save(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(GROUPS)).cast("int").alias("part")))
        one = sets.select(F.col("id").alias("_id"), "s")
        members = pairs.join(one, F.col("b") == F.col("_id")).select("a", "part", F.lit(1).alias("role"), "b", "s")
        centres = pairs.select("a", "part").distinct().join(one, F.col("a") == F.col("_id")).select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "s")
        parts = max(int(self.space.spark.conf.get("spark.sql.shuffle.partitions")), 8)
        together = members.union(centres).repartition(parts, "a", "part").sortWithinPartitions("a", "part", "role")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre = np.zeros(0, np.uint64)
            for batch in batches:
                a, role, b = (batch.column(i).to_pylist() for i in (0, 2, 3))
                out = []
                for x, r, y, packed in zip(a, role, b, batch.column(4)):
                    s = np.frombuffer(packed.as_py(), np.uint64)
                    if r == 0:
                        centre = s
                    else:
                        at = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
                        both = int((centre[at] == s).sum())
                        if den * both >= num * (len(s) + len(centre) - both):
                            out.append((x, y))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        links = self.space.save(together.mapInArrow(run, "a long, b long"))
        self.space.drop(pairs)
        return links

    # -- the whole --------------------------------------------------------------------------------

    def run(self, full: DataFrame, classes: DataFrame | None, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Buckets (band, id) of ``shared`` -> (links (a, b), components (id, comp)).

        ``classes`` (id, n, regs) are for the estimates; ``fetch`` maps (id) to (id, s), one row an id, s
        the non-empty set as its sorted 64-bit hashes. Links within a component are not all looked for;
        between components none is left out.
        """
        save, drop = self.space.save, self.space.drop
        ends = save(full.groupBy(F.col("band").alias("_band")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi"))
        # a pair met in several buckets counts once; its centre is the end that is a centre more surely
        star = full.join(small(ends, SMALL), F.col("band") == F.col("_band")).select("id", F.explode(F.array("lo", "hi")).alias("c")).where("id <> c")
        pairs = star.select(F.least("id", "c").alias("x"), F.greatest("id", "c").alias("y"), "c").groupBy("x", "y").agg(F.min("c").alias("a"))
        pairs = pairs.select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))
        likely = save(self._likely(pairs, classes))
        sets = self._sets(full, likely, fetch)
        best = save(likely.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b"))
        links = self.verify(best, sets)
        comp = components(links, self.space)
        rest = likely.join(best.withColumnsRenamed({"a": "_a", "b": "_b"}), (F.col("b") == F.col("_b")) & (F.col("a") == F.col("_a")), "left_anti")
        more = self.verify(self._across(rest, comp), sets)
        if not more.isEmpty():
            links = save(links.union(more))
            comp = components(links, self.space)
        # buckets that still hold several components
        named = save(full.join(comp.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("band", "id", F.coalesce("comp", "id").alias("comp")))
        open_ = save(self._open(named))
        members = save(named.join(small(open_, SMALL), F.col("band") == F.col("_band")).select("band", "id", "comp"))
        drop(named, likely, best, ends, open_)
        more = save(self._blocks(*self._dealt(members, sets, fetch)))
        if not more.isEmpty():
            links = save(links.union(more))
            comp = components(links, self.space)
        drop(full, sets, members)
        return links, comp

    @staticmethod
    def _open(named: DataFrame) -> DataFrame:
        """(_band) of buckets that hold several components, one of all buckets with the same members.

        Pairs meet in several bands, and what is the same set of members need not be compared again. Members are told by their number
        and 128 bits of their ids' hashes.
        """
        bits = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"_x{seed}") for seed in (0, 1)]
        sums = named.groupBy("band").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_n"), *bits).where("_lo <> _hi")
        return sums.groupBy("_n", "_x0", "_x1").agg(F.min("band").alias("_band")).select("_band")

    @staticmethod
    def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """The pairs whose ends lie in different components."""
        side = lambda x: comp.select(F.col("id").alias(f"_i{x}"), F.col("comp").alias(f"_c{x}"))
        both = pairs.join(side("a"), F.col("a") == F.col("_ia"), "left").join(side("b"), F.col("b") == F.col("_ib"), "left")
        return both.where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")

    def _sets(self, full: DataFrame, likely: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The written sets of all ids that pairs name."""
        ids = self.space.save(likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct())
        return self.space.save(fetch(ids))

    def _dealt(self, members: DataFrame, sets: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(band, id, comp) of open buckets, and the written sets of their members."""
        return members, self.space.save(fetch(self.space.save(members.select("id").distinct())))

    def _blocks(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """(band, id, comp) of open buckets -> links (a < b) that connect what their members' links connect.

        A bucket's members outside its largest component are its odd ones. Blocks of odd members meet all
        blocks by their whole sets; the largest component's members never meet one another. A block has at
        most BLOCK members on average, fewer where sets are large. Of the links between two blocks a
        forest comes out, not all pairs.
        """
        num, den = self.num, self.den
        sized = members.join(sets.select(F.col("id").alias("_id"), (F.length("s") / 8).cast("long").alias("n")), F.col("id") == F.col("_id")).select("band", "id", "comp", "n")
        sizes = sized.groupBy("band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        odd = lambda c: (F.sum(c) - F.max_by(c, F.struct("c", "comp"))).alias(f"_odd_{c}")
        main = lambda c: F.max_by(c, F.struct("c", "comp")).alias(f"_main_{c}")
        largest = self.space.save(sizes.groupBy(F.col("band").alias("_band")).agg(F.max_by("comp", F.struct("c", "comp")).alias("_main"), odd("c"), odd("n"), main("c"), main("n")))
        blocks = lambda x: F.greatest(F.ceil(F.col(f"_{x}_c") / F.lit(BLOCK)), F.ceil(F.col(f"_{x}_n") / F.lit(BLOCK_ELEMENTS))).cast("int")
        rows = members.join(small(largest, SMALL // 2), F.col("band") == F.col("_band")).withColumns({"_odd": blocks("odd"), "_all": blocks("odd") + blocks("main"), "_is_odd": F.col("comp") != F.col("_main")})
        own = F.when(F.col("_is_odd"), F.pmod(F.xxhash64("id"), F.col("_odd"))).otherwise(F.col("_odd") + F.pmod(F.xxhash64("id"), F.col("_all") - F.col("_odd"))).cast("int")
        # an odd block meets itself, later odd blocks and the main ones; a block also is met by earlier odd ones
        meets = F.transform(F.sequence(F.lit(0), F.when(F.col("_is_odd"), F.col("_all")).otherwise(F.col("_odd")) - 1), lambda x: F.struct(F.least(x, F.col("_own")).alias("i"), F.greatest(x, F.col("_own")).alias("j")))
        rows = rows.withColumn("_own", own).select("band", "id", "comp", "_own", F.explode(meets).alias("m")).select("band", "m.i", "m.j", F.col("_own").alias("own"), "id", "comp")
        parts = max(int(self.space.spark.conf.get("spark.sql.shuffle.partitions")), 8)
        rows = rows.join(sets.select(F.col("id").alias("_id"), "s"), F.col("id") == F.col("_id")).select("band", "i", "j", "own", "id", "comp", "s").repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")

        def compare(own: tuple, ids: tuple, comp: tuple, packed: tuple, crossed: bool) -> list[tuple[int, int]]:
            n = np.array([len(s) // 8 for s in packed])
            values, flat = np.unique(np.frombuffer(b"".join(packed), np.uint64), return_inverse=True)
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            own_ = np.array(own)
            root = np.unique(np.array(comp), return_inverse=True)[1]  # members of a component are one from the start
            there = np.zeros(len(values), bool)
            out = []
            for at in range(len(ids) - 1):
                fit = (root[at + 1 :] != root[at]) & (den * np.minimum(n[at + 1 :], n[at]) >= num * np.maximum(n[at + 1 :], n[at]))
                if crossed:
                    fit &= own_[at + 1 :] != own_[at]
                if not fit.any():
                    continue
                mine = flat[starts[at] : starts[at] + n[at]]
                there[mine] = True
                # elements in common with every later member at once
                both = np.add.reduceat(there[flat[starts[at + 1] :]], starts[at + 1 :] - starts[at + 1], dtype=np.int64)
                there[mine] = False
                for x in (np.flatnonzero(fit & (den * both >= num * (n[at + 1 :] + n[at] - both))) + at + 1).tolist():
                    if root[x] != root[at]:
                        out.append((min(ids[at], ids[x]), max(ids[at], ids[x])))
                        root[root == root[x]] = root[at]
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []
            flush = lambda: compare(*zip(*held), key[1] != key[2]) if len(held) > 1 else []
            pack = lambda out: pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])
            for batch in batches:
                out = []
                for band, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if (band, i, j) != key:
                        out += flush()
                        key, held = (band, i, j), []
                    held.append(row)
                yield pack(out)
            yield pack(flush())

        return rows.mapInArrow(run, "a long, b long").distinct()
