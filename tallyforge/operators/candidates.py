"""Field candidates: what on a page may be a value, with the label that says so.

Set-oriented over lines (see ``templates.text_lines``): each way of pairing labels and values is an expression over the words of
a line, or of a line and the two above. Ways come in an order, and a candidate that overlaps a kept one of an earlier way is left out.

Defined cases: a label with a colon and nothing behind it is a candidate without a value, beside the label. A line without words
has no candidates. Of equal boxes of a line the first way's is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators.edits import without_overlaps

#: How dates and identifiers look; in points: gaps that part fields, cells, labels from values, runs of values; reach of a label above.
DATEISH = r"(?i)^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?)$"
IDISH = r"^(?=.*\d)[A-Za-z0-9][A-Za-z0-9\-/_.]{3,}$"
FIELD, TIMES, CELL, PARTED, NEAR, REACH = 14.0, 3.0, 18.0, 4.0, 12.0, 40.0
COLON, GAP, MONEY, VALUE = 0, 1, 2, 3


def is_money(text: Column) -> Column:
    """An amount that is written as one: with a fraction, groups or a currency sign."""
    return S.is_amount(text) & text.rlike(r"[.,₹$€£]")


def said(ws: Column) -> Column:
    return F.array_join(F.transform(ws, lambda w: w["text"]), " ")


def label(ws: Column) -> Column:
    return F.trim(F.regexp_replace(said(ws), ":+$", ""))


def looks_like_value(ws: Column) -> Column:
    """Six words at most, one of which is money, a date or an identifier; or an address of mail."""
    one = F.exists(ws, lambda w: is_money(w["text"]) | w["text"].rlike(DATEISH) | w["text"].rlike(IDISH))
    return F.size(ws).between(1, 6) & (one | (F.contains(said(ws), F.lit("@")) & F.contains(said(ws), F.lit("."))))


def looks_like_label(ws: Column) -> Column:
    """Four words at most, of three letters or more, most of it letters."""
    text = F.regexp_replace(F.trim(said(ws)), ":+$", "")
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return F.size(ws).between(1, 4) & (F.length(text) >= 3) & (letters >= F.greatest(F.lit(3), F.floor(F.length(text) * 0.6)))


def gaps(ws: Column) -> Column:
    """The distances between neighbouring words."""
    return F.transform(F.slice(ws, 2, F.size(ws)), lambda w, i: w["x0"] - F.get(ws, i)["x1"])


def adaptive_gap(ws: Column) -> Column:
    """What parts fields on this line: three times the least gap between its words, 14 points at least."""
    return F.greatest(F.lit(FIELD), TIMES * F.coalesce(F.array_min(F.filter(gaps(ws), lambda g: g > 0)), F.lit(2.0)))


def runs(ws: Column, cut) -> Column:
    """Words in runs; ``cut`` says of a gap whether it ends one."""
    starts = F.concat(F.array(F.lit(0)), F.filter(F.transform(gaps(ws), lambda g, i: F.when(cut(g), i + 1)), lambda i: i.isNotNull()))
    return F.when(F.size(ws) > 0, F.transform(starts, lambda s, k: F.slice(ws, s + 1, F.coalesce(F.get(starts, k + 1), F.size(ws)) - s))).otherwise(F.array(ws))


def _candidate(kind: int, anchor: Column, value: Column, x0: Column, x1: Column, nth=None, gap=None, below=None) -> Column:
    n = lambda x, t: (F.lit(None) if x is None else x).cast(t)
    return F.struct(
        F.lit(kind).alias("kind"), anchor.alias("anchor"), F.trim(value).alias("value"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"),
        n(nth, "int").alias("nth"), n(gap, "double").alias("gap"), n(below, "int").alias("below"),
    )


def _boxed(kind: int, anchor: Column, ws: Column, **more: Column) -> Column:
    return _candidate(kind, anchor, said(ws), F.array_min(F.transform(ws, lambda w: w["x0"])), F.array_max(F.transform(ws, lambda w: w["x1"])), **more)


def colon_segments(chunks: Column) -> Column:
    """``Label: value`` in a chunk of a line; a label that ends its chunk takes the next chunk, which then is no label."""
    colon = lambda c: F.array_position(F.transform(c, lambda w: F.endswith(w["text"], F.lit(":"))), True).cast("int")
    bare = lambda i: (colon(F.get(chunks, i)) == F.size(F.get(chunks, i))) & (i + 1 < F.size(chunks))

    def walk(s: Column, i: Column) -> Column:
        open_ = ~s["skip"] & (colon(F.get(chunks, i)) > 0)
        return F.struct((open_ & bare(i)).alias("skip"), F.when(open_, F.array_append(s["at"], i)).otherwise(s["at"]).alias("at"))

    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<int>").alias("at"))
    at = F.aggregate(F.sequence(F.lit(0), F.size(chunks) - 1), start, walk)["at"]

    def one(i: Column) -> Column:
        c, last = F.get(chunks, i), i + 1 >= F.size(chunks)
        own = F.slice(c, colon(c) + 1, F.size(c))
        ws = F.when((F.size(own) == 0) & ~last, F.get(chunks, i + 1)).otherwise(own)
        end = F.element_at(c, colon(c))
        brk = F.get(F.get(chunks, i + 1), F.lit(0))["x0"] - F.element_at(c, -1)["x1"]
        gap = F.when(~last, F.bround((F.coalesce(F.array_max(gaps(ws)), F.lit(2.0)) + brk) / 2, 0))
        x0 = F.coalesce(F.array_min(F.transform(ws, lambda w: w["x0"])), end["x1"] + 2)
        x1 = F.coalesce(F.array_max(F.transform(ws, lambda w: w["x1"])), end["x1"] + 60)
        return _candidate(COLON, label(F.slice(c, F.lit(1), colon(c))), said(ws), x0, x1, gap=gap)

    return F.filter(F.transform(at, one), lambda c: c["anchor"] != "")


def gap_segments(cells: Column) -> Column:
    """A label and a value that the widest gap of a cell parts."""
    widest = lambda c: F.array_position(gaps(c), F.array_max(gaps(c))).cast("int")
    wide = F.filter(cells, lambda c: (F.size(c) > 1) & (F.array_max(gaps(c)) >= PARTED))
    parted = F.transform(wide, lambda c: F.struct(F.slice(c, F.lit(1), widest(c)).alias("a"), F.slice(c, widest(c) + 1, F.size(c)).alias("b")))
    fits = F.filter(parted, lambda p: looks_like_label(p["a"]) & looks_like_value(p["b"]))
    return F.transform(fits, lambda p: _boxed(GAP, label(p["a"]), p["b"], gap=F.bround(F.coalesce(F.array_max(gaps(p["b"])), F.lit(2.0)) + 3, 0)))


def money_on_line(ws: Column) -> Column:
    """Every amount of a line that begins with words, with its place among the figures behind them."""
    first = F.array_position(F.transform(ws, lambda w: is_money(w["text"])), True).cast("int")
    rest = F.filter(F.slice(ws, first, F.size(ws)), lambda w: S.to_number(w["text"]).isNotNull())
    amounts = F.filter(F.transform(rest, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: is_money(x["w"]["text"]))
    anchor = label(F.slice(ws, F.lit(1), first - 1))
    none = F.slice(F.transform(ws, lambda w: _candidate(MONEY, w["text"], w["text"], w["x0"], w["x1"], nth=F.lit(1))), 1, 0)
    return F.when((first > 1) & (anchor != ""), F.transform(amounts, lambda x: _candidate(MONEY, anchor, x["w"]["text"], x["w"]["x0"], x["w"]["x1"], nth=x["i"] + 1))).otherwise(none)


def value_groups(ws: Column, above: Column, further: Column) -> Column:
    """Runs that look like values, with the label left of them, or else above them on one of two lines."""
    groups = F.filter(runs(ws, lambda g: g >= NEAR), looks_like_value)

    def one(g: Column) -> Column:
        x0 = F.array_min(F.transform(g, lambda w: w["x0"]))
        left = F.filter(ws, lambda w: w["x1"] <= x0 + 1)
        left = F.slice(left, F.greatest(F.size(left) - 3, F.lit(1)), F.lit(4))
        over = lambda line: F.filter(line, lambda w: F.abs(w["x0"] - x0) < REACH)
        up = lambda line: F.when(looks_like_label(over(line)), F.nullif(label(over(line)), F.lit("")))
        beside = F.when(looks_like_label(left), F.nullif(label(left), F.lit("")))
        anchor = F.coalesce(beside, up(above), up(further))
        return _boxed(VALUE, anchor, g, below=F.when(beside.isNull(), 1))

    return F.filter(F.transform(groups, one), lambda c: c["anchor"].isNotNull())


def field_candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, ws) -> (doc_id, line_no, kind, x0, x1, anchor, value, nth, gap, below, is_money), in order of ways and places."""
    down = Window.partitionBy("doc_id").orderBy("line_no")
    df = lines.select("doc_id", "line_no", "ws", F.lag("ws", 1).over(down).alias("_a"), F.lag("ws", 2).over(down).alias("_b")).where(F.size("ws") > 0)
    ws = F.col("ws")
    df = df.withColumn("_gap", adaptive_gap(ws)).withColumn("_chunks", runs(ws, lambda g: g > F.col("_gap"))).withColumn("_cells", runs(ws, lambda g: g > CELL))
    every = F.concat(colon_segments(F.col("_chunks")), gap_segments(F.col("_cells")), money_on_line(ws), value_groups(ws, F.col("_a"), F.col("_b")))
    found = df.select("doc_id", "line_no", F.explode(every).alias("_c")).select("doc_id", "line_no", "_c.*")
    kept = without_overlaps(found, "anchor", "value", "nth", "gap", "below")
    return kept.withColumn("is_money", (F.col("kind") == MONEY) | ((F.col("kind") == VALUE) & F.exists(F.split("value", " "), is_money)))
