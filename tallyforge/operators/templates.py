"""Reading documents by a template: anchors, values beside them, item tables, as relations.

Templates are rows too. A template (JSON, or a mapping that is checked first) becomes one plan for each of its
variants: an array of field rules and a table rule. Words become lines by a fold; lines meet the plans of their
template; rules that hit a line leave a row; a document's header and items are aggregates of such rows. There is no
Python in the plan, and any number of templates is read by the same plan: the rules are data.

A document is a pair (doc_id, template_id). Words go through one exchange, by that pair. Folds run over the words of
one stretch of a page, not of a document: stretches are cut where no line can go on.

Defined cases. Documents of an unknown template have neither header nor items. Words of equal place are in order of page and
number. Words without text or place are left out. An occurrence that is not there, a label without value, a figure that is no
number give null. Rows without a description (band tables) or without any value (header tables) are left out.
"""

from __future__ import annotations

import json
from graphlib import CycleError, TopologicalSorter
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.sources.readers import shared_folder

RULE = "struct<anchor:string,type:string,occurrence:string,max_words:int,gap:double,nth:int,sum_nth:array<int>,below:string,x_tol:double,before:int>"
COLUMN = "struct<name:string,type:string,header:string,x_min:double,x_max:double>"
TABLE = f"struct<header_anchor:string,header_occurrence:string,end_anchor:string,end_occurrence:string,start_offset:double,end_offset:double,row_tol:double,columns:array<{COLUMN}>,derive_totals:map<string,struct<sum:string,diff:array<string>>>>"
LAYOUT = f"vendor:string,identify:struct<keyword:string>,fields:map<string,{RULE}>,line_items:{TABLE}"
TEMPLATE = f"struct<{LAYOUT},variants:array<struct<{LAYOUT}>>>"

#: Fixed values, in points: words of one line; gaps that end a value beside, below a label; reach left of a label; offsets and rows of a band table.
LINE, GAP, GAP_BELOW, REACH, START, END, ROW = 3.0, 55.0, 30.0, 22.0, 10.0, 8.0, 6.0
FIGURES = ("money", "number")
KEYS = ["doc_id", "template_id"]


class Uses(NamedTuple):
    """What templates make use of; a plan leaves out what none does."""

    below: bool = True
    headers: bool = True
    bands: bool = True
    variants: bool = True

    @classmethod
    def of(cls, templates: dict[str, dict]) -> Uses:
        layouts = [x for t in templates.values() for x in (t, *(t.get("variants") or ()))]
        columns = [c[0] for x in layouts if (c := (x.get("line_items") or {}).get("columns"))]
        return cls(
            any(r.get("below") for x in layouts for r in (x.get("fields") or {}).values()), any("x_min" not in c for c in columns), any("x_min" in c for c in columns), any(t.get("variants") for t in templates.values()),
        )


# -- templates


def checked(template: dict[str, Any]) -> dict[str, Any]:
    """The template with derived totals in an order in which each comes after those it needs.

    A value that is derived from itself by way of others is an error that names them; so are an occurrence below 1 and two columns of
    one name. A difference may name itself: it then means the printed value.
    """

    def layout(x: dict[str, Any]) -> dict[str, Any]:
        rules = x.get("line_items") or {}
        for where, rule, keys in [*((k, v, ("occurrence",)) for k, v in (x.get("fields") or {}).items()), ("line_items", rules, ("header_occurrence", "end_occurrence"))]:
            for key in keys:
                if rule.get(key, 1) != "last" and int(rule.get(key, 1)) < 1:
                    raise ValueError(f"{where}: {key} counts from 1")
        names = [c["name"] for c in rules.get("columns") or []]
        if len(names) != len(set(names)):
            raise ValueError(f"columns of one name: {names}")
        if derived := rules.get("derive_totals"):
            needs = {k: {d for d in how.get("diff", ()) if d in derived and d != k} for k, how in derived.items()}
            try:
                order = list(TopologicalSorter(needs).static_order())
            except CycleError as e:
                raise ValueError(f"derived totals need each other: {' <- '.join(e.args[1])}") from None
            x = x | {"line_items": rules | {"derive_totals": {k: derived[k] for k in order}}}
        return x

    out = layout(template)
    return out | {"variants": [layout(v) for v in out["variants"]]} if out.get("variants") else out


def template_table(spark: SparkSession, templates: dict[str, dict]) -> DataFrame:
    """(template_id, template): checked templates as JSON."""
    return spark.createDataFrame([(k, json.dumps(checked(v))) for k, v in templates.items()], "template_id string, template string")


def _tokens(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), S.norm_label)


def _occurrence(text: Column) -> Column:
    return F.when(text == "last", -1).otherwise(F.coalesce(text.try_cast("int"), F.lit(1)))


def _rule(name: Column, r: Column, no: Column) -> Column:
    below = r["below"].isNotNull() & ~r["below"].isin("", "0", "false")
    kind = F.when(r["sum_nth"].isNotNull() | r["nth"].isNotNull(), "figures").when(below, "below").when(F.coalesce(r["before"], F.lit(0)) != 0, "before").otherwise("right")
    return F.struct(
        no.alias("no"), name.alias("name"), kind.alias("kind"), _tokens(r["anchor"]).alias("anchor"), F.coalesce(r["type"], F.lit("text")).alias("type"), _occurrence(r["occurrence"]).alias("occurrence"),
        r["max_words"].alias("max_words"), F.coalesce(r["gap"], F.when(below, GAP_BELOW).otherwise(GAP)).alias("gap"), r["nth"].alias("nth"), r["sum_nth"].alias("sum_nth"),
        F.when(below, F.coalesce(F.when(r["below"].rlike("^[0-9]+$"), r["below"].cast("int")), F.lit(1))).alias("below"), F.coalesce(r["x_tol"], F.lit(REACH)).alias("x_tol"), r["before"].alias("before"),
    )


def _table_rule(t: Column) -> Column:
    columns = F.transform(t["columns"], lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["type"], F.lit("text")).alias("type"), S.norm_label(F.split(F.trim(c["header"]), r"\s+")[0]).alias("header"), c["x_min"].alias("x_min"), c["x_max"].alias("x_max")))
    derived = F.map_entries(t["derive_totals"])
    return F.when(
        F.size(columns) > 0,
        F.struct(
            F.get(columns, F.lit(0))["x_min"].isNotNull().alias("bands"), _tokens(t["header_anchor"]).alias("header_anchor"), _occurrence(t["header_occurrence"]).alias("header_occurrence"),
            F.coalesce(_tokens(t["end_anchor"]), F.array().cast("array<string>")).alias("end_anchor"), _occurrence(t["end_occurrence"]).alias("end_occurrence"), F.coalesce(t["start_offset"], F.lit(START)).alias("start_offset"),
            F.coalesce(t["end_offset"], F.lit(END)).alias("end_offset"), F.coalesce(t["row_tol"], F.lit(ROW)).alias("row_tol"), columns.alias("columns"),
            F.coalesce(F.concat(F.filter(derived, lambda e: e["value"]["sum"].isNotNull()), F.filter(derived, lambda e: e["value"]["diff"].isNotNull())), derived).alias("derived"),
        ),
    )


def plans(templates: DataFrame) -> DataFrame:
    """(template_id, template JSON) -> (template_id, variant, keyword, vendor, fields, items): a row for each layout of a template.

    A variant lays its own keys over the template's. A template without variants is its only layout.
    """
    t = templates.select("template_id", F.from_json("template", TEMPLATE).alias("t"))
    own = F.struct(F.col("t.vendor").alias("vendor"), F.col("t.identify.keyword").alias("keyword"), F.col("t.fields").alias("fields"), F.col("t.line_items").alias("line_items"))
    layouts = F.when(F.size("t.variants") > 0, F.transform("t.variants", lambda v: F.struct(F.coalesce(v["vendor"], F.col("t.vendor")).alias("vendor"), v["identify"]["keyword"].alias("keyword"), F.coalesce(v["fields"], F.col("t.fields")).alias("fields"), F.coalesce(v["line_items"], F.col("t.line_items")).alias("line_items")))).otherwise(F.array(own))
    rows = t.select("template_id", F.posexplode(layouts).alias("variant", "p"))
    fields = F.coalesce(F.transform(F.map_entries("p.fields"), lambda e, i: _rule(e["key"], e["value"], i)), F.array())
    return rows.select("template_id", "variant", "p.keyword", F.coalesce("p.vendor", F.lit("")).alias("vendor"), fields.alias("fields"), _table_rule(F.col("p.line_items")).alias("items"))


def chosen_variants(words: DataFrame, layouts: DataFrame) -> DataFrame:
    """The layout of each document: the first whose keyword is in its text, else the first."""
    several = layouts.where("variant > 0").select(F.col("template_id").alias("_t")).distinct()
    text = words.join(several, F.col("template_id") == F.col("_t"), "left_semi").groupBy(*KEYS).agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "word_no", "text"))), lambda w: w["text"]), " ")).alias("_text"))
    keywords = layouts.select(F.col("template_id").alias("_t"), F.col("variant").alias("_v"), F.lower("keyword").alias("_k"))
    hits = text.join(keywords, F.col("template_id") == F.col("_t"))
    return hits.groupBy(*KEYS).agg(F.coalesce(F.min(F.when((F.col("_k") != "") & F.contains("_text", "_k"), F.col("_v"))), F.lit(0)).alias("variant"))


# -- lines


def _stretches(words: DataFrame, keys: list[str], height: Column, apart: Column, word: Column, *alike: str) -> DataFrame:
    """Words, sorted, in stretches that end where the next word is further down than ``apart``; (keys, stretch, ws), and columns ``alike`` in all words of the keys."""
    order = Window.partitionBy(*keys).orderBy(height, "x0", "page_no", "word_no")
    cut = words.withColumn("_far", F.when(height - F.lag(height).over(order) > apart, 1).otherwise(0)).withColumn("stretch", F.sum("_far").over(order))
    return cut.groupBy(*keys, "stretch").agg(F.array_sort(F.collect_list(word)).alias("ws"), *(F.first(c).alias(c) for c in alike))


def text_lines(words: DataFrame) -> DataFrame:
    """(doc_id, template_id, line_no, top, ws, names): lines in reading order, words by place with their text, and as labels.

    In order of rounded height a word joins the first line whose first word is within LINE of it, else it begins a line. First words
    are more than LINE apart and come in order, so only the last two lines can take it. A line's height is that of its leftmost word.
    """
    height = F.rint("top")
    word = F.struct(height.alias("h"), "x0", "page_no", "word_no", "x1", "top", "text")
    found = _stretches(words, KEYS, height, F.lit(LINE + 1), word)
    start = F.struct(F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def place(s: Column, w: Column) -> Column:
        at = F.when(F.abs(s["a"] - w["top"]) <= LINE, s["n"] - 2).when(F.abs(s["b"] - w["top"]) <= LINE, s["n"] - 1).otherwise(s["n"])
        new = at == s["n"]
        return F.struct(F.when(new, s["b"]).otherwise(s["a"]).alias("a"), F.when(new, w["top"]).otherwise(s["b"]).alias("b"), (s["n"] + new.cast("int")).alias("n"), F.array_append(s["at"], at).alias("at"))

    found = found.withColumn("_f", F.aggregate("ws", start, place))
    own = lambda k: F.array_sort(F.transform(F.filter("ws", lambda w, i: F.get(F.col("_f.at"), i) == k), lambda w: F.struct(w["x0"].alias("x0"), w["h"].alias("h"), w["page_no"].alias("page_no"), w["word_no"].alias("word_no"), w["x1"].alias("x1"), w["top"].alias("top"), w["text"].alias("text"))))
    lines = found.select(*KEYS, "stretch", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_f.n") - 1), own)).alias("_k", "ws"))
    top = F.col("ws")[0]["top"]
    order = Window.partitionBy(*KEYS).orderBy("top", "stretch", "_k")
    return lines.withColumn("top", top).withColumn("line_no", F.row_number().over(order)).select(*KEYS, "line_no", "top", "ws", F.transform("ws", lambda w: S.norm_label(w["text"])).alias("names"))


def _at(anchor: Column) -> Column:
    """Where the anchor's words first stand in the line, from 0; null if nowhere."""
    n = F.size(anchor)
    places = F.filter(F.sequence(F.lit(0), F.size("names") - n), lambda i: F.slice("names", i + 1, n) == anchor)
    return F.when((n > 0) & (F.size("names") >= n) & F.array_contains("names", F.get(anchor, F.lit(0))), F.get(places, F.lit(0)))


def _first(n: Column, start: int, holds) -> Column:
    """The first of the numbers from ``start`` to below n that holds; null if none."""
    return F.when(n > start, F.get(F.filter(F.sequence(F.lit(start), n - 1), holds), F.lit(0)))


def _said(ws: Column) -> Column:
    return F.trim(F.array_join(F.transform(ws, lambda w: w["text"]), " "))


def _until_gap(ws: Column, gap: Column) -> Column:
    stop = _first(F.size(ws), 1, lambda i: F.get(ws, i)["x0"] - F.get(ws, i - 1)["x1"] > gap)
    return F.slice(ws, F.lit(1), F.coalesce(stop, F.size(ws)))


def convert(text: Column, kind: Column) -> Column:
    """A figure or ISO date as text; other texts as they are."""
    return F.when(kind.isin(*FIGURES), S.to_number(text).cast("string")).when(kind == "date", S.iso_date(text)).otherwise(text)


def _meet(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines with the layouts of their template: all of them, or the one that the lines name as ``variant``."""
    on = F.col("template_id") == F.col("_t")
    if "variant" not in lines.columns:
        return lines.join(rules, on).drop("_t")
    return lines.join(rules.withColumnRenamed("variant", "_v"), on & (F.col("variant") == F.col("_v"))).drop("_t", "_v")


# -- header fields


def header_fields(lines: DataFrame, layouts: DataFrame, below: bool = True) -> DataFrame:
    """(doc_id, template_id, variant, found): the values of the field rules that hit, by name.

    ``below`` says whether any rule reads the lines under its label; these are fetched by a join on the line's number.
    """
    keys = [*KEYS, "variant"]
    rules = layouts.select(F.col("template_id").alias("_t"), "variant", "fields")
    # most lines have the first word of no label
    near = F.filter("fields", lambda f: F.array_contains("names", F.get(f["anchor"], F.lit(0))))
    hits = F.filter(F.transform("_near", lambda f: F.struct(f.alias("f"), _at(f["anchor"]).alias("at"))), lambda x: x["at"].isNotNull())
    df = _meet(lines, rules).withColumn("_near", near).where(F.size("_near") > 0).select(*keys, "line_no", "ws", "names", F.explode(hits).alias("_x")).select(*keys, "line_no", "ws", "names", "_x.*")
    n, behind = F.size("f.anchor"), F.col("at") + F.size("f.anchor")
    rest, labels = F.slice("ws", behind + 1, F.size("ws")), F.slice("names", behind + 1, F.size("ws"))
    # a separator that stands alone is no value
    skip = _first(F.size("_labels"), 0, lambda i: F.get("_labels", i) != "")
    df = df.withColumn("_rest", rest).withColumn("_labels", labels).withColumn("_tail", F.when(skip.isNotNull(), F.slice("_rest", skip + 1, F.size("_rest"))).otherwise(F.slice("_rest", 1, 0)))
    right = F.when(F.col("f.max_words").isNull(), _said(_until_gap(F.col("_tail"), F.col("f.gap")))).otherwise(_said(F.slice("_tail", F.lit(1), F.greatest("f.max_words", F.lit(1)))))
    left = F.greatest(F.col("at") - F.col("f.before"), F.lit(0))
    text = F.when(F.col("f.kind") == "right", right).when(F.col("f.kind") == "before", _said(F.slice("ws", left + 1, F.col("at") - left)))
    figures = F.when(F.col("f.kind") == "figures", F.filter(F.transform("_rest", lambda w: S.to_number(w["text"])), lambda v: v.isNotNull()))
    valid = F.when(F.col("f.kind") == "right", behind < F.size("ws")).when(F.col("f.kind") == "before", F.col("at") > 0).otherwise(True)
    hit = F.struct("line_no", text.alias("text"), figures.alias("figures"), F.when(F.col("f.kind") == "below", F.get("ws", F.col("at"))["x0"] - F.col("f.x_tol")).alias("edge"))
    found = df.where(valid).select(*keys, "f", hit.alias("hit")).groupBy(*keys, "f.no").agg(F.first("f").alias("_f"), F.array_sort(F.collect_list("hit")).alias("hits")).withColumnRenamed("_f", "f")
    # labels below and before take the first hit, whatever the occurrence
    pick = F.try_element_at("hits", F.when(F.col("f.kind").isin("below", "before"), 1).otherwise(F.col("f.occurrence")))
    found = found.select(*keys, "f", pick.alias("h")).where(F.col("h").isNotNull())
    chosen = F.filter(F.transform("f.sum_nth", lambda k: F.when(k > 0, F.get("h.figures", k - 1))), lambda v: v.isNotNull())
    nth = F.when(F.col("f.sum_nth").isNull(), F.when(F.col("f.nth") > 0, F.get("h.figures", F.col("f.nth") - 1))).when(F.size(chosen) > 0, F.round(F.aggregate(chosen, F.lit(0.0), lambda a, v: a + v), 2))
    value = F.when(F.col("f.kind") == "figures", nth.cast("string")).otherwise(F.nullif(convert(F.col("h.text"), F.col("f.type")), F.lit("")))
    out = found.where("f.kind <> 'below'" if below else "true").select(*keys, "f.name", value.alias("value"))
    if below:
        under = lines.select(*(F.col(k).alias(f"_{k}") for k in KEYS), F.col("line_no").alias("_line"), F.col("ws").alias("_ws"))
        want = found.where("f.kind = 'below'").withColumn("_target", F.col("h.line_no") + F.col("f.below"))
        got = want.join(under, (F.col("doc_id") == F.col("_doc_id")) & (F.col("template_id") == F.col("_template_id")) & (F.col("_target") == F.col("_line")))
        got = got.withColumn("_ws", F.filter("_ws", lambda w: w["x0"] >= F.col("h.edge"))).withColumn("_run", _until_gap(F.col("_ws"), F.col("f.gap")))
        most = F.when(F.coalesce("f.max_words", F.lit(0)) > 0, F.col("f.max_words")).otherwise(F.size("_run"))
        said = _said(F.slice("_run", F.lit(1), most))
        out = out.unionByName(got.select(*keys, "f.name", F.nullif(convert(said, F.col("f.type")), F.lit("")).alias("value")))
    return out.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("found"))


# -- item tables


def _bounded(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Lines with their table rule ``t``, its ``head`` and ``end`` (line_no, top) in the document."""
    keys = [*KEYS, "variant"]
    rules = layouts.where(F.col("items").isNotNull()).select(F.col("template_id").alias("_t"), "variant", F.col("items").alias("t"))
    df = _meet(lines, rules)
    whole = Window.partitionBy(*keys)
    place = F.struct("line_no", "top")
    df = df.withColumns({"_heads": F.array_sort(F.collect_list(F.when(_at(F.col("t.header_anchor")).isNotNull(), place)).over(whole)), "_ends": F.array_sort(F.collect_list(F.when(_at(F.col("t.end_anchor")).isNotNull(), place)).over(whole))})
    bands = F.col("t.bands")
    df = df.withColumn("head", F.try_element_at("_heads", F.when(bands, F.col("t.header_occurrence")).otherwise(1))).where(F.col("head").isNotNull())
    later = F.filter("_ends", lambda e: F.when(bands, e["top"] > F.col("head.top")).otherwise(e["line_no"] > F.col("head.line_no")))
    return df.withColumn("end", F.try_element_at(later, F.when(bands, F.col("t.end_occurrence")).otherwise(1))).drop("_heads", "_ends")


def header_rows(bounded: DataFrame) -> DataFrame:
    """(keys, row_no, names, values): rows under a header line, cut at midpoints between the header words found."""
    keys = [*KEYS, "variant"]
    at = F.transform("t.columns", lambda c, i: F.struct(F.get(F.filter("ws", lambda w: S.norm_label(w["text"]) == c["header"]), F.lit(0))["x0"].alias("x0"), i.alias("i")))
    seen = F.when(F.col("line_no") == F.col("head.line_no"), F.array_sort(F.filter(at, lambda p: p["x0"].isNotNull())))
    df = bounded.where("not t.bands").withColumn("places", F.first(seen, ignorenulls=True).over(Window.partitionBy(*keys)))
    df = df.where((F.size("places") > 0) & (F.col("top") > F.col("head.top") + 1) & (F.col("end").isNull() | (F.col("top") < F.col("end.top"))))
    df = df.withColumn("mids", F.transform(F.slice("places", 2, F.size("places")), lambda p, i: (F.get("places", i)["x0"] + p["x0"]) / 2))
    df = df.withColumn("held", F.transform("ws", lambda w: F.struct(w["text"].alias("text"), F.size(F.filter("mids", lambda m: m <= (w["x0"] + w["x1"]) / 2)).alias("k"))))
    kind = lambda p: F.get("t.columns", p["i"])["type"]
    values = F.transform("places", lambda p, k: convert(_said(F.filter("held", lambda w: w["k"] == k)), kind(p)))
    df = df.select(*keys, F.col("line_no").alias("row_no"), F.transform("places", lambda p: F.get("t.columns", p["i"])["name"]).alias("names"), values.alias("values"), F.transform("places", kind).alias("kinds"))
    full = F.exists(F.zip_with("values", "kinds", lambda v, k: F.when(k.isin(*FIGURES), v.try_cast("double") != 0).otherwise(v != "")), lambda x: F.coalesce(x, F.lit(False)))
    return df.where(full).drop("kinds")


def band_rows(bounded: DataFrame, layouts: DataFrame) -> DataFrame:
    """(keys, row_no, names, values): rows of fixed bands. Rows without figures join the nearest row with figures, the upper of two as near.

    A word joins the last row if it is within row_tol of that row's first word. Pieces of a description are joined by spaces, those of other texts without, in order of height.
    """
    keys = [*KEYS, "variant"]
    df = bounded.where("t.bands").select(*keys, "t", "head", "end", F.explode("ws").alias("w")).select(*keys, "t", "head", "end", "w.*")
    df = df.where((F.col("top") > F.col("head.top") + F.col("t.start_offset")) & (F.col("end").isNull() | (F.col("top") < F.col("end.top") - F.col("t.end_offset"))))
    within = lambda x: F.nullif(F.array_position(F.transform("t.columns", lambda c: (c["x_min"] <= x) & (x < c["x_max"])), True), F.lit(0))
    df = df.withColumn("col", F.coalesce(within((F.col("x0") + F.col("x1")) / 2), within(F.col("x0"))).cast("int"))
    # the rule stays behind while words are sorted; it meets the rows again
    df = df.select(*keys, "x0", "page_no", "word_no", "top", "text", "col", F.col("t.row_tol").alias("tol"))
    cut = _stretches(df, keys, F.col("top"), F.col("tol"), F.struct("top", "x0", "page_no", "word_no", "text", "col"), "tol")
    start = F.struct(F.lit(None).cast("double").alias("top"), F.array().cast("array<double>").alias("tops"), F.array().cast("array<int>").alias("at"))

    def place(s: Column, w: Column) -> Column:
        new = s["top"].isNull() | (F.abs(s["top"] - w["top"]) > F.col("tol"))
        tops = F.when(new, F.array_append(s["tops"], w["top"])).otherwise(s["tops"])
        return F.struct(F.when(new, w["top"]).otherwise(s["top"]).alias("top"), tops.alias("tops"), F.array_append(s["at"], F.size(s["tops"]) - 1 + new.cast("int")).alias("at"))

    cut = cut.withColumn("_f", F.aggregate("ws", start, place))
    own = lambda k: F.transform(F.filter("ws", lambda w, i: F.get(F.col("_f.at"), i) == k), lambda w: F.struct(w["text"].alias("text"), w["col"].alias("col")))
    rows = cut.select(*keys, F.explode(F.transform(F.col("_f.tops"), lambda top, k: F.struct(top.alias("top"), own(k).alias("ws")))).alias("r")).select(*keys, "r.*")
    rules = layouts.where("items.bands").select(F.col("template_id").alias("_t"), "variant", F.col("items.columns").alias("columns"))
    cells = F.transform("columns", lambda c, j: _said(F.filter("ws", lambda w: w["col"] == j + 1)))
    rows = _meet(rows, rules).select(*keys, "top", "columns", cells.alias("cells"))
    has = lambda test: F.exists(F.zip_with("columns", "cells", test), lambda x: F.coalesce(x, F.lit(False)))
    rows = rows.withColumn("full", has(lambda c, s: c["type"].isin(*FIGURES) & S.to_number(s).isNotNull())).where(F.col("full") | has(lambda c, s: (c["type"] == "text") & (s != "")))
    down = Window.partitionBy(*keys).orderBy("top")
    own = F.when(F.col("full"), F.col("top"))
    above, below = F.last(own, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)), F.first(own, ignorenulls=True).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"_above": above, "_below": below})
    home = F.when(F.col("_below").isNull() | (F.col("top") - F.col("_above") <= F.col("_below") - F.col("top")), F.col("_above")).otherwise(F.col("_below"))
    rows = rows.withColumn("home", home).where(F.col("home").isNotNull())
    merged = rows.groupBy(*keys, "home").agg(F.first("columns").alias("_c"), F.array_sort(F.collect_list(F.struct("top", "cells"))).alias("parts"), F.max(F.when(F.col("top") == F.col("home"), F.col("cells"))).alias("own")).withColumnRenamed("_c", "columns")
    pieces = lambda j, by: F.array_join(F.filter(F.transform("parts", lambda p: F.get(p["cells"], j)), lambda s: s != ""), by)

    def value(c: Column, j: Column) -> Column:
        return F.when(c["name"] == "description", pieces(j, " ")).when((c["type"] == "text") & (F.size("parts") > 1), pieces(j, "")).otherwise(convert(F.get("own", j), c["type"]))

    names = F.transform("columns", lambda c: c["name"])
    merged = merged.withColumns({"names": names, "values": F.transform("columns", value)})
    said = F.get("values", F.nullif(F.array_position("names", "description"), F.lit(0)).cast("int") - 1)
    order = Window.partitionBy(*keys).orderBy("home")
    return merged.where(F.coalesce(said, F.lit("")) != "").withColumn("row_no", F.row_number().over(order)).select(*keys, "row_no", "names", "values")


def _derived(header: Column, items: Column) -> Column:
    """The header with its sums over items, then its differences, in the given order."""
    figure = lambda name: F.exists("items.columns", lambda c: (c["name"] == name) & c["type"].isin(*FIGURES))
    total = lambda name: F.when(figure(name), F.aggregate(items, F.lit(0.0), lambda a, r: a + F.coalesce(F.try_element_at(r, name).try_cast("double"), F.lit(0.0)))).otherwise(0.0)
    of = lambda m, d, i: F.coalesce(F.try_element_at(m, F.get(d, F.lit(i))).try_cast("double"), F.lit(0.0))

    def put(m: Column, e: Column) -> Column:
        how = e["value"]
        new = F.when(how["sum"].isNotNull(), total(how["sum"])).otherwise(of(m, how["diff"], 0) - of(m, how["diff"], 1))
        return F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], F.round(new, 2).cast("string")))

    return F.when(F.col("items.derived").isNull(), header).otherwise(F.aggregate("items.derived", header, put))


def read_lines(lines: DataFrame, layouts: DataFrame, uses: Uses = Uses()) -> DataFrame:
    """(doc_id, template_id, variant, header map, items array of maps): every layout of a document's template, read.

    Where lines have a ``variant``, only that one is. Lines are read several times: callers give them checkpointed.
    """
    keys = [*KEYS, "variant"]
    bounded = _bounded(lines, layouts)
    parts = [rows for rows, used in ((header_rows(bounded), uses.headers), (band_rows(bounded, layouts), uses.bands)) if used]
    rows = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else header_rows(bounded).where("false")
    tables = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "names", "values"))), lambda r: F.map_from_arrays(r["names"], r["values"])).alias("_items"))
    rules = layouts.withColumnRenamed("template_id", "_t").withColumnRenamed("variant", "_v")
    on = F.col("template_id") == F.col("_t")
    docs = lines.select(*KEYS).distinct().join(rules, on, "left") if "variant" not in lines.columns else lines.select(*keys).distinct().join(rules, on & (F.col("variant") == F.col("_v")), "left").drop("variant")
    docs = docs.withColumn("variant", F.coalesce("_v", F.lit(0))).drop("_t", "_v")
    named = docs.join(header_fields(lines, layouts, uses.below), keys, "left").join(tables, keys, "left")
    items = F.coalesce("_items", F.array().cast("array<map<string,string>>"))
    every = F.map_from_entries(F.concat(F.array(F.struct(F.lit("vendor").alias("key"), F.col("vendor").alias("value"))), F.transform(F.filter("fields", lambda f: f["name"] != "vendor"), lambda f: F.struct(f["name"].alias("key"), F.try_element_at(F.coalesce("found", F.create_map().cast("map<string,string>")), f["name"]).alias("value")))))
    named = named.withColumn("_items", items)
    header = F.when(F.col("vendor").isNull(), F.create_map().cast("map<string,string>")).otherwise(_derived(every, F.col("_items")))
    return named.select(*keys, header.alias("header"), F.col("_items").alias("items"))


def extract_documents(words: DataFrame, templates: dict[str, dict] | DataFrame) -> DataFrame:
    """Words (with template_id) and templates, a mapping or a table (template_id, template JSON) -> header and items of every document."""
    known = isinstance(templates, dict)
    # a mapping is small: were lines dealt by template to meet it, all lines of a template would be one task's
    layouts = F.broadcast(plans(template_table(words.sparkSession, templates))) if known else plans(templates)
    words = words.where(F.col("text").isNotNull() & F.col("x0").isNotNull() & F.col("top").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("template_id").cast("string").alias("template_id"), "page_no", "word_no", "text", "x0", "x1", "top")
    uses = Uses.of(templates) if known else Uses()
    shared_folder(words.sparkSession)
    lines = text_lines(words)
    if uses.variants:
        best = chosen_variants(words, layouts).select(*(F.col(k).alias(f"_{k}") for k in KEYS), F.col("variant").alias("_v"))
        on = (F.col("doc_id") == F.col("_doc_id")) & (F.col("template_id") == F.col("_template_id"))
        lines = lines.join(best, on, "left").withColumn("variant", F.coalesce("_v", F.lit(0))).drop("_doc_id", "_template_id", "_v")
    return read_lines(lines.checkpoint(), layouts, uses).drop("variant")


def to_invoices(extracted: DataFrame) -> DataFrame:
    """Headers as maps -> typed header columns, ``extra`` for other fields, ``lines`` as maps, sums of lines."""
    core = {"vendor": "string", "invoice_number": "string", "invoice_date": "string", "po_number": "string", "subtotal": "double", "tax": "double", "total": "double", "cgst": "double", "sgst": "double", "igst": "double", "taxable_value": "double"}
    amount = lambda line: F.coalesce(*(F.try_element_at(line, F.lit(k)).try_cast("decimal(18,2)") for k in ("amount", "total", "line_total", "total_incl")))
    return extracted.select(
        "doc_id", "template_id", F.col("doc_id").alias("source_file"), *(F.try_element_at("header", F.lit(c)).try_cast(t).alias(c) for c, t in core.items()),
        F.map_filter("header", lambda k, v: ~k.isin(*core)).alias("extra"), F.col("items").alias("lines"), F.size("items").alias("n_lines"),
        F.aggregate("items", F.lit(0).cast("decimal(18,2)"), lambda acc, x: (acc + F.coalesce(amount(x), F.lit(0))).cast("decimal(18,2)")).alias("line_sum"),
    )
