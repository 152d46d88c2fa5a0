"""URL filters: rules of host and path first, then gradient-boosted trees on lexical features.

The trees are trained on the driver from a bounded table of labelled URLs and compiled into one SQL
expression, so judging needs neither Python nor a shuffle. The tables here carry no labels of URLs;
without a table of labels of one's own, ``samples`` makes labelled URLs by rule: readable addresses,
and addresses of trackers, adverts and generated spam.

Defined results: a null url or one without ``://`` has an empty host and path, meets no rule and gets
the trees' verdict on empty features. Of rules of the same length that fit, the first by text wins.
Repeated rows are judged alike. Urls are judged whole, of any length. Extra columns of any name pass through
``keep_urls``; ``judge`` returns only its own.
An empty table gives an empty result. Labels of one class give that class's verdict throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host and path). A host stands for itself and its subdomains.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: So many rules are part of the expression; more are joined by host.
MOST_RULES = 500
#: Labelled URLs that the trees are fitted on, chosen by a hash of the URL.
TRAIN_URLS = 20_000
TREES, DEPTH, RATE, CUTS = 40, 3, 0.2, 32
#: Suffixes whose share of blocked URLs is a feature; the rest counts as unknown.
MOST_SUFFIXES = 200

NAMES = ("length", "host_length", "labels", "depth", "longest_part", "digits", "entropy", "params", "hyphens", "upper", "escapes", "suffix")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, query."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.:]*)(?::[0-9]*)?$", 1)


def features(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds _host, _path and the lexical features _f_<name> other than the suffix statistic."""
    host, path, query = parts(F.col(url))
    df = df.withColumns({"_u": F.coalesce(F.col(url), F.lit("")), "_host": host, "_path": path, "_query": query})
    df = df.withColumn("_chars", F.split("_u", ""))
    size = F.greatest(F.length("_u"), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count("_u", F.lit(pattern))
    letters = F.array_distinct("_chars")
    n = F.col("_n")
    df = df.withColumns({"_n": size, "_suffix": suffix(F.col("_host"))})
    # Shannon entropy of the characters, in bits
    entropy = -F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + F.when(F.length(c) > 0, (F.length("_u") - F.length(F.replace(F.col("_u"), c, F.lit("")))) / n * F.log2((F.length("_u") - F.length(F.replace(F.col("_u"), c, F.lit("")))) / n)).otherwise(F.lit(0.0)))
    return df.withColumns({
        "_f_length": F.length("_u").cast("double"), "_f_host_length": F.length("_host").cast("double"), "_f_labels": F.size(F.split("_host", "[.]")).cast("double"),
        "_f_depth": F.regexp_count("_path", F.lit("/[^/]")).cast("double"), "_f_longest_part": F.array_max(F.transform(F.split("_u", "[^A-Za-z0-9]"), F.length)).cast("double"),
        "_f_digits": count("[0-9]") / n, "_f_entropy": entropy,
        "_f_params": F.when(F.length("_query") > 0, F.regexp_count("_query", F.lit("&")) + 1).otherwise(F.lit(0)).cast("double"),
        "_f_hyphens": F.regexp_count("_host", F.lit("-")).cast("double"), "_f_upper": count("[A-Z]") / n, "_f_escapes": count("%[0-9A-Fa-f]{2}").cast("double"),
    }).drop("_chars", "_n", "_u", "_query")


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(url, blocked): ``n`` URLs of each class, made by rule from row numbers."""
    pick = lambda k, *options: F.element_at(F.array(*(F.lit(x) for x in options)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(options))) + 1).cast("int"))
    word = lambda k: pick(k, "river", "garden", "report", "north", "music", "paper", "window", "travel", "market", "winter", "school", "health", "letter", "stone", "energy", "forest")
    lang = lambda k: pick(k, "en", "de", "fr", "es", "it", "news", "blog", "docs")
    number = F.pmod(F.xxhash64("id", F.lit(50)), F.lit(90000)).cast("string")
    noise = F.sha2(F.col("id").cast("string"), 256)
    tld = lambda k: pick(k, "com", "net", "org", "com", "de", "io")
    good = F.concat(
        pick(1, "https://", "http://"), pick(2, "", "www.", "blog.", "m."), word(3), pick(4, "", word(5)), pick(6, "", ".example"), F.lit("."), tld(7), F.lit("/"), lang(8), F.lit("/"),
        pick(9, number, F.concat(word(10), F.lit("-"), word(11)), F.concat(word(12), F.lit("/"), number)), pick(13, "", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed", "?id=7"),
    )
    bad = F.concat(
        pick(21, "https://", "http://"), pick(22, "ads.", "track.", "click-", "m.ads-", "go-"), pick(23, "ads-track", "best-deals", "win-now", "click-count", "free-cash", "ad-server"), pick(24, "", number), pick(25, "", ".example"), F.lit("."), tld(27),
        pick(28, "/", "/en/", "/c/", "/redirect/"), pick(29, number, F.substring(noise, 1, 24), F.concat(F.substring(noise, 9, 16), F.lit("/"), F.substring(noise, 30, 12))),
        pick(30, "", F.concat(F.lit("?sid="), F.substring(noise, 3, 32), F.lit("&clk="), number, F.lit("&aff=9&sub=1&z="), F.substring(noise, 40, 8)), F.concat(F.lit("?u=http%3A%2F%2F"), word(31), F.lit("%2F&r="), number, F.lit("&k=1&v=2"))),
    )
    ids = spark.range(n, numPartitions=1)
    return ids.select(good.alias("url"), F.lit(0).alias("blocked")).union(ids.select(bad.alias("url"), F.lit(1).alias("blocked")))


@dataclass
class Trees:
    prior: float
    trees: list[tuple]  # a tree: a leaf's value, or (feature, cut, left, right); left holds values <= cut
    suffixes: dict[str, float]
    unknown: float


def _grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple | float:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf = float(RATE * total_g / (total_h + 1.0))
    best = (1e-6, 0, 0)
    if depth and len(rows) >= 20:
        for f in range(bins.shape[1]):
            gs = np.cumsum(np.bincount(bins[rows, f], g[rows], CUTS + 1))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, f], h[rows], CUTS + 1))[:-1]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            at = int(gain[: len(edges[f])].argmax()) if len(edges[f]) else 0
            if len(edges[f]) and gain[at] > best[0]:
                best = (float(gain[at]), f, at)
    if best[0] <= 1e-6:
        return leaf
    _, f, at = best
    low = bins[rows, f] <= at
    if low.all() or not low.any():
        return leaf
    return f, float(edges[f][at]), _grow(bins, edges, g, h, rows[low], depth - 1), _grow(bins, edges, g, h, rows[~low], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Log-odds of the whole and trees that follow the gradient of the logistic loss."""
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return (20.0 if share else -20.0), []
    prior = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(x.shape[1])], 1)
    score, trees = np.full(len(y), prior), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(bins, edges, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
        trees.append(tree)
        score += _value(tree, x)
    return prior, trees


def train(labelled: DataFrame, limit: int = TRAIN_URLS) -> Trees:
    """Fit on at most ``limit`` rows of (url, blocked)."""
    rows = features(labelled.select("url", "blocked").where("url is not null and blocked is not null").orderBy(F.xxhash64("url"), "url", "blocked").limit(limit)).collect()
    seen: dict[str, list[int]] = {}
    for r in rows:
        at = seen.setdefault(r._suffix, [0, 0])
        at[0] += r.blocked
        at[1] += 1
    overall = sum(a for a, _ in seen.values()) / max(len(rows), 1)
    rate = lambda a, n: (a + 5 * overall) / (n + 5)
    top = sorted(seen, key=lambda s: (-seen[s][1], s))[:MOST_SUFFIXES]
    suffixes = {s: rate(*seen[s]) for s in top}
    # a row does not see its own label in its suffix's share
    own = [rate(seen[r._suffix][0] - r.blocked, seen[r._suffix][1] - 1) if r._suffix in suffixes else overall for r in rows]
    x = np.array([[*(r[f"_f_{n}"] for n in NAMES[:-1]), s] for r, s in zip(rows, own)], float).reshape(len(rows), len(NAMES))
    return Trees(*boost(x, np.array([r.blocked for r in rows], float)), suffixes, overall)


def _sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"CASE WHEN _f_{NAMES[tree[0]]} <= {tree[1]!r}D THEN {_sql(tree[2])} ELSE {_sql(tree[3])} END"


def score(df: DataFrame, model: Trees) -> DataFrame:
    """Adds _score, the log-odds that a URL is to be blocked, to the output of ``features``."""
    known = F.create_map(*(F.lit(x) for kv in model.suffixes.items() for x in kv)) if model.suffixes else F.create_map().cast("map<string,double>")
    df = df.withColumn("_f_suffix", F.coalesce(F.try_element_at(known, F.col("_suffix")), F.lit(model.unknown)))
    return df.withColumn("_score", F.expr(" + ".join([f"{model.prior!r}D", *(f"({_sql(t)})" for t in model.trees)])))


def rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds _rule to the output of ``features``.

    Many rules meet the different hosts, by all their parent domains; a host comes back with its own rules,
    the longest first, and each row picks the first that its path fits.
    """
    if len(rules) <= MOST_RULES:
        return df.withColumn("_rule", rule(F.col("_host"), F.col("_path"), rules))
    spark = df.sparkSession
    known = spark.createDataFrame([(t.partition("/")[0], -len(t), t, "/" + t.partition("/")[2], v) for v, t in rules], "name string, less int, rule string, path string, verdict string")
    labels = F.split("_h", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = (
        df.select(F.col("_host").alias("_h")).distinct().select("_h", F.explode(parents).alias("_p")).join(known, F.col("_p") == F.col("name"))
        .groupBy("_h").agg(F.array_sort(F.collect_list(F.struct("less", "rule", "path", "verdict"))).alias("_own"))
    )
    fits = F.filter("_own", lambda r: F.startswith(F.col("_path"), r["path"]))
    best = F.try_element_at(fits, F.lit(1))
    found = F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))
    return df.join(own, F.col("_host") == F.col("_h"), "left").withColumn("_rule", found).drop("_h", "_own")


def judge(pages: DataFrame, model: Trees, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, score."""
    df = with_rule(score(features(pages.select(F.col("page_id").cast("long").alias("page_id"), "url")), model), rules)
    learned = F.when(F.col("_score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", learned).alias("verdict"), (1 / (1 + F.exp(-F.col("_score")))).alias("score"))


def keep_urls(pages: DataFrame, model: Trees, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """The rows of ``pages`` that are not blocked, with all their columns."""
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_row"), "url")
    df = with_rule(score(features(rows), model), rules)
    return df.where(F.coalesce(F.col("_rule.verdict") == "allow", F.col("_score") <= 0)).select("_row.*")
