"""Secret scans in DataFrame operations only: base patterns, and character Markov models.

Base spans come from three patterns. The models add spans: two first-order Markov chains over
characters, one of random strings and one of ordinary identifiers, are trained from labelled samples;
a long token whose log-likelihood ratio favours randomness is a secret too, unless a base span
overlaps it.

Positions are code points, end exclusive. They come from splitting a text by the pattern: pieces and
matches alternate, so running lengths give every start. A text that cannot match (a cheap test) is
never split.

Defined results: null and empty texts have no spans. Repeated rows are scanned alike, each on its own.
Texts are scanned whole, in time that grows with their length and their number of spans, not with the
squares. Extra columns of any name pass through ``redact``; ``scan`` returns only its own columns. An empty table gives an
empty result. Samples of one label only give models that find nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
_KEYWORD = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Least lengths: of what is assigned, of an access key, of a hexadecimal run.
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Tokens that the models judge: runs of these characters, with a digit and a letter, of TOKEN_LEAST or more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN_LEAST = 20
#: A token is a secret from this log-likelihood ratio per transition on, in thousandths of a nat.
THRESHOLD = 250

#: Parts of ordinary identifiers.
PARTS = (
    "get set add new old max min sum count total index value name user data file path item list node tree left right first last next prev start end begin "
    "size length width height color style font text line word page table row column field record query result error message status state event handler "
    "request response client server session thread process worker queue task job time date year month day hour build test check load save read write open "
    "close update delete insert remove create find search sort filter map reduce apply merge split join parse format print config option default version "
    "module package import export source target input output buffer stream batch model layer weight image video audio http html json report invoice order"
)


def samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(text, label): ``n`` random strings (label 1) and ``n`` ordinary identifiers (label 0), made by rule."""
    words = F.split(F.lit(PARTS), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    base64 = F.translate(F.base64(F.unhex(digest)), "\r\n", "")
    random = (
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", "")))
        .when(F.col("id") % 4 == 2, F.regexp_replace(base64, "[+/=]", "")).otherwise(base64)
    )
    number = (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(100))).cast("string")
    plain = (
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", pick(1), pick(2), pick(3), pick(4))).when(F.col("id") % 4 == 1, F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)), F.initcap(pick(4)), number))
        .when(F.col("id") % 4 == 2, F.concat_ws("-", pick(1), pick(2), pick(3), number)).otherwise(F.concat_ws("_", F.upper(pick(1)), F.upper(pick(2)), F.upper(pick(3)), number))
    )
    ids = spark.range(n, numPartitions=1)
    return ids.select(random.alias("text"), F.lit(1).alias("label")).union(ids.select(plain.alias("text"), F.lit(0).alias("label")))


def train(labelled: DataFrame, smooth: float = 3.0) -> list[int]:
    """Log-likelihood ratios of all pairs of characters, in thousandths of a nat; index (i - 1) * n + j - 1.

    Transitions are counted in Spark; at most 2 * n * n counts come to the driver.
    """
    n = len(ALPHABET)
    pairs = labelled.where("length(text) > 1").select("label", F.explode(F.expr("transform(sequence(1, length(text) - 1), i -> substring(text, i, 2))")).alias("pair"))
    table = {(r.label, r.pair): r.n for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    if len({label for label, _ in table}) < 2:
        return [-1000] * (n * n)
    out = []
    for a in ALPHABET:
        rows = [[table.get((label, a + b), 0) + smooth for b in ALPHABET] for label in (0, 1)]
        plain, random = ([math.log(x / sum(row)) for x in row] for row in rows)
        out += [round(1000 * (r - p)) for r, p in zip(random, plain)]
    return out


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


FOUND = "array<struct<start:int,kind:int,stop:int,token:string>>"
#: Running sums and maxima go by blocks of so many entries.
BLOCK = 64
#: Texts are cut into stretches of so many characters where parts of them are taken out by place.
STRETCH = 1024


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is reckoned once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, op: str, zero: int) -> str:
    """For each entry of a list of whole numbers the result of ``op`` (of a and x) over those before it.

    A fold that gathers a list would copy it for every entry; so a block's start is reckoned from the blocks
    before, and an entry from the start of its block.
    """
    fold = lambda part, start: f"aggregate({part}, {start}, (a, x) -> {op})"
    block = lambda n: f"slice(vs, cast(b * {BLOCK} + 1 AS int), {n})"
    entries = f"transform(sequence(0, cast(least({BLOCK}, size(vs) - b * {BLOCK}) AS int) - 1), j -> {fold(block('j'), 'element_at(bases, b + 1)')})"
    bases = f"transform(sequence(1, size(sums)), k -> {fold('slice(sums, 1, k - 1)', str(zero))})"
    sums = f"transform(sequence(0, cast((size(vs) - 1) div {BLOCK} AS int)), b -> {fold(block(BLOCK), str(zero))})"
    whole = _let(sums, "sums", _let(bases, "bases", f"flatten(transform(sequence(0, size(sums) - 1), b -> {entries}))"))
    return _let(values, "vs", f"CASE WHEN size(vs) > 0 THEN {whole} ELSE cast(array() AS array<int>) END")


def _locate(df: DataFrame, to: str, pattern: str, gate: str, kind: str, least: int, group: int = 0) -> DataFrame:
    """Adds column ``to``: array of (start, kind number, stop, token) of the matches whose group is long enough; reads _text."""
    p = _quoted(pattern)
    split = {"_piece": f"split(_text, {p}, -1)", "_hit": f"regexp_extract_all(_text, {p}, 0)", "_part": f"regexp_extract_all(_text, {p}, {group})"}
    df = df.withColumns({k: F.expr(f"CASE WHEN {gate} THEN {v} END") for k, v in split.items()})
    lengths = "transform(arrays_zip(_piece, _hit), y -> length(y._piece) + coalesce(length(y._hit), 0))"
    df = df.withColumn("_at", F.expr(f"CASE WHEN size(_hit) > 0 THEN {_running(lengths, 'a + x', 0)} END"))
    start = "x._at + length(x._piece)"
    return df.withColumn(to, F.expr(
        f"""coalesce(transform(filter(arrays_zip(_piece, _hit, _part, _at), x -> x._hit IS NOT NULL AND length(x._part) >= {least}),
              x -> named_struct('start', {start}, 'kind', {KINDS.index(kind) + 1}, 'stop', {start} + length(x._hit), 'token', x._part)), cast(array() AS {FOUND}))"""
    )).drop("_piece", "_hit", "_part", "_at")


def _clear(array: str, other: str) -> str:
    """Those of ``array`` that overlap none of ``other``, both sorted lists of spans."""
    entry = lambda own: f"s -> named_struct('start', s.start, 'own', {own}, 'stop', s.stop, 'kind', s.kind, 'token', s.token)"
    both = f"array_sort(concat(transform({other}, {entry(0)}), transform({array}, {entry(1)})))"
    # no other span before it reaches into it, and none after it starts inside
    reach = _running("transform(es, e -> CASE WHEN e.own = 0 THEN e.stop ELSE 0 END)", "greatest(a, x)", 0)
    onward = f"reverse({_running('transform(reverse(es), e -> CASE WHEN e.own = 0 THEN e.start ELSE 2147483647 END)', 'least(a, x)', 2147483647)})"
    clear = f"filter(arrays_zip(es, {reach}, {onward}), z -> z.es.own = 1 AND z.`1` <= z.es.start AND z.es.stop <= z.`2`)"
    clear = f"transform({clear}, z -> named_struct('start', z.es.start, 'kind', z.es.kind, 'stop', z.es.stop, 'token', z.es.token))"
    return f"CASE WHEN size({array}) = 0 OR size({other}) = 0 THEN {array} ELSE {_let(both, 'es', clear)} END"


def _found(docs: DataFrame, ratios: list[int], threshold: int) -> DataFrame:
    """``docs``, which has the column _text, with _base and _random: sorted arrays of (start, kind number, stop, token)."""
    n = len(ALPHABET)
    # of runs that are taken whole, those of the least length or more are found without the shorter ones
    df = _locate(docs, "_assign", ASSIGN, f"rlike(_text, {_quoted(_KEYWORD)})", "assign", LEAST["assign"], 1)
    df = _locate(df, "_access", f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", "contains(_text, 'AKIA')", "access", LEAST["access"])
    df = _locate(df, "_hex", f"[0-9a-f]{{{LEAST['hex']},}}", f"rlike(_text, '[0-9a-f]{{{LEAST['hex']}}}')", "hex", LEAST["hex"])
    df = _locate(df, "_tokens", f"[A-Za-z0-9+/_=-]{{{TOKEN_LEAST},}}", f"rlike(_text, '[A-Za-z0-9+/_=-]{{{TOKEN_LEAST}}}')", "random", TOKEN_LEAST)
    df = df.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex"))).withColumn("_ratios", F.lit(ratios))
    # a token is split once; the walk over its characters knows the one before
    step = f"struct(instr('{ALPHABET}', c) AS before, acc.sum + CASE WHEN acc.before = 0 THEN 0 ELSE element_at(_ratios, (acc.before - 1) * {n} + instr('{ALPHABET}', c)) END AS sum)"
    score = f"aggregate(split(t.token, ''), struct(0 AS before, 0 AS sum), (acc, c) -> CASE WHEN c = '' THEN acc ELSE {step} END, acc -> acc.sum)"
    likely = f"filter(_tokens, t -> rlike(t.token, '[0-9]') AND rlike(t.token, '[A-Za-z]') AND {score} >= {threshold} * (length(t.token) - 1))"
    df = df.withColumn("_tokens", F.expr(likely))
    return df.withColumn("_random", F.expr(_clear("_tokens", "_base"))).drop("_tokens", "_ratios", "_assign", "_access", "_hex")


def _written(array: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"concat_ws(',', transform({array}, s -> concat(element_at({names}, s.kind), ':', s.start, ':', s.stop)))"


def scan(docs: DataFrame, ratios: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: counts by kind, a hash of the base spans, all spans."""
    found = _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("_text")), ratios, threshold)
    count = lambda kind: F.expr(f"cast(size(filter(_base, s -> s.kind = {KINDS.index(kind) + 1})) AS bigint)").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.size("_random").cast("long").alias("n_random"),
        F.sha2(F.expr(_written("_base")), 256).alias("base_sha256"), F.expr(_written("array_sort(concat(_base, _random))")).alias("spans"),
    )


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def redact(docs: DataFrame, ratios: list[int], mask: str = "[SECRET]", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one); n_chars, if there, follows."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), _text().alias("_text"))
    found = _found(rows, ratios, threshold).withColumn("_all", F.array_sort(F.concat("_base", "_random")))
    found = found.withColumn("_stretch", F.expr(f"CASE WHEN size(_all) > 0 THEN regexp_extract_all(_text, '(?s).{{1,{STRETCH}}}', 0) END"))
    m = _quoted(mask)

    def part(a: str, b: str) -> str:
        """The text from a to b, a < b, from the stretches it lies in."""
        i, j = f"({a} div {STRETCH})", f"(({b} - 1) div {STRETCH})"
        return f"""CASE WHEN {i} = {j} THEN substring(element_at(_stretch, cast({i} + 1 AS int)), cast({a} % {STRETCH} + 1 AS int), cast({b} - {a} AS int))
            ELSE concat(substring(element_at(_stretch, cast({i} + 1 AS int)), cast({a} % {STRETCH} + 1 AS int)), array_join(slice(_stretch, cast({i} + 2 AS int), cast({j} - {i} - 1 AS int)), ''),
              left(element_at(_stretch, cast({j} + 1 AS int)), cast(({b} - 1) % {STRETCH} + 1 AS int))) END"""

    # a span that no earlier one reaches is masked with what overlaps it; what lies before it, from where the last ended, stays
    heads = f"filter(arrays_zip(transform(_all, s -> s.start), {_running('transform(_all, s -> s.stop)', 'greatest(a, x)', 0)}), z -> z.`0` >= z.`1`)"
    kept = f"transform({heads}, z -> concat(CASE WHEN z.`0` > z.`1` THEN {part('z.`1`', 'z.`0`')} ELSE '' END, {m}))"
    found = found.withColumn("_end", F.expr("array_max(transform(_all, s -> s.stop))"))
    clean = F.expr(f"concat(array_join({kept}, ''), CASE WHEN _end < length(_text) THEN {part('_end', 'length(_text)')} ELSE '' END)")
    found = found.select("_row", F.when(F.size("_all") > 0, clean).alias("_clean"))
    new = {"text": F.coalesce("_clean", "_row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_clean").isNotNull(), F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return found.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
