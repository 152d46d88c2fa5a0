"""Repair of conversation structure: the cheapest edits that make the turns of a conversation alternate.

A repaired conversation has the role initials ``(s?(ua)+)?``. Four states say where a prefix of it ends: nothing
yet, after the system turn, after a user turn, after an answer. Flags come from windows; the turns of a
conversation, without their texts, are folded by ``aggregate`` over these states, each a struct (cost, edits). Struct
comparison takes the cheaper one, and of equally cheap ones the ASCII-least edits. That is exact although the fold
compares prefixes: of two prefixes of the same rows and cost, none is the beginning of the other (the longer would
have further inserts, which cost), so what follows never turns their order.

Edits are carried as letters that also name the role: D delete, I / J insert a user / an assistant turn, K keep,
R / S make it a user / an assistant turn. Their order is that of the audit letters D I K R, and equal audits of the
same rows are equal edits.

Defined cases. Null roles, texts and turns are one space in keys; null roles and texts are one space afterwards, a
null turn comes first. Rows of the same turn are in order of role and text; rows that are equal may be swapped. An
empty role or one with another initial can't be kept, only changed or deleted. A null ``conv_id`` is a conversation
of its own. An empty table has no conversations. Other columns are ignored. A conversation is one row of the result,
its audit has a letter a turn: the fold holds one conversation's flags, the final step its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits; a truncated turn that stays costs one more. Inserts must cost something.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The cost of what can't be reached: more than any conversation's edits.
_NEVER = 1 << 60
_STATES = ("start", "system", "user", "answer")
_ANY = r"[^\x20\x09-\x0D]"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults of known kinds, by the checksum of ``conv_id:turn``, and ``gone``.

    0 drops a row (``gone``, so that the conversation is still known), 1 empties its text, 2 removes its sentence ends, 3 repeats
    it, 4 gives it to the user. Nulls are one space, but for a null turn or conversation, which stay null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    df = rows.select("conv_id", "turn", "role", "text", kind.alias("_kind")).select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), "_kind")
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select("conv_id", "turn", "role", "text", (F.col("_kind") == 0).alias("gone"), F.explode(times).alias("_copy")).drop("_copy")


def flagged(rows: DataFrame) -> DataFrame:
    """Rows with ``pos`` (their place in the conversation), ``fault`` (blank, duplicate, truncated or null) and ``illegal``.

    All windows are dealt by conversation alone, by one exchange.
    """
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    turns = Window.partitionBy("conv_id", "gone").orderBy(*order)
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    df = rows.repartition("conv_id").withColumn("_again", F.row_number().over(same) > 1).withColumn("pos", F.row_number().over(turns))
    before = F.lag(F.left("role", F.lit(1))).over(turns)
    illegal = before.isNotNull() & ~F.concat(before, F.left("role", F.lit(1))).isin("su", "ua", "au")
    fault = F.when(~F.col("text").rlike(_ANY), "blank").when(F.col("_again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return df.withColumn("illegal", illegal).withColumn("fault", fault).drop("_again")


def _step(state: Column, turn: Column) -> Column:
    """The four states after a turn, before inserts."""
    extra = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    may = ~F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False))
    to = lambda s, cost, letter: F.struct((state[s]["cost"] + cost).cast("long").alias("cost"), F.concat(state[s]["edits"], F.lit(letter)).alias("edits"))
    drop = {s: to(s, DELETE, "D") for s in _STATES}

    def enter(new: str, role: str, letter: str, olds: tuple[str, ...]) -> Column:
        here = turn["role"] == role
        ways = [to(s, F.when(here, extra).otherwise(extra + REROLE), "") for s in olds]
        best = F.least(*ways) if len(ways) > 1 else ways[0]
        taken = F.struct(best["cost"].alias("cost"), F.concat(best["edits"], F.when(here, "K").otherwise(letter)).alias("edits"))
        return F.when(may, F.least(drop[new], taken)).otherwise(drop[new])

    keep_s = F.when(may & (turn["role"] == "s"), F.least(drop["system"], to("start", extra, "K"))).otherwise(drop["system"])
    return F.struct(
        drop["start"].alias("start"), keep_s.alias("system"), enter("user", "u", "R", ("start", "system", "answer")).alias("user"), enter("answer", "a", "S", ("user",)).alias("answer")
    )


def _inserts(state: Column) -> Column:
    """The four states once turns may be inserted behind."""
    to = lambda s, letters: F.struct((s["cost"] + INSERT * len(letters)).cast("long").alias("cost"), F.concat(s["edits"], F.lit(letters)).alias("edits"))
    user = F.least(state["user"], *(to(state[s], "I") for s in ("start", "system", "answer")))
    answer = F.least(state["answer"], to(state["user"], "J"), *(to(state[s], "IJ") for s in ("start", "system")))
    return F.struct(state["start"].alias("start"), state["system"].alias("system"), user.alias("user"), answer.alias("answer"))


def _bind(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text[, gone]) -> one row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    ``repaired`` is the array of (role, text) after the cheapest edits, ``audit`` their letters in order. Rows marked
    ``gone`` are no turns, but keep their conversation in the result.
    """
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = flagged(rows.select("conv_id", "turn", said("role"), said("text"), "gone"))
    live = ~F.col("gone")
    count = lambda what: F.count(F.when(live & what, 1))
    turn = F.when(live, F.col("turn"))
    by = turns.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"),
        *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), count(F.col("illegal")).alias("illegal"),
        F.array_sort(F.collect_list(F.when(live, F.struct("pos", "role", "text", "fault")))).alias("turns"),
    )
    never = F.struct(F.lit(_NEVER).alias("cost"), F.lit("").alias("edits"))
    first = F.struct(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("edits")).alias("start"), *(never.alias(s) for s in _STATES[1:]))
    slim = F.transform("turns", lambda t: F.struct(F.left(t["role"], F.lit(1)).alias("role"), t["fault"].alias("fault")))
    end = F.aggregate(slim, _inserts(first), lambda s, t: _bind(_step(s, t), _inserts), lambda s: F.least(s["start"], s["answer"]))
    by = by.withColumn("_end", end)
    # what stands before a row, and the row's own letter; what is left at the end are inserts
    steps = F.regexp_extract_all("_end.edits", F.lit("[IJ]*[DKRS]"), F.lit(0))
    made = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.struct(F.when(c == "I", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    letter = lambda s: F.right(s, F.lit(1))
    own = lambda t, s: F.when(letter(s) == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(
        F.array(F.struct(F.when(letter(s) == "K", t["role"]).when(letter(s) == "R", "user").otherwise("assistant").alias("role"), t["text"].alias("text")))
    )
    inside = F.flatten(F.zip_with("turns", steps, lambda t, s: F.concat(made(F.regexp_replace(s, "[DKRS]", "")), own(t, s))))
    repaired = F.concat(inside, made(F.regexp_extract("_end.edits", "([IJ]*)$", 1)))
    return by.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("_end.cost").alias("cost"), F.translate("_end.edits", "JS", "IR").alias("audit"), repaired.alias("repaired"))


def op11(rows: DataFrame) -> DataFrame:
    """The damaged conversations, repaired; the repaired turns as a hash of their ``role:text`` lines."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repair(damage(rows)).withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")
