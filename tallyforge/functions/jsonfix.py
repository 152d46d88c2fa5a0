"""Lenient JSON: valid text is parsed by Spark; only what fails is read by a tolerant reader in Python.

The reader takes one value from the beginning of the text and keeps whatever it has when the text ends or
stops making sense: an open string counts as said, a key without a value does not, missing and surplus
commas do not matter, what follows the value, or is nested deeper than DEPTH, is ignored. It goes once over the text and needs no recursion.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Fixed value: what white space is to a pattern.
SPACE = " \t\n\x0b\f\r"


def unwrapped(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds ``to``: the object inside thinking marks, prose and code fences.

    Each step reads the one before once: a filter that Spark moves below them would else repeat them many times over.
    """
    strip = lambda c: F.btrim(c, F.lit(SPACE))
    s = F.regexp_extract(strip(F.regexp_replace(column, r"(?s)<think>.*?</think>", "")), r"(?s)^(?:```[a-zA-Z]*\n?)?(.*)", 1)
    return df.withColumn(to, F.regexp_replace(strip(F.regexp_replace(s, "```$", "")), r"^[^{]*+(?=\{)", ""))


_LEXEME = re.compile(r'\s*(?:(?P<mark>[{}\[\]:,])|"(?P<string>(?:[^"\\]|\\.)*)(?P<closed>"?)|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>true|false|null)\b)', re.S)
_NAMES = {"true": True, "false": False, "null": None}
_NOTHING = object()
#: Nesting beyond this depth is not read.
DEPTH = 500


def _string(body: str) -> str:
    try:
        return json.loads(f'"{body}"', strict=False)
    except ValueError:  # an escape that means nothing
        return body.replace("\\", "")


class _Reader:
    """Containers that are open, innermost last; a key waits beside its object."""

    def __init__(self) -> None:
        self.open: list[Any] = []
        self.keys: list[Any] = []
        self.value: Any = _NOTHING

    def put(self, value: Any) -> None:
        """A value, or in an object without a waiting key, the key."""
        if not self.open:
            self.value = value
        elif isinstance(self.open[-1], list):
            self.open[-1].append(value)
        elif self.keys[-1] is _NOTHING:
            self.keys[-1] = value if isinstance(value, str) else str(value)
        else:
            self.open[-1][self.keys[-1]] = value
            self.keys[-1] = _NOTHING

    def enter(self, container: Any) -> bool:
        if self.open and isinstance(self.open[-1], dict) and self.keys[-1] is _NOTHING:
            return False  # a container is no key
        if len(self.open) >= DEPTH:
            return False
        self.put(container)
        self.open.append(container)
        self.keys.append(_NOTHING)
        return True

    def leave(self, kind: type) -> bool:
        """Closes the innermost container of this kind, with those in it that were left open."""
        if not any(isinstance(c, kind) for c in self.open):
            return False
        while True:
            self.keys.pop()
            if isinstance(self.open.pop(), kind):
                return True

    def read(self, text: str) -> Any:
        at = 0
        while (m := _LEXEME.match(text, at)) is not None:
            at, mark = m.end(), m.group("mark")
            if mark in ("{", "["):
                if not self.enter({} if mark == "{" else []):
                    break
            elif mark in ("}", "]"):
                if not self.leave(dict if mark == "}" else list):
                    break
            elif mark is None:
                key = bool(self.open) and isinstance(self.open[-1], dict) and self.keys[-1] is _NOTHING
                if m.group("string") is not None:
                    if key and not m.group("closed"):
                        break
                    self.put(_string(m.group("string")))
                elif key:
                    break  # keys are strings
                elif m.group("number") is not None:
                    self.put(json.loads(m.group("number")) if not re.match(r"-?0\d", m.group("number")) else float(m.group("number")))
                else:
                    self.put(_NAMES[m.group("name")])
            elif not self.open:
                break
            if not self.open and self.value is not _NOTHING:
                break
        return self.value


def repair(text: str | None) -> str | None:
    """JSON text of what can be read from the beginning, or null."""
    value = _Reader().read(text) if text else _NOTHING
    return None if value is _NOTHING else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair)


def parse_json(df: DataFrame, column: str, to: str = "json") -> DataFrame:
    """Adds ``to``: valid JSON text or null. Of rows that Spark can parse, Python sees a null only; the input is computed once.

    Spark's parser passes over what follows the value, so texts where something may follow are read again.
    """
    df = unwrapped(df, column, "_raw")
    good = F.coalesce(F.try_parse_json("_raw").isNotNull() & ~F.col("_raw").rlike(r"[}\]]\s*[^\s,}\]]"), F.lit(False))
    df = df.withColumn("_bad", F.when(~good, F.col("_raw")))
    return df.withColumn(to, F.coalesce(_repaired("_bad"), F.when(F.col("_bad").isNull(), F.col("_raw")))).drop("_raw", "_bad")
