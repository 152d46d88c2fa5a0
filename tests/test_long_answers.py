"""Answers are unwrapped in time that grows with their length; figures are taken as before."""

import time

from pyspark.sql import functions as F

from tallyforge.functions import jsonfix
from tallyforge.functions import scalars as S


def test_long_white_space_in_an_answer_takes_no_square_time(spark):
    raw = '```json\n{"a": "x' + " " * 300_000 + 'y"}\n```'
    df = spark.createDataFrame([(raw,)], "raw string")
    began = time.perf_counter()
    (row,) = jsonfix.parse_json(df, "raw").collect()
    assert time.perf_counter() - began < 60
    assert row.json == raw[8:-4]


def test_unwrapping_takes_what_it_took(spark):
    texts = ["```\n{1}```", "``````", "````", "a````", " \t```json {2} ```\n", "<think>x</think> {3}", "<think>x", "```x``` ", "x\u000b", "", None]
    old = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    s = old(F.regexp_replace(old(F.regexp_replace("t", r"(?s)<think>.*?</think>", "")), r"^```[a-zA-Z]*\n?|```$", ""))
    was = F.when(F.locate("{", s) > 0, F.substring(s, F.locate("{", s), F.length(s))).otherwise(s)
    rows = jsonfix.unwrapped(spark.createDataFrame([(t,) for t in texts], "t string").withColumn("was", was), "t", "now").collect()
    assert [r.now for r in rows] == [r.was for r in rows]


def test_numbers_are_what_the_cast_says(spark):
    texts = ["", ".", "-", "1.", ".5", "-.5", "a1b.2c", "1-2", "--1", "- 1", "x", "1.2.3", "-a.b5-", "\n7\n", "Rs 1,234.50", "9\n-", ". 5", "5 .", None]
    was = F.regexp_replace("t", r"[^0-9.\-]", "").try_cast("double")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.to_number(F.col("t")).alias("now"), was.alias("was")).collect()
    assert [r.now for r in rows] == [r.was for r in rows]
