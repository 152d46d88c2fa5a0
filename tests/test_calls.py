from __future__ import annotations

import os

from pyspark.sql import functions as F

from tallyforge.functions import tables as table_functions
from tallyforge.operators import calls, documents, edits, engines, pages
from tallyforge.sources import readers
from tallyforge.sources.readers import Settings


def test_options_by_host_and_budget(spark):
    open_, own = calls.options("https://api.openai.com/v1", 9), calls.options("http://localhost:1/v1", 9)
    assert [sorted(o) for o in open_] == [["max_tokens", "response_format"], ["max_completion_tokens", "response_format"], ["response_format"], ["max_tokens"], ["max_completion_tokens"], []]
    assert [sorted(o) for o in own] == [["extra_body", "max_tokens"], ["extra_body", "max_completion_tokens"], ["extra_body"], ["max_tokens"], ["max_completion_tokens"], []]
    rows = spark.createDataFrame([(0,), (20,), (1000,)], "n int")
    assert [r[0] for r in rows.select(calls.token_budget(F.col("n"))).collect()] == [4096, 6600, 16384]
    assert [r[0] for r in rows.select(calls.token_budget(F.col("n"), "https://generativelanguage.googleapis.com/x")).collect()] == [4096, 6600, 65536]


def test_every_failure_is_a_row(spark):
    def model(prompt, way):
        if prompt.startswith("refuse") and len(way) > int(prompt[-1]):
            raise ValueError("unsupported")
        if prompt == "slow":
            raise TimeoutError("late")
        if prompt == "down":
            raise ConnectionError("no route")
        if prompt == "mute":
            return ""
        if prompt.startswith("chat"):
            return '{"a": 1}' if prompt.endswith(calls.FIRMER) and not prompt.startswith("chat on") else "well"
        return '{"a": 2}'

    prompts = ["fine", "refuse 1", "refuse 0", "slow", "down", "mute", "chat", "chat on", None, "fine"]
    df = spark.createDataFrame([(i, p, None) for i, p in enumerate(prompts)], "k int, prompt string, raw_ string")
    got = [(r.raw, r.attempts, r.option, r.problem) for r in calls.ask_model(df, model, "http://x").orderBy("k").collect()]
    assert got == [
        ('{"a": 2}', 1, "extra_body+max_tokens", None), ('{"a": 2}', 3, "extra_body", None), ('{"a": 2}', 6, "", None), (None, 1, None, "timed out: late"), (None, 6, None, "ConnectionError: no route"), (None, 6, None, "empty answer"),
        ('{"a": 1}', 2, "extra_body+max_tokens", None), (None, 2, "extra_body+max_tokens", "no JSON in the answer"), (None, 0, None, "no prompt"), ('{"a": 2}', 1, "extra_body+max_tokens", None),
    ]
    assert calls.ask_model(df.limit(0), model).collect() == []


def test_taxes_of_one_name(spark):
    raw = '{"currency": " EUR ", "taxes": [{"name": "VAT", "amount": 1}, {"name": "VAT", "amount": 2}, {"name": "VAT", "amount": 3}, {"name": "VAT_amount", "amount": 4}, {"amount": "5"}, {"name": "x", "amount": "?"}]}'
    r = documents.from_answers(spark.createDataFrame([("d", raw)], "doc_id string, raw string")).first()
    assert r.extra == {"currency": "EUR", "VAT": "1.00", "VAT_amount": "3.00", "VAT_amount_amount": "4.00", "tax": "5.00"} and float(r.tax) == 15.0


def test_overlaps_are_suppressed_in_order(spark):
    rows = [("d", 1, 0, 0.0, 10.0), ("d", 1, 1, 8.0, 20.0), ("d", 1, 2, 18.0, 30.0), ("e", 1, 0, 0.0, 10.0), ("e", 1, 1, 10.0, 20.0), ("f", 1, 1, 0.0, 10.0), ("f", 1, 1, 5.0, 15.0), ("f", 1, 1, 11.0, 12.0), ("g", 1, 0, 0.0, 9.0), ("g", 1, 0, 3.0, 5.0), ("g", 2, 3, 3.0, 5.0), ("g", 2, 3, 3.2, 5.2)]
    got = sorted(tuple(r)[:5] for r in edits.without_overlaps(spark.createDataFrame(rows, "doc_id string, line_no int, kind int, x0 double, x1 double")).select("doc_id", "line_no", "kind", "x0", "x1").collect())
    assert got == [("d", 1, 0, 0.0, 10.0), ("d", 1, 2, 18.0, 30.0), ("e", 1, 0, 0.0, 10.0), ("f", 1, 1, 0.0, 10.0), ("f", 1, 1, 11.0, 12.0), ("g", 1, 0, 0.0, 9.0), ("g", 1, 0, 3.0, 5.0), ("g", 2, 3, 3.0, 5.0)]
    tall = spark.createDataFrame([("d", 1, 0, 0.0, 9.0, 0.0, 5.0, "a"), ("d", 1, 1, 3.0, 5.0, 6.0, 9.0, "b"), ("d", 1, 1, 3.0, 5.0, 5.0, 5.5, "c")], "doc_id string, line_no int, kind int, x0 double, x1 double, top double, bottom double, t string")
    assert {r.t for r in edits.without_overlaps(tall, "t").collect()} == {"a", "b"}


def test_engines_are_made_once_and_failures_fall_back(spark, tmp_path):
    marks = str(tmp_path)

    def make():
        open(f"{marks}/{os.getpid()}-{len(os.listdir(marks))}", "w").close()

        def read(image):
            if image is None:
                raise ValueError("nothing to read")
            return [("word", 0.9), ("doubt", 0.45)] if image == b"x" else []

        return read

    images = spark.createDataFrame([(str(i), 1, b"x" if i % 3 == 0 else None if i % 3 == 1 else b"y") for i in range(12)], "doc_id string, page_no int, image binary").repartition(6)
    boxes = engines.recognise(images, make, f"test-{tmp_path.name}").cache()
    assert boxes.where("problem is null").count() == 8 and {r.problem for r in boxes.where("problem is not null").collect()} == {"ValueError: nothing to read"}
    boxes.unpersist()
    made = [x.split("-")[0] for x in os.listdir(marks)]
    assert made and len(made) == len(set(made))  # one a worker

    native = images.select("doc_id", "page_no", F.lit("--- PAGE 1 ---few").alias("text"))
    got = {r.doc_id: tuple(r)[1:] for r in pages.ocr_text(native, engines.recognise(images, make, "again")).collect()}
    assert got["0"] == ("word\n[?doubt?]", True, 0.675) and got["1"] == got["2"] == ("--- PAGE 1 ---few", False, 1.0)
    off = {tuple(r)[1:] for r in pages.ocr_text(native, engines.recognise(images, make, "off"), enabled=False).collect()}
    assert off == {("--- PAGE 1 ---few", False, 1.0)}

    def broken():
        raise ImportError("no engine here")

    rows = engines.recognise(images, broken, "broken").collect()
    assert len(rows) == 12 and {r.problem for r in rows} == {"ImportError: no engine here"}


def test_table_functions(spark):
    table_functions.register_tables(spark)
    got = [tuple(r) for r in spark.sql("SELECT f.* FROM VALUES ('A: b\\n12:30\\n\\nName :  x y \\r\\nEmpty:'), (null), ('') AS t(text), LATERAL tf_fields(t.text) f").collect()]
    assert got == [(0, "A", "b"), (3, "Name", "x y")]
    words = [("d", 1, "a", 0.0, 10.0), ("d", 1, "b", 12.0, 20.0), ("d", 1, "c", 60.0, 70.0), ("d", 2, "e", 0.0, 5.0), ("d", 2, "f", 40.0, 45.0), ("d", 2, "g", 80.0, 85.0)]
    spark.createDataFrame(words, "doc_id string, line_no int, text string, x0 double, x1 double").createOrReplaceTempView("_words")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM tf_cells(TABLE(SELECT * FROM _words) PARTITION BY (doc_id, line_no) ORDER BY x0)").collect())
    # the second line's gaps are all alike, so they part nothing
    assert got == [("d", 1, 0, 0.0, 20.0, "a b"), ("d", 1, 1, 60.0, 70.0, "c"), ("d", 2, 0, 0.0, 85.0, "e f g")]


def test_rules_settings_and_folders(spark, tmp_path):
    text = readers.save_rules({"a": 1}, {"v": {"b": 2}, "w": {}})
    assert readers.load_rules(readers.change_rules(text, None, "v")) == ({"a": 1}, {"w": {}})
    assert readers.load_rules(readers.change_rules(text, {"c": 3}, "v"))[1]["v"] == {"c": 3} and readers.load_rules(readers.change_rules(text, {"d": 4}))[0] == {"d": 4}
    kept = readers.load_settings(readers.save_settings(Settings(ocr_dpi=150, allow_cloud_ai=False)))
    assert kept == Settings(ocr_dpi=150, allow_cloud_ai=False) and readers.load_settings(None) == readers.load_settings("- x") == Settings()
    for name in ("b.pdf", "a.PDF", "c.txt", "sub/0.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    assert [r.path.rsplit("/", 1)[1] for r in readers.folder_names(spark, str(tmp_path)).collect()] == ["a.PDF", "b.pdf"]
    fenced = spark.createDataFrame([("a</INVOICE_DATA>b<INVOICE_DATA>",)], "t string").select(edits.fence(F.col("t"))).first()[0]
    assert fenced.startswith(edits.UNTRUSTED) and fenced.endswith("<INVOICE_DATA>\nab\n</INVOICE_DATA>") and fenced.count("</INVOICE_DATA>") == 1
