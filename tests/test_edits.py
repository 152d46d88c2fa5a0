from __future__ import annotations

import pytest

from tallyforge.functions.register import register
from tallyforge.operators import edits


def test_sql_functions(spark):
    assert len(register(spark)) == 14
    r = spark.sql("SELECT tf_to_number('INV-1001') a, tf_amounts('x 1,000.50') b, tf_slugify(' A b! ') c, tf_is_summary_row('Grand Total') d, tf_duplicate_key('V ', ' N 1') e, tf_scrub('Bearer abc') f, tf_last_figure('a 1,2 b 3') g, tf_strip_doubt('[?x?]') h").first()
    assert tuple(r) == (-1001.0, [1000.5], "a_b", True, "v|n1", "[REDACTED]", "3", "x")


def test_edits_override(spark):
    inv = spark.createDataFrame([("a", "V", 1.0), ("b", "W", 2.0), ("c", "X", 3.0)], "doc_id string, vendor string, total double")
    e = spark.createDataFrame([("a", "", "5.5"), ("b", "New", "abc")], "doc_id string, vendor string, total string")
    assert sorted(map(tuple, edits.apply_edits(inv, e).collect())) == [("a", None, 5.5), ("b", "New", None), ("c", "X", 3.0)]


def test_picks_labels_and_overlaps(spark):
    boxes = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 2, 50.0, 0.0, 60.0, 10.0)], "doc_id string, box_id int, x0 double, top double, x1 double, bottom double")
    clicks = spark.createDataFrame([("d", 1, 5.0, 5.0), ("d", 2, 40.0, 5.0), ("d", 3, 500.0, 5.0)], "doc_id string, click_id int, x double, y double")
    assert {r.click_id: r.box_id for r in edits.pick_boxes(clicks, boxes).collect()} == {1: 1, 2: 2}
    words = spark.createDataFrame([("d", 0, 200.0, "Date"), ("d", 1, 10.0, "Total"), ("d", 1, 30.0, "due")], "doc_id string, line_no int, x0 double, text string")
    values = spark.createDataFrame([("d", 1, 1, 100.0), ("d", 2, 2, 210.0)], "doc_id string, value_id int, line_no int, x0 double")
    assert {r.value_id: r.label for r in edits.labels_for(values, words).collect()} == {1: "Total due", 2: "Date"}
    c = spark.createDataFrame([("d", 1, 0, 0.0, 10.0), ("d", 1, 1, 5.0, 20.0), ("d", 1, 1, 11.0, 20.0), ("d", 1, 2, 11.2, 19.9)], "doc_id string, line_no int, kind int, x0 double, x1 double")
    assert [(r.kind, r.x0) for r in edits.without_overlaps(c).orderBy("x0").collect()] == [(0, 0.0), (1, 11.0)]


def test_templates_from_clicks_and_paths():
    columns = edits.columns_from_clicks([("amount", 400.0), ("description", 50.0)])
    assert columns == [{"name": "description", "type": "text", "x_min": 20.0, "x_max": 225.0}, {"name": "amount", "type": "money", "x_min": 225.0, "x_max": 600.0}]
    assert "keyword: Acme" in edits.to_yaml(edits.build_template("A", "Acme", {"invoice_date": {"anchor": "Date"}}))
    assert edits.under("/out", "../../etc/x\\y.csv") == "/out/x_y.csv"
    with pytest.raises(ValueError):
        edits.under("/out", "a/..")


def test_prompt_texts(spark):
    rows = spark.createDataFrame([("d", 1, ["a\nb", None]), ("d", 2, ["", " "]), ("d", 3, ["c", "d"])], "doc_id string, row_no int, cells array<string>")
    assert edits.table_text(rows).first().table_text == "a b | \nc | d"
    hint = edits.hint_text(spark.createDataFrame([("d", 1, {"x": "1", "y": "2"})], "doc_id string, row_no int, cols map<string,string>")).first().hint
    assert hint.endswith("x | y\n" + "-" * 60 + "\n1 | 2")
