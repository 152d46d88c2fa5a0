from __future__ import annotations

from tallyforge.functions import tables


def test_lines_of_a_partition_are_told_apart(spark):
    tables.register_tables(spark)
    rows = [("d", 1, "a", 0.0, 10.0), ("d", 1, "b", 12.0, 20.0), ("d", 2, "c", 5.0, 9.0), ("e", 2, "x", 0.0, 4.0), ("e", 2, "w", 6.0, 10.0), ("e", 2, "y", 90.0, 95.0)]
    spark.createDataFrame(rows, "doc_id string, line_no int, text string, x0 double, x1 double").createOrReplaceTempView("placed")
    got = spark.sql("SELECT * FROM tf_cells(TABLE(SELECT * FROM placed) PARTITION BY doc_id ORDER BY (line_no, x0))").collect()
    assert sorted((r["doc_id"], r["line_no"], r["cell_no"], r["text"]) for r in got) == [("d", 1, 0, "a b"), ("d", 2, 0, "c"), ("e", 2, 0, "x w"), ("e", 2, 1, "y")]
