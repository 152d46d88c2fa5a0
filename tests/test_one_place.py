from __future__ import annotations

import re

from tallyforge.operators import tables
from tallyforge.plans import document_queries, table_queries

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    """Exchanges of rows in the plan, without those that send a small table to all."""
    return len(re.findall(r"^[ :+-]*Exchange ", df._jdf.queryExecution().executedPlan().toString(), re.M))


def test_words_of_a_statement_are_dealt_once(spark):
    assert exchanges(document_queries.statements(spark, SF)) == 1


def test_tables_are_read_where_their_words_lie(spark):
    assert exchanges(document_queries.table_read(spark, SF)) == 1
    assert exchanges(table_queries.positional_table(spark, SF)) == 1


def test_pages_of_all_kinds(spark):
    """A header that is carried over, a page before any, a document whose header has nothing below it, words without page."""
    head = [("Description", 50.0), ("Amount", 300.0)]
    pages = {("a", 1): [("early", 50.0, 9.0)], ("a", 2): [(t, x, 10.0) for t, x in head] + [("pen", 50.0, 30.0), ("5", 300.0, 30.0)], ("a", 4): [("ink", 52.0, 10.0), ("7", 290.0, 10.0)], ("b", 1): [(t, x, 10.0) for t, x in head], ("c", 1): [("one", 50.0, 10.0)], ("a", None): [("lost", 50.0, 10.0)]}
    rows = [(d, p, i, t, x, x + 30, y) for (d, p), ws in pages.items() for i, (t, x, y) in enumerate(ws)]
    words = spark.createDataFrame(rows, "doc_id string, page_no int, word_no int, text string, x0 double, x1 double, top double")
    got = [(r["doc_id"], r["row_no"], r["cols"]) for r in tables.read_tables(words).orderBy("doc_id", "row_no").collect()]
    assert got == [
        ("a", 1, {"description": "pen", "amount": "5"}), ("a", 2, {"description": "ink", "amount": "7"}), ("b", 1, {"col_0": "Description", "col_1": "Amount"}),
    ]


def test_a_row_is_dealt_once_a_key(spark):
    """Of the joins of a key the second finds its rows where the first has left them."""
    from tallyforge.operators import checks

    columns = "source_file string, vendor string, invoice_number string, file_hash string"
    new, old = spark.createDataFrame([("n", "V", "1", "h", 1)], f"{columns}, batch_pos long"), spark.createDataFrame([("o", "V", "1", "h", "2025", 1)], f"{columns}, processed_at string, history_seq long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # a key: its rows, their first, their distinct keys, the history
        assert exchanges(checks.check_duplicates(new, old)) == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
