from __future__ import annotations

from tallyforge.sources import page_source


def test_texts_are_written_in_place(spark, tmp_path):
    """A file for each row, none of them moved by a commit afterwards; rows of one doc_id stay apart."""
    rows = [(1, "a b\fc"), (1, "again"), (2, None), (34, "x")]
    page_source.write_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id"), f"file://{tmp_path}")
    assert not list(tmp_path.rglob("_SUCCESS")) and len(list(tmp_path.glob("folder=*/doc_id=*.txt"))) == 4
    page_source.register(spark)
    read = spark.read.format("tallyforge_words").option("path", str(tmp_path)).option("suffix", ".txt").load()
    got = read.selectExpr("cast(regexp_extract(doc_id, 'doc_id=([0-9]+)', 1) as long) as d", "page_no", "text").collect()
    assert sorted((r.d, r.page_no, r.text) for r in got) == [(1, 1, "a"), (1, 1, "again"), (1, 1, "b"), (1, 2, "c"), (34, 1, "x")]
