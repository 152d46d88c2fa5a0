"""Table functions for SQL: fields of a text by ``LATERAL``, cells of lines by ``PARTITION BY``.

    SELECT d.doc_id, f.* FROM documents d, LATERAL tf_fields(d.text) f
    SELECT * FROM tf_cells(TABLE(SELECT doc_id, line_no, text, x0, x1 FROM words) PARTITION BY doc_id ORDER BY (line_no, x0))

``tf_fields`` is a SQL function that the optimizer unfolds: nothing of it runs in Python. ``tf_cells`` sees the words of a document, or
of a line, in order and holds one line at a time; by document it is started a few times less often than by line.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

#: Points that part cells at least, and times the least gap of the line.
FIELD, TIMES = 14.0, 3.0

FIELDS = r"""
CREATE OR REPLACE TEMPORARY FUNCTION tf_fields(text STRING) RETURNS TABLE(line_no INT, label STRING, value STRING)
RETURN SELECT line_no, trim(regexp_extract(line, r'^([^:]{1,60}):\s*(.*\S)\s*$', 1)), regexp_extract(line, r'^([^:]{1,60}):\s*(.*\S)\s*$', 2)
FROM (SELECT posexplode(split(tf_fields.text, r'\r\n|\r|\n')) AS (line_no, line)) WHERE line RLIKE r'^[^:]{0,59}\p{L}[^:]{0,59}:\s*\S'
"""


@udtf(returnType="doc_id string, line_no int, cell_no int, x0 double, x1 double, text string")
class Cells:
    """The words of each line, in order, as cells that end at wide gaps: three times the line's least gap, 14 points at least."""

    def __init__(self):
        self.words: list[tuple[str, float, float]] = []
        self.key: tuple[str, int] | None = None
        self.at: list[int] = []

    def eval(self, row: Row) -> Iterator[tuple]:
        # a row finds a name by a search in Python, so places are looked up once a partition
        self.at = self.at or [row.__fields__.index(c) for c in ("doc_id", "line_no", "text", "x0", "x1")]
        values = tuple(row)
        doc_id, line_no, text, x0, x1 = [values[i] for i in self.at]
        key = str(doc_id), line_no
        if key != self.key:
            yield from self.terminate()
            self.key, self.words = key, []
        self.words.append((text or "", x0, x1))

    def terminate(self) -> Iterator[tuple]:
        if self.key is None:
            return
        gaps = [b[1] - a[2] for a, b in zip(self.words, self.words[1:])]
        wide = max(FIELD, TIMES * min((g for g in gaps if g > 0), default=2.0))
        start, cell = 0, 0
        for i, gap in enumerate([*gaps, float("inf")]):
            if gap > wide:
                own = self.words[start : i + 1]
                yield *self.key, cell, min(w[1] for w in own), max(w[2] for w in own), " ".join(w[0] for w in own)
                start, cell = i + 1, cell + 1


def register_tables(spark: SparkSession) -> None:
    spark.sql(FIELDS)
    spark.udtf.register("tf_cells", Cells)
