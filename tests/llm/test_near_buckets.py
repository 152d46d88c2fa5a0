from __future__ import annotations

from tallyforge.llm.near import NearLinks


def test_equal_buckets_are_compared_once(spark):
    """Two bands with the members 1, 2; one with 1, 2, 3; one within a component; one with other members."""
    rows = [(10, 1, 1), (10, 2, 2), (20, 2, 2), (20, 1, 1), (30, 1, 1), (30, 2, 2), (30, 3, 3), (40, 4, 4), (40, 5, 4), (50, 2, 2), (50, 3, 3)]
    got = NearLinks._open(spark.createDataFrame(rows, "band long, id long, comp long"))
    assert sorted(r[0] for r in got.collect()) == [10, 30, 50]
