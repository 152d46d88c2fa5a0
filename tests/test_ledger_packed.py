from __future__ import annotations

import glob

import pyarrow.parquet as pq

from tallyforge.sinks.ledger import Ledger


def test_entries_are_packed_closely(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), "id long")
    for k in range(2):
        assert ledger.append(spark.range(9), f"b{k}")
    ledger.compact()
    found = glob.glob(f"{tmp_path}/merged=*/*.parquet")
    assert found and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in found if pq.ParquetFile(f).metadata.num_row_groups} == {"ZSTD"}
    assert ledger.read().count() == 18
