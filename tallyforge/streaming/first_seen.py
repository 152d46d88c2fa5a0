"""Duplicates in a stream by keyed state (an extension): the first arrival of a file and of an invoice is remembered per key.

No batch reads history again: a key's state is one row, found by its key, and survives restarts with the query's checkpoint. A
timer forgets it once the watermark has passed the horizon, so state is bounded by the keys of one horizon.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from tallyforge.functions.scalars import duplicate_key

STATE = StructType([StructField("source_file", StringType()), StructField("arrived", TimestampType())])
OUT = "kind string, key string, source_file string, arrived timestamp, first_file string, first_arrived timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Each row with the first one of its key; rows of a batch count in order of arrival, then of name."""

    def __init__(self, horizon_ms: int):
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # names and times of one key in one micro-batch, whose size the source bounds
        arrivals = sorted((r.arrived, r.source_file or "") for r in rows)
        if not self.first.exists():
            at, name = arrivals[0]
            self.first.update((name, at))
            self.handle.registerTimer(int(at.replace(tzinfo=at.tzinfo or datetime.timezone.utc).timestamp() * 1000) + self.horizon_ms)
        name, at = self.first.get()
        for arrived, source in arrivals:
            yield Row(kind=key[0], key=key[1], source_file=source, arrived=arrived, first_file=name, first_arrived=at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def first_seen(stream: DataFrame, horizon: datetime.timedelta = datetime.timedelta(days=30), delay: str = "1 day") -> DataFrame:
    """(source_file, vendor, invoice_number, file_hash, arrived) -> a row per key of a document, of kinds ``file`` and ``invoice``, with the key's first document.

    A document is a duplicate where ``first_file`` is another. Empty keys are none. What arrives after the watermark is dropped.
    """
    keys = F.array(F.struct(F.lit("file").alias("kind"), F.coalesce("file_hash", F.lit("")).alias("key")), F.struct(F.lit("invoice").alias("kind"), duplicate_key(F.col("vendor"), F.col("invoice_number")).alias("key")))
    keyed = stream.withWatermark("arrived", delay).select("source_file", "arrived", F.explode(keys).alias("k")).select("source_file", "arrived", "k.*").where(F.col("key") != "")
    return keyed.groupBy("kind", "key").transformWithState(FirstSeen(int(horizon.total_seconds() * 1000)), OUT, "Append", "EventTime")
