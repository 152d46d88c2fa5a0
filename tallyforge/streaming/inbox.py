"""Streams of documents (an extension): every micro-batch is checked against what earlier ones appended.

``foreachBatch`` gives a batch its number; a batch that is run again after a failure finds its rows in the ledger,
and sees only what came before it, so history counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.checks import check_duplicates, validate
from tallyforge.sinks.files import HISTORY
from tallyforge.sinks.ledger import Ledger

INCOMING = "source_file string, vendor string, invoice_number string, invoice_date string, subtotal double, tax double, total double, line_sum double, n_lines int, file_hash string, arrived timestamp"


def read_inbox(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """A folder of JSON lines as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", per_batch).json(path)


def process_batch(batch: DataFrame, number: int, history: str, out: str) -> None:
    """Validates a batch, marks its duplicates against history, writes results, appends to history."""
    spark = batch.sparkSession
    ledger, first = Ledger(spark, history, HISTORY), number * 10_000_000_000
    placed = batch.withColumn("batch_pos", F.row_number().over(Window.orderBy("arrived", "source_file")).cast("long"))
    done = validate(check_duplicates(placed, ledger.read().where(F.col("history_seq") < first)))
    done.write.mode("overwrite").parquet(f"{out}/batch={number}")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = done.select(
        (F.col("batch_pos") + F.lit(first)).alias("history_seq"), F.date_format("arrived", "yyyy-MM-dd HH:mm:ss").alias("processed_at"), "source_file", "vendor",
        text("invoice_number"), text("invoice_date"), text("total"), text("file_hash"), F.when(F.col("validation_ok"), "OK").otherwise("REVIEW").alias("status"),
    )
    ledger.append(rows, f"{number:010d}")


def start(stream: DataFrame, history: str, out: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: process_batch(df, n, history, out)).start()


def distinct_files(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops files seen within the watermark, with bounded state."""
    return stream.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["file_hash"])


def hourly_counts(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Documents and sums by vendor and hour of arrival; late rows count until the watermark passes."""
    return stream.withWatermark("arrived", delay).groupBy(F.window("arrived", "1 hour"), "vendor").agg(F.count("*").alias("n"), F.sum("total").alias("total"))
