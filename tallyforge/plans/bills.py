"""The canonical bills: one invoice per order and supplier, from the star schema.

Amounts are decimals. So that every branch of the checks is met, some bills are made to lack a field or
to be off, by rules on their key that the SQL versions state too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: doc_id, order and supplier key, pos, amounts. Only the needed columns are read."""
    li = table(spark, sf_dir, "lineitem")
    price, disc = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    amount = F.round(price * (1 - disc), 2).cast("decimal(18,2)")
    return li.select(
        F.concat(F.lit("INV-"), F.col("l_orderkey"), F.lit("-"), F.col("l_suppkey")).alias("doc_id"), "l_orderkey", "l_suppkey", "l_partkey", F.col("l_linenumber").alias("pos"),
        F.col("l_quantity").alias("quantity"), price.alias("price"), amount.alias("amount"), F.round(amount * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(18,2)").alias("tax_amount"),
        F.round(F.col("l_tax") * 100, 0).alias("tax_rate"),
    )


#: Suppliers up to this number, a name each, are sent to every executor; beyond it the join shuffles.
FEW = 1_000_000


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per bill. Few lines share order and supplier, so there is little to sum beforehand: narrow lines go to their order, once."""
    lines = bill_lines(spark, sf_dir).select("l_orderkey", "l_suppkey", "amount", "tax_amount", "tax_rate").repartition("l_orderkey")
    return lines.groupBy("l_orderkey", "l_suppkey").agg(
        F.sum("amount").cast("decimal(18,2)").alias("line_sum"), F.sum("tax_amount").cast("decimal(18,2)").alias("tax_sum"), F.count("*").alias("n_lines"),
        F.max("tax_rate").alias("max_rate"), F.min("tax_rate").alias("min_rate"),
    )


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders meet their customers first, then lie where their lines are: whole bills are never shuffled."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    supplier = F.broadcast(supplier) if supplier.count() <= FEW else supplier  # counted from the files' footers
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    k = F.col("l_orderkey") + F.col("l_suppkey")
    lack = lambda n, c: F.when(k % n != 0, c)
    total = F.col("line_sum") + F.col("tax_sum")
    doc = F.concat(F.lit("INV-"), F.col("l_orderkey"), F.lit("-"), F.col("l_suppkey"))
    return (
        totals(spark, sf_dir).join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("doc_id", doc)
        .select(
            "doc_id", "l_orderkey", "l_suppkey", F.concat("doc_id", F.lit(".pdf")).alias("source_file"), F.col("s_name").alias("vendor"), lack(13, F.col("doc_id")).alias("invoice_number"),
            lack(17, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("invoice_date"), F.col("c_name").alias("bill_to"), "n_lines", "line_sum", "tax_sum", "min_rate", "max_rate",
            lack(23, F.col("line_sum")).alias("subtotal"), lack(3, F.col("tax_sum")).alias("tax"),
            lack(19, F.when(k % 5 == 0, total + F.lit("0.50").cast("decimal(18,2)")).otherwise(total)).cast("decimal(18,2)").alias("total"),
        )
    )
