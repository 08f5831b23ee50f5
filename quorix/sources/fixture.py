"""Transactions made from the star-schema tables, as a service would receive them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorix import ship
from quorix.functions.scalar import quantize

CODES = ["5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "0000", "abcd"]
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the customer's and supplier's balances, the count of the day before (_n) and the time of the one before (_last).

    The windows have one order, so rows are sorted once.
    """
    e, c, s = (table(spark, sf_dir, n) for n in ("events", "customer", "supplier"))
    day = F.expr("count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row)")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select("event_id", "ts", "user_id", "event_type", "value").withColumn("_last", F.lag("ts").over(order)).withColumn("_n", day - 1)
    return rows.join(c.select("c_custkey", "c_acctbal"), F.col("c_custkey") == F.col("user_id")).join(s.select("s_suppkey", "s_acctbal"), F.col("s_suppkey") == F.col("event_id") % 10)


def payloads(rows: DataFrame) -> DataFrame:
    """Payload columns with tx_id and fraud, from purchases."""
    i, f = F.col("event_id"), "float"
    last = F.struct(F.date_format("_last", ISO).alias("timestamp"), ((i * 53) % 1200).cast(f).alias("km_from_current"))
    return rows.select(
        i.alias("tx_id"), i.cast("string").alias("id"),
        F.struct((F.col("value") * 30).cast(f).alias("amount"), (1 + i % 14).cast(f).alias("installments"), F.date_format("ts", ISO).alias("requested_at")).alias("transaction"),
        F.struct((F.col("c_acctbal") / 10).cast(f).alias("avg_amount"), F.col("_n").cast(f).alias("tx_count_24h"), F.array(*[(k * 5 + F.col("user_id") % 5).cast("string") for k in range(10)]).alias("known_merchants")).alias("customer"),
        F.struct((i % 50).cast("string").alias("id"), F.array(*map(F.lit, CODES))[(i % 12).cast("int")].alias("mcc"), F.col("s_acctbal").cast(f).alias("avg_amount")).alias("merchant"),
        F.struct(F.col("event_type").isin("view", "click").alias("is_online"), (i % 3 == 0).alias("card_present"), ((i * 37) % 1500 + 0.25).cast(f).alias("km_from_home")).alias("terminal"),
        F.when(F.col("_last").isNotNull(), last).alias("last_transaction"),
        F.when((F.col("event_type") == "error") | (F.col("value") > 40), 1).otherwise(0).alias("fraud"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads(purchases(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(orig_id, q, label): labels under 3 are fraud."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("orig_id"), F.transform("embedding", lambda x: quantize(x)).alias("q"), (F.col("label") < 3).cast("int").alias("label"))
