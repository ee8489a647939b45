"""The driver tables under the names that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as prices: (asset, ts, tie, price, kind)."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("asset"), "ts", F.col("event_id").alias("tie"), F.col("value").alias("price"), F.col("event_type").alias("kind")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as daily bars of each type: (asset, ts, tie, open, high, low, close, volume)."""
    rows = read(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    return rows.groupBy(F.col("event_type").alias("asset"), F.to_date("ts").alias("ts")).agg(
        F.lit(0).alias("tie"),
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades: (symbol, ts, okey, line, quantity, price, pnl)."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"),
    )


def weights(spark: SparkSession, sf_dir: str, table: str, prefix: str) -> DataFrame:
    """Positive balances by nation as shares of all: (nation, weight)."""
    rows = read(spark, sf_dir, table).where(F.col(f"{prefix}_acctbal") > 0)
    sums = rows.groupBy(F.col(f"{prefix}_nationkey").alias("nation")).agg(F.sum(f"{prefix}_acctbal").alias("bal"))
    total = sums.agg(F.sum("bal").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("nation", (F.col("bal") / F.col("total")).alias("weight"))  # total is one row


#: The same tables in DuckDB SQL.
TICKS_SQL = "ticks AS (SELECT user_id AS asset, ts, event_id AS tie, value AS price, event_type AS kind FROM events)"
BARS_SQL = (
    "bars AS (SELECT event_type AS asset, CAST(ts AS DATE) AS ts, 0 AS tie, arg_min(value, (ts, event_id)) AS open, max(value) AS high, "
    "min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"
)
TRADES_SQL = (
    "trades AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, l_orderkey AS okey, l_linenumber AS line, l_quantity AS quantity, "
    "l_extendedprice AS price, l_extendedprice * (l_discount - l_tax) AS pnl FROM lineitem)"
)


def weights_sql(name: str, table: str, prefix: str) -> str:
    return (
        f"{name} AS (SELECT {prefix}_nationkey AS nation, sum({prefix}_acctbal) / (SELECT sum({prefix}_acctbal) FROM {table} WHERE {prefix}_acctbal > 0) AS weight "
        f"FROM {table} WHERE {prefix}_acctbal > 0 GROUP BY 1)"
    )
