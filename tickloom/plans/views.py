"""Market views over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars

HOUR = 3600


def trades(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_id").alias("agg_id"), "ts", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"), F.col("event_type").alias("symbol"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"), "user_id")


def book(spark: SparkSession, sf: str, levels: int = 3) -> DataFrame:
    t = trades(spark, sf)
    columns = [c for i in range(1, levels + 1) for c in (F.round(F.col("price") - 0.01 * i, 2).alias(f"bid_price_{i}"), F.round(F.col("price") + 0.01 * i, 2).alias(f"ask_price_{i}"), (F.col("qty") + i).alias(f"bid_size_{i}"), (F.col("user_id") % 17 + i).cast("double").alias(f"ask_size_{i}"))]
    return t.select("agg_id", "symbol", "ts", *columns)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return bars.time_bars(trades(spark, sf), HOUR)


TRADES = """trades AS (SELECT event_id AS agg_id, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty,
  event_type AS symbol, user_id % 2 = 0 AS is_buyer_maker, user_id FROM events)"""
BOOK = TRADES + """, book AS (SELECT agg_id, symbol, ts, """ + ", ".join(f"round(price - {0.01 * i}, 2) AS bid_price_{i}, round(price + {0.01 * i}, 2) AS ask_price_{i}, qty + {i} AS bid_size_{i}, CAST(user_id % 17 + {i} AS DOUBLE) AS ask_size_{i}" for i in (1, 2, 3)) + " FROM trades)"


def end_of(ts: str, us: int) -> str:
    return f"make_timestamp(CAST(epoch_us({ts}) + (({us} - epoch_us({ts}) % {us}) % {us}) AS BIGINT))"


def floor_of(ts: str, us: int) -> str:
    return f"make_timestamp(CAST(epoch_us({ts}) - epoch_us({ts}) % {us} AS BIGINT))"


def exact(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(29,9))) AS DOUBLE)"


def bars_sql(us: int, name: str = "bars", ts: str = "ts") -> str:
    """CTEs for hourly or other bars of trades with the dense spine."""
    return f"""{TRADES}, raw_{name} AS (SELECT symbol, {end_of('ts', us)} AS bar, arg_min(price, (ts, agg_id)) AS mid_open, max(price) AS mid_high,
  min(price) AS mid_low, arg_max(price, (ts, agg_id)) AS mid_close, {exact('qty')} AS volume, {exact('price * qty')} / nullif({exact('qty')}, 0) AS vwap FROM trades GROUP BY ALL),
spine_{name} AS (SELECT symbol, unnest(generate_series(a, b, to_microseconds({us}))) AS bar FROM (SELECT symbol, min(bar) AS a, max(bar) AS b FROM raw_{name} GROUP BY symbol)),
{name} AS (SELECT s.symbol, s.bar, mid_open, mid_high, mid_low, mid_close, coalesce(volume, 0) AS volume, vwap FROM spine_{name} s LEFT JOIN raw_{name} r ON r.symbol = s.symbol AND r.bar = s.bar)"""

