"""Bars of a stream of trades, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import exact_sum


def stream_bars(trades: DataFrame, seconds: int, late: str = "1 minute", by: str = "symbol", ts: str = "ts", tie: str = "agg_id") -> DataFrame:
    """The batch bars' prices, volume and vwap for each right-closed bar, once the watermark has passed its end.

    A microsecond off the time makes Spark's left-closed windows right-closed. Empty bars don't come.
    """
    at = F.struct(ts, tie)
    t = trades.withColumn("_t", F.col(ts).cast("timestamp") - F.expr("INTERVAL 0.000001 SECOND")).withWatermark("_t", late)
    sums = t.groupBy(by, F.window("_t", f"{seconds} seconds").alias("_w")).agg(F.min_by("price", at).alias("mid_open"), F.max("price").alias("mid_high"), F.min("price").alias("mid_low"), F.max_by("price", at).alias("mid_close"), exact_sum(F.col("qty")).alias("volume"), exact_sum(F.col("price") * F.col("qty")).alias("_value"))
    return sums.select(by, F.col("_w.end").alias("bar"), "mid_open", "mid_high", "mid_low", "mid_close", "volume", F.try_divide("_value", "volume").alias("vwap"))
