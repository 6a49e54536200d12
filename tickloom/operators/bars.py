"""Time bars from trades and top-of-book rows, right-closed and labelled by their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import bar_end, exact_sum, require, spine
from .joins import full_outer, on_spine


def time_bars(trades: DataFrame, seconds: int, book: DataFrame | None = None, by: str = "symbol", ts: str = "ts", tie: str = "agg_id") -> DataFrame:
    """Bars with mid_open, mid_high, mid_low, mid_close, volume, vwap; with a book also spread_mean, microprice_close.

    With a book the four prices are of its mid, else of trades. Bars without rows are there, with volume 0 and NULLs.
    Equal times are in order of ``tie``.
    """
    require(trades, by, ts, "price", "qty", tie)
    t = trades.withColumn("bar", bar_end(F.col(ts), seconds))
    at = F.struct(ts, tie)
    prices = lambda p, at: [F.min_by(p, at).alias("mid_open"), F.max(p).alias("mid_high"), F.min(p).alias("mid_low"), F.max_by(p, at).alias("mid_close")]
    sums = [exact_sum(F.col("qty")).alias("volume"), F.try_divide(exact_sum(F.col("price") * F.col("qty")), exact_sum(F.col("qty"))).alias("vwap")]
    if book is None:
        bars = t.groupBy(by, "bar").agg(*prices("price", at), *sums)
    else:
        require(book, by, ts, "bid", "ask", "bid_size", "ask_size")
        b = book.select(by, ts, bar_end(F.col(ts), seconds).alias("bar"), ((F.col("bid") + F.col("ask")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"), F.try_divide(F.col("ask") * F.col("bid_size") + F.col("bid") * F.col("ask_size"), F.col("bid_size") + F.col("ask_size")).alias("micro"))
        place = F.struct(ts, "mid", "spread", "micro")
        quotes = b.groupBy(by, "bar").agg(*prices("mid", place), (exact_sum(F.col("spread")) / F.count("spread")).alias("spread_mean"), F.max_by("micro", F.when(F.col("micro").isNotNull(), place)).alias("microprice_close"))
        bars = full_outer([t.groupBy(by, "bar").agg(*sums), quotes], [by, "bar"])
    return on_spine(spine(bars, by, "bar", seconds), bars, [by, "bar"], {"volume": 0.0})


def resample(bars: DataFrame, seconds: int, by: str = "symbol") -> DataFrame:
    """Wider bars from bars: first and last skip NULLs, vwap is weighted by volume."""
    wide = bars.withColumn("wide", bar_end(F.col("bar"), seconds))
    seen = lambda c: F.when(F.col(c).isNotNull(), F.col("bar"))
    aggregates = [F.min_by("mid_open", seen("mid_open")).alias("mid_open"), F.max("mid_high").alias("mid_high"), F.min("mid_low").alias("mid_low"), F.max_by("mid_close", seen("mid_close")).alias("mid_close"), exact_sum(F.col("volume")).alias("volume"), F.try_divide(exact_sum(F.col("vwap") * F.col("volume")), exact_sum(F.col("volume"))).alias("vwap")]
    if "spread_mean" in bars.columns:
        aggregates.append((exact_sum(F.col("spread_mean")) / F.count("spread_mean")).alias("spread_mean"))
    if "microprice_close" in bars.columns:
        aggregates.append(F.max_by("microprice_close", seen("microprice_close")).alias("microprice_close"))
    out = wide.groupBy(by, F.col("wide").alias("bar")).agg(*aggregates)
    return on_spine(spine(out, by, "bar", seconds), out, [by, "bar"], {"volume": 0.0})


def bars_from_klines(klines: DataFrame) -> DataFrame:
    """Klines as bars; they keep the open time as their label. vwap is the close where there is no volume."""
    vwap = F.when(F.col("volume") > 0, F.try_divide("quote_volume", "volume")).otherwise(F.col("close"))
    return klines.select("symbol", F.col("ts").alias("bar"), F.col("open").alias("mid_open"), F.col("high").alias("mid_high"), F.col("low").alias("mid_low"), F.col("close").alias("mid_close"), "volume", vwap.alias("vwap"))
