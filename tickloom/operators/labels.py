"""Barrier labels and hazard rows for events, by interval joins with the bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import from_micros, micros, ordered, rolling_std, shifted, simple_return
from .folds import ewm
from .joins import asof, within


def volatility(bars: DataFrame, kind: str = "ewma", window: int = 60, least: float = 1e-6, price: str = "mid_close", by: str = "symbol", bar: str = "bar") -> DataFrame:
    """(key, bar, sigma): the deviation of simple returns, exponentially weighted or rolling, ``least`` where unknown."""
    w = ordered(by, bar)
    r = bars.select(by, bar, simple_return(F.col(price), 1, w).alias("_r"))
    if kind == "ewma":
        sigma = ewm(r, "_r", window, by, bar).withColumnRenamed("ewm_std", "_s")
    elif kind == "rolling":
        sigma = r.withColumn("_s", rolling_std(F.col("_r"), window, w))
    else:
        raise ValueError(f"unknown volatility {kind!r}")
    return sigma.select(by, bar, F.greatest(F.coalesce("_s", F.lit(least)), F.lit(least)).alias("sigma"))


def by_regime(regime: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(regime == name, F.lit(value)).otherwise(out)
    return out


def triple_barrier(events: DataFrame, bars: DataFrame, sigma: DataFrame, horizon: int, pt: float, sl: float, tie_break: str = "worst_case", overrides: dict[str, dict[str, float]] | None = None, by: str = "symbol", t0: str = "t0", key: str = "event_id") -> DataFrame:
    """Adds t1, label, event_type, pt_price, sl_price and sigma to events (key, symbol, t0, side, and entry_price or not).

    The first bar in (t0, t0 + horizon] whose high or low reaches a barrier decides; one that reaches both, by
    ``tie_break``: worst_case, best_case, or by_candle, the way the bar went. Without a touch, t1 is the last bar of the
    window, or its end. ``overrides`` has horizon, pt and sl by ``regime``. Events before the first bar are left out.
    """
    rules = overrides or {}
    regime = F.col("regime") if rules else F.lit(None).cast("string")
    pick = lambda name, default: by_regime(regime, {k: float(v[name]) for k, v in rules.items() if name in v}, float(default))
    ends = [v.get("horizon", horizon) for v in rules.values()] + [horizon]
    at = asof(events, bars.select(by, "bar", F.col("mid_close").alias("bar_close")).join(sigma, [by, "bar"]), by, t0, "bar").where("bar is not null")
    price = F.coalesce(F.col("entry_price"), F.col("bar_close")) if "entry_price" in events.columns else F.col("bar_close")
    at = at.withColumn("entry_price", price).withColumn("_end", from_micros(micros(F.col(t0)) + (pick("horizon", horizon) * 1_000_000).cast("long")))
    up, down = 1 + F.col("side") * pick("pt", pt) * F.col("sigma"), 1 - F.col("side") * pick("sl", sl) * F.col("sigma")
    at = at.withColumn("pt_price", F.col("entry_price") * up).withColumn("sl_price", F.col("entry_price") * down).drop("bar", "bar_close")
    j = within(at.select(key, by, t0, "side", "_end", "pt_price", "sl_price"), bars.select(by, "bar", "mid_open", "mid_high", "mid_low", "mid_close"), by, F.col(t0), F.col("_end"), int(max(ends)), "bar")
    long = F.col("side") > 0
    hit_pt = F.when(long, F.col("mid_high") >= F.col("pt_price")).otherwise(F.col("mid_low") <= F.col("pt_price"))
    hit_sl = F.when(long, F.col("mid_low") <= F.col("sl_price")).otherwise(F.col("mid_high") >= F.col("sl_price"))
    candle = F.when((F.col("mid_close") >= F.col("mid_open")) == long, "pt").otherwise("sl")
    both = {"worst_case": F.lit("sl"), "best_case": F.lit("pt"), "by_candle": candle}[tie_break]
    hit = F.when(hit_pt & hit_sl, both).when(hit_pt, "pt").when(hit_sl, "sl")
    first = j.withColumn("_hit", hit).groupBy(key).agg(F.min(F.when(F.col("_hit").isNotNull(), F.col("row_bar"))).alias("_touch"), F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("row_bar"))).alias("_kind"), F.max("row_bar").alias("_last"))
    out = at.join(first, key, "left").withColumn("event_type", F.coalesce("_kind", F.lit("timeout")))
    out = out.withColumn("label", F.when(F.col("_kind") == "pt", 1).when(F.col("_kind") == "sl", -1).otherwise(0)).withColumn("t1", F.coalesce("_touch", "_last", "_end"))
    return out.drop("_touch", "_kind", "_last", "_end")


def hazard_rows(trades: DataFrame, bars: DataFrame, horizon: int, step: int = 60, by: str = "symbol", key: str = "event_id") -> DataFrame:
    """A row for each step in (entry, exit] of trades with an sl_price: y is whether the stop is touched in (t, min(t + horizon, exit)].

    y is NULL where no bar lies ahead, as at the exit itself.
    """
    start, end, us = micros(F.col("entry_ts")), micros(F.col("exit_ts")), step * 1_000_000
    rows = trades.where(end >= start + us).select(key, by, "side", "entry_ts", "exit_ts", "entry_price", "sl_price", F.explode(F.sequence(start + us, end, F.lit(us).cast("long"))).alias("_us"))
    rows = rows.withColumn("t", from_micros(F.col("_us"))).drop("_us").withColumn("horizon_end_ts", F.least(shifted(F.col("t"), horizon), F.col("exit_ts")))
    j = within(rows.select(key, by, "t", "horizon_end_ts"), bars.select(by, "bar", "mid_low", "mid_high"), by, F.col("t"), F.col("horizon_end_ts"), horizon, "bar")
    ahead = j.groupBy(key, "t").agg(F.min("mid_low").alias("future_min_low"), F.max("mid_high").alias("future_max_high"))
    now = bars.select(by, F.col("bar").alias("t"), F.col("mid_close").alias("mid_close_t"))
    out = rows.join(ahead, [key, "t"], "left").join(now, [by, "t"], "left")
    touched = F.when(F.col("side") > 0, F.col("future_min_low") <= F.col("sl_price")).otherwise(F.col("future_max_high") >= F.col("sl_price"))
    return out.withColumn("y", touched.cast("int"))


def cost_label(trades: DataFrame, fee_bps: float, slippage_bps: float) -> DataFrame:
    """Adds net_pnl_est and label: 1 where what a trade earned is more than its costs on both legs."""
    net = F.col("gross_pnl") - 2 * F.col("notional") * (fee_bps + slippage_bps) / 10_000
    return trades.withColumn("net_pnl_est", net).withColumn("label", (net > 0).cast("int"))
