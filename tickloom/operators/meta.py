"""Feature frames for the hazard and meta models, and the choice of events by score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import WindowSpec

from ..functions.timeops import by_day, ordered, rolling_std, rolling_zscore, simple_return
from . import micro
from .joins import asof
from .quality_gates import enough_values

CANDLES = micro.CANDLES


def feature_frame(bars: DataFrame, book: DataFrame | None, flow: DataFrame, levels: list[int], lambda_window: int = 10, z_window: int = 20, by: str = "symbol") -> DataFrame:
    """Bars with order flow, imbalance, depth, replenishment, price impact and their z-scores, each known by the bar's end."""
    w = ordered(by, "bar")
    out = bars.join(micro.flow_on_bars(bars, flow, by), [by, "bar"])
    out = out.withColumn("mid_change", F.col("mid_close") - F.lag("mid_close").over(w))
    out = micro.kyle_lambda(out, lambda_window, by=by)
    names = ["flow", "mid_change", "lambda", "resid_std"]
    if book is not None:
        def features(rows: DataFrame, _: WindowSpec) -> DataFrame:
            d = micro.depth_features(micro.weighted_imbalance(micro.weighted_order_flow(micro.order_flow(rows, levels), levels), levels), levels)
            return micro.replenishment(d.drop("spread"), levels)

        d = by_day(book, by, "ts", "agg_id", 3, features)
        top = levels[-1]
        columns = [f"ofi_L{top}", f"w_ofi_L{top}", f"w_obi_L{top}", f"depth_L{top}", f"repl_ratio_L{top}", "spread_mean"]
        others = [f"{c}_L{n}" for n in levels if n != top for c in ("ofi", "repl_ratio")]  # for the policy
        out = micro.on_bars(out.drop("spread_mean"), d, [*columns, *others], by)
        names += columns
    for c in names:
        out = out.withColumn(f"{c}_z", rolling_zscore(F.col(c), z_window, w))
    return out


def hazard_frame(rows: DataFrame, features: DataFrame, columns: list[str], by: str = "symbol") -> tuple[DataFrame, list[str]]:
    """Hazard rows with the features as of their time; columns that are missing too often go, and then rows with a NULL."""
    joined = asof(rows, features.select(by, F.col("bar").alias("feature_ts"), *columns), by, "t", "feature_ts").where("y is not null")
    kept = enough_values(joined, columns)
    return joined.dropna(subset=kept), kept


def meta_frame(events: DataFrame, bars: DataFrame, features: DataFrame, columns: list[str], unit_seconds: int, window: int = 12, most: int = 20, by: str = "symbol") -> tuple[DataFrame, list[str]]:
    """Events with bar returns, deviation, regime flags, at most ``most`` micro features and candle features.

    Features that are missing in more than 0.8 of the rows go; other missing values are 0.
    """
    w = ordered(by, "bar")
    p = F.col("mid_close")
    own = bars.select(by, F.col("bar").alias("bar_ts"), simple_return(p, 1, w).alias("ret_1"), simple_return(p, 3, w).alias("ret_3")).withColumn("rv", rolling_std(F.col("ret_1"), window, ordered(by, "bar_ts")))
    micros = columns[:most]
    j = asof(events, own, by, "entry_ts", "bar_ts").drop("bar_ts")
    j = asof(j, features.select(by, F.col("bar").alias("micro_ts"), *(F.col(c).alias(f"{c}_micro") for c in micros)), by, "entry_ts", "micro_ts").drop("micro_ts")
    j = j.join(micro.candles_before(events, bars, 5, 60, unit_seconds, by), [by, "entry_ts"], "left")
    j = reduce(lambda d, name: d.withColumn(f"regime_{name.lower()}", (F.coalesce("regime", F.lit("")) == name).cast("double")), ("RANGE", "TREND"), j)
    names = ["ret_1", "ret_3", "rv", *(f"{c}_micro" for c in micros), *CANDLES, "regime_range", "regime_trend"]
    kept = enough_values(j, names)
    return j.fillna(0.0, kept), kept


def missing_examples(frame: DataFrame, columns: list[str], key: str = "event_id", n: int = 5) -> tuple[float, list]:
    """The share of rows that lack a value, and some of their keys."""
    lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    share = frame.agg(F.avg(lacks.cast("double"))).first()[0] or 0.0
    return share, [r[key] for r in frame.where(lacks).orderBy(key).limit(n).collect()]


def vetoed(events: DataFrame, scores: DataFrame, threshold: float, key: str = "event_id") -> DataFrame:
    """The events whose score is at or above the threshold."""
    return events.join(scores.where(F.col("score") >= threshold).select(key), key, "left_semi")
