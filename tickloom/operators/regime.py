"""Regimes of bars, entries, and exits by hazard: windows for what is bounded, folds for what isn't."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import debounced, last_rows, log_return, ordered, rolling_mean, rolling_quantile, rolling_std, run_length, true_range
from .folds import cooldown, ewm

EPS = 1e-12


def realized(bars: DataFrame, window: int, price: str = "mid_close", by: str = "symbol", bar: str = "bar") -> DataFrame:
    """Adds log_ret and rv, the rolling deviation of log returns, to 12 places: equal windows are equal to a threshold."""
    w = ordered(by, bar)
    d = bars.withColumn("log_ret", log_return(F.col(price), w))
    return d.withColumn("rv", F.round(rolling_std(F.col("log_ret"), window, w), 12))


def hazard_flags(bars: DataFrame, window: int, q: float, enter: int = 2, leave: int = 2, threshold_window: int | None = None, **names: str) -> DataFrame:
    """Adds rv, its rolling quantile ``hazard_threshold``, and hazard_flag, debounced."""
    by, bar = names.get("by", "symbol"), names.get("bar", "bar")
    w = ordered(by, bar)
    d = realized(bars, window, **names)
    d = d.withColumn("hazard_threshold", rolling_quantile(F.col("rv"), threshold_window or max(5 * window, 60), q, w))
    return d.withColumn("hazard_flag", debounced(F.col("rv") >= F.col("hazard_threshold"), enter, leave, w))


def exponential_means(bars: DataFrame, fast: int, slow: int, price: str = "mid_close", by: str = "symbol", bar: str = "bar") -> DataFrame:
    out = bars
    for name, span in (("ema_fast", fast), ("ema_slow", slow)):
        out = out.join(ewm(bars, price, span, by, bar).select(by, bar, F.col("ewm_mean").alias(name)), [by, bar], "left")
    return out


def classify(bars: DataFrame, window: int = 12, q: float = 0.8, fast: int = 12, slow: int = 48, strength: float = 1.0, enter: int = 2, leave: int = 2, hazard_enter: int = 2, hazard_leave: int = 2, price: str = "mid_close", by: str = "symbol", bar: str = "bar") -> DataFrame:
    """Adds rv, both exponential means, trend_strength, the flags, and regime: HAZARD, else TREND, else RANGE."""
    d = hazard_flags(exponential_means(bars, fast, slow, price, by, bar), window, q, hazard_enter, hazard_leave, price=price, by=by, bar=bar)
    d = d.withColumn("trend_strength", F.abs(F.col("ema_fast") - F.col("ema_slow")) / (F.col("rv") + EPS))
    d = d.withColumn("trend_flag", debounced(F.col("trend_strength") > strength, enter, leave, ordered(by, bar)))
    return d.withColumn("regime", F.when(F.col("hazard_flag"), "HAZARD").when(F.col("trend_flag"), "TREND").otherwise("RANGE"))


def event_id(symbol: Column, ts: Column, side: Column, reason: Column) -> Column:
    """Twelve hexadecimal digits that an entry always gets."""
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.substring(F.sha1(F.concat_ws("|", symbol, iso, side.cast("string"), reason)), 1, 12)


def entries(bars: DataFrame, band_window: int = 20, band_k: float = 2.0, atr_window: int = 14, tolerance: float = 0.3, range_wait: int = 3, trend_wait: int = 3, center: str = "ema", confirm: int = 0, enabled: set[str] | None = None, price: str = "mid_close", by: str = "symbol", bar: str = "bar") -> DataFrame:
    """Entries from classified bars: band touches in RANGE, pullbacks to the fast mean in TREND, none in HAZARD.

    A family waits so many bars after an entry of its own. ``center`` is the fast mean or the rolling vwap; ``confirm``
    asks long pullbacks for a rising mean and so many rising bars.
    """
    w = ordered(by, bar)
    p = F.col(price)
    vwap = F.try_divide(F.sum(p * F.col("volume")).over(last_rows(w, band_window)), F.sum("volume").over(last_rows(w, band_window))) if center == "vwap" else F.col("ema_fast")
    d = bars.withColumn("center", vwap).withColumn("band", band_k * rolling_std(p, band_window, w))
    d = d.withColumn("upper", F.col("center") + F.col("band")).withColumn("lower", F.col("center") - F.col("band"))
    d = d.withColumn("_tr", true_range(F.col("mid_high"), F.col("mid_low"), p, w)).withColumn("atr", rolling_mean(F.col("_tr"), atr_window, w))
    d = d.withColumn("_before", F.lag(p).over(w)).withColumn("position", F.row_number().over(w).cast("long"))
    long_ok = F.lit(True)
    if confirm:
        long_ok = F.col("ema_fast") > F.lag("ema_fast").over(w)
        for k in range(confirm):
            long_ok = long_ok & (F.lag(p, k).over(w) > F.lag(p, k + 1).over(w))
    d = d.withColumn("_long_ok", F.coalesce(long_ok, F.lit(False)))
    near = F.abs(p - F.col("ema_fast")) <= tolerance * F.col("atr")
    touch = F.when(p >= F.col("upper"), "range_upper_touch").when(p <= F.col("lower"), "range_lower_touch")
    pull = F.when((p > F.col("ema_slow")) & near & (p > F.col("_before")) & F.col("_long_ok"), "trend_pullback_long").when((p < F.col("ema_slow")) & near & (p < F.col("_before")), "trend_pullback_short")
    reason = F.when(F.col("regime") == "RANGE", touch).when((F.col("regime") == "TREND") & (F.col("atr") > 0), pull)
    found = d.withColumn("reason", reason).where("reason is not null")
    if enabled is not None:
        found = found.where(F.col("reason").isin(*enabled) | (F.lit("range_vwap_band" in enabled) & F.col("reason").startswith("range_")))
    found = found.withColumn("side", F.when(F.col("reason").isin("range_lower_touch", "trend_pullback_long"), 1).otherwise(-1))
    columns = [by, bar, "position", "side", F.col(price).alias("entry_price"), "regime", "reason", "center", "band", "upper", "lower", "ema_fast", "ema_slow", "atr"]
    keyed = found.select(*columns).withColumn("_family", F.concat_ws("|", by, "regime"))
    taken = [cooldown(keyed.where(F.col("regime") == name), wait + 1, "_family") for name, wait in (("RANGE", range_wait), ("TREND", trend_wait))]
    out = taken[0].unionByName(taken[1]).drop("_family", "position").withColumnRenamed(bar, "entry_ts")
    return out.withColumn("event_id", event_id(F.col(by), F.col("entry_ts"), F.col("side"), F.col("reason")))


def first_exits(rows: DataFrame, exit_at: float, fail_at: float, in_a_row: int = 2, rising: bool = False, absorption: bool = False, drop: bool = False, window: int = 3, mode: str = "full_policy", key: str = "event_id", t: str = "t", p: str = "p") -> DataFrame:
    """The first exit of each event, of those that have one: (key, exit_ts, exit_reason).

    Fail-fast comes first at any time: p at its level and, where asked, an absorption spike (the largest order flow of any level
    at the window's 0.9 quantile while lambda fell or its residuals rose) and a drop in the mean of the replenishment ratios of
    all levels (or a wider spread); what the rows have no columns for isn't asked. Otherwise p is
    at the exit level for ``in_a_row`` rows, rising where asked; the first row never rises.
    """
    d = rows.where(F.col(p).isNotNull())
    w = ordered(key, t)
    d = run_length(d.withColumn("_high", F.col(p) >= exit_at), "_high", key, t, "_run")
    ok = F.lit(True)
    seen = F.row_number().over(w) > 1
    before = lambda c: F.lag(c).over(w)
    flows = [c for c in rows.columns if c == "ofi" or c.startswith("ofi_L")]
    changes = [x for c, x in (("lambda", F.col("lambda") < before("lambda")), ("resid_std", F.col("resid_std") > before("resid_std"))) if c in rows.columns]
    if absorption and flows and changes:
        size = F.greatest(*(F.abs(F.col(c)) for c in flows)) if len(flows) > 1 else F.abs(F.col(flows[0]))
        d = d.withColumn("_flow", size)
        spike = F.col("_flow") >= F.percentile("_flow", 0.9).over(last_rows(w, window))
        ok = ok & F.coalesce(spike & seen & reduce(lambda x, y: x | y, (F.coalesce(x, F.lit(False)) for x in changes)), F.lit(False))
    ratios = [c for c in rows.columns if c.startswith("repl_ratio")]
    if drop and (ratios or "spread_mean" in rows.columns):
        fell = []
        if ratios:
            n = sum((F.col(c).isNotNull().cast("int") for c in ratios), F.lit(0))
            d = d.withColumn("_ratio", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ratios), F.lit(0.0)) / F.nullif(n, F.lit(0)))
            fell.append(F.col("_ratio") < before("_ratio"))
        if "spread_mean" in rows.columns:
            fell.append(F.col("spread_mean") > before("spread_mean"))
        ok = ok & seen & reduce(lambda x, y: x | y, (F.coalesce(x, F.lit(False)) for x in fell))
    d = d.withColumn("_ok", ok).withColumn("_rise", F.coalesce(F.col(p) > before(p), F.lit(False)))
    fail = (F.col(p) >= fail_at) & F.col("_ok") if mode in ("full_policy", "fail_fast_only") else F.lit(False)
    leave = (F.col("_run") >= in_a_row) & (F.col("_rise") | F.lit(not rising)) if mode in ("full_policy", "hazard_exit_only") else F.lit(False)
    marked = d.withColumn("_why", F.when(fail, "hazard_fail_fast").when(leave, "hazard_exit")).where("_why is not null")
    return marked.groupBy(key).agg(F.min(t).alias("exit_ts"), F.min_by("_why", t).alias("exit_reason"))


def recommend(p: Column, exit_at: float, reduce_at: float, add_most: float) -> Column:
    return F.when(p >= exit_at, "exit").when(p >= reduce_at, "reduce").when(p > add_most, "no_add").otherwise("hold")


def may_add(p: Column, most: float) -> Column:
    return p <= most


