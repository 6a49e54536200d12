"""Backtests: trades from labelled events, equity on bars, summaries, folds, sweeps and attribution."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeops import add_quantiles, exact_sum, micros, ordered, upto_now
from .folds import nonoverlapping
from .joins import asof, next_row


def delayed(events: DataFrame, bars: DataFrame, latency_ms: int, by: str = "symbol", ts: str = "t0") -> DataFrame:
    """Events moved to the next bar, with its close as their price, where the latency is at least the median gap of bars."""
    gap = bars.select((micros(F.col("bar")) - micros(F.lag("bar").over(ordered(by, "bar")))).alias("g")).agg(F.percentile("g", 0.5)).first()[0]
    if not latency_ms or gap is None or latency_ms * 1000 < gap:
        return events
    rows = next_row(bars.select(by, "bar", "mid_close"), by, "bar", "mid_close")
    moved = asof(events, rows.select(by, "bar", "next_ts", "next_mid_close"), by, ts, "bar")
    out = moved.withColumn(ts, F.coalesce("next_ts", ts))
    if "entry_price" in events.columns:
        out = out.withColumn("entry_price", F.coalesce("next_mid_close", "entry_price"))
    return out.select(*events.columns)


def trade_log(labelled: DataFrame, bars: DataFrame, capital: float = 10_000.0, leverage: float = 1.0, share: float = 0.1, fee_bps: float = 4.0, slippage_bps: float = 2.0, by: str = "symbol") -> DataFrame:
    """Trades of labelled events (t0, t1, side, entry_price, event_type, ...), none entered before the one before has left."""
    priced = asof(labelled, bars.select(by, "bar", F.col("mid_close").alias("_close")).where("_close is not null"), by, "t1", "bar").drop("bar")
    exit_price = F.when(F.col("event_type") == "pt", F.col("pt_price")).when(F.col("event_type") == "sl", F.col("sl_price")).otherwise(F.col("_close"))
    priced = priced.withColumn("exit_price", exit_price).drop("_close").withColumnsRenamed({"t0": "entry_ts", "t1": "exit_ts"})
    taken = nonoverlapping(priced, by)
    notional = capital * leverage * share
    gross = F.col("side") * F.try_divide(F.col("exit_price") - F.col("entry_price"), F.col("entry_price")) * notional
    out = taken.withColumn("gross_pnl", gross).withColumn("fees", F.lit(2 * notional * fee_bps / 10_000)).withColumn("slippage", F.lit(2 * notional * slippage_bps / 10_000)).withColumn("notional", F.lit(notional))
    return out.withColumn("net_pnl", F.col("gross_pnl") - F.col("fees") - F.col("slippage")).withColumn("exit_reason", F.coalesce(F.col("exit_reason"), F.concat(F.lit("barrier_"), "event_type")) if "exit_reason" in labelled.columns else F.concat(F.lit("barrier_"), "event_type"))


def with_exits(labelled: DataFrame, exits: DataFrame, bars: DataFrame, key: str = "event_id", by: str = "symbol") -> DataFrame:
    """Labelled events with the exits of a policy that come strictly before their own; priced as of that time."""
    j = labelled.join(exits.withColumnRenamed("exit_ts", "_exit"), key, "left").withColumn("_early", F.col("_exit") < F.col("t1"))
    pick = lambda early, otherwise: F.when(F.col("_early"), early).otherwise(otherwise)
    j = j.withColumns({"event_type": pick(F.col("exit_reason"), F.col("event_type")), "t1": pick(F.col("_exit"), F.col("t1")), "exit_reason": F.when(F.col("_early"), F.col("exit_reason"))})
    return j.drop("_exit", "_early")


def equity(trades: DataFrame, bars: DataFrame, capital: float = 10_000.0, by: str = "symbol", pnl: str = "net_pnl") -> DataFrame:
    """(key, bar, equity): the capital and what trades that have left by each bar's label have earned."""
    on = asof(trades.select(by, "exit_ts", pnl), bars.select(by, "bar"), by, "exit_ts", "bar").where("bar is not null")
    earned = on.groupBy(by, "bar").agg(exact_sum(F.col(pnl)).alias("_pnl"))
    rows = bars.select(by, "bar").join(earned, [by, "bar"], "left")
    return rows.select(by, "bar", (F.lit(capital) + F.sum(F.coalesce("_pnl", F.lit(0.0))).over(upto_now(ordered(by, "bar")))).alias("equity"))


def drawdown(curve: DataFrame, by: str = "symbol", bar: str = "bar") -> DataFrame:
    w = ordered(by, bar)
    return curve.withColumn("drawdown", F.try_divide("equity", F.max("equity").over(upto_now(w))) - 1).withColumn("ret", F.coalesce(F.try_divide("equity", F.lag("equity").over(w)) - 1, F.lit(0.0)))


def curve_summary(curve: DataFrame, by: str = "symbol", periods: float | None = None) -> DataFrame:
    """Sharpe ratio (0 where flat) and the deepest drawdown."""
    d = drawdown(curve, by)
    ratio = F.coalesce(F.try_divide(F.avg("ret"), F.nullif(F.stddev_pop("ret"), F.lit(0.0))), F.lit(0.0)) * (periods**0.5 if periods else 1.0)
    return d.groupBy(by).agg(ratio.alias("sharpe"), F.min("drawdown").alias("max_drawdown"))


def trade_summary(trades: DataFrame, by: list[str], capital: float = 10_000.0) -> DataFrame:
    won, lost = F.col("net_pnl") > 0, F.col("net_pnl") < 0
    mean = lambda which: F.coalesce(exact_sum(F.when(which, F.col("net_pnl"))) / F.nullif(F.count_if(which), F.lit(0)), F.lit(0.0))
    return trades.groupBy(*by).agg(
        exact_sum(F.col("net_pnl")).alias("pnl_net"), exact_sum(F.col("gross_pnl")).alias("pnl_gross"), exact_sum(F.col("fees")).alias("total_fees"), exact_sum(F.col("slippage")).alias("total_slippage"),
        (F.count_if(won) / F.count("*")).alias("win_rate"), mean(won).alias("avg_win"), mean(lost).alias("avg_loss"), F.count("*").alias("trade_count"), (exact_sum(F.col("notional")) / capital).alias("turnover"),
    )


def tail(trades: DataFrame, by: list[str]) -> DataFrame:
    """The 5 % quantile, the mean of the worst 5 % (one at least), and the worst week by exit."""
    ranked = trades.withColumn("_r", F.row_number().over(ordered(by, "net_pnl", "event_id"))).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    worst = F.col("_r") <= F.greatest(F.lit(1), F.ceil(0.05 * F.col("_n")))
    one = ranked.groupBy(*by).agg((exact_sum(F.when(worst, F.col("net_pnl"))) / F.count_if(worst)).alias("expected_shortfall_95"))
    weeks = trades.groupBy(*by, F.date_trunc("week", "exit_ts").alias("_week")).agg(exact_sum(F.col("net_pnl")).alias("_pnl"))
    one = add_quantiles(one, trades, by, "net_pnl", {"worst_5pct_trade": 0.05})
    return one.join(weeks.groupBy(*by).agg(F.min("_pnl").alias("worst_week_pnl")), by)


def pnl_by(trades: DataFrame, key: str) -> DataFrame:
    """Trades, net profit and holding time by ``day``, ``week`` (Monday first), or a column (UNKNOWN where NULL)."""
    of = {"day": F.date_format("exit_ts", "yyyy-MM-dd"), "week": F.date_format(F.date_trunc("week", "exit_ts"), "yyyy-MM-dd")}.get(key, F.coalesce(F.col(key).cast("string"), F.lit("UNKNOWN")) if key not in ("day", "week") else None)
    return trades.groupBy(of.alias("key")).agg(F.count("*").alias("trades"), exact_sum(F.col("net_pnl")).alias("net_pnl"))


def holding(trades: DataFrame, by: list[str]) -> DataFrame:
    minutes = (micros(F.col("exit_ts")) - micros(F.col("entry_ts"))) / 60_000_000
    rows = trades.select(*by, minutes.alias("_m"))
    return add_quantiles(rows.groupBy(*by).agg((exact_sum(F.col("_m")) / F.count("_m")).alias("mean_min")), rows, by, "_m", {"median_min": 0.5, "p95_min": 0.95})


def hazard_exit_counts(trades: DataFrame, by: list[str]) -> DataFrame:
    return trades.groupBy(*by).agg(F.count_if(F.col("exit_reason") == "hazard_exit").alias("hazard_exits"), F.count_if(F.col("exit_reason") == "hazard_fail_fast").alias("fail_fast_exits"))


def cost_sweep(trades: DataFrame, pairs: list[tuple[float, float]]) -> DataFrame:
    """The trade log under pairs of fee and slippage in basis points: totals of each pair in one pass."""
    grid = F.explode(F.array(*(F.struct(F.lit(float(f)).alias("fee_bps"), F.lit(float(s)).alias("slip_bps")) for f, s in pairs)))
    net = F.col("gross_pnl") - 2 * F.col("notional") * (F.col("fee_bps") + F.col("slip_bps")) / 10_000
    return trades.select("gross_pnl", "notional", grid.alias("g")).select("gross_pnl", "notional", "g.*").groupBy("fee_bps", "slip_bps").agg(F.count("*").alias("trades"), exact_sum(net).alias("net_pnl"), F.count_if(net > 0).alias("wins"))


def threshold_sweep(trades: DataFrame, thresholds: list[float], score: str = "score") -> DataFrame:
    """Trades with a score at or above each threshold: number, share, net profit, fees; in one pass."""
    passed = F.explode(F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: t <= F.col(score)))
    all_ = trades.agg(F.count("*").alias("_n"))
    return trades.select(passed.alias("threshold"), "net_pnl", "fees").groupBy("threshold").agg(F.count("*").alias("accepted"), exact_sum(F.col("net_pnl")).alias("net_pnl"), exact_sum(F.col("fees")).alias("fees")).join(F.broadcast(all_)).withColumn("accept_rate", F.col("accepted") / F.col("_n")).drop("_n")


def accept_rates(trades: DataFrame, thresholds: list[float], by: str = "regime", score: str = "score") -> DataFrame:
    """For each threshold and group (UNKNOWN where NULL): trades, those with a score at or above it, and their share."""
    grid = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    rows = trades.select(F.coalesce(F.col(by).cast("string"), F.lit("UNKNOWN")).alias(by), F.col(score).alias("_s"), grid)
    passed = F.count_if(F.col("_s") >= F.col("threshold"))
    return rows.groupBy("threshold", by).agg(F.count("*").alias("trades"), passed.alias("accepted"), (passed / F.count("*")).alias("accept_rate"))


def recommended(sweep: DataFrame, total: int) -> DataFrame:
    """The threshold with the best mean net profit (then least fees, then lowest) of those with enough trades."""
    least = max(20, 0.2 * total)
    return sweep.where(F.col("accepted") >= least).withColumn("expected_net", F.col("net_pnl") / F.col("accepted")).orderBy(F.desc("expected_net"), "fees", "threshold").limit(1)


def folds(spark: SparkSession, start: datetime, end: datetime, train_days: int, test_days: int, step_days: int, embargo_minutes: int) -> DataFrame:
    """Walk-forward folds between two times: train, embargo, test; a fold whose test ends too late is none."""
    if min(train_days, test_days, step_days) <= 0:
        raise ValueError("train_days, test_days and step_days must be positive")
    out, at = [], start
    while True:
        train_end = at + timedelta(days=train_days)
        test_start = train_end + timedelta(minutes=embargo_minutes)
        test_end = test_start + timedelta(days=test_days)
        if test_end > end:
            break
        out.append((len(out), at, train_end, test_start, test_end))
        at += timedelta(days=step_days)
    return spark.createDataFrame(out, "fold_id long, train_start timestamp_ntz, train_end timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz")


def by_fold(events: DataFrame, fold_rows: DataFrame, ts: str) -> DataFrame:
    """Events with each fold whose test range, ends included, they fall in.

    Every event is held against every fold: these are as many as the steps of the range, dozens, which bounds the broadcast.
    """
    return events.join(F.broadcast(fold_rows), (F.col(ts) >= F.col("test_start")) & (F.col(ts) <= F.col("test_end")))


def walk_forward(trades: DataFrame, fold_rows: DataFrame, fee_mults: list[float], slippage_mults: list[float], capital: float = 10_000.0) -> DataFrame:
    """Summaries by fold and cost multiples. Features look only back, so trades are made once and cut by fold."""
    grid = F.explode(F.array(*(F.struct(F.lit(float(f)).alias("fee_mult"), F.lit(float(s)).alias("slippage_mult")) for f in fee_mults for s in slippage_mults)))
    t = by_fold(trades, fold_rows, "entry_ts").withColumn("_g", grid).select("*", "_g.*").drop("_g")
    t = t.withColumn("fees", F.col("fees") * F.col("fee_mult")).withColumn("slippage", F.col("slippage") * F.col("slippage_mult")).withColumn("net_pnl", F.col("gross_pnl") - F.col("fees") - F.col("slippage"))
    return trade_summary(t, ["fold_id", "fee_mult", "slippage_mult"], capital)


def compared(base: DataFrame, other: DataFrame, key: str = "event_id") -> DataFrame:
    """Trades side by side: what the other run saved, and whether it left a stop-loss early."""
    b = base.select(key, F.col("net_pnl").alias("net_pnl_base"), F.col("event_type").alias("event_type_base"), F.col("exit_ts").alias("exit_ts_base"))
    o = other.select(key, F.col("net_pnl").alias("net_pnl_enh"), F.col("exit_reason").alias("exit_reason_enh"), F.col("exit_ts").alias("exit_ts_enh"))
    j = b.join(o, key, "left")
    return j.withColumn("saved", F.col("net_pnl_enh") - F.col("net_pnl_base")).withColumn("stop_avoided", (F.col("event_type_base") == "sl") & (F.col("exit_ts_enh") < F.col("exit_ts_base")))


def flags(summary: DataFrame, turnover_most: float = 50.0, hazard_share_most: float = 0.6) -> DataFrame:
    """Churn, over-exit and misalignment, from a row with turnover, trade_count, hazard_exits, fail_fast_exits, pnl_gross, pnl_net."""
    exits = F.try_divide(F.col("hazard_exits") + F.col("fail_fast_exits"), F.col("trade_count"))
    return summary.withColumn("churn", F.col("turnover") > turnover_most).withColumn("over_exit", exits > hazard_share_most).withColumn("misaligned", (F.col("pnl_gross") > 0) & (F.col("pnl_net") < 0))


def walk_forward_compared(labelled: DataFrame, probabilities: DataFrame, bars: DataFrame, fold_rows: DataFrame, modes: list[str], exit_at: float, fail_at: float, in_a_row: int = 2, costs: tuple[float, ...] = (10_000.0, 1.0, 0.1, 4.0, 2.0)) -> DataFrame:
    """For each fold and mode of the exit policy: the summaries of the trades with and without it, and what it saved.

    ``probabilities`` (event_id, t, p) are out of fold. Trades are made once for each mode and cut by fold.
    """
    from functools import reduce

    from .regime import first_exits

    base = trade_log(labelled, bars, *costs)
    parts = []
    for mode in modes:
        exits = first_exits(probabilities, exit_at, fail_at, in_a_row, mode=mode)
        other = trade_log(with_exits(labelled, exits, bars), bars, *costs)
        both = compared(base.select("event_id", "entry_ts", "net_pnl", "event_type", "exit_ts"), other).join(base.select("event_id", "entry_ts"), "event_id")
        parts.append(by_fold(both, fold_rows, "entry_ts").withColumn("mode", F.lit(mode)))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("fold_id", "mode").agg(F.count("*").alias("trades"), exact_sum(F.col("net_pnl_base")).alias("net_pnl_base"), exact_sum(F.col("net_pnl_enh")).alias("net_pnl_enh"), exact_sum(F.col("saved")).alias("saved"), F.count_if("stop_avoided").alias("stops_avoided"), F.count_if(F.col("exit_reason_enh").startswith("hazard")).alias("hazard_exits"))


def top_drivers(trades: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The n groups, over all keys, that earned and that lost most."""
    from functools import reduce

    groups = reduce(DataFrame.unionByName, [pnl_by(trades, k).withColumn("by", F.lit(k)) for k in keys])
    best = groups.orderBy(F.desc("net_pnl"), "by", "key").limit(n).withColumn("side", F.lit("profit"))
    worst = groups.orderBy("net_pnl", "by", "key").limit(n).withColumn("side", F.lit("loss"))
    return best.unionByName(worst)
