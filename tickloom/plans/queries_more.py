"""Parsers, sources and sinks, confirmations, costs and delays, samples and small statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeops as T
from ..operators import backtest, folds, joins, labels, meta, micro, models, quality_gates, regime
from ..sources import files, parsers, sinks
from .queries_bars import LAG, OVER, rolled
from .queries_joins import FLOW, IC, KYLE, PICKED, TICK, flow, over, picked, rounded
from .queries_models import LOG, classified, log
from .register import Register
from .views import BOOK, HOUR, TRADES, bars_sql, book, exact, hourly, trades

REGISTER = Register()
US = HOUR * 1_000_000
BARS = bars_sql(US)
MS = "epoch_us(ts) // 1000"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ms(ts: str = "ts"):
    return F.floor(T.micros(F.col(ts)) / 1000)


# --- trades, flow and bars


SIDE = "CASE user_id % 3 WHEN 0 THEN 'Buy' WHEN 1 THEN 's' ELSE '?' END"


@REGISTER(f"WITH {TRADES} SELECT symbol, agg_id, coalesce(last_value(CASE user_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN -1.0 END IGNORE NULLS) {TICK}, 1.0) AS sign FROM trades")
def sign_by_side(spark: SparkSession, sf: str) -> DataFrame:
    return micro.sign_by_side(trades(spark, sf), F.expr(SIDE)).select("symbol", "agg_id", "sign")


@REGISTER(f"WITH {KYLE}, l AS (SELECT symbol, bar, CASE WHEN count(x) {over(5)} >= 5 THEN covar_samp(x, y) {over(5)} / nullif(var_pop(x) {over(5)}, 0) END AS lam FROM xy), z AS (SELECT symbol, bar, lam, CASE WHEN count(lam) {over(8)} >= 8 THEN (lam - avg(lam) {over(8)}) / (nullif(stddev_pop(lam) {over(8)}, 0) + 1e-9) END AS z FROM l) SELECT symbol, bar, round(lam, 4) AS lambda_raw, round(z, 3) AS lambda_z, coalesce(z > 1.5, false) AS illiquidity_flag FROM z")
def illiquidity(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf).select("symbol", "bar", "mid_close").join(micro.flow_on_bars(hourly(spark, sf), flow(spark, sf)), ["symbol", "bar"])
    found = micro.illiquidity(rows, 5, 8, 1.5).select("symbol", "bar", F.round("lambda_raw", 4).alias("lambda_raw"), F.round("lambda_z", 3).alias("lambda_z"), "illiquidity_flag")
    return found


@REGISTER(f"WITH {BOOK}, f AS (SELECT symbol, ts, agg_id, coalesce(CASE WHEN bid_price_1 > lag(bid_price_1) {TICK} THEN bid_size_1 WHEN bid_price_1 = lag(bid_price_1) {TICK} THEN bid_size_1 - lag(bid_size_1) {TICK} ELSE -lag(bid_size_1) {TICK} END - CASE WHEN ask_price_1 < lag(ask_price_1) {TICK} THEN ask_size_1 WHEN ask_price_1 = lag(ask_price_1) {TICK} THEN ask_size_1 - lag(ask_size_1) {TICK} ELSE -lag(ask_size_1) {TICK} END, 0) AS ofi_L1 FROM book), {BARS.replace(TRADES + ', ', '')} SELECT b.symbol, b.bar, f.ofi_L1 FROM bars b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.bar >= f.ts")
def ofi_on_bars(spark: SparkSession, sf: str) -> DataFrame:
    return micro.on_bars(hourly(spark, sf).select("symbol", "bar"), micro.order_flow(book(spark, sf), [1]), ["ofi_L1"])


@REGISTER(f"WITH {BARS}, r AS (SELECT symbol, bar, mid_close / lag(mid_close) {LAG} - 1 AS x FROM bars) SELECT symbol, bar, round(greatest(coalesce({rolled(6, 'x', 'stddev_pop(x)')}, 1e-6), 1e-6), 8) AS sigma FROM r")
def volatility_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(labels.volatility(hourly(spark, sf), "rolling", 6), 8, "sigma")


@REGISTER(f"WITH {BARS} SELECT symbol, bar, round(mid_close / lag(mid_close) {LAG} - 1, 8) AS ret_1, round(mid_close / lag(mid_close, 3) {LAG} - 1, 8) AS ret_3 FROM bars")
def simple_returns(spark: SparkSession, sf: str) -> DataFrame:
    w, p = T.ordered("symbol", "bar"), F.col("mid_close")
    return hourly(spark, sf).select("symbol", "bar", F.round(T.simple_return(p, 1, w), 8).alias("ret_1"), F.round(T.simple_return(p, 3, w), 8).alias("ret_3"))


@REGISTER(f"WITH {IC} SELECT feature, target, count(*) AS n, round(corr(x, y), 6) AS r FROM v WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL")
def ic_pearson(spark: SparkSession, sf: str) -> DataFrame:
    w, p = T.ordered("symbol", "bar"), F.col("mid_close")
    rows = hourly(spark, sf).select("volume", (F.col("mid_high") - F.col("mid_low")).alias("range_"), T.forward_return(p, 1, w).alias("fwd1"), T.forward_return(p, 4, w).alias("fwd4"))
    return rounded(micro.correlation(rows, ["volume", "range_"], ["fwd1", "fwd4"]), 6, "r")


# --- joins along time


@REGISTER(f"WITH {BARS}, {PICKED} SELECT event_id, count(*) AS n, max(mid_high) AS high FROM ev JOIN bars ON bars.symbol = ev.symbol AND bar >= entry_ts - INTERVAL 30 MINUTE AND bar <= entry_ts + INTERVAL 30 MINUTE GROUP BY event_id")
def around_entries(spark: SparkSession, sf: str) -> DataFrame:
    j = joins.around(picked(spark, sf), hourly(spark, sf), "symbol", "entry_ts", 1800, "bar")
    return j.groupBy("event_id").agg(F.count("*").alias("n"), F.max("mid_high").alias("high"))


@REGISTER(f"WITH {BARS}, e AS (SELECT event_id, event_type AS symbol, {US} AS w, ts FROM events), s AS (SELECT event_id, symbol, make_timestamp(CAST(epoch_us(ts) - epoch_us(ts) % {US} AS BIGINT)) AS a FROM e) SELECT event_id, count(*) AS n, sum(volume) AS volume FROM s JOIN bars ON bars.symbol = s.symbol AND bar >= a AND bar <= a + INTERVAL 3 HOUR GROUP BY event_id")
def closed_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """The bars of [entry, exit], both ends included."""
    ev = picked(spark, sf).select("event_id", "symbol", T.bar_floor(F.col("entry_ts"), HOUR).alias("a"))
    j = joins.within(ev, hourly(spark, sf), "symbol", F.col("a"), T.shifted(F.col("a"), 3 * HOUR), 3 * HOUR, "bar", include_start=True)
    return j.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@REGISTER(f"WITH {BARS}, e AS (SELECT event_id, event_type AS symbol, make_timestamp(CAST(epoch_us(ts) + ({US} - epoch_us(ts) % {US}) % {US} AS BIGINT)) AS at FROM events) SELECT e.event_id, e.symbol, e.at, b.mid_close FROM e ASOF JOIN bars b ON e.symbol = b.symbol AND e.at >= b.bar")
def asof_required(spark: SparkSession, sf: str) -> DataFrame:
    e = trades(spark, sf).select(F.col("agg_id").alias("event_id"), "symbol", T.bar_end(F.col("ts"), HOUR).alias("at"))
    return joins.asof_required(e, hourly(spark, sf).select("symbol", "bar", "mid_close"), "symbol", "at", "bar").drop("bar")


@REGISTER(f"WITH {BARS}, {PICKED}, n AS (SELECT symbol, bar, lead(bar) {LAG} AS nb, lead(mid_close) {LAG} AS nc FROM bars) SELECT event_id, ev.symbol, coalesce(nb, entry_ts) AS t0, coalesce(nc, entry_price) AS entry_price FROM ev ASOF LEFT JOIN n ON n.symbol = ev.symbol AND ev.entry_ts >= n.bar")
def delayed_entries(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.delayed(picked(spark, sf).withColumnRenamed("entry_ts", "t0"), hourly(spark, sf), 3_600_000)


LATE = "FILTER (bar >= entry_ts - INTERVAL 5 HOUR)"


def z_sql(c: str) -> str:
    return f"CASE WHEN count(*) {LATE} > 0 THEN CASE WHEN stddev_pop({c}) > 0 THEN (avg({c}) {LATE} - avg({c})) / stddev_pop({c}) ELSE 0 END END"


LAST5 = "FILTER (bar >= entry_ts - INTERVAL 5 HOUR AND back <= 5)"


@REGISTER(
    f"""WITH {BARS}, b AS (SELECT *, mid_close / lag(mid_close) {LAG} - 1 AS ret, mid_high - mid_low + 1e-12 AS rng FROM bars),
    e AS (SELECT DISTINCT event_type AS symbol, make_timestamp(CAST(epoch_us(ts) + ({US} - epoch_us(ts) % {US}) % {US} AS BIGINT)) AS entry_ts FROM events),
    j AS (SELECT e.symbol, entry_ts, b.* EXCLUDE (symbol), row_number() OVER v AS back, count(ret) OVER (v ROWS UNBOUNDED PRECEDING) AS moves FROM e JOIN b ON b.symbol = e.symbol AND bar >= entry_ts - INTERVAL 60 HOUR AND bar < entry_ts WINDOW v AS (PARTITION BY e.symbol, entry_ts ORDER BY bar DESC)),
    a AS (SELECT symbol, entry_ts, {', '.join(f"sum(ret) FILTER (bar >= entry_ts - INTERVAL 5 HOUR AND moves <= {k}) AS {n}" for k, n in ((1, 'ret_1m_last'), (2, 'ret_2m_sum'), (5, 'ret_5m_sum')))},
      CASE WHEN count(mid_close) {LAST5} = 5 THEN regr_slope(mid_close, -back) {LAST5} END AS ret_slope_5, stddev_pop(ret) {LATE} AS realized_vol_5, avg(abs(mid_close - mid_open) / rng) {LATE} AS body_ratio_mean,
      max(CASE WHEN mid_close IS NOT NULL THEN (mid_high - greatest(mid_open, mid_close)) / rng END) {LATE} AS upper_wick_ratio_max, max(CASE WHEN mid_close IS NOT NULL THEN (least(mid_open, mid_close) - mid_low) / rng END) {LATE} AS lower_wick_ratio_max,
      arg_max_null((mid_close - mid_low) / rng, bar) {LATE} AS close_location_last, avg((mid_close - mid_low) / rng) {LATE} AS close_location_mean, {z_sql('volume')} AS vol_zscore_5 FROM j GROUP BY ALL)
    SELECT e.symbol, e.entry_ts, {', '.join(f'round({c}, 6) AS {c}' for c in micro.CANDLES[:-1])}, CAST(NULL AS DOUBLE) AS trade_count_zscore_5 FROM e LEFT JOIN a ON a.symbol = e.symbol AND a.entry_ts = e.entry_ts"""
)
def intrabar_features(spark: SparkSession, sf: str) -> DataFrame:
    ev = picked(spark, sf).select("symbol", T.bar_end(F.col("entry_ts"), HOUR).alias("entry_ts"))
    return rounded(micro.candles_before(ev, hourly(spark, sf), 5, 60, HOUR), 6, *micro.CANDLES[:-1])


# --- regimes, confirmations, costs


def debounced_sql(raw: str, out: str) -> str:
    return f"CASE WHEN count(*) {over(2)} >= 2 AND min({raw}) {over(2)} = 1 THEN true WHEN count(*) {over(2)} >= 2 AND max({raw}) {over(2)} = 0 THEN false END AS {out}"


@REGISTER(
    f"""WITH RECURSIVE {BARS}, l AS (SELECT symbol, bar, last_value(mid_close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS p, row_number() {LAG} AS k FROM bars),
    e AS (SELECT symbol, bar, k, p AS f, p AS s FROM l WHERE k = 1 UNION ALL SELECT l.symbol, l.bar, l.k, (1 - 2.0 / 7) * f + 2.0 / 7 * p, (1 - 2.0 / 25) * s + 2.0 / 25 * p FROM e JOIN l ON l.symbol = e.symbol AND l.k = e.k + 1),
    r AS (SELECT symbol, bar, ln(p) - ln(lag(p) {LAG}) AS x FROM l), v AS (SELECT symbol, bar, CASE WHEN count(x) {over(6)} >= 6 THEN round(stddev_pop(x) {over(6)}, 12) END AS rv FROM r),
    t AS (SELECT symbol, bar, rv, CASE WHEN count(rv) {over(60)} >= 60 THEN quantile_cont(rv, 0.8) {over(60)} END AS thr FROM v),
    g AS (SELECT e.symbol, e.bar, f, s, rv, abs(f - s) / (rv + 1e-12) AS strength, coalesce(abs(f - s) / (rv + 1e-12) > 20, false)::INT AS trend, coalesce(rv >= thr, false)::INT AS hazard FROM e JOIN t ON t.symbol = e.symbol AND t.bar = e.bar),
    m AS (SELECT *, {debounced_sql('trend', 'tm')}, {debounced_sql('hazard', 'hm')} FROM g),
    q AS (SELECT *, coalesce(last_value(tm IGNORE NULLS) OVER u, false) AS trend_flag, coalesce(last_value(hm IGNORE NULLS) OVER u, false) AS hazard_flag FROM m WINDOW u AS (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING))
    SELECT symbol, bar, round(rv, 9) AS rv, round(f, 6) AS ema_fast, round(s, 6) AS ema_slow, round(least(strength, 1e6), 2) AS trend_strength, hazard_flag, trend_flag, CASE WHEN hazard_flag THEN 'HAZARD' WHEN trend_flag THEN 'TREND' ELSE 'RANGE' END AS regime FROM q"""
)
def regime_classes(spark: SparkSession, sf: str) -> DataFrame:
    c = classified(spark, sf)
    return c.select("symbol", "bar", F.round("rv", 9).alias("rv"), F.round("ema_fast", 6).alias("ema_fast"), F.round("ema_slow", 6).alias("ema_slow"), F.round(F.least("trend_strength", F.lit(1e6)), 2).alias("trend_strength"), "hazard_flag", "trend_flag", "regime")


RISK = f"""{BARS}, p AS (SELECT symbol || '-' || strftime(b.bar, '%d') AS event_id, b.bar AS t, (CAST(volume AS BIGINT) * 7 % 100) / 100.0 AS p, mid_high - mid_low AS ofi, mid_open AS lam, mid_close AS resid, mid_low AS repl, volume AS spread FROM bars b WHERE mid_close IS NOT NULL)"""


@REGISTER(
    f"""WITH {RISK}, f AS (SELECT *, p >= 0.6 AS high, lag(p) OVER w AS before, row_number() OVER w > 1 AS seen, abs(ofi) >= quantile_cont(abs(ofi), 0.9) OVER (PARTITION BY event_id ORDER BY t ROWS 2 PRECEDING) AS spike, lam < lag(lam) OVER w OR resid > lag(resid) OVER w AS absorbed, repl < lag(repl) OVER w OR spread > lag(spread) OVER w AS dropped FROM p WINDOW w AS (PARTITION BY event_id ORDER BY t)),
    g AS (SELECT *, sum((NOT high)::INT) OVER (PARTITION BY event_id ORDER BY t) AS island FROM f), r AS (SELECT *, sum(high::INT) OVER (PARTITION BY event_id, island ORDER BY t) AS run FROM g),
    y AS (SELECT event_id, t, CASE WHEN p >= 0.7 AND coalesce(spike AND seen AND absorbed, false) AND coalesce(seen AND dropped, false) THEN 'hazard_fail_fast' WHEN run >= 2 AND p > before THEN 'hazard_exit' END AS why FROM r)
    SELECT event_id, min(t) AS exit_ts, arg_min(why, t) AS exit_reason FROM y WHERE why IS NOT NULL GROUP BY event_id"""
)
def confirmed_exits(spark: SparkSession, sf: str) -> DataFrame:
    """Exits whose fail-fast asks for an absorption spike and a drop in replenishment."""
    b = hourly(spark, sf).where("mid_close is not null")
    rows = b.select(F.concat("symbol", F.lit("-"), F.date_format("bar", "dd")).alias("event_id"), F.col("bar").alias("t"), (F.col("volume").cast("long") * 7 % 100 / 100).alias("p"), (F.col("mid_high") - F.col("mid_low")).alias("ofi"), F.col("mid_open").alias("lambda"), F.col("mid_close").alias("resid_std"), F.col("mid_low").alias("repl_ratio"), F.col("volume").alias("spread_mean"))
    return regime.first_exits(rows, 0.6, 0.7, 2, rising=True, absorption=True, drop=True)


@REGISTER(f"WITH {LOG} SELECT event_id, gross_pnl - 2 * notional * 6.0 / 10000 AS net_pnl_est, (gross_pnl - 2 * notional * 6.0 / 10000 > 0)::INT AS label FROM log")
def cost_label(spark: SparkSession, sf: str) -> DataFrame:
    return labels.cost_label(log(spark, sf), 4.0, 2.0).select("event_id", "net_pnl_est", "label")


LABELLED = "k AS (SELECT event_id, symbol, exit_ts AS t1, entry_ts, CASE WHEN score < 0.3 THEN 'sl' WHEN score < 0.6 THEN 'pt' ELSE 'timeout' END AS event_type, score FROM log)"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("score") < 0.3, "sl").when(F.col("score") < 0.6, "pt").otherwise("timeout")
    return log(spark, sf).select("event_id", "symbol", F.col("exit_ts").alias("t1"), "entry_ts", kind.alias("event_type"), "score")


@REGISTER(f"WITH {LOG}, {LABELLED}, x AS (SELECT event_id, entry_ts + INTERVAL 2 DAY AS x FROM log WHERE score >= 0.5) SELECT k.event_id, CASE WHEN x < t1 THEN x ELSE t1 END AS t1, CASE WHEN x < t1 THEN 'hazard_exit' ELSE event_type END AS event_type, CASE WHEN x < t1 THEN 'hazard_exit' END AS exit_reason FROM k LEFT JOIN x ON x.event_id = k.event_id")
def early_exits(spark: SparkSession, sf: str) -> DataFrame:
    exits = log(spark, sf).where("score >= 0.5").select("event_id", T.shifted(F.col("entry_ts"), 2 * 86_400).alias("exit_ts"), F.lit("hazard_exit").alias("exit_reason"))
    return backtest.with_exits(labelled(spark, sf), exits, None).select("event_id", "t1", "event_type", "exit_reason")


@REGISTER(f"WITH {LOG}, d AS (SELECT symbol, date_trunc('day', exit_ts) AS bar, {exact('net_pnl')} AS pnl FROM log GROUP BY ALL), q AS (SELECT symbol, bar, 10000000 + CAST(sum(CAST(pnl AS DECIMAL(29,9))) {LAG} AS DOUBLE) AS equity FROM d), r AS (SELECT symbol, equity / max(equity) {LAG} - 1 AS dd, coalesce(equity / lag(equity) {LAG} - 1, 0) AS ret FROM q) SELECT symbol, round(avg(ret) / stddev_pop(ret), 6) AS sharpe, round(min(dd), 8) AS max_drawdown FROM r GROUP BY symbol")
def curve_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = log(spark, sf)
    days = t.select("symbol", F.date_trunc("day", "exit_ts").cast("timestamp_ntz").alias("bar")).distinct()
    t = t.withColumn("exit_ts", F.date_trunc("day", "exit_ts").cast("timestamp_ntz"))
    s = backtest.curve_summary(backtest.equity(t, days, 10_000_000.0))
    return s.select("symbol", F.round("sharpe", 6).alias("sharpe"), F.round("max_drawdown", 8).alias("max_drawdown"))


@REGISTER(f"WITH {LOG}, s AS (SELECT symbol, {exact('notional')} / 10000 AS turnover, count(*) AS n, count(*) FILTER (score >= 0.5) AS x, {exact('gross_pnl')} AS g, {exact('net_pnl')} AS p FROM log GROUP BY symbol) SELECT symbol, turnover > 50 AS churn, x / n > 0.4 AS over_exit, g > 0 AND p < 0 AS misaligned FROM s")
def summary_flags(spark: SparkSession, sf: str) -> DataFrame:
    t = log(spark, sf).withColumn("exit_reason", F.when(F.col("score") >= 0.9, "hazard_fail_fast").when(F.col("score") >= 0.5, "hazard_exit"))
    rows = backtest.trade_summary(t, ["symbol"]).join(backtest.hazard_exit_counts(t, ["symbol"]), "symbol")
    return backtest.flags(rows, 50.0, 0.4).select("symbol", "churn", "over_exit", "misaligned")


@REGISTER(f"WITH {LOG}, g AS (SELECT 'regime' AS \"by\", coalesce(regime, 'UNKNOWN') AS key, count(*) AS trades, {exact('net_pnl')} AS net_pnl FROM log GROUP BY ALL UNION ALL SELECT 'symbol', coalesce(symbol, 'UNKNOWN'), count(*), {exact('net_pnl')} FROM log GROUP BY ALL) (SELECT \"by\", key, trades, net_pnl, 'profit' AS side FROM g ORDER BY net_pnl DESC, \"by\", key LIMIT 3) UNION ALL (SELECT \"by\", key, trades, net_pnl, 'loss' FROM g ORDER BY net_pnl, \"by\", key LIMIT 3)")
def top_drivers(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.top_drivers(log(spark, sf), ["regime", "symbol"], 3)


@REGISTER(f"WITH {LOG} SELECT threshold, coalesce(regime, 'UNKNOWN') AS regime, count(*) AS trades, count(*) FILTER (score >= threshold) AS accepted, count(*) FILTER (score >= threshold) / count(*) AS accept_rate FROM log CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold) GROUP BY ALL")
def accept_rates(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.accept_rates(log(spark, sf), [0.25, 0.5, 0.75])


# --- models


@REGISTER("WITH s AS (SELECT vec_id, label % 2 AS y FROM embeddings), n AS (SELECT y, count(*) AS k, (SELECT count(*) FROM s) AS n FROM s GROUP BY y) SELECT vec_id, s.y, n / (2.0 * k) AS weight FROM s JOIN n ON n.y = s.y")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return models.class_weights(table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).alias("y")))


@REGISTER("SELECT event_id, round(CASE WHEN value <= 10 THEN 0.1 WHEN value <= 50 THEN 0.1 + (value - 10) / 40 * 0.4 WHEN value < 200 THEN 0.5 + (value - 50) / 150 * 0.4 ELSE 0.9 END, 9) AS p FROM events")
def interpolated(spark: SparkSession, sf: str) -> DataFrame:
    points = {"x": [10.0, 50.0, 200.0], "y": [0.1, 0.5, 0.9]}
    return table(spark, sf, "events").select("event_id", F.round(models.interpolated(F.col("value"), points), 9).alias("p"))


@REGISTER(f"WITH {LOG} SELECT event_id, CASE WHEN score < 0.4 THEN score ELSE 1 - score END AS score, CASE WHEN score < 0.4 THEN 'oof' ELSE 'full' END AS score_source FROM log")
def fused_scores(spark: SparkSession, sf: str) -> DataFrame:
    t = log(spark, sf)
    oof, full = t.where("score < 0.4").select("event_id", F.col("score").alias("p_hat")), t.select("event_id", (1 - F.col("score")).alias("p_hat"))
    return models.gated(models.fused(t.select("event_id"), oof, full)).select("event_id", "score", "score_source")


@REGISTER(f"WITH {LOG}, r AS (SELECT event_id, entry_ts, row_number() OVER (ORDER BY entry_ts) AS r, count(*) OVER () AS n FROM log) SELECT min(entry_ts) AS train_start, min(entry_ts) FILTER (r >= n * 7 // 10) AS train_end, min(entry_ts) FILTER (r >= n * 7 // 10 + 1) AS test_start, max(entry_ts) AS test_end FROM r")
def split_in_time(spark: SparkSession, sf: str) -> DataFrame:
    fold = models.split_at(log(spark, sf), "entry_ts", 0.7)
    names = ("train_start", "train_end", "test_start", "test_end")
    return spark.createDataFrame([tuple(fold[n] for n in names)], ", ".join(f"{n} timestamp_ntz" for n in names))


@REGISTER()
def meta_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold scores of trades by a calibrated model of what they earn after costs."""
    t = labels.cost_label(log(spark, sf), 4.0, 2.0).select("event_id", "entry_ts", "label", "net_pnl_est", "score", (F.col("notional") * F.col("score") + F.dayofweek("entry_ts")).alias("load"), F.month("entry_ts").cast("double").alias("month"))
    oof, _, _ = models.fit_meta(t, ["score", "load", "month"], [], calibration="isotonic")
    return oof.select("event_id", "label", "p_hat", "fold_id")


# --- samples and small statistics


@REGISTER(" UNION ALL ".join(f"SELECT '{c}' AS column, {exact(c)} / count({c}) AS mean, median({c}) AS median FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def column_middles(spark: SparkSession, sf: str) -> DataFrame:
    """Not rounded: exact sums over counts are the same doubles everywhere, and a mean may lie half-way between two roundings."""
    return quality_gates.middles(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@REGISTER("SELECT c_custkey, c_name FROM customer ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 100")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gates.sampled(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 7)


@REGISTER("WITH r AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS z FROM events) SELECT event_type, event_id, ts, CAST(a AS INT) AS place, false AS from_end FROM r WHERE a <= 3 UNION ALL SELECT event_type, event_id, ts, CAST(z AS INT), true FROM r WHERE z <= 3")
def first_and_last(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gates.first_and_last(table(spark, sf, "events").select("event_type", "event_id", "ts"), "event_type", ["ts", "event_id"], 3)


@REGISTER("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders")
def columns_by_name(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(*quality_gates.columns_by(o, ("o_order",), ("priority",)), ).drop("o_orderstatus")


# --- parsers


RAW = f"""raw AS (SELECT event_id, CASE WHEN user_id % 17 = 0 THEN NULL WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000000 * 1000 ELSE {MS} END AS t, CASE WHEN user_id % 13 = 0 THEN 'OTHER' ELSE 'BTC' END AS symbol,
  CASE user_id % 5 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' WHEN 2 THEN 'sell' WHEN 3 THEN 'buy' END AS side, CASE WHEN value < 5 THEN NULL ELSE value END AS price, CASE WHEN value > 300 THEN NULL ELSE user_id % 7 + 0.5 END::DOUBLE AS size FROM events)"""


def raw_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades as a file might have them: mixed units and cases, bad values, and every row twice."""
    e = table(spark, sf, "events")
    t = F.when(F.col("user_id") % 17 == 0, "bad").when(F.col("event_id") % 2 == 0, F.floor(T.micros(F.col("ts")) / 1_000_000).cast("string")).otherwise(ms().cast("string"))
    side = F.element_at(F.array(*map(F.lit, ("Buy", " SELL", "s", "b ", "?"))), (F.col("user_id") % 5 + 1).cast("int"))
    rows = e.select(t.alias(" Timestamp"), F.when(F.col("user_id") % 13 == 0, "other").otherwise("btc").alias("Symbol"), side.alias("side"), F.when(F.col("value") < 5, "-1").otherwise(F.col("value").cast("string")).alias("PRICE"), F.when(F.col("value") > 300, "").otherwise((F.col("user_id") % 7 + 0.5).cast("string")).alias("size"), F.col("event_id").cast("string").alias("trdMatchID"))
    return rows.unionByName(rows)


WINDOW = (1_704_067_200_000, 1_705_276_800_000)


@REGISTER(f"WITH {RAW} SELECT t AS ts_ms, symbol, side, price, size, CAST(event_id AS VARCHAR) AS trade_id FROM raw WHERE t IS NOT NULL AND symbol = 'BTC' AND side IS NOT NULL AND price > 0 AND size > 0 AND t >= {WINDOW[0]} AND t < {WINDOW[1]}")
def strict_trades(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.strict_trades(raw_trades(spark, sf), "btc", *WINDOW)


@REGISTER(f"WITH {RAW} SELECT 2 * count(*) AS seen, 2 * count(*) FILTER (t IS NULL) AS bad_ts, 2 * count(*) FILTER (price IS NULL) AS bad_price, 2 * count(*) FILTER (size IS NULL) AS bad_size, 2 * count(*) FILTER (side IS NULL) AS bad_side, 2 * count(*) FILTER (symbol <> 'BTC') AS bad_symbol, 2 * count(*) FILTER (t IS NOT NULL AND symbol = 'BTC' AND side IS NOT NULL AND price > 0 AND size > 0 AND t >= {WINDOW[0]} AND t < {WINDOW[1]}) AS valid, min(t) AS min_ts, max(t) AS max_ts FROM raw")
def strict_trade_counts(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.strict_counts(raw_trades(spark, sf), "btc", *WINDOW)


@REGISTER("SELECT epoch_us(o_orderdate) // 1000 + o_orderkey AS ts, o_totalprice AS open, o_totalprice + 1 AS high, o_totalprice - 1 AS low, o_totalprice AS close, CAST(o_custkey AS DOUBLE) AS volume, epoch_us(o_orderdate) // 1000 + o_orderkey + 60000 AS close_ts, o_totalprice * 2 AS quote_volume, o_custkey AS trade_count, 0.0::DOUBLE AS taker_buy_base, 0.0::DOUBLE AS taker_buy_quote, 'S' AS symbol FROM orders WHERE o_orderstatus <> 'P'")
def parse_klines(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    raw = o.select((ms("o_orderdate") + F.col("o_orderkey")).cast("string").alias("Open Time"), price.alias("Open"), (F.col("o_totalprice") + 1).alias("HIGH"), (F.col("o_totalprice") - 1).alias("low "), price.alias("close"), F.col("o_custkey").cast("string").alias("Vol"), (F.col("o_totalprice") * 2).alias("volCcyQuote"), F.col("o_custkey").alias("Number-of-Trades"))
    return parsers.klines(raw, "S")


@REGISTER(f"SELECT event_id AS agg_id, {MS} AS ts, value AS price, CAST(user_id AS DOUBLE) AS qty, user_id % 2 = 0 AS is_buyer_maker, 'S' AS symbol FROM events WHERE value >= 1")
def parse_agg_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Times in seconds, milliseconds, microseconds and nanoseconds, as strings."""
    e = table(spark, sf, "events")
    us = T.micros(F.col("ts"))
    millis = F.floor(us / 1000)
    t = F.when(F.col("user_id") % 3 == 0, millis.cast("string")).when(F.col("user_id") % 3 == 1, (millis * 1000).cast("string")).otherwise((millis * 1_000_000).cast("string"))
    price = F.when(F.col("value") < 1, "x").otherwise(F.col("value").cast("string"))
    raw = e.select(F.col("event_id").cast("string").alias("agg trade id"), t.alias("Transact-Time"), price.alias("price"), F.col("user_id").cast("string").alias("Quantity"), F.when(F.col("user_id") % 2 == 0, " True").otherwise("false").alias("is_buyer_maker"))
    return parsers.agg_trades(raw, "S")


@REGISTER(f"SELECT event_id AS agg_id, {MS} AS ts, value AS price, CAST(user_id AS DOUBLE) AS qty, user_id % 3 = 0 AS is_buyer_maker, 'S' AS symbol FROM events")
def parse_side_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades with a taker's side instead of the maker flag."""
    raw = table(spark, sf, "events").select(F.col("event_id").alias("id"), ms().alias("ts_ms"), F.col("value").alias("px"), F.col("user_id").alias("sz"), F.when(F.col("user_id") % 3 == 0, " Sell ").when(F.col("user_id") % 3 == 1, "buy").otherwise("?").alias("Side"))
    return parsers.agg_trades(raw, "S")


SIDED = "CASE WHEN user_id % 3 = 0 THEN 'sell' WHEN user_id % 3 = 1 THEN 'buy' ELSE '?' END"


def sided(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("user_id") % 3 == 0, " Sell ").when(F.col("user_id") % 3 == 1, "buy").otherwise("?")
    return table(spark, sf, "events").select(ms().alias("ts_ms"), F.col("value").alias("px"), F.col("user_id").alias("sz"), side.alias("Side"))


@REGISTER(f"SELECT row_number() OVER (ORDER BY {MS}, value, user_id, user_id % 3 = 0) AS agg_id, {MS} AS ts, value AS price, CAST(user_id AS DOUBLE) AS qty, user_id % 3 = 0 AS is_buyer_maker, 'S' AS symbol FROM events")
def numbered_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades without ids are numbered in order of time."""
    return parsers.numbered_trades(sided(spark, sf), "S")


@REGISTER(f"SELECT count(*) AS n, count(*) FILTER ({SIDED} = '?') AS unknown_side FROM events")
def unknown_sides(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.side_counts(sided(spark, sf))


@REGISTER(f"SELECT {MS} AS ts, event_id AS update_id, value - 1 AS bid_price, CAST(user_id AS DOUBLE) AS bid_qty, value + 1 AS ask_price, CAST(NULL AS DOUBLE) AS ask_qty, 'S' AS symbol FROM events")
def parse_book_ticker(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select(ms().cast("string").alias("event_time"), F.col("event_id").cast("string").alias("u"), (F.col("value") - 1).cast("string").alias("best_bid_price"), F.col("user_id").cast("string").alias("best_bid_qty"), (F.col("value") + 1).cast("string").alias("askPx"), F.lit("none").alias("askSz"))
    return parsers.book_ticker(raw, "S")


@REGISTER("SELECT epoch_us(o_orderdate) // 1000 AS ts, o_totalprice / 1e9 AS funding_rate, 'S' AS symbol FROM orders")
def parse_funding(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select(ms("o_orderdate").cast("string").alias("calc_time"), (F.col("o_totalprice") / 1e9).cast("string").alias("Last-Funding-Rate"))
    return parsers.funding_rate(raw, "S")


DEPTH = ["ts", "update_id", "bid_price_1", "bid_size_1", "ask_price_1", "ask_size_1", "bid_price_2", "ask_size_2", "bid_price_3"]


@REGISTER(f"SELECT {MS} AS ts, event_id AS update_id, value - 1 AS bid_price_1, CAST(user_id AS DOUBLE) AS bid_size_1, value + 1 AS ask_price_1, 2.0::DOUBLE AS ask_size_1, value - 2 AS bid_price_2, 3.0::DOUBLE AS ask_size_2, CAST(NULL AS DOUBLE) AS bid_price_3 FROM events")
def parse_book_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A column for each level, in two of the ways that they are named."""
    raw = table(spark, sf, "events").select(ms().alias("ts"), F.col("event_id").alias("last_update_id"), (F.col("value") - 1).alias("bid_px_1"), F.col("user_id").alias("bid_qty_1"), (F.col("value") + 1).alias("ask_px_1"), F.lit("2").alias("ask_sz_1"), (F.col("value") - 2).alias("bid2_price"), F.lit("3").alias("ask_2_size"))
    return parsers.book_depth(raw, "S").select(*DEPTH)


@REGISTER(f"SELECT {MS} AS ts, event_id AS update_id, value + 0.5 AS bid_price_1, 2.0::DOUBLE AS bid_size_1, value + 1 AS ask_price_1, 4.0::DOUBLE AS ask_size_1, value AS bid_price_2, 3.0::DOUBLE AS ask_size_2, CAST(NULL AS DOUBLE) AS bid_price_3 FROM events")
def parse_book_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lists of levels in no order, with an item that is none."""
    pair = lambda price, size: F.concat(F.lit('["'), price.cast("string"), F.lit(f'","{size}","0"]'))
    bids = F.concat(F.lit("["), pair(F.col("value"), 1), F.lit(","), pair(F.col("value") + 0.5, 2), F.lit(',["x","1"]]'))
    asks = F.concat(F.lit("["), pair(F.col("value") + 2, 3), F.lit(","), pair(F.col("value") + 1, 4), F.lit("]"))
    raw = table(spark, sf, "events").select(ms().alias("ts"), F.col("event_id").alias("seqId"), bids.alias("bids"), asks.alias("asks"))
    return parsers.book_depth(raw, "S").select(*DEPTH)


def book_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of snapshots and deltas as lines, one file a symbol, with lines that are broken."""
    e = table(spark, sf, "events")
    body = F.format_string('{"type":"%s","ts":%d,"data":{"s":"S","u":%d,"seq":%d,"b":[["%s","1"]],"a":[["%s","%d"]]}}', F.when(F.col("event_id") % 50 == 0, "snapshot").otherwise("delta"), ms(), F.col("event_id") + 2, F.col("event_id"), F.round("value", 0), F.round(F.col("value") + 1, 0), F.col("user_id") % 3)
    return e.select(F.col("event_type").alias("path"), F.col("event_id").alias("line"), F.when(F.col("user_id") % 19 == 0, '{"type":').otherwise(body).alias("value"), "ts")


@REGISTER(f"SELECT event_type AS path, count(*) AS lines, count(*) FILTER (user_id % 19 = 0) AS decode_errors, count(*) FILTER (user_id % 19 <> 0) AS records, count(*) FILTER (user_id % 19 <> 0 AND {MS} >= {WINDOW[0]} AND {MS} < {WINDOW[1]}) AS in_window, count(*) FILTER (user_id % 19 <> 0 AND event_id % 50 = 0) AS snapshots, count(*) FILTER (user_id % 19 <> 0 AND event_id % 50 <> 0) AS deltas, min({MS}) FILTER (user_id % 19 <> 0) AS min_ts, max({MS}) FILTER (user_id % 19 <> 0) AS max_ts FROM events GROUP BY 1")
def book_log_report(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.book_log_report(book_log(spark, sf), *WINDOW).drop("bytes", "units")


@REGISTER()
def book_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots and deltas of each symbol to book rows at most once an hour."""
    return folds.replay_book(parsers.book_events(book_log(spark, sf), F.col("path")), 2, 3_600_000)


# --- sources and sinks


def stored(spark: SparkSession, sf: str) -> tuple[str, dict]:
    """All trades, then those above 100 anew with another price, in a partitioned table; its root and manifest."""
    root = sinks.scratch(spark, "table")
    t = trades(spark, sf).select("agg_id", ms().alias("ts"), "price", "qty", "is_buyer_maker", "symbol")
    sinks.upsert(t, root, "agg_trades", "x", "spot")
    return root, sinks.upsert(t.where("price > 100").withColumn("price", F.col("price") + 1), root, "agg_trades", "x", "spot")


@REGISTER(f"WITH {TRADES} SELECT agg_id, {MS} AS ts, CASE WHEN price > 100 THEN price + 1 ELSE price END AS price, symbol FROM trades WHERE {MS} >= {WINDOW[0]} AND {MS} < {WINDOW[1]}")
def upserted_window(spark: SparkSession, sf: str) -> DataFrame:
    return files.partitioned(spark, f"{stored(spark, sf)[0]}/agg_trades", *WINDOW, ["agg_id", "ts", "price", "symbol"], exchange="x", market="spot")


@REGISTER("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS rows, min(epoch_us(ts) // 1000) AS start, max(epoch_us(ts) // 1000) AS end FROM events GROUP BY 1")
def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    parts = stored(spark, sf)[1]["partitions"]
    return spark.createDataFrame([(p["date"], p["rows"], p["start"], p["end"]) for p in parts], "date string, rows long, start long, end long")


@REGISTER("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def csv_table(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch(spark, "table") + ".csv"
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").write.option("header", True).csv(path)
    return files.table(spark, path)


@REGISTER("SELECT o_orderkey AS k, o_orderpriority AS p, o_totalprice AS v FROM orders")
def json_table(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch(spark, "table")
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v")).write.json(path)
    return files.json_rows(spark, path, "k long, p string, v double")
