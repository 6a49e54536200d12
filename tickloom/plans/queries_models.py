"""Regimes, labels, policies, backtests, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeops as T
from ..functions.stage import staged
from ..operators import backtest, labels, models, regime
from ..sources import parsers
from .queries_joins import PICKED, picked
from .register import Register
from .views import HOUR, TRADES, bars_sql, book, exact, hourly, trades

REGISTER = Register()
US = HOUR * 1_000_000
BARS = bars_sql(US)
LAG = "OVER (PARTITION BY symbol ORDER BY bar)"


def over(n: int, by: str = "symbol", order: str = "bar") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@REGISTER(
    f"""WITH {BARS}, l AS (SELECT symbol, bar, last_value(mid_close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS p FROM bars),
    r AS (SELECT symbol, bar, ln(p) - ln(lag(p) {LAG}) AS x FROM l),
    v AS (SELECT symbol, bar, CASE WHEN count(x) {over(6)} >= 6 THEN round(stddev_pop(x) {over(6)}, 12) END AS rv FROM r),
    t AS (SELECT symbol, bar, rv, CASE WHEN count(rv) {over(24)} >= 24 THEN quantile_cont(rv, 0.8) {over(24)} END AS thr FROM v),
    f AS (SELECT *, coalesce(rv >= thr, false)::INT AS raw FROM t),
    m AS (SELECT *, CASE WHEN count(*) {over(2)} >= 2 AND min(raw) {over(2)} = 1 THEN true WHEN count(*) {over(2)} >= 2 AND max(raw) {over(2)} = 0 THEN false END AS mark FROM f)
    SELECT symbol, bar, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING), false) AS hazard_flag FROM m"""
)
def regime_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    b = hourly(spark, sf).withColumn("mid_close", T.fill_forward(F.col("mid_close"), T.ordered("symbol", "bar")))
    return regime.hazard_flags(b, 6, 0.8, threshold_window=24).select("symbol", "bar", "hazard_flag")


def classified(spark: SparkSession, sf: str) -> DataFrame:
    w = T.ordered("symbol", "bar")
    b = hourly(spark, sf)
    for c in ("mid_open", "mid_high", "mid_low", "mid_close"):
        b = b.withColumn(c, T.fill_forward(F.col(c), w))
    return staged(regime.classify(b, window=6, q=0.8, fast=6, slow=24, strength=20.0), "classified")


@REGISTER()
def entries_by_regime(spark: SparkSession, sf: str) -> DataFrame:
    return regime.entries(classified(spark, sf), 10, 1.0, 8, 1.0)


@REGISTER(f"WITH {PICKED} SELECT event_id AS id, substr(sha1(concat_ws('|', symbol, strftime(entry_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00', '1', 'range_lower_touch')), 1, 12) AS event_id FROM ev")
def event_id_sha1(spark: SparkSession, sf: str) -> DataFrame:
    return picked(spark, sf).select(F.col("event_id").alias("id"), regime.event_id(F.col("symbol"), F.col("entry_ts"), F.lit(1), F.lit("range_lower_touch")).alias("event_id"))


def barrier_sql(horizon: str, pt: str, sl: str) -> str:
    return f"""WITH {BARS}, {PICKED}, e AS (SELECT ev.event_id, ev.symbol, ev.entry_ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, entry_price AS p0, b.bar AS b0, {horizon} AS h, {pt} AS pt, {sl} AS sl FROM ev ASOF JOIN bars b ON b.symbol = ev.symbol AND ev.entry_ts >= b.bar),
    k AS (SELECT *, p0 * (1 + side * pt * 0.25) AS ptp, p0 * (1 - side * sl * 0.25) AS slp FROM e),
    j AS (SELECT k.*, bars.bar, CASE WHEN CASE WHEN side > 0 THEN mid_low <= slp ELSE mid_high >= slp END THEN 'sl' WHEN CASE WHEN side > 0 THEN mid_high >= ptp ELSE mid_low <= ptp END THEN 'pt' END AS hit
      FROM k LEFT JOIN bars ON bars.symbol = k.symbol AND bars.bar > k.entry_ts AND bars.bar <= k.entry_ts + to_hours(h))
    SELECT event_id, coalesce(arg_min(hit, bar) FILTER (hit IS NOT NULL), 'timeout') AS event_type, coalesce(min(bar) FILTER (hit IS NOT NULL), max(bar), any_value(entry_ts + to_hours(h))) AS t1 FROM j GROUP BY event_id"""


def barrier_events(spark: SparkSession, sf: str) -> DataFrame:
    return picked(spark, sf).withColumnRenamed("entry_ts", "t0").withColumn("side", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1))


@REGISTER(barrier_sql("8", "1.0", "2.0"))
def triple_barrier(spark: SparkSession, sf: str) -> DataFrame:
    b = hourly(spark, sf)
    sigma = b.select("symbol", "bar", F.lit(0.25).alias("sigma"))
    return labels.triple_barrier(barrier_events(spark, sf), b, sigma, 8 * HOUR, 1.0, 2.0).select("event_id", "event_type", "t1")


@REGISTER(barrier_sql("CASE WHEN ev.symbol = 'click' THEN 4 ELSE 8 END", "CASE WHEN ev.symbol = 'click' THEN 2.0 ELSE 1.0 END", "1.0"))
def triple_barrier_by_group(spark: SparkSession, sf: str) -> DataFrame:
    b = hourly(spark, sf)
    ev = barrier_events(spark, sf).withColumn("regime", F.when(F.col("symbol") == "click", "RANGE").otherwise("TREND"))
    rules = {"RANGE": {"horizon": 4 * HOUR, "pt": 2.0}, "TREND": {"horizon": 8 * HOUR}}
    found = labels.triple_barrier(ev, b, b.select("symbol", "bar", F.lit(0.25).alias("sigma")), 8 * HOUR, 1.0, 1.0, overrides=rules)
    return found.select("event_id", "event_type", "t1")


@REGISTER(f"""WITH {BARS}, {PICKED}, m AS (SELECT event_id, symbol, entry_price * 0.8 AS sl, unnest(generate_series(entry_ts + INTERVAL 1 HOUR, entry_ts + INTERVAL 5 HOUR, INTERVAL 1 HOUR)) AS t, entry_ts + INTERVAL 5 HOUR AS exit_ts FROM ev)
    SELECT m.event_id, m.t, least(t + INTERVAL 2 HOUR, exit_ts) AS horizon_end_ts, CASE WHEN min(mid_low) <= sl THEN 1 WHEN min(mid_low) > sl THEN 0 END AS y FROM m LEFT JOIN bars ON bars.symbol = m.symbol AND bar > t AND bar <= least(t + INTERVAL 2 HOUR, exit_ts) GROUP BY m.event_id, m.t, exit_ts, sl""")
def hazard_dataset(spark: SparkSession, sf: str) -> DataFrame:
    t = picked(spark, sf).select("event_id", "symbol", "entry_ts", "entry_price", F.lit(1).alias("side"), T.shifted(F.col("entry_ts"), 5 * HOUR).alias("exit_ts"), (F.col("entry_price") * 0.8).alias("sl_price"))
    return labels.hazard_rows(t, hourly(spark, sf), 2 * HOUR, HOUR).select("event_id", "t", "horizon_end_ts", "y")


@REGISTER(
    f"""WITH {BARS}, p AS (SELECT symbol, bar AS t, (CAST(volume AS BIGINT) * 7 % 100) / 100.0 AS p FROM bars), c AS (SELECT symbol || '-' || strftime(t, '%d') AS event_id, t, p FROM p),
    f AS (SELECT *, p >= 0.6 AS high, lag(p) OVER (PARTITION BY event_id ORDER BY t) AS before FROM c), g AS (SELECT *, sum((NOT high)::INT) OVER (PARTITION BY event_id ORDER BY t) AS island FROM f),
    r AS (SELECT *, sum(high::INT) OVER (PARTITION BY event_id, island ORDER BY t) AS run FROM g),
    w AS (SELECT event_id, t, CASE WHEN p >= 0.97 THEN 'hazard_fail_fast' WHEN run >= 2 AND p > before THEN 'hazard_exit' END AS why FROM r)
    SELECT event_id, min(t) AS exit_ts, arg_min(why, t) AS exit_reason FROM w WHERE why IS NOT NULL GROUP BY event_id"""
)
def policy_first_exit(spark: SparkSession, sf: str) -> DataFrame:
    p = hourly(spark, sf).select(F.concat("symbol", F.lit("-"), F.date_format("bar", "dd")).alias("event_id"), F.col("bar").alias("t"), (F.col("volume").cast("long") * 7 % 100 / 100).alias("p"))
    return regime.first_exits(p, 0.6, 0.97, 2, rising=True)


@REGISTER(f"WITH {BARS} SELECT symbol, bar, CASE WHEN p >= 0.8 THEN 'exit' WHEN p >= 0.6 THEN 'reduce' WHEN p > 0.3 THEN 'no_add' ELSE 'hold' END AS action, p <= 0.3 AS may_add FROM (SELECT symbol, bar, (CAST(volume AS BIGINT) * 7 % 100) / 100.0 AS p FROM bars)")
def signal_actions(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("volume").cast("long") * 7 % 100 / 100
    return hourly(spark, sf).select("symbol", "bar", regime.recommend(p, 0.8, 0.6, 0.3).alias("action"), regime.may_add(p, 0.3).alias("may_add"))


LOG = """log AS (SELECT o_orderkey AS event_id, o_orderpriority AS symbol, o_orderdate AS entry_ts, o_orderdate + to_days(CAST(o_custkey % 5 + 1 AS INT)) AS exit_ts, o_orderstatus AS regime,
  round((o_totalprice - 150000) / 1000, 5) AS gross_pnl, 3.0 AS fees, 1.5 AS slippage, 1000.0 AS notional, round((o_totalprice - 150000) / 1000, 5) - 4.5 AS net_pnl, o_custkey % 100 / 100.0 AS score FROM orders)"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    gross = F.round((F.col("o_totalprice") - 150000) / 1000, 5)
    return o.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("entry_ts"), T.from_micros(T.micros(F.col("o_orderdate")) + (F.col("o_custkey") % 5 + 1) * 86_400_000_000).alias("exit_ts"), F.col("o_orderstatus").alias("regime"), gross.alias("gross_pnl"), F.lit(3.0).alias("fees"), F.lit(1.5).alias("slippage"), F.lit(1000.0).alias("notional"), (gross - 4.5).alias("net_pnl"), (F.col("o_custkey") % 100 / 100).alias("score"))


@REGISTER(f"WITH {LOG} SELECT symbol, {exact('net_pnl')} AS pnl_net, {exact('gross_pnl')} AS pnl_gross, {exact('fees')} AS total_fees, {exact('slippage')} AS total_slippage, count(*) FILTER (net_pnl > 0) / count(*) AS win_rate, coalesce(CAST(sum(CAST(net_pnl AS DECIMAL(29,9))) FILTER (net_pnl > 0) AS DOUBLE) / count(*) FILTER (net_pnl > 0), 0) AS avg_win, coalesce(CAST(sum(CAST(net_pnl AS DECIMAL(29,9))) FILTER (net_pnl < 0) AS DOUBLE) / count(*) FILTER (net_pnl < 0), 0) AS avg_loss, count(*) AS trade_count, {exact('notional')} / 10000 AS turnover FROM log GROUP BY symbol")
def trade_summary(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.trade_summary(log(spark, sf), ["symbol"])


@REGISTER(f"WITH {LOG}, d AS (SELECT symbol, date_trunc('day', exit_ts) AS bar, {exact('net_pnl')} AS pnl FROM log GROUP BY ALL), q AS (SELECT symbol, bar, 10000000 + CAST(sum(CAST(pnl AS DECIMAL(29,9))) {LAG} AS DOUBLE) AS equity FROM d) SELECT symbol, bar, round(equity, 5) AS equity, round(equity / max(equity) {LAG} - 1, 8) + 0.0 AS drawdown FROM q")
def equity_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    t = log(spark, sf)
    days = t.select("symbol", F.date_trunc("day", "exit_ts").cast("timestamp_ntz").alias("bar")).distinct()
    t = t.withColumn("exit_ts", F.date_trunc("day", "exit_ts").cast("timestamp_ntz"))
    d = backtest.drawdown(backtest.equity(t, days, 10_000_000.0))
    return d.select("symbol", "bar", F.round("equity", 5).alias("equity"), (F.round("drawdown", 8) + F.lit(0.0)).alias("drawdown"))


@REGISTER(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net_pnl, event_id) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM log), w AS (SELECT symbol, date_trunc('week', exit_ts) AS week, {exact('net_pnl')} AS pnl FROM log GROUP BY ALL), m AS (SELECT symbol, min(pnl) AS worst_week_pnl FROM w GROUP BY symbol) SELECT r.symbol, round(quantile_cont(net_pnl, 0.05), 9) AS worst_5pct_trade, CAST(sum(CAST(net_pnl AS DECIMAL(29,9))) FILTER (r <= greatest(1, ceil(0.05 * n))) AS DOUBLE) / count(*) FILTER (r <= greatest(1, ceil(0.05 * n))) AS expected_shortfall_95, any_value(worst_week_pnl) AS worst_week_pnl FROM r JOIN m ON m.symbol = r.symbol GROUP BY r.symbol")
def tail_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = backtest.tail(log(spark, sf), ["symbol"])
    return t.withColumn("worst_5pct_trade", F.round("worst_5pct_trade", 9))


@REGISTER(f"WITH {LOG} SELECT strftime(date_trunc('week', exit_ts), '%Y-%m-%d') AS key, count(*) AS trades, {exact('net_pnl')} AS net_pnl FROM log GROUP BY 1")
def pnl_by_week(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.pnl_by(log(spark, sf), "week")


@REGISTER(f"WITH {LOG} SELECT coalesce(regime, 'UNKNOWN') AS key, count(*) AS trades, {exact('net_pnl')} AS net_pnl FROM log GROUP BY 1")
def pnl_by_regime(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.pnl_by(log(spark, sf), "regime")


@REGISTER(f"WITH {LOG}, m AS (SELECT symbol, (epoch_us(exit_ts) - epoch_us(entry_ts)) / 60000000.0 AS m FROM log) SELECT symbol, {exact('m')} / count(*) AS mean_min, median(m) AS median_min, quantile_cont(m, 0.95) AS p95_min FROM m GROUP BY symbol")
def holding_stats(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.holding(log(spark, sf), ["symbol"])


@REGISTER(f"WITH {LOG}, g AS (SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (1, 1), (2, 2), (3, 3), (4, 4)) AS t(fee_bps, slip_bps)) SELECT fee_bps, slip_bps, count(*) AS trades, {exact('gross_pnl - 2 * notional * (fee_bps + slip_bps) / 10000')} AS net_pnl, count(*) FILTER (gross_pnl - 2 * notional * (fee_bps + slip_bps) / 10000 > 0) AS wins FROM log CROSS JOIN g GROUP BY ALL")
def cost_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.cost_sweep(log(spark, sf), [(k, k) for k in range(5)])


THRESHOLDS = f"{LOG}, s AS (SELECT t AS threshold, count(*) AS accepted, {exact('net_pnl')} AS net_pnl, {exact('fees')} AS fees, count(*) / (SELECT count(*) FROM log) AS accept_rate FROM log CROSS JOIN (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS t) WHERE score >= t GROUP BY t)"


@REGISTER(f"WITH {THRESHOLDS} SELECT * FROM s")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.threshold_sweep(log(spark, sf), [0.1, 0.3, 0.5, 0.7, 0.9])


@REGISTER(f"WITH {THRESHOLDS} SELECT threshold, accepted FROM s WHERE accepted >= greatest(20, 0.2 * (SELECT count(*) FROM log)) ORDER BY net_pnl / accepted DESC, fees, threshold LIMIT 1")
def threshold_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    t = log(spark, sf)
    return backtest.recommended(backtest.threshold_sweep(t, [0.1, 0.3, 0.5, 0.7, 0.9]), t.count()).select("threshold", "accepted")


@REGISTER("""WITH r AS (SELECT min(ts) AS a, max(ts) AS b FROM events), k AS (SELECT i AS fold_id, a + to_days(CAST(i * 3 AS INT)) AS train_start, b FROM r, range(0, 100) t(i)), f AS (SELECT fold_id, train_start, train_start + INTERVAL 10 DAY AS train_end, train_start + INTERVAL 10 DAY + INTERVAL 60 MINUTE AS test_start, train_start + INTERVAL 15 DAY + INTERVAL 60 MINUTE AS test_end, b FROM k)
    SELECT fold_id, train_start, train_end, test_start, test_end FROM f WHERE test_end <= b""")
def walkforward_folds(spark: SparkSession, sf: str) -> DataFrame:
    a, b = spark.read.parquet(f"{sf}/events.parquet").agg(F.min("ts"), F.max("ts")).first()
    return backtest.folds(spark, a, b, 10, 5, 3, 60)


FOLDS = "f AS (SELECT i AS fold_id, a + to_days(CAST(i * 200 AS INT)) + INTERVAL 400 DAY + INTERVAL 60 MINUTE AS s, a + to_days(CAST(i * 200 AS INT)) + INTERVAL 600 DAY + INTERVAL 60 MINUTE AS e FROM (SELECT min(entry_ts) AS a, max(entry_ts) AS b FROM log), range(0, 100) t(i) WHERE a + to_days(CAST(i * 200 AS INT)) + INTERVAL 600 DAY + INTERVAL 60 MINUTE <= b)"


@REGISTER(f"WITH {LOG}, {FOLDS}, g AS (SELECT unnest([1.0, 2.0])::DOUBLE AS fee_mult) SELECT fold_id, fee_mult, 1.0::DOUBLE AS slippage_mult, count(*) AS trade_count, {exact('gross_pnl - fees * fee_mult - slippage')} AS pnl_net FROM log JOIN f ON entry_ts >= s AND entry_ts <= e CROSS JOIN g GROUP BY ALL")
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    t = log(spark, sf)
    a, b = t.agg(F.min("entry_ts"), F.max("entry_ts")).first()
    found = backtest.walk_forward(t, backtest.folds(spark, a, b, 400, 200, 200, 60), [1.0, 2.0], [1.0])
    return found.select("fold_id", "fee_mult", "slippage_mult", "trade_count", "pnl_net")


SCORES = "s AS (SELECT vec_id, label % 2 AS y, 1 / (1 + exp(-3 * CAST(embedding[1] AS DOUBLE))) AS p FROM embeddings)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", (F.col("label") % 2).alias("y"), models.sigmoid(3 * F.get("embedding", F.lit(0)).cast("double")).alias("p"))


@REGISTER(f"WITH {SCORES} SELECT vec_id, y, round(p, 9) AS p FROM s")
def logit_score(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).withColumn("p", F.round("p", 9))


@REGISTER(f"WITH {SCORES}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auc FROM r")
def auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    return models.auc(scores(spark, sf), "p", "y").select(F.round("auc", 9).alias("auc"))


@REGISTER(f"WITH {SCORES}, c AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY p), d AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn FROM c) SELECT round(sum(pos * cp / cn) / sum(pos), 9) AS ap FROM d")
def avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    return models.average_precision(scores(spark, sf), "p", "y").select(F.round("ap", 9).alias("ap"))


@REGISTER(f"WITH {SCORES} SELECT round(avg(pow(p - y, 2)), 9) AS brier FROM s")
def brier(spark: SparkSession, sf: str) -> DataFrame:
    return models.brier(scores(spark, sf), "p", "y").select(F.round("brier", 9).alias("brier"))


@REGISTER(f"WITH {SCORES} SELECT CAST(ceil(p * 10) AS INT) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM s WHERE p > 0 AND p <= 1 GROUP BY 1")
def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    return models.reliability(scores(spark, sf), "p", "y").select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


@REGISTER(f"WITH {SCORES} SELECT round(count(*) FILTER (p >= 0.5 AND y = 1) / count(*) FILTER (p >= 0.5), 9) AS precision, round(count(*) FILTER (p >= 0.5 AND y = 1) / count(*) FILTER (y = 1), 9) AS recall FROM s")
def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    return models.precision_recall(scores(spark, sf), "p", "y", 0.5).select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@REGISTER(f"WITH {SCORES}, c AS (SELECT quantile_cont(p, 0.9) AS cut, avg(y) AS base FROM s) SELECT round(avg(y) FILTER (p >= cut) / max(base), 9) AS lift FROM s, c")
def lift_decile(spark: SparkSession, sf: str) -> DataFrame:
    return models.lift(scores(spark, sf), "p", "y").select(F.round("lift", 9).alias("lift"))


@REGISTER(f"WITH {TRADES} SELECT agg_id, list_sort([[price - 0.5, qty], [price, qty + 1], [price + 0.5, qty + 2]], 'DESC')[1][1] AS best_bid, CAST(3 AS INT) AS n FROM trades")
def json_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level lists as exchanges send them, with a bad item that is skipped."""
    t = trades(spark, sf)
    text = F.concat(F.lit('[["'), F.col("price") - 0.5, F.lit('","'), F.col("qty"), F.lit('"],["'), F.col("price"), F.lit('","'), F.col("qty") + 1, F.lit('"],["x"],["'), F.col("price") + 0.5, F.lit('","'), F.col("qty") + 2, F.lit('"]]'))
    levels = t.select("agg_id", parsers.level_list(text).alias("l"))
    return levels.select("agg_id", F.get(parsers.top_levels(F.col("l"), 2, bids=True), F.lit(0))["price"].alias("best_bid"), F.size("l").alias("n"))


@REGISTER()
def backtest_by_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Bars to regimes, entries, barrier labels and trades that don't overlap."""
    c = classified(spark, sf)
    ev = regime.entries(c, 10, 1.0, 8, 1.0).select("event_id", "symbol", F.col("entry_ts").alias("t0"), "side", "entry_price", "regime", "reason")
    sigma = labels.volatility(c, "ewma", 20)
    labelled = labels.triple_barrier(ev, c, sigma, 6 * HOUR, 0.5, 0.5, overrides={"TREND": {"horizon": 12 * HOUR, "pt": 1.0}})
    return backtest.trade_log(labelled, c).select("event_id", "symbol", "entry_ts", "exit_ts", "side", "entry_price", "exit_price", "gross_pnl", "net_pnl", "event_type", "exit_reason", "regime")


@REGISTER()
def hazard_model(spark: SparkSession, sf: str) -> DataFrame:
    """A calibrated model of the labels on all dimensions, fitted and applied."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = e.select(F.size("embedding")).first()[0]
    e = e.select("vec_id", (F.col("label") % 2).alias("y"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(n)))
    return models.scored(e, models.fitted(e, [f"f{i}" for i in range(n)], calibration="isotonic", max_iter=25)).select("vec_id", "y", "p_hat")
