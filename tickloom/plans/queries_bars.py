"""Bars, aggregates, quality gates and rolling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeops as T
from ..operators import bars, quality_gates
from .register import Register
from .views import BOOK, HOUR, TRADES, bars_sql, book, end_of, exact, hourly, trades

REGISTER = Register()
US = HOUR * 1_000_000
BARS = bars_sql(US)


@REGISTER(f"WITH {BARS} SELECT * FROM bars")
def time_bars_1h(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf)


WIDE = f"""wide AS (SELECT symbol, {end_of('bar', 4 * US)} AS bar, arg_min(mid_open, bar) FILTER (mid_open IS NOT NULL) AS mid_open, max(mid_high) AS mid_high, min(mid_low) AS mid_low,
  arg_max(mid_close, bar) FILTER (mid_close IS NOT NULL) AS mid_close, {exact('volume')} AS volume, {exact('vwap * volume')} / nullif({exact('volume')}, 0) AS vwap FROM bars GROUP BY ALL)"""


@REGISTER(f"WITH {BARS}, {WIDE} SELECT symbol, bar, mid_open, mid_high, mid_low, mid_close, coalesce(volume, 0) AS volume, round(vwap, 6) AS vwap FROM wide")
def time_bars_4h_from_1h(spark: SparkSession, sf: str) -> DataFrame:
    return bars.resample(hourly(spark, sf), 4 * HOUR).withColumn("vwap", F.round("vwap", 6))


@REGISTER(
    f"""WITH {BOOK}, q AS (SELECT symbol, ts, {end_of('ts', US)} AS bar, (bid_price_1 + ask_price_1) / 2 AS mid, ask_price_1 - bid_price_1 AS spread,
      (ask_price_1 * bid_size_1 + bid_price_1 * ask_size_1) / (bid_size_1 + ask_size_1) AS micro FROM book),
    t AS (SELECT symbol, {end_of('ts', US)} AS bar, {exact('qty')} AS volume FROM trades GROUP BY ALL),
    b AS (SELECT symbol, bar, arg_min(mid, (ts, mid)) AS mid_open, max(mid) AS mid_high, min(mid) AS mid_low, arg_max(mid, (ts, mid)) AS mid_close, {exact('spread')} / count(*) AS spread_mean, arg_max(micro, (ts, mid)) AS microprice_close FROM q GROUP BY ALL),
    s AS (SELECT symbol, unnest(generate_series(min(bar), max(bar), to_microseconds({US}))) AS bar FROM b GROUP BY symbol)
    SELECT s.symbol, s.bar, coalesce(volume, 0) AS volume, mid_open, mid_high, mid_low, mid_close, round(spread_mean, 9) AS spread_mean, round(microprice_close, 9) AS microprice_close
    FROM s LEFT JOIN b ON s.symbol = b.symbol AND s.bar = b.bar LEFT JOIN t ON s.symbol = t.symbol AND s.bar = t.bar"""
)
def time_bars_with_book(spark: SparkSession, sf: str) -> DataFrame:
    top = book(spark, sf, 1).select("symbol", "ts", *(F.col(f"{s}_{p}_1").alias(o) for s, p, o in (("bid", "price", "bid"), ("ask", "price", "ask"), ("bid", "size", "bid_size"), ("ask", "size", "ask_size"))))
    found = bars.time_bars(trades(spark, sf), HOUR, top).drop("vwap")
    return found.withColumn("spread_mean", F.round("spread_mean", 9)).withColumn("microprice_close", F.round("microprice_close", 9))


KLINES = f"""klines AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, CAST(sum(o_custkey % 7) AS DOUBLE) AS volume, {exact('o_totalprice * (o_custkey % 7)')} AS quote_volume FROM orders GROUP BY ALL)"""


def klines(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    at = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.min_by("o_totalprice", at).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", at).alias("close"), F.sum(F.col("o_custkey") % 7).cast("double").alias("volume"), T.exact_sum(F.col("o_totalprice") * (F.col("o_custkey") % 7)).alias("quote_volume"))


@REGISTER(f"WITH {KLINES} SELECT symbol, ts AS bar, open AS mid_open, high AS mid_high, low AS mid_low, close AS mid_close, volume, CASE WHEN volume > 0 THEN quote_volume / volume ELSE close END AS vwap FROM klines")
def klines_to_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars.bars_from_klines(klines(spark, sf))


@REGISTER("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def dedupe_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return quality_gates.keep_last(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@REGISTER("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return quality_gates.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts")


@REGISTER("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity").dropDuplicates()


@REGISTER("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gates.key_violations(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey", "l_partkey"])


@REGISTER(f"WITH {TRADES} SELECT symbol, ts, prev_ts, epoch_us(ts) - epoch_us(prev_ts) AS gap_us FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, agg_id) AS prev_ts FROM trades) WHERE epoch_us(ts) - epoch_us(prev_ts) > 3600000000")
def gap_check(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gates.gaps(trades(spark, sf), "symbol", "ts", "agg_id", HOUR)


@REGISTER("SELECT coalesce(event_type, 'UNKNOWN') AS key, " + exact("value") + " AS total FROM events GROUP BY ALL")
def group_sum_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gates.sum_by(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value")


@REGISTER(f"WITH {TRADES} SELECT symbol, count(DISTINCT date_trunc('minute', ts)) AS minutes, CAST(CEIL((epoch_us(max(ts)) - epoch_us(min(ts)) + 1) / 60000000.0) AS BIGINT) AS expected, count(DISTINCT date_trunc('minute', ts)) / CEIL((epoch_us(max(ts)) - epoch_us(min(ts)) + 1) / 60000000.0) AS ratio FROM trades GROUP BY symbol")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gates.minute_coverage(trades(spark, sf), "symbol", "ts")


@REGISTER(f"WITH {TRADES} SELECT symbol, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM trades GROUP BY ALL")
def rows_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gates.rows_per_day(trades(spark, sf), "symbol", "ts")


@REGISTER(f"WITH {TRADES} SELECT symbol, median(g) / 1000000.0 AS median_gap_s FROM (SELECT symbol, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, agg_id)) AS g FROM trades) WHERE g IS NOT NULL GROUP BY symbol")
def sampling_interval(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gates.median_gap(trades(spark, sf), "symbol", "ts", "agg_id")


@REGISTER(f"WITH {BARS} SELECT CAST(bar AS DATE) AS day, avg(CASE WHEN mid_close IS NULL THEN 1.0 ELSE 0 END) AS mid_close, avg(CASE WHEN vwap IS NULL THEN 1.0 ELSE 0 END) AS vwap FROM bars GROUP BY ALL")
def missingness(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gates.missing_share(hourly(spark, sf).withColumn("day", F.to_date("bar")), ["mid_close", "vwap"], ["day"])


@REGISTER(
    f"""WITH {BARS}, v AS (SELECT symbol, bar, volume AS x, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
    m AS (SELECT symbol, avg(x) AS mean, stddev_pop(x) AS sd FROM v GROUP BY symbol)
    SELECT v.symbol, round(max(mean), 6) AS mean, round(max(sd), 6) AS std, min(x) AS min, max(x) AS max, avg(CASE WHEN abs(x - mean) > 5 * sd THEN 1.0 ELSE 0 END) AS outlier_share,
      round((avg(x) FILTER (r > n // 2) - avg(x) FILTER (r <= n // 2)) / nullif(max(sd), 0), 6) AS drift_z FROM v JOIN m ON m.symbol = v.symbol GROUP BY v.symbol"""
)
def feature_health(spark: SparkSession, sf: str) -> DataFrame:
    out = quality_gates.health(hourly(spark, sf), "symbol", "bar", "volume")
    return out.select("symbol", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", "max", "outlier_share", F.round("drift_z", 6).alias("drift_z"))


@REGISTER("SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(min(date_trunc('day', o_orderdate)), max(date_trunc('day', o_orderdate)), INTERVAL 1 DAY)) AS d FROM orders WHERE o_orderpriority = '1-URGENT') WHERE d NOT IN (SELECT date_trunc('day', o_orderdate) FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderpriority = '1-URGENT'")
    return quality_gates.missing_days(o, "o_orderdate")


def w(c: str = "bar"):
    return T.ordered("symbol", c)


OVER = "OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def rolled(n: int, value: str, expression: str) -> str:
    over = OVER.format(n - 1)
    return f"CASE WHEN count({value}) {over} >= {n} THEN {expression} {over} END"


@REGISTER(f"WITH {BARS} SELECT symbol, bar, round({rolled(5, 'mid_close', 'avg(mid_close)')}, 5) AS mean5, round({rolled(5, 'mid_close', 'stddev_pop(mid_close)')}, 5) AS std5, {rolled(5, 'volume', 'sum(volume)')} AS sum5 FROM bars")
def rolling_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    b = hourly(spark, sf)
    return b.select("symbol", "bar", F.round(T.rolling_mean(F.col("mid_close"), 5, w()), 5).alias("mean5"), F.round(T.rolling_std(F.col("mid_close"), 5, w()), 5).alias("std5"), T.full(5, F.col("volume"), F.sum("volume").over(T.last_rows(w(), 5)), w()).alias("sum5"))


@REGISTER(f"WITH {BARS} SELECT symbol, bar, round({rolled(8, 'volume', 'quantile_cont(volume, 0.9)')}, 6) AS q90 FROM bars")
def rolling_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).select("symbol", "bar", F.round(T.rolling_quantile(F.col("volume"), 8, 0.9, w()), 6).alias("q90"))


@REGISTER(f"WITH {BARS} SELECT symbol, bar, round((volume - {rolled(6, 'volume', 'avg(volume)')}) / (nullif({rolled(6, 'volume', 'stddev_pop(volume)')}, 0) + 1e-9), 5) AS z FROM bars")
def rolling_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).select("symbol", "bar", F.round(T.rolling_zscore(F.col("volume"), 6, w()), 5).alias("z"))


@REGISTER(f"WITH {BARS}, l AS (SELECT symbol, bar, volume, list(volume) {OVER.format(7)} AS xs FROM bars) SELECT symbol, bar, CASE WHEN len(xs) >= 8 THEN len(list_filter(xs, lambda z: z <= volume)) / 8.0 END AS cdf FROM l")
def rolling_cdf(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).select("symbol", "bar", T.rolling_cdf(F.col("volume"), 8, w()).alias("cdf"))


LAG = "OVER (PARTITION BY symbol ORDER BY bar)"


@REGISTER(f"WITH {BARS} SELECT symbol, bar, round(lead(mid_close, 1) {LAG} / mid_close - 1, 8) AS fwd1, round(lead(mid_close, 5) {LAG} / mid_close - 1, 8) AS fwd5, round(ln(mid_close) - ln(lag(mid_close) {LAG}), 8) AS log_ret, round(mid_close / lag(mid_close, 3) {LAG} - 1, 8) AS ret3 FROM bars")
def forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("mid_close")
    return hourly(spark, sf).select("symbol", "bar", F.round(T.forward_return(p, 1, w()), 8).alias("fwd1"), F.round(T.forward_return(p, 5, w()), 8).alias("fwd5"), F.round(T.log_return(p, w()), 8).alias("log_ret"), F.round(T.simple_return(p, 3, w()), 8).alias("ret3"))


@REGISTER(f"WITH {BARS}, r AS (SELECT symbol, bar, greatest(mid_high - mid_low, abs(mid_high - lag(mid_close) {LAG}), abs(mid_low - lag(mid_close) {LAG})) AS tr FROM bars) SELECT symbol, bar, round(tr, 6) AS tr, round({rolled(4, 'tr', 'avg(tr)')}, 5) AS atr FROM r")
def atr(spark: SparkSession, sf: str) -> DataFrame:
    b = hourly(spark, sf).withColumn("tr", T.true_range(F.col("mid_high"), F.col("mid_low"), F.col("mid_close"), w()))
    return b.select("symbol", "bar", F.round("tr", 6).alias("tr"), F.round(T.rolling_mean(F.col("tr"), 4, w()), 5).alias("atr"))


@REGISTER(f"WITH {BARS}, r AS (SELECT symbol, bar, mid_close, row_number() {LAG} AS k FROM bars) SELECT symbol, bar, round({rolled(5, 'mid_close', 'regr_slope(mid_close, k)')}, 5) AS slope5 FROM r")
def slope5(spark: SparkSession, sf: str) -> DataFrame:
    b = hourly(spark, sf).withColumn("k", F.row_number().over(w()).cast("double"))
    return b.select("symbol", "bar", F.round(T.full(5, F.col("mid_close"), F.regr_slope("mid_close", "k").over(T.last_rows(w(), 5)), w()), 5).alias("slope5"))


@REGISTER(f"WITH {BARS} SELECT symbol, bar, sum(volume) {OVER.format('UNBOUNDED')} AS cum_volume, max(mid_high) {OVER.format('UNBOUNDED')} AS cum_high FROM bars")
def cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).select("symbol", "bar", F.sum("volume").over(T.upto_now(w())).alias("cum_volume"), F.max("mid_high").over(T.upto_now(w())).alias("cum_high"))


@REGISTER(f"WITH {BARS} SELECT symbol, bar, last_value(mid_close IGNORE NULLS) {OVER.format('UNBOUNDED')} AS filled FROM bars")
def ffill_spine(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).select("symbol", "bar", T.fill_forward(F.col("mid_close"), w()).alias("filled"))


RUNS = f"WITH {BARS}, f AS (SELECT symbol, bar, coalesce(mid_close > lag(mid_close) {LAG}, false) AS rising FROM bars), g AS (SELECT *, sum((NOT rising)::INT) OVER (PARTITION BY symbol ORDER BY bar) AS island FROM f)"


@REGISTER(RUNS + " SELECT symbol, bar, CAST(sum(rising::INT) OVER (PARTITION BY symbol, island ORDER BY bar) AS BIGINT) AS run FROM g")
def run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    b = hourly(spark, sf).select("symbol", "bar", F.coalesce(F.col("mid_close") > F.lag("mid_close").over(w()), F.lit(False)).alias("rising"))
    return T.run_length(b, "rising", "symbol", "bar", "run").select("symbol", "bar", "run")
