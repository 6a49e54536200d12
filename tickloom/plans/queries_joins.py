"""Joins, set operations, microstructure features, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeops as T
from ..operators import folds, joins, micro
from .register import Register
from .views import BOOK, HOUR, TRADES, bars_sql, book, end_of, exact, floor_of, hourly, trades

REGISTER = Register()
US = HOUR * 1_000_000
BARS = bars_sql(US)
LAG = "OVER (PARTITION BY symbol ORDER BY bar)"
TICK = "OVER (PARTITION BY symbol ORDER BY ts, agg_id)"


def over(n: int, order: str = "bar") -> str:
    return f"OVER (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rounded(df: DataFrame, n: int, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, n))
    return df


@REGISTER(f"WITH {BARS} SELECT b.symbol, b.bar, b.volume, t.ts, t.price, t.agg_id FROM bars b ASOF LEFT JOIN trades t ON b.symbol = t.symbol AND b.bar >= t.ts")
def asof_trades_to_bars(spark: SparkSession, sf: str) -> DataFrame:
    return joins.asof(hourly(spark, sf).select("symbol", "bar", "volume"), trades(spark, sf).select("symbol", "ts", "price", "agg_id"), "symbol", "bar", "ts", "agg_id")


@REGISTER(f"WITH {BARS}, e AS (SELECT event_id, event_type AS symbol, ts + INTERVAL 30 MINUTE AS at FROM events) SELECT e.event_id, e.symbol, e.at, b.bar, b.mid_close FROM e ASOF LEFT JOIN bars b ON e.symbol = b.symbol AND e.at >= b.bar")
def asof_events_to_features(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf).select(F.col("agg_id").alias("event_id"), "symbol", T.shifted(F.col("ts"), 1800).alias("at"))
    return joins.asof(t, hourly(spark, sf).select("symbol", "bar", "mid_close"), "symbol", "at", "bar")


@REGISTER(f"WITH {BARS} SELECT symbol, bar, lead(bar) {LAG} AS next_bar, lead(mid_close) {LAG} AS next_close FROM bars")
def next_bar(spark: SparkSession, sf: str) -> DataFrame:
    out = joins.next_row(hourly(spark, sf).select("symbol", "bar", "mid_close"), "symbol", "bar", "mid_close")
    return out.select("symbol", "bar", F.col("next_ts").alias("next_bar"), F.col("next_mid_close").alias("next_close"))


PICKED = "ev AS (SELECT event_id, event_type AS symbol, ts AS entry_ts, value AS entry_price FROM events)"


def picked(spark: SparkSession, sf: str) -> DataFrame:
    return trades(spark, sf).select(F.col("agg_id").alias("event_id"), "symbol", F.col("ts").alias("entry_ts"), F.col("price").alias("entry_price"))


@REGISTER(f"WITH {BARS}, {PICKED} SELECT ev.event_id, min(bars.bar) FILTER (mid_high >= entry_price * 1.5) AS first_up, min(bars.bar) FILTER (mid_low <= entry_price * 0.5) AS first_down, count(*) AS n FROM ev JOIN bars ON bars.symbol = ev.symbol AND bar > entry_ts AND bar <= entry_ts + INTERVAL 6 HOUR GROUP BY ev.event_id")
def range_first_touch(spark: SparkSession, sf: str) -> DataFrame:
    j = joins.within(picked(spark, sf), hourly(spark, sf), "symbol", F.col("entry_ts"), T.shifted(F.col("entry_ts"), 6 * HOUR), 6 * HOUR, "bar")
    return j.groupBy("event_id").agg(F.min(F.when(F.col("mid_high") >= F.col("entry_price") * 1.5, F.col("row_bar"))).alias("first_up"), F.min(F.when(F.col("mid_low") <= F.col("entry_price") * 0.5, F.col("row_bar"))).alias("first_down"), F.count("*").alias("n"))


@REGISTER(f"WITH {BARS}, {PICKED}, m AS (SELECT event_id, symbol, unnest(generate_series(entry_ts + INTERVAL 1 HOUR, entry_ts + INTERVAL 4 HOUR, INTERVAL 1 HOUR)) AS t, entry_ts + INTERVAL 4 HOUR AS exit_ts FROM ev) SELECT m.event_id, m.t, min(mid_low) AS future_min_low, max(mid_high) AS future_max_high FROM m LEFT JOIN bars ON bars.symbol = m.symbol AND bar > t AND bar <= least(t + INTERVAL 2 HOUR, exit_ts) GROUP BY ALL")
def range_future_minmax(spark: SparkSession, sf: str) -> DataFrame:
    ev = picked(spark, sf).withColumn("exit_ts", T.shifted(F.col("entry_ts"), 4 * HOUR))
    us = T.micros(F.col("entry_ts"))
    m = ev.select("event_id", "symbol", "exit_ts", F.explode(F.sequence(us + US, us + 4 * US, F.lit(US).cast("long"))).alias("us")).select("event_id", "symbol", "exit_ts", T.from_micros(F.col("us")).alias("t"))
    j = joins.within(m, hourly(spark, sf), "symbol", F.col("t"), F.least(T.shifted(F.col("t"), 2 * HOUR), F.col("exit_ts")), 2 * HOUR, "bar")
    found = j.groupBy("event_id", "t").agg(F.min("mid_low").alias("future_min_low"), F.max("mid_high").alias("future_max_high"))
    return m.select("event_id", "t").join(found, ["event_id", "t"], "left")


@REGISTER("SELECT o.o_orderkey, o.o_totalprice AS total_base, l.q AS qty_enh FROM orders o LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) l ON l_orderkey = o_orderkey")
def equi_left_suffix(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("total_base"))
    q = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty_enh"))
    return o.join(q, "o_orderkey", "left")


@REGISTER("SELECT a.l_orderkey, a.p - b.p AS delta FROM (SELECT l_orderkey, max(l_extendedprice) AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT l_orderkey, max(l_extendedprice) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.l_orderkey = b.l_orderkey")
def equi_inner_delta(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda flag, name: spark.read.parquet(f"{sf}/lineitem.parquet").where(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.max("l_extendedprice").alias(name))
    return side("A", "a").join(side("R", "b"), "l_orderkey").select("l_orderkey", (F.col("a") - F.col("b")).alias("delta"))


@REGISTER("SELECT thr, count(*) AS n, " + exact("value") + " AS total FROM events CROSS JOIN (SELECT unnest([10.0, 50.0, 100.0, 200.0])::DOUBLE AS thr) WHERE value >= thr GROUP BY thr")
def semi_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """All thresholds at once; those a row passes are an array of its own, so nothing is crossed."""
    passed = F.filter(F.array(*(F.lit(x) for x in (10.0, 50.0, 100.0, 200.0))), lambda t: t <= F.col("value"))
    return spark.read.parquet(f"{sf}/events.parquet").select("value", F.explode(passed).alias("thr")).groupBy("thr").agg(F.count("*").alias("n"), T.exact_sum(F.col("value")).alias("total"))


@REGISTER("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50) AND c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 50)")
def anti_best_worst(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal")
    ends = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).union(c.orderBy("c_acctbal", "c_custkey").limit(50))
    return c.join(ends, "c_custkey", "left_anti")


@REGISTER(f"WITH {BARS}, f AS (SELECT symbol, {end_of('ts', US)} AS bar, count(*) AS makers FROM trades WHERE is_buyer_maker GROUP BY ALL) SELECT coalesce(b.symbol, f.symbol) AS symbol, coalesce(b.bar, f.bar) AS bar, b.mid_close, f.makers FROM (SELECT * FROM bars WHERE volume > 10) b FULL JOIN f ON b.symbol = f.symbol AND b.bar = f.bar")
def outer_assemble(spark: SparkSession, sf: str) -> DataFrame:
    f = trades(spark, sf).where("is_buyer_maker").groupBy("symbol", T.bar_end(F.col("ts"), HOUR).alias("bar")).agg(F.count("*").alias("makers"))
    return joins.full_outer([hourly(spark, sf).where("volume > 10").select("symbol", "bar", "mid_close"), f], ["symbol", "bar"])


@REGISTER("SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.where("o_orderpriority = '1-URGENT'").select("o_custkey").subtract(o.where("o_orderpriority = '5-LOW'").select("o_custkey"))


@REGISTER("SELECT n_nationkey AS key FROM nation UNION SELECT r_regionkey FROM region")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    n, r = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/region.parquet")
    return n.select(F.col("n_nationkey").alias("key")).union(r.select("r_regionkey")).distinct()


@REGISTER("SELECT c_custkey AS key, 'c' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, 's', s_acctbal FROM supplier")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    c, s = spark.read.parquet(f"{sf}/customer.parquet"), spark.read.parquet(f"{sf}/supplier.parquet")
    return c.select(F.col("c_custkey").alias("key"), F.lit("c").alias("kind"), F.col("c_acctbal").alias("balance")).unionByName(s.select(F.col("s_suppkey").alias("key"), F.lit("s").alias("kind"), F.col("s_acctbal").alias("balance")))


FLOW = f"flow AS (SELECT symbol, {end_of('ts', US)} AS bar, {exact('qty * CASE WHEN is_buyer_maker THEN -1.0 ELSE 1.0 END')} AS flow FROM trades GROUP BY ALL)"


def flow(spark: SparkSession, sf: str) -> DataFrame:
    return micro.signed_flow(trades(spark, sf), HOUR, micro.sign_by_maker(F.col("is_buyer_maker")))


@REGISTER(f"WITH {BARS}, {FLOW} SELECT b.symbol, b.bar, coalesce(flow, 0) AS flow FROM bars b LEFT JOIN flow f ON f.symbol = b.symbol AND f.bar = b.bar")
def signed_flow(spark: SparkSession, sf: str) -> DataFrame:
    return micro.flow_on_bars(hourly(spark, sf), flow(spark, sf))


@REGISTER(f"WITH {TRADES} SELECT symbol, agg_id, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, agg_id), 1.0) AS sign FROM (SELECT *, nullif(CAST(sign(price - lag(price) {TICK}) AS DOUBLE), 0) AS m FROM trades)")
def tick_rule_sign(spark: SparkSession, sf: str) -> DataFrame:
    return micro.sign_by_tick(trades(spark, sf)).select("symbol", "agg_id", "sign")


@REGISTER(f"WITH {TRADES} SELECT symbol, {floor_of('ts', 60_000_000)} AS minute, coalesce({exact('CASE WHEN NOT is_buyer_maker THEN qty END')}, 0) AS buy, coalesce({exact('CASE WHEN is_buyer_maker THEN qty END')}, 0) AS sell, {exact('qty')} AS volume FROM trades GROUP BY ALL")
def minute_buy_sell(spark: SparkSession, sf: str) -> DataFrame:
    return micro.minute_sides(trades(spark, sf), micro.sign_by_maker(F.col("is_buyer_maker")))


def ofi_sql(i: int) -> str:
    def side(s: str, sign: str) -> str:
        p, v = f"{s}_price_{i}", f"{s}_size_{i}"
        return f"CASE WHEN {p} {sign} lag({p}) {TICK} THEN {v} WHEN {p} = lag({p}) {TICK} THEN {v} - lag({v}) {TICK} ELSE -lag({v}) {TICK} END"

    return f"coalesce({side('bid', '>')} - {side('ask', '<')}, 0) AS ofi_{i}"


OFI = f"{BOOK}, f AS (SELECT *, {', '.join(ofi_sql(i) for i in (1, 2, 3))} FROM book)"


@REGISTER(f"WITH {OFI} SELECT agg_id, symbol, ofi_1 AS ofi_L1, ofi_1 + ofi_2 + ofi_3 AS ofi_L3 FROM (SELECT * REPLACE (0 AS ofi_2) FROM f)")
def ofi_levels(spark: SparkSession, sf: str) -> DataFrame:
    return micro.order_flow(book(spark, sf), [1, 3]).select("agg_id", "symbol", "ofi_L1", "ofi_L3")


@REGISTER(f"WITH {OFI}, r AS (SELECT agg_id, symbol, ts, (ofi_1 + 0.7 * ofi_2 + 0.7 * 0.7 * ofi_3) / (bid_size_1 + ask_size_1 + 0.7 * (bid_size_2 + ask_size_2) + 0.7 * 0.7 * (bid_size_3 + ask_size_3) + 1e-9) AS w FROM f) SELECT agg_id, symbol, round(w, 7) AS w_ofi_L3, CASE WHEN count(w) {over(20, 'ts, agg_id')} >= 20 THEN round((w - avg(w) {over(20, 'ts, agg_id')}) / (nullif(stddev_pop(w) {over(20, 'ts, agg_id')}, 0) + 1e-9), 5) END AS w_ofi_L3_z FROM r")
def weighted_ofi_z(spark: SparkSession, sf: str) -> DataFrame:
    f = T.by_day(book(spark, sf), "symbol", "ts", "agg_id", 20, lambda d, w: micro.weighted_order_flow(d, [1, 2, 3], 0.7, normalize=True).withColumn("w_ofi_L3_z", T.rolling_zscore(F.col("w_ofi_L3"), 20, w)))
    return rounded(f.withColumn("w_ofi_L3", F.round("w_ofi_L3", 7)), 5, "w_ofi_L3_z").select("agg_id", "symbol", "w_ofi_L3", "w_ofi_L3_z")


@REGISTER(f"WITH {BOOK} SELECT agg_id, symbol, round((bid_size_1 - ask_size_1 + 0.7 * (bid_size_2 - ask_size_2) + 0.7 * 0.7 * (bid_size_3 - ask_size_3)) / (bid_size_1 + ask_size_1 + 0.7 * (bid_size_2 + ask_size_2) + 0.7 * 0.7 * (bid_size_3 + ask_size_3) + 1e-9), 7) AS w_obi_L3 FROM book")
def obi_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(micro.weighted_imbalance(book(spark, sf), [1, 2, 3]), 7, "w_obi_L3").select("agg_id", "symbol", "w_obi_L3")


DEEP = {n: " + ".join(f"{side}_size_{i}" for i in range(1, n + 1) for side in ("bid", "ask")) for n in (1, 2, 3)}


@REGISTER(
    f"""WITH {BOOK}, d AS (SELECT *, {', '.join(f'{x} AS depth_L{n}' for n, x in DEEP.items())} FROM book),
    m AS (SELECT *, {', '.join(f'depth_L{n} - lag(depth_L{n}) {TICK} AS more_{n}' for n in DEEP)} FROM d),
    r AS (SELECT *, {', '.join(f'greatest(0.0::DOUBLE, -more_{n}) + 0 * more_{n} AS depletion_L{n}, greatest(0.0::DOUBLE, more_{n}) + 0 * more_{n} AS replenish_L{n}' for n in DEEP)} FROM m)
    SELECT agg_id, symbol, round(ask_price_1 - bid_price_1, 6) AS spread_mean, {', '.join(f"depth_L{n}, depletion_L{n}, replenish_L{n}, CASE WHEN count(more_{n}) {over(3, 'ts, agg_id')} >= 3 THEN round(avg(replenish_L{n} / (depletion_L{n} + 1e-9)) {over(3, 'ts, agg_id')} / 1e9, 6) END AS repl_ratio_L{n}" for n in DEEP)} FROM r"""
)
def replenishment(spark: SparkSession, sf: str) -> DataFrame:
    r = micro.replenishment(book(spark, sf), [1, 2, 3])
    return r.select("agg_id", "symbol", F.round("spread_mean", 6).alias("spread_mean"), *(f"{c}_L{n}" for n in DEEP for c in ("depth", "depletion", "replenish")), *(F.round(F.col(f"repl_ratio_L{n}") / 1e9, 6).alias(f"repl_ratio_L{n}") for n in DEEP))


@REGISTER(f"WITH {BARS}, f AS (SELECT agg_id, symbol, ts, bid_size_1 + ask_size_1 AS depth_L1, bid_size_1 + ask_size_1 + bid_size_3 + ask_size_3 AS depth_L3 FROM ({BOOK.replace(TRADES + ', book AS (', '')[:-1]})) SELECT b.symbol, b.bar, f.depth_L1, f.depth_L3 FROM bars b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.bar >= f.ts")
def depth_on_bars(spark: SparkSession, sf: str) -> DataFrame:
    d = micro.depth_features(book(spark, sf), [1, 3])
    return micro.on_bars(hourly(spark, sf).select("symbol", "bar"), d, ["depth_L1", "depth_L3"])


KYLE = f"""{BARS}, {FLOW}, k AS (SELECT b.symbol, b.bar, b.mid_close - lag(b.mid_close) OVER (PARTITION BY b.symbol ORDER BY b.bar) AS y0, coalesce(f.flow, 0) AS x0
  FROM bars b LEFT JOIN flow f ON f.symbol = b.symbol AND f.bar = b.bar), xy AS (SELECT symbol, bar, CASE WHEN y0 IS NOT NULL THEN x0 END AS x, y0 AS y FROM k)"""


@REGISTER(f"WITH {KYLE}, l AS (SELECT *, CASE WHEN count(x) {over(5)} >= 5 THEN covar_samp(x, y) {over(5)} / nullif(var_pop(x) {over(5)}, 0) END AS lam, CASE WHEN count(x) {over(5)} >= 5 THEN pow(covar_samp(x, y) {over(5)}, 2) / nullif(var_pop(x) {over(5)} * var_pop(y) {over(5)}, 0) END AS r2 FROM xy), r AS (SELECT *, y - lam * x AS e FROM l) SELECT symbol, bar, round(lam, 4) AS lambda, round(r2, 4) AS r2, CASE WHEN count(e) {over(5)} >= 5 THEN round(stddev_pop(e) {over(5)}, 4) END AS resid_std FROM r")
def kyle_lambda(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf).select("symbol", "bar", "mid_close").join(micro.flow_on_bars(hourly(spark, sf), flow(spark, sf)), ["symbol", "bar"])
    return rounded(micro.kyle_lambda(rows, 5).select("symbol", "bar", "lambda", "r2", "resid_std"), 4, "lambda", "r2", "resid_std")


@REGISTER(f"WITH {KYLE}, s AS (SELECT symbol, bar, CASE WHEN x > 0 THEN x END AS xu, CASE WHEN x > 0 THEN y END AS yu, CASE WHEN x < 0 THEN x END AS xd, CASE WHEN x < 0 THEN y END AS yd FROM xy) SELECT symbol, bar, CASE WHEN count(xu) {over(12)} >= 2 THEN round(covar_samp(xu, yu) {over(12)} / nullif(var_pop(xu) {over(12)}, 0), 7) + 0.0 END AS lambda_up, CASE WHEN count(xd) {over(12)} >= 2 THEN round(covar_samp(xd, yd) {over(12)} / nullif(var_pop(xd) {over(12)}, 0), 7) + 0.0 END AS lambda_down FROM s")
def kyle_up_down(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf).select("symbol", "bar", "mid_close").join(micro.flow_on_bars(hourly(spark, sf), flow(spark, sf)), ["symbol", "bar"])
    found = micro.kyle_lambda(rows, 12, up_down=True)
    return found.select("symbol", "bar", *((F.round(c, 7) + F.lit(0.0)).alias(c) for c in ("lambda_up", "lambda_down")))


IC = f"""{BARS}, p AS (SELECT symbol, volume, mid_high - mid_low AS range_, lead(mid_close, 1) {LAG} / mid_close - 1 AS fwd1, lead(mid_close, 4) {LAG} / mid_close - 1 AS fwd4 FROM bars),
u AS (SELECT 'volume' AS feature, volume AS x, fwd1, fwd4 FROM p UNION ALL SELECT 'range_', range_, fwd1, fwd4 FROM p),
v AS (SELECT feature, x, 'fwd1' AS target, fwd1 AS y FROM u UNION ALL SELECT feature, x, 'fwd4', fwd4 FROM u),
r AS (SELECT feature, target, rank() OVER (PARTITION BY feature, target ORDER BY x) + (count(*) OVER (PARTITION BY feature, target, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY feature, target ORDER BY y) + (count(*) OVER (PARTITION BY feature, target, y) - 1) / 2.0 AS ry FROM v WHERE x IS NOT NULL AND y IS NOT NULL),
ic AS (SELECT feature, target, count(*) AS n, corr(rx, ry) AS ic FROM r GROUP BY ALL)"""


def ics(spark: SparkSession, sf: str) -> DataFrame:
    w, p = T.ordered("symbol", "bar"), F.col("mid_close")
    rows = hourly(spark, sf).select("volume", (F.col("mid_high") - F.col("mid_low")).alias("range_"), T.forward_return(p, 1, w).alias("fwd1"), T.forward_return(p, 4, w).alias("fwd4"))
    return micro.rank_correlation(rows, ["volume", "range_"], ["fwd1", "fwd4"])


@REGISTER(f"WITH {IC} SELECT feature, target, n, round(ic, 6) AS ic FROM ic")
def ic_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ics(spark, sf), 6, "ic")


@REGISTER(f"WITH {IC} SELECT feature, target, round(ic, 6) AS ic, CAST(row_number() OVER (PARTITION BY target ORDER BY abs(ic) DESC, feature) AS INT) AS place FROM ic QUALIFY place <= 1")
def top_ic(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(micro.top_features(ics(spark, sf), 1), 6, "ic").select("feature", "target", "ic", "place")


EWM = f"""WITH RECURSIVE {BARS}, v AS (SELECT symbol, bar, volume AS x, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS r FROM bars),
e AS (SELECT symbol, bar, r, x AS m, 0.0::DOUBLE AS c, 1.0::DOUBLE AS s FROM v WHERE r = 1
  UNION ALL SELECT v.symbol, v.bar, v.r, (1 - 2.0 / 13) * m + 2.0 / 13 * x, (1 - 2.0 / 13) * (c + 2.0 / 13 * pow(x - m, 2)), pow(1 - 2.0 / 13, 2) * s + pow(2.0 / 13, 2) FROM e JOIN v ON v.symbol = e.symbol AND v.r = e.r + 1)"""


@REGISTER(EWM + " SELECT symbol, bar, round(m, 6) AS ewm_mean, CASE WHEN s < 1 THEN round(sqrt(c / (1 - s)), 6) END AS ewm_std FROM e")
def ewm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(folds.ewm(hourly(spark, sf), "volume", 12), 6, "ewm_mean", "ewm_std")


@REGISTER(
    f"""WITH RECURSIVE {BARS}, v AS (SELECT symbol, bar, ln(mid_close) - ln(lag(mid_close) {LAG}) AS ret FROM bars),
    q AS (SELECT symbol, bar, ret, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS r FROM v WHERE ret IS NOT NULL),
    e AS (SELECT symbol, bar, r, greatest(0, ret) AS up, least(0, ret) AS down FROM q WHERE r = 1
      UNION ALL SELECT q.symbol, q.bar, q.r, greatest(0, CASE WHEN up > 3 OR down < -3 THEN 0 ELSE up END + ret), least(0, CASE WHEN up > 3 OR down < -3 THEN 0 ELSE down END + ret) FROM e JOIN q ON q.symbol = e.symbol AND q.r = e.r + 1)
    SELECT symbol, bar AS t0, CASE WHEN up > 3 THEN 1 ELSE -1 END AS side FROM e WHERE up > 3 OR down < -3"""
)
def cusum_events(spark: SparkSession, sf: str) -> DataFrame:
    w = T.ordered("symbol", "bar")
    rows = hourly(spark, sf).select("symbol", "bar", T.log_return(F.col("mid_close"), w).alias("ret"), F.lit(1.0).alias("sigma"))
    return folds.cusum(rows, 3.0).select("symbol", "t0", "side")


@REGISTER(
    f"""WITH RECURSIVE {BARS}, c AS (SELECT symbol, bar, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS position, volume FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY position) AS r FROM c WHERE volume >= 15),
    e AS (SELECT symbol, bar, position, r, position AS last, true AS taken FROM k WHERE r = 1 UNION ALL
      SELECT k.symbol, k.bar, k.position, k.r, CASE WHEN k.position - last >= 6 THEN k.position ELSE last END, k.position - last >= 6 FROM e JOIN k ON k.symbol = e.symbol AND k.r = e.r + 1)
    SELECT symbol, bar, position FROM e WHERE taken"""
)
def cooldown_entries(spark: SparkSession, sf: str) -> DataFrame:
    b = hourly(spark, sf).select("symbol", "bar", F.row_number().over(T.ordered("symbol", "bar")).cast("long").alias("position"), "volume")
    return folds.cooldown(b.where("volume >= 15"), 6).select("symbol", "bar", "position")


@REGISTER(
    f"""WITH RECURSIVE {PICKED}, k AS (SELECT *, entry_ts + to_hours(CAST(2 + event_id % 5 AS INT)) AS exit_ts, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts, event_id) AS r FROM ev),
    o AS (SELECT symbol, entry_ts AS at, min(r) AS r FROM k GROUP BY ALL), n AS (SELECT k.*, o.r AS following FROM k ASOF LEFT JOIN o ON o.symbol = k.symbol AND k.exit_ts <= o.at),
    e AS (SELECT * FROM n WHERE r = 1 UNION ALL SELECT n.* FROM e JOIN n ON n.symbol = e.symbol AND n.r = e.following)
    SELECT symbol, event_id, entry_ts, exit_ts FROM e"""
)
def nonoverlap_trades(spark: SparkSession, sf: str) -> DataFrame:
    t = picked(spark, sf).select("symbol", "event_id", "entry_ts", T.from_micros(T.micros(F.col("entry_ts")) + (2 + F.col("event_id") % 5) * US).alias("exit_ts"))
    return folds.nonoverlapping(t)


@REGISTER()
def vpin(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets of equal volume, the mean imbalance of the last ones, on hourly bars with its rolling distribution."""
    minutes = micro.minute_sides(trades(spark, sf), micro.sign_by_maker(F.col("is_buyer_maker")))
    b = folds.volume_buckets(minutes, 5.0, 30, 1.0)
    w = T.ordered("symbol", "place")
    v = b.select("symbol", F.col("end").alias("ts"), "place", T.rolling_mean(F.col("imbalance"), 10, w).alias("vpin"))
    on = joins.asof(hourly(spark, sf).select("symbol", "bar"), v, "symbol", "bar", "ts", "place")
    return on.select("symbol", "bar", "vpin", T.rolling_cdf(F.col("vpin"), 20, T.ordered("symbol", "bar")).alias("vpin_cdf"))

