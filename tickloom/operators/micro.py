"""Microstructure features: order flow, imbalance, depth, replenishment, price impact, trade signs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import WindowSpec

from ..functions.timeops import bar_end, bar_floor, by_day, exact_sum, filled_by_day, full, last_rows, ordered, rolling_mean, rolling_zscore, running_totals, upto_now
from .joins import asof, on_spine


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def flow_of_level(level: int, w: WindowSpec) -> Column:
    """Order-flow imbalance of one level: what was added at the bid less what was added at the ask; 0 where unknown."""

    def side(name: str, better: int) -> Column:
        price, size = F.col(f"{name}_price_{level}"), F.col(f"{name}_size_{level}")
        before, had = F.lag(price).over(w), F.lag(size).over(w)
        moved = price > before if better > 0 else price < before
        return F.when(moved, size).when(price == before, size - had).otherwise(-had)

    return F.coalesce(side("bid", 1) - side("ask", -1), F.lit(0.0))


def depth(levels: list[int], weights: list[float] | None = None) -> Column:
    weights = weights or [1.0] * len(levels)
    return total([F.lit(x) * (F.col(f"bid_size_{i}") + F.col(f"ask_size_{i}")) for i, x in zip(levels, weights, strict=True)])


def order_flow(book: DataFrame, levels: list[int], normalize: bool = False, eps: float = 1e-9, by: str = "symbol", ts: str = "ts", tie: str = "agg_id") -> DataFrame:
    """Adds ofi_L<n> for each level n: the sum of the flows of the configured levels up to n."""

    def run(rows: DataFrame, w: WindowSpec) -> DataFrame:
        flows = rows.select("*", *(flow_of_level(i, w).alias(f"_ofi_{i}") for i in levels))
        for n in levels:
            used = [i for i in levels if i <= n]
            value = total([F.col(f"_ofi_{i}") for i in used])
            flows = flows.withColumn(f"ofi_L{n}", value / (depth(used) + eps) if normalize else value)
        return flows.drop(*(f"_ofi_{i}" for i in levels))

    return by_day(book, by, ts, tie, 1, run)


def weighted_order_flow(book: DataFrame, levels: list[int], decay: float = 0.7, normalize: bool = False, eps: float = 1e-9, by: str = "symbol", ts: str = "ts", tie: str = "agg_id") -> DataFrame:
    """Adds w_ofi_L<n>, levels weighted by decay to the power of their place."""

    def run(rows: DataFrame, w: WindowSpec) -> DataFrame:
        flows = rows.select("*", *(flow_of_level(i, w).alias(f"_ofi_{i}") for i in levels))
        for n in levels:
            used = [i for i in levels if i <= n]
            weights = [decay**k for k in range(len(used))]
            value = total([F.lit(x) * F.col(f"_ofi_{i}") for i, x in zip(used, weights, strict=True)])
            flows = flows.withColumn(f"w_ofi_L{n}", value / (depth(used, weights) + eps) if normalize else value)
        return flows.drop(*(f"_ofi_{i}" for i in levels))

    return by_day(book, by, ts, tie, 1, run)


def weighted_imbalance(book: DataFrame, levels: list[int], decay: float = 0.7, eps: float = 1e-9) -> DataFrame:
    """Adds w_obi_L<n>: the weighted excess of bid sizes over ask sizes."""
    for n in levels:
        used = [(i, decay**k) for k, i in enumerate(i for i in levels if i <= n)]
        more = total([F.lit(x) * (F.col(f"bid_size_{i}") - F.col(f"ask_size_{i}")) for i, x in used])
        book = book.withColumn(f"w_obi_L{n}", more / (depth([i for i, _ in used], [x for _, x in used]) + eps))
    return book


def depth_features(book: DataFrame, levels: list[int]) -> DataFrame:
    """Adds depth_L<n> and the best spread."""
    for n in levels:
        book = book.withColumn(f"depth_L{n}", depth([i for i in levels if i <= n]))
    return book.withColumn("spread", F.col("ask_price_1") - F.col("bid_price_1"))


def replenishment(book: DataFrame, levels: list[int], window: int = 3, eps: float = 1e-9, by: str = "symbol", ts: str = "ts", tie: str = "agg_id") -> DataFrame:
    """Adds depth_L<n>, depletion_L<n>, replenish_L<n> and repl_ratio_L<n> (a rolling mean) for each level n, summed over the
    configured levels up to n, and spread_mean and microprice."""
    if eps <= 0 or window <= 0 or not levels:
        raise ValueError("levels, and an eps and a window above zero are needed")

    def run(rows: DataFrame, w: WindowSpec) -> DataFrame:
        levels_ = sorted(set(levels))
        d = rows.withColumns({f"depth_L{n}": depth([i for i in levels_ if i <= n]) for n in levels_})
        more = {n: F.col(f"depth_L{n}") - F.lag(f"depth_L{n}").over(w) for n in levels_}
        d = d.withColumns({f"{name}_L{n}": F.when(x.isNotNull(), F.greatest(F.lit(0.0), x)) for n in levels_ for name, x in (("depletion", -more[n]), ("replenish", more[n]))})
        d = d.withColumns({f"repl_ratio_L{n}": rolling_mean(F.col(f"replenish_L{n}") / (F.col(f"depletion_L{n}") + eps), window, w) for n in levels_})
        size = F.col("bid_size_1") + F.col("ask_size_1")
        micro = F.try_divide(F.col("ask_price_1") * F.col("bid_size_1") + F.col("bid_price_1") * F.col("ask_size_1"), size)
        return d.withColumn("spread_mean", F.col("ask_price_1") - F.col("bid_price_1")).withColumn("microprice", micro)

    return by_day(book, by, ts, tie, window, run)


#: The features that a bar gets of the book, by the names before their level.
WHITELIST = ("depth", "depletion", "replenish", "repl_ratio", "spread_mean", "microprice")


def replenishment_on_bars(bars: DataFrame, book: DataFrame, levels: list[int], window: int = 3, keep: tuple[str, ...] = WHITELIST, by: str = "symbol") -> DataFrame:
    """Each bar with the last replenishment features at or before its label, those of ``keep`` (a name stands for all its levels)."""
    features = replenishment(book, levels, window, by=by)
    names = [c for c in features.columns if c.rsplit("_L", 1)[0] in keep and c not in book.columns]
    return on_bars(bars, features, names, by)


def on_bars(bars: DataFrame, features: DataFrame, columns: list[str], by: str = "symbol", bar: str = "bar", ts: str = "ts") -> DataFrame:
    """Each bar with the last feature row at or before its label."""
    return asof(bars, features.select(by, ts, *columns), by, bar, ts).drop(ts)


def sign_by_maker(maker: Column) -> Column:
    """-1 where the buyer was the maker, so that the taker sold; else +1."""
    return F.when(maker, -1.0).otherwise(1.0)


def sign_by_side(trades: DataFrame, side: Column, by: str = "symbol", ts: str = "ts", tie: str = "agg_id") -> DataFrame:
    """Adds ``sign``: +1 for buy, -1 for sell; others as the trade before, +1 at first."""
    known = F.when(F.lower(side).isin("buy", "b"), 1.0).when(F.lower(side).isin("sell", "s"), -1.0)
    return filled_by_day(trades, known, "sign", by, ts, tie).fillna(1.0, ["sign"])


def sign_by_tick(trades: DataFrame, by: str = "symbol", ts: str = "ts", tie: str = "agg_id") -> DataFrame:
    """Adds ``sign``: the direction of the last price change, +1 before any."""
    move = lambda rows, w: rows.withColumn("_move", F.nullif(F.signum(F.col("price") - F.lag("price").over(w)), F.lit(0.0)))
    moved = by_day(trades, by, ts, tie, 1, move)
    return filled_by_day(moved, F.col("_move"), "sign", by, ts, tie).fillna(1.0, ["sign"]).drop("_move")


def signed_flow(trades: DataFrame, seconds: int, sign: Column, by: str = "symbol", ts: str = "ts", label: str = "right") -> DataFrame:
    """Signed volume of each bucket, labelled by its end (``right``) or, for parity, by its start (``floor``)."""
    bucket = {"right": bar_end, "floor": bar_floor}[label](F.col(ts), seconds)
    return trades.groupBy(by, bucket.alias("bar")).agg(exact_sum(F.col("qty") * sign).alias("flow"))


def flow_on_bars(bars: DataFrame, flow: DataFrame, by: str = "symbol") -> DataFrame:
    return on_spine(bars.select(by, "bar"), flow, [by, "bar"], {"flow": 0.0})


def minute_sides(trades: DataFrame, sign: Column, by: str = "symbol", ts: str = "ts", seconds: int = 60) -> DataFrame:
    buy, sell = F.when(sign > 0, F.col("qty")), F.when(sign < 0, F.col("qty"))
    return trades.groupBy(by, bar_floor(F.col(ts), seconds).alias("minute")).agg(F.coalesce(exact_sum(buy), F.lit(0.0)).alias("buy"), F.coalesce(exact_sum(sell), F.lit(0.0)).alias("sell"), exact_sum(F.col("qty")).alias("volume"))


def kyle_lambda(rows: DataFrame, window: int, up_down: bool = False, by: str = "symbol", bar: str = "bar", price: str = "mid_close", flow: str = "flow") -> DataFrame:
    """Adds lambda, r2 and resid_std of price changes on flow, over the last rows; with ``up_down`` by the flow's sign.

    The covariance is the sample's and the variances the population's, on purpose.
    """
    w = ordered(by, bar)
    d = rows.withColumn("_y", F.col(price) - F.lag(price).over(w)).withColumn("_x", F.when(F.col("_y").isNotNull(), F.col(flow))).withColumn("_y", F.when(F.col("_x").isNotNull(), F.col("_y")))

    def slope(x: Column, y: Column, least: int) -> tuple[Column, Column]:
        f = last_rows(w, window)
        cov, vx, vy = F.covar_samp(x, y).over(f), F.var_pop(x).over(f), F.var_pop(y).over(f)
        enough = F.count(x).over(f) >= least
        return F.when(enough, F.try_divide(cov, vx)), F.when(enough, F.try_divide(cov * cov, vx * vy))

    value, r2 = slope(F.col("_x"), F.col("_y"), window)
    d = d.withColumn("lambda", value).withColumn("r2", r2)
    d = d.withColumn("_resid", F.col("_y") - F.col("lambda") * F.col("_x"))
    d = d.withColumn("resid_std", full(window, F.col("_resid"), F.stddev_pop("_resid").over(last_rows(w, window)), w))
    if up_down:
        for name, which in (("lambda_up", F.col("_x") > 0), ("lambda_down", F.col("_x") < 0)):
            d = d.withColumn("_xs", F.when(which, F.col("_x"))).withColumn("_ys", F.when(which, F.col("_y")))
            d = d.withColumn(name, slope(F.col("_xs"), F.col("_ys"), 2)[0]).drop("_xs", "_ys")
    return d.drop("_x", "_y", "_resid")


def illiquidity(rows: DataFrame, window: int, z_window: int, threshold: float = 2.0, by: str = "symbol", bar: str = "bar") -> DataFrame:
    """Adds lambda_raw, lambda_z and illiquidity_flag (false where unknown)."""
    d = kyle_lambda(rows, window, by=by, bar=bar).withColumnRenamed("lambda", "lambda_raw")
    d = d.withColumn("lambda_z", rolling_zscore(F.col("lambda_raw"), z_window, ordered(by, bar)))
    return d.withColumn("illiquidity_flag", F.coalesce(F.col("lambda_z") > threshold, F.lit(False)))


def rank_correlation(rows: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Spearman's correlation of each feature and target over the rows that have both: feature, target, n, ic."""
    cells = rows.select(*targets, F.expr(f"stack({len(features)}, {', '.join(f'{f!r}, double(`{f}`)' for f in features)}) AS (feature, x)"))
    pairs = cells.select("feature", "x", F.expr(f"stack({len(targets)}, {', '.join(f'{t!r}, double(`{t}`)' for t in targets)}) AS (target, y)")).where("x is not null and y is not null")
    key = ["feature", "target"]
    # average ranks from counts of distinct values, by ranges of values
    for v in ("x", "y"):
        counts = pairs.groupBy(*key, v).agg(F.count("*").alias("n"))
        ranks = running_totals(counts, key, v, ["n"]).select(*key, v, (F.col("cum_n") - (F.col("n") - 1) / 2).alias(f"r{v}"))
        pairs = pairs.join(ranks, [*key, v])
    return pairs.groupBy(*key).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("ic"))


def correlation(rows: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Pearson's correlation of each feature and target over the rows that have both, all in one pass: feature, target, n, r."""
    both = [(f, t, F.when(F.col(f).isNotNull() & F.col(t).isNotNull(), F.col(f).cast("double")), F.when(F.col(f).isNotNull() & F.col(t).isNotNull(), F.col(t).cast("double"))) for f in features for t in targets]
    one = rows.agg(*(x for i, (_, _, a, b) in enumerate(both) for x in (F.count(a).alias(f"n{i}"), F.corr(a, b).alias(f"r{i}"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")) for i, (f, t, _, _) in enumerate(both)))))


def top_features(ics: DataFrame, n: int) -> DataFrame:
    """The n features of each target with the largest absolute correlation."""
    return ics.where("ic is not null").withColumn("place", F.row_number().over(ordered("target", F.abs("ic").desc(), "feature"))).where(F.col("place") <= n)


#: The names of the candle features.
CANDLES = ["ret_1m_last", "ret_2m_sum", "ret_5m_sum", "ret_slope_5", "realized_vol_5", "body_ratio_mean", "upper_wick_ratio_max", "lower_wick_ratio_max", "close_location_last", "close_location_mean", "vol_zscore_5", "trade_count_zscore_5"]


def candles_before(events: DataFrame, bars: DataFrame, minutes: int = 5, history: int = 60, unit_seconds: int = 60, by: str = "symbol", at: str = "entry_ts", bar: str = "bar", count: str | None = None) -> DataFrame:
    """CANDLES of the ``minutes`` bars before each event, [T - n, T); an event without bars there has NULLs.

    Returns are those that aren't NULL; the slope is that of the last five closes, if there are five. Z-scores are of the window's
    mean against mean and deviation of [T - history, T), 0 where that doesn't vary, NULL where the bars have no such column;
    ``count`` is trade_count, count or num_trades where it isn't given. One interval join and one aggregation.
    """
    from ..functions.timeops import micros, shifted
    from .joins import within

    ids = [by, at]
    count = count or next((c for c in ("trade_count", "count", "num_trades") if c in bars.columns), "")
    ev = events.select(*ids).distinct()
    span = history * unit_seconds
    b = bars.withColumn("_ret", F.try_divide("mid_close", F.lag("mid_close").over(ordered(by, bar))) - 1)
    j = within(ev, b, by, shifted(F.col(at), -span), shifted(F.col(at), 0), span, bar, include_start=True).where(F.col(f"row_{bar}") < F.col(at))
    late = F.col(f"row_{bar}") >= shifted(F.col(at), -minutes * unit_seconds)
    w = ordered(ids, F.col(f"row_{bar}").desc())
    j = j.withColumn("_back", F.row_number().over(w)).withColumn("_moves", F.count("_ret").over(upto_now(w)))
    wide = F.col("mid_high") - F.col("mid_low") + 1e-12
    candle = {"_body": F.abs(F.col("mid_close") - F.col("mid_open")), "_upper": F.col("mid_high") - F.greatest("mid_open", "mid_close"), "_lower": F.least("mid_open", "mid_close") - F.col("mid_low"), "_place": F.col("mid_close") - F.col("mid_low")}
    whole = F.col("mid_open").isNotNull() & F.col("mid_close").isNotNull()
    j = j.withColumns({n: F.when(whole if n in ("_upper", "_lower") else F.lit(True), x / wide) for n, x in candle.items()})
    moves = lambda k: F.sum(F.when(late & (F.col("_moves") <= k), F.col("_ret")))
    tail = F.when(late & (F.col("_back") <= 5), F.col("mid_close"))
    inside = lambda f, c: f(F.when(late, F.col(c)))
    some = F.count(F.when(late, 1)) > 0
    z = lambda c: F.when(some, F.when(F.stddev_pop(c) > 0, (inside(F.avg, c) - F.avg(c)) / F.stddev_pop(c)).otherwise(0.0)) if c in bars.columns else F.lit(None).cast("double")
    features = [
        moves(1), moves(2), moves(5), F.when(F.count(tail) == 5, F.regr_slope(tail, -F.col("_back").cast("double"))), inside(F.stddev_pop, "_ret"),
        inside(F.avg, "_body"), inside(F.max, "_upper"), inside(F.max, "_lower"), F.max_by("_place", F.when(late, micros(F.col(f"row_{bar}")))), inside(F.avg, "_place"), z("volume"), z(count),
    ]
    return ev.join(j.groupBy(*ids).agg(*(f.alias(n) for n, f in zip(CANDLES, features, strict=True))), ids, "left")
