"""Folds against plain loops, hand-made cases, and invariance to later rows and to row order."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import timeops as T
from tickloom.operators import backtest, bars, folds, joins, labels, micro, models, quality_gates, regime
from tickloom.plans import views

SF = "/root/testdata/sf0.001"
T0 = datetime(2025, 1, 1)


def minutes(k):
    return T0 + timedelta(minutes=k)


def bar_rows(spark, closes, highs=None, lows=None, symbol="S"):
    rows = [(symbol, minutes(i + 1), float(c), float((highs or closes)[i]), float((lows or closes)[i]), float(c), 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, mid_open double, mid_high double, mid_low double, mid_close double, volume double")


def test_bar_edges(spark):
    rows = spark.createDataFrame([(minutes(1),), (minutes(1) + timedelta(microseconds=1),), (minutes(1) - timedelta(microseconds=1),)], "ts timestamp_ntz")
    assert [r[0] for r in rows.select(T.bar_end(F.col("ts"), 60)).collect()] == [minutes(1), minutes(2), minutes(1)]
    assert [r[0] for r in rows.select(T.bar_floor(F.col("ts"), 60)).collect()] == [minutes(1), minutes(1), minutes(0)]


def test_epochs(spark):
    rows = spark.createDataFrame([(1735689600,), (1735689600000,), (1735689600000000,), (1735689600000000000,)], "v long")
    assert {r[0] for r in rows.select(T.epoch_to_ts(F.col("v"))).collect()} == {T0}


def test_bars_are_dense_and_hand_computed(spark):
    trades = spark.createDataFrame([("S", minutes(0) + timedelta(seconds=s), i, p, q) for i, (s, p, q) in enumerate([(10, 100.0, 1.0), (50, 102.0, 3.0), (60, 101.0, 1.0), (200, 99.0, 2.0)])], "symbol string, ts timestamp_ntz, agg_id long, price double, qty double")
    found = {r.bar: r for r in bars.time_bars(trades, 60).collect()}
    assert sorted(found) == [minutes(1), minutes(2), minutes(3), minutes(4)]
    first = found[minutes(1)]
    assert (first.mid_open, first.mid_high, first.mid_low, first.mid_close, first.volume) == (100.0, 102.0, 100.0, 101.0, 5.0) and first.vwap == pytest.approx(507 / 5)
    assert found[minutes(2)].volume == 0 and found[minutes(2)].mid_close is None


def test_asof_crosses_days_and_takes_exact_matches(spark):
    right = spark.createDataFrame([("a", T0, 1, None), ("a", T0 + timedelta(days=3), 2, "x"), ("b", T0, 9, "y")], "k string, rts timestamp_ntz, v int, n string")
    left = spark.createDataFrame([("a", T0 - timedelta(seconds=1)), ("a", T0), ("a", T0 + timedelta(days=2)), ("a", T0 + timedelta(days=3)), ("a", T0 + timedelta(days=9)), ("c", T0)], "k string, ts timestamp_ntz")
    found = {(r.k, r.ts): (r.v, r.n) for r in joins.asof(left, right, "k", "ts", "rts").collect()}
    assert found == {("a", T0 - timedelta(seconds=1)): (None, None), ("a", T0): (1, None), ("a", T0 + timedelta(days=2)): (1, None), ("a", T0 + timedelta(days=3)): (2, "x"), ("a", T0 + timedelta(days=9)): (2, "x"), ("c", T0): (None, None)}


def test_features_ignore_later_rows_and_row_order(spark):
    book = views.book(spark, SF)
    cut = datetime(2024, 1, 16)

    def features(b):
        f = micro.weighted_order_flow(micro.order_flow(b, [1, 3]), [1, 2, 3])
        f = micro.replenishment(micro.weighted_imbalance(f, [1, 2]), [1, 2, 3])
        return f.withColumn("z", T.rolling_zscore(F.col("ofi_L1"), 5, T.ordered("symbol", "ts", "agg_id"))).orderBy("agg_id")

    whole = features(book).where(F.col("ts") < F.lit(cut)).toPandas()
    pd.testing.assert_frame_equal(whole, features(book.where(F.col("ts") < F.lit(cut))).toPandas())
    pd.testing.assert_frame_equal(whole, features(book.where(F.col("ts") < F.lit(cut)).orderBy(F.xxhash64("agg_id")).repartition(7)).toPandas())


def test_regime_ignores_later_rows(spark):
    b = views.hourly(spark, SF).withColumn("mid_close", T.fill_forward(F.col("mid_close"), T.ordered("symbol", "bar")))
    cut = datetime(2024, 1, 20)
    rules = dict(window=4, q=0.7, fast=4, slow=12, strength=10.0)
    whole = regime.classify(b, **rules).where(F.col("bar") < F.lit(cut)).orderBy("symbol", "bar").toPandas()
    pd.testing.assert_frame_equal(whole, regime.classify(b.where(F.col("bar") < F.lit(cut)), **rules).orderBy("symbol", "bar").toPandas())
    assert whole.regime.nunique() > 1


def test_a_look_ahead_would_be_seen(spark):
    b = bar_rows(spark, [1, 2, 4, 8, 16])
    ahead = b.withColumn("x", F.lead("mid_close").over(T.ordered("symbol", "bar")))
    cut = ahead.where(F.col("bar") <= F.lit(minutes(3))).orderBy("bar").toPandas().x
    again = b.where(F.col("bar") <= F.lit(minutes(3))).withColumn("x", F.lead("mid_close").over(T.ordered("symbol", "bar"))).orderBy("bar").toPandas().x
    assert not cut.equals(again)


def test_ewm_is_pandas(spark):
    x = np.random.default_rng(1).normal(size=80)
    got = folds.ewm(bar_rows(spark, x.tolist()), "mid_close", 7).orderBy("bar").toPandas()
    want = pd.Series(x).ewm(span=7, adjust=False)
    assert np.allclose(got.ewm_mean.astype(float), want.mean()) and np.allclose(got.ewm_std.astype(float)[1:], want.std()[1:]) and got.ewm_std.isna()[0]


def test_cooldown_and_nonoverlap(spark):
    c = spark.createDataFrame([("S", p) for p in (1, 3, 4, 9, 10, 14)], "symbol string, position long")
    assert sorted(r.position for r in folds.cooldown(c, 4).collect()) == [1, 9, 14]
    t = spark.createDataFrame([("S", "a", minutes(0), minutes(5)), ("S", "b", minutes(4), minutes(6)), ("S", "c", minutes(5), minutes(9)), ("R", "d", minutes(4), minutes(6))], "symbol string, event_id string, entry_ts timestamp_ntz, exit_ts timestamp_ntz")
    assert sorted(r.event_id for r in folds.nonoverlapping(t).collect()) == ["a", "c", "d"]


def test_volume_buckets_share_minutes(spark):
    m = spark.createDataFrame([("S", minutes(0), 6.0, 4.0, 10.0), ("S", minutes(1), 0.0, 10.0, 10.0), ("S", minutes(2), 3.0, 0.0, 3.0)], "symbol string, minute timestamp_ntz, buy double, sell double, volume double")
    got = folds.volume_buckets(m, 0.5, 1, 1.0).orderBy("place").collect()
    assert [(r.bucket_volume, round(r.imbalance, 6)) for r in got] == [(5.0, 0.2), (5.0, 0.2), (5.0, 1.0), (5.0, 1.0), (1.5, 1.0), (1.5, 1.0)]


def book_event(line, ts, kind, u, bids, asks, seq=None):
    return ("S", ts, line, kind, u, seq, bids, asks)


def test_book_replay(spark):
    rows = [
        book_event(0, 500, "delta", 9, [["1", "1"]], []),  # before any snapshot
        book_event(1, 1000, "snapshot", 10, [["100", "2"], ["99", "1"]], [["101", "3"]], 10),
        book_event(2, 1400, "delta", 11, [["100", "0"]], [["102", "5"]], 11),
        book_event(3, 2100, "delta", 12, [["98", "4"], ["bad"]], [], 12),
        book_event(4, 3100, "delta", 12, [["97", "1"]], [], 12),  # doesn't grow: wait for a snapshot
        book_event(5, 4100, "delta", 13, [["96", "1"]], [], 13),
        book_event(6, 5100, "delta", 1, [["50", "1"]], [["51", "1"]], 1),  # acts as one
    ]
    events = spark.createDataFrame(rows, folds.BOOK_EVENT).orderBy(F.desc("line"))
    got = folds.replay_book(events, 2).orderBy("ts").collect()
    assert [(r.ts, r.bid_price_1, r.bid_size_2, r.ask_price_1, r.ask_price_2) for r in got] == [(1000, 100.0, 1.0, 101.0, None), (2100, 99.0, 4.0, 101.0, 102.0), (5100, 50.0, None, 51.0, None)]
    assert got[1].update_id == 2100 * 1_000_000 + 1 and folds.replay_book(events, 1, every=True).count() == 4


def test_barriers(spark):
    b = bar_rows(spark, [100, 100, 100, 100, 100], [100, 101, 103, 100, 100], [100, 99.5, 97, 100, 100])
    ev = spark.createDataFrame([("up", "S", minutes(1), 1, 0.01), ("short", "S", minutes(1), -1, 0.02), ("both", "S", minutes(2), 1, 0.025), ("calm", "S", minutes(3), 1, 0.02), ("end", "S", minutes(5), 1, 0.01)], "event_id string, symbol string, t0 timestamp_ntz, side int, s double")
    for tie, want in (("worst_case", "sl"), ("best_case", "pt"), ("by_candle", "pt")):
        found = {}
        for s in (0.01, 0.02, 0.025):
            sigma = b.select("symbol", "bar", F.lit(s).alias("sigma"))
            found |= {r.event_id: (r.event_type, r.label, r.t1) for r in labels.triple_barrier(ev.where(F.col("s") == s).drop("s"), b, sigma, 120, 1.0, 1.0, tie).collect()}
        assert found["up"] == ("pt", 1, minutes(2)) and found["calm"] == ("timeout", 0, minutes(5)) and found["end"] == ("timeout", 0, minutes(7))
        assert found["both"] == (want, 1 if want == "pt" else -1, minutes(3))


def test_hazard_rows_end_without_a_future(spark):
    b = bar_rows(spark, [100] * 6, lows=[100, 100, 100, 95, 100, 100])
    t = spark.createDataFrame([("e", "S", minutes(1), minutes(5), 1, 100.0, 96.0)], "event_id string, symbol string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, side int, entry_price double, sl_price double")
    assert [(r.t, r.y) for r in labels.hazard_rows(t, b, 120).orderBy("t").collect()] == [(minutes(2), 1), (minutes(3), 1), (minutes(4), 0), (minutes(5), None)]


def test_policy(spark):
    p = spark.createDataFrame([("a", minutes(i), x) for i, x in enumerate([0.7, 0.7, 0.8, 0.2])] + [("b", minutes(i), x) for i, x in enumerate([0.1, 0.95, 0.95])] + [("c", minutes(0), 0.7), ("d", minutes(0), None)], "event_id string, t timestamp_ntz, p double")
    got = {r.event_id: (r.exit_ts, r.exit_reason) for r in regime.first_exits(p, 0.6, 0.9, 2, rising=True).collect()}
    assert got == {"a": (minutes(2), "hazard_exit"), "b": (minutes(1), "hazard_fail_fast")}
    assert regime.first_exits(p, 0.6, 0.9, 2, mode="hazard_exit_only").where("exit_reason = 'hazard_fail_fast'").count() == 0


def test_without_hazard_the_trades_are_the_baseline_s(spark):
    from tickloom.plans.queries_models import backtest_by_regime, classified

    base = backtest_by_regime(spark, SF)
    c = classified(spark, SF)
    ev = regime.entries(c, 10, 1.0, 8, 1.0).select("event_id", "symbol", F.col("entry_ts").alias("t0"), "side", "entry_price", "regime", "reason")
    labelled = labels.triple_barrier(ev, c, labels.volatility(c, "ewma", 20), 6 * 3600, 0.5, 0.5, overrides={"TREND": {"horizon": 12 * 3600, "pt": 1.0}})
    calm = labelled.select("event_id", F.col("t0").alias("t"), F.lit(0.0).alias("p"))
    same = backtest.trade_log(backtest.with_exits(labelled, regime.first_exits(calm, 0.6, 0.9), c), c).select(*base.columns)
    assert base.count() > 0 and sorted(map(repr, base.collect())) == sorted(map(repr, same.collect()))


def test_costs_add_up(spark):
    from tickloom.plans.queries_models import log

    row = backtest.trade_summary(log(spark, SF).withColumn("all", F.lit(1)), ["all"]).first()
    assert row.pnl_net == pytest.approx(row.pnl_gross - row.total_fees - row.total_slippage)


def test_models(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=400)
    y = (draw.random(400) < 1 / (1 + np.exp(-4 * x))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"event_id": np.arange(400), "y": y, "x": x, "n": draw.normal(size=400)}))
    model = models.fit_logistic(df, ["x", "n"])
    p = models.scored(df, model)
    assert models.auc(p, "p_hat", "y").first()[0] > 0.9 and model == models.fit_logistic(df, ["x", "n"])
    slow = models.fit_by_descent(df, ["x", "n"], steps=3)
    z, w = np.clip((np.stack([x, df.toPandas().n]).T - [[x.mean(), df.toPandas().n.mean()]]) / [[x.std(), df.toPandas().n.std(ddof=0)]], -5, 5), np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    b, v = 0.0, np.zeros(2)
    for _ in range(3):
        e = w * (1 / (1 + np.exp(-(z @ v + b))) - y)
        v, b = v - 0.1 * (e @ z) / 400, b - 0.1 * e.mean()
    assert np.allclose(slow["weights"], v) and np.isclose(slow["intercept"], b)
    model["isotonic"] = models.fit_isotonic(df.withColumn("m", models.margin(model)), "m", "y")
    q = [r.p_hat for r in models.scored(df, model).collect()]
    assert min(q) >= 0 and max(q) <= 1


def test_bad_input(spark):
    with pytest.raises(ValueError):
        bars.time_bars(spark.createDataFrame([(1,)], "x int"), 60)
    with pytest.raises(ValueError):
        backtest.folds(spark, T0, T0, 0, 1, 1, 0)


def test_many_calibration_points(spark):
    """A row looks its place up among thousands of points; the expression doesn't grow with them."""
    draw = np.random.default_rng(3)
    xs = sorted({round(float(v), 6) for v in draw.normal(size=5000)})
    ys = np.sort(draw.uniform(size=len(xs))).tolist()
    few, many = (models.interpolated(F.col("x"), {"x": xs[:n], "y": ys[:n]}) for n in (len(xs) // 100, len(xs)))
    df = spark.createDataFrame([(float(v),) for v in [*xs[:200], *draw.normal(size=800), -9.0, 9.0]], "x double").repartition(4)
    rows = df.select("x", many.alias("p")).collect()
    assert len(rows) == 1002 and max(abs(r.p - np.interp(r.x, xs, ys)) for r in rows) < 1e-12
    size = [df.select(c.alias("p"))._jdf.queryExecution().analyzed().treeString().count("(") for c in (few, many)]
    assert size[1] < 2 * size[0]


def test_isotonic_fit_of_distinct_scores(spark):
    """Labels of one score count as one weighted row."""
    rows = [(0.1, 0)] * 3 + [(0.2, 1)] * 2 + [(0.3, 0)] * 2 + [(0.3, 1)] + [(0.4, 1)]
    points = models.fit_isotonic(spark.createDataFrame(rows, "s double, y int").repartition(3), "s", "y")
    assert points["x"] == [0.1, 0.2, 0.3, 0.4] and np.allclose(points["y"], [0.0, 0.6, 0.6, 1.0])


def test_book_log_is_parsed_and_replayed_once(spark):
    """However many symbols there are, the log is read by one plan, and what the sessions give isn't made anew to number it."""
    from tickloom.plans import queries_more

    events = queries_more.parsers.book_events(queries_more.book_log(spark, "/root/testdata/sf0.001"), F.col("path"))
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "Union" not in plan and events.select("symbol").distinct().count() == 5
    plan = folds.replay_book(events, 2, 3_600_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


def test_session_goes_on_in_the_next_batch(spark):
    rows = [("S", 1000 * i, i, "delta" if i % 40 else "snapshot", None, i, [[str(100 + i % 7), str(i)]], [["200", "1"]]) for i in range(200)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    for n in ("3", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            found.append(sorted(tuple(map(str, r)) for r in folds.replay_book(spark.createDataFrame(rows, folds.BOOK_EVENT), 3, every=True).collect()))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found[0]) == 200 and found[0] == found[1]


def test_quantiles_by_counts(spark):
    """As percentile() has them: keys that are NULL, keys without a value, ties; without a task that holds a key's values."""
    draw = np.random.default_rng(11)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in draw.normal(size=301).round(1)] + [("a", None), ("none", None), ("one", 2.5)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = T.add_quantiles(df.select("k").distinct(), df, ["k"], "x", {"m": 0.5, "q": 0.07})
    want = df.groupBy("k").agg(F.percentile("x", 0.5).alias("m"), F.percentile("x", 0.07).alias("q"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = quality_gates.middles(spark.createDataFrame([(1.0, None), (4.0, None)], "a double, b double"), ["a", "b"])
    assert {(r["column"], r["mean"], r["median"]) for r in plan.collect()} == {("a", 2.5, 2.5), ("b", None, None)}
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in text and "percentile(" not in text
