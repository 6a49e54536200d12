"""Candle features, replenishment and confirmed exits against plain loops over their definitions."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import micro, regime

T0 = datetime(2024, 1, 1)
BARS = "symbol string, bar timestamp_ntz, mid_open double, mid_high double, mid_low double, mid_close double, volume double, trade_count double"


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def random_bars(rng, n: int) -> list[tuple]:
    out, price = [], 100.0
    for i in range(n):
        if rng.random() < 0.1:
            continue  # a minute without a bar
        o, c = price, price + rng.normal()
        row = ["s", at(i), o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, float(rng.integers(0, 50)), float(rng.integers(1, 9))]
        if rng.random() < 0.1:
            row[2:6] = [None] * 4
        if rng.random() < 0.05:
            row[6] = None
        out.append(tuple(row))
        price = c
    return out


def mean(x):
    x = [v for v in x if v is not None]
    return sum(x) / len(x) if x else None


def deviation(x):
    x = [v for v in x if v is not None]
    return math.sqrt(sum((v - mean(x)) ** 2 for v in x) / len(x)) if x else None


def candles(bars: list[tuple], t: datetime, minutes: int) -> dict:
    returns = [None] + [b[5] / a[5] - 1 if a[5] is not None and b[5] is not None else None for a, b in zip(bars, bars[1:], strict=False)]
    window = [i for i, b in enumerate(bars) if t - timedelta(minutes=minutes) <= b[1] < t]
    history = [b for b in bars if t - timedelta(minutes=60) <= b[1] < t]
    out = dict.fromkeys(micro.CANDLES)
    if not window:
        return out
    moves = [returns[i] for i in window if returns[i] is not None]
    if moves:
        out.update(ret_1m_last=moves[-1], ret_2m_sum=sum(moves[-2:]), ret_5m_sum=sum(moves[-5:]), realized_vol_5=deviation(moves))
    closes = [bars[i][5] for i in window][-5:]
    if len(closes) == 5 and None not in closes:
        out["ret_slope_5"] = float(np.polyfit(range(5), closes, 1)[0])
    body, upper, lower, place = [], [], [], []
    for _, _, o, h, low, c, *_ in (bars[i] for i in window):
        if c is None:
            place.append(None)
            continue
        wide = h - low + 1e-12
        body.append(abs(c - o) / wide)
        upper.append((h - max(o, c)) / wide)
        lower.append((min(o, c) - low) / wide)
        place.append((c - low) / wide)
    out.update(body_ratio_mean=mean(body), upper_wick_ratio_max=max(upper, default=None), lower_wick_ratio_max=max(lower, default=None), close_location_last=place[-1], close_location_mean=mean(place))
    for name, k in (("vol_zscore_5", 6), ("trade_count_zscore_5", 7)):
        base, wide = mean([b[k] for b in history]), deviation([b[k] for b in history])
        now = mean([bars[i][k] for i in window])
        out[name] = 0.0 if not wide else None if now is None else (now - base) / wide
    return out


def same(a, b) -> bool:
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("minutes", [3, 5, 8])
def test_candles(spark, minutes):
    bars = random_bars(np.random.default_rng(minutes), 150)
    times = [at(m) for m in (0, 1, 2, 6, 30, 30.5, 61, 100, 149, 152, 158, 400)]
    got = micro.candles_before(spark.createDataFrame([("s", t) for t in times], "symbol string, entry_ts timestamp_ntz"), spark.createDataFrame(bars, BARS), minutes)
    assert got.columns == ["symbol", "entry_ts", *micro.CANDLES]
    rows = {r.entry_ts: r for r in got.collect()}
    assert len(rows) == len(times)
    for t in times:
        want = candles(bars, t, minutes)
        assert all(same(rows[t][c], want[c]) for c in micro.CANDLES), (t, rows[t], want)


def test_candles_without_counts(spark):
    bars = spark.createDataFrame(random_bars(np.random.default_rng(1), 40), BARS).drop("volume", "trade_count")
    row = micro.candles_before(spark.createDataFrame([("s", at(30))], "symbol string, entry_ts timestamp_ntz"), bars).first()
    assert row.vol_zscore_5 is None and row.trade_count_zscore_5 is None and row.body_ratio_mean is not None


def test_replenishment_of_each_level(spark):
    rng = np.random.default_rng(2)
    rows = [("s", at(i), i, 10.0, 11.0, *map(float, rng.integers(1, 9, 4))) for i in range(40)]
    book = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, agg_id long, bid_price_1 double, ask_price_1 double, bid_size_1 double, ask_size_1 double, bid_size_3 double, ask_size_3 double")
    got = micro.replenishment(book, [3, 1], window=4).orderBy("agg_id").collect()
    for n, k in ((1, 2), (3, 4)):
        depths = [sum(r[5 : 5 + k]) for r in rows]
        ratios = [None]
        for i, r in enumerate(got):
            assert r[f"depth_L{n}"] == depths[i]
            if not i:
                assert r[f"depletion_L{n}"] is None and r[f"replenish_L{n}"] is None
                continue
            less, more = max(0, depths[i - 1] - depths[i]), max(0, depths[i] - depths[i - 1])
            assert (r[f"depletion_L{n}"], r[f"replenish_L{n}"]) == (less, more)
            ratios.append(more / (less + 1e-9))
            assert same(r[f"repl_ratio_L{n}"], mean(ratios[-4:]) if i >= 4 else None)
    assert all(r.spread_mean == 1.0 and same(r.microprice, (11 * r.bid_size_1 + 10 * r.ask_size_1) / (r.bid_size_1 + r.ask_size_1)) for r in got)
    bars = spark.createDataFrame([("s", at(7.5))], "symbol string, bar timestamp_ntz")
    on = micro.replenishment_on_bars(bars, book, [1, 3], keep=("depth", "spread_mean"))
    assert on.columns == ["symbol", "bar", "depth_L1", "depth_L3", "spread_mean"] and on.first().depth_L1 == sum(rows[7][5:7])
    with pytest.raises(ValueError):
        micro.replenishment(book, [1], window=0)


def confirmed(rows: list[dict], fail_at: float, window: int) -> datetime | None:
    """The first time at which p is at the level, flow spikes while lambda falls or residuals rise, and ratios fall or the spread widens."""
    for i, r in enumerate(rows):
        seen = rows[max(0, i - window + 1) : i + 1]
        size = [max(abs(x[c]) for c in ("ofi_L1", "ofi_L5")) for x in seen]
        if i == 0 or r["p"] < fail_at:
            continue
        b = rows[i - 1]
        spike = size[-1] >= np.quantile(size, 0.9) and (r["lambda"] < b["lambda"] or r["resid_std"] > b["resid_std"])
        ratio = lambda x: mean([x["repl_ratio_L1"], x["repl_ratio_L5"]])
        fell = ratio(r) is not None and ratio(b) is not None and ratio(r) < ratio(b)
        if spike and (fell or r["spread_mean"] > b["spread_mean"]):
            return r["t"]
    return None


def test_confirmations_look_at_all_levels(spark):
    rng = np.random.default_rng(8)
    rows = []
    for e in range(12):
        for i in range(15):
            row = {"event_id": f"e{e}", "t": at(i), "p": float(rng.random()), **{c: float(rng.normal()) for c in ("ofi_L1", "ofi_L5", "lambda", "resid_std", "spread_mean")}}
            rows.append(row | {c: None if rng.random() < 0.2 else float(rng.random()) for c in ("repl_ratio_L1", "repl_ratio_L5")})
    df = spark.createDataFrame(rows, "event_id string, t timestamp_ntz, p double, ofi_L1 double, ofi_L5 double, lambda double, resid_std double, spread_mean double, repl_ratio_L1 double, repl_ratio_L5 double")
    got = {r.event_id: r.exit_ts for r in regime.first_exits(df, 2.0, 0.4, absorption=True, drop=True, window=4, mode="fail_fast_only").collect()}
    want = {f"e{e}": confirmed([r for r in rows if r["event_id"] == f"e{e}"], 0.4, 4) for e in range(12)}
    assert got == {k: v for k, v in want.items() if v is not None} and got
    fewer = regime.first_exits(df.drop("ofi_L1", "ofi_L5", "repl_ratio_L1", "repl_ratio_L5", "spread_mean"), 2.0, 0.4, absorption=True, drop=True, mode="fail_fast_only")
    assert fewer.count() == 12  # what isn't there isn't asked
