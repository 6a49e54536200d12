"""Queries that SQL can't express, against plain loops over the same rows."""

import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import folds, models
from tickloom.plans import queries_models, queries_more, views
from tickloom.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def by_symbol(rows, order="bar"):
    out = {}
    for r in sorted(rows, key=lambda r: (r["symbol"], r[order])):
        out.setdefault(r["symbol"], []).append(r)
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def std(x):
    return None if any(v is None for v in x) else float(np.std(x))


def plain_entries(rows, band_window=10, k=1.0, atr_window=8, tolerance=1.0, wait=3):
    """Bands and pullbacks, one bar after another."""
    out = []
    for symbol, bars in by_symbol(rows).items():
        last = {}
        for i, b in enumerate(bars):
            p, before = b["mid_close"], bars[i - 1]["mid_close"] if i else None
            sd = std([x["mid_close"] for x in bars[i - band_window + 1 : i + 1]]) if i >= band_window - 1 else None
            ranges = []
            for j in range(max(0, i - atr_window + 1), i + 1):
                y, past = bars[j], bars[j - 1]["mid_close"] if j else None
                # greatest() leaves NULLs out
                ranges.append(max([y["mid_high"] - y["mid_low"], *([abs(y["mid_high"] - past), abs(y["mid_low"] - past)] if past is not None else [])]))
            atr = sum(ranges) / atr_window if i >= atr_window - 1 else None
            reason = None
            if b["regime"] == "RANGE" and sd is not None:
                reason = "range_upper_touch" if p >= b["ema_fast"] + k * sd else "range_lower_touch" if p <= b["ema_fast"] - k * sd else None
            elif b["regime"] == "TREND" and atr and before is not None and abs(p - b["ema_fast"]) <= tolerance * atr:
                reason = "trend_pullback_long" if p > b["ema_slow"] and p > before else "trend_pullback_short" if p < b["ema_slow"] and p < before else None
            if reason and (b["regime"] not in last or i - last[b["regime"]] >= wait + 1):
                last[b["regime"]] = i
                out.append((symbol, b["bar"], 1 if reason in ("range_lower_touch", "trend_pullback_long") else -1, p, b["regime"], reason))
    return sorted(out)


def test_entries(spark):
    rows = [r.asDict() for r in queries_models.classified(spark, SF).collect()]
    got = sorted((r.symbol, r.entry_ts, r.side, r.entry_price, r.regime, r.reason) for r in QUERIES["entries_by_regime"](spark, SF).collect())
    assert got == plain_entries(rows) and {g[5] for g in got} > {"range_upper_touch", "trend_pullback_long"}


def test_backtest(spark):
    """Barriers, exits and trades that don't overlap, event by event."""
    rows = [r.asDict() for r in queries_models.classified(spark, SF).collect()]
    bars, sigma = by_symbol(rows), {}
    for symbol, b in bars.items():
        a, m, c, s = 2 / 21, None, 0.0, 1.0
        for i, x in enumerate(b):
            r = b[i]["mid_close"] / b[i - 1]["mid_close"] - 1 if i else None
            if r is not None:
                if m is None:
                    m = r
                else:
                    c, m, s = (1 - a) * (c + a * (r - m) ** 2), (1 - a) * m + a * r, (1 - a) ** 2 * s + a * a
            sigma[symbol, x["bar"]] = max((c / (1 - s)) ** 0.5 if s < 1 else 1e-6, 1e-6)
    want, free = [], {}
    for symbol, t0, side, price, regime, _ in plain_entries(rows):
        hours, pt = (12, 1.0) if regime == "TREND" else (6, 0.5)
        up, down = price * (1 + side * pt * sigma[symbol, t0]), price * (1 - side * 0.5 * sigma[symbol, t0])
        ahead = [x for x in bars[symbol] if t0 < x["bar"] <= t0 + timedelta(hours=hours)]
        kind, t1 = "timeout", ahead[-1]["bar"] if ahead else t0 + timedelta(hours=hours)
        for x in ahead:
            if (x["mid_low"] <= down) if side > 0 else (x["mid_high"] >= down):
                kind, t1 = "sl", x["bar"]
                break
            if (x["mid_high"] >= up) if side > 0 else (x["mid_low"] <= up):
                kind, t1 = "pt", x["bar"]
                break
        if symbol in free and t0 < free[symbol]:
            continue
        free[symbol] = t1
        exit_price = {"pt": up, "sl": down, "timeout": [x for x in bars[symbol] if x["bar"] <= t1][-1]["mid_close"]}[kind]
        gross = side * (exit_price - price) / price * 1000
        want.append((symbol, t0, t1, side, kind, exit_price, gross, gross - 2 * 1000 * 6 / 10_000))
    got = sorted((r.symbol, r.entry_ts, r.exit_ts, r.side, r.event_type, r.exit_price, r.gross_pnl, r.net_pnl) for r in QUERIES["backtest_by_regime"](spark, SF).collect())
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)] and len(got) > 20
    assert all(close(x, y) for g, w in zip(got, sorted(want), strict=True) for x, y in zip(g[5:], w[5:], strict=True))


def test_vpin(spark):
    """Minutes are poured into buckets one by one; the mean imbalance of the last ten is known from a bucket's end on."""
    minutes = {}
    for t in views.trades(spark, SF).collect():
        m = minutes.setdefault((t.symbol, t.ts.replace(second=0, microsecond=0)), [0.0, 0.0])
        m[1 if t.is_buyer_maker else 0] += t.qty
    known = {}
    for symbol in {s for s, _ in minutes}:
        rows, volumes, buckets, size, fill = sorted((t, *m) for (s, t), m in minutes.items() if s == symbol), [], [], None, [0.0, 0.0]
        for t, buy, sell in rows:
            volumes.append(buy + sell)
            left, share = buy + sell, buy / (buy + sell) if buy + sell else 0
            while left > 1e-12:
                size = size or max(np.mean(volumes[-30:]) * 5.0, 1.0)
                take = min(left, size - sum(fill))
                fill, left = [fill[0] + take * share, fill[1] + take * (1 - share)], left - take
                if sum(fill) >= size - 1e-9:
                    buckets.append((t, abs(fill[0] - fill[1]) / size))
                    size, fill = None, [0.0, 0.0]
        known[symbol] = [(t, np.mean([x for _, x in buckets[i - 9 : i + 1]]) if i >= 9 else None) for i, (t, _) in enumerate(buckets)]
    for r in QUERIES["vpin"](spark, SF).collect():
        before = [v for t, v in known[r.symbol] if t <= r.bar]
        assert close(r.vpin, before[-1] if before else None), r


def test_replay_by_session(spark):
    """Sessions replayed by themselves give what one book over the whole log gives."""
    lines = queries_more.book_log(spark, SF)
    got = sorted(tuple(r) for r in QUERIES["book_replay"](spark, SF).collect())
    import json

    want, states = [], {}
    for r in sorted(lines.collect(), key=lambda r: (r.path, r.ts, r.line)):
        try:
            j = json.loads(r.value)
        except ValueError:
            continue
        book, valid, last, bucket, n = states.get(r.path) or (folds.BookState(), False, None, None, 0)
        snapshot = j["type"] == "snapshot" or j["data"]["u"] == 1
        if not snapshot and valid and j["data"]["seq"] <= last:
            valid = False
        if snapshot or valid:
            book.apply(j["data"]["b"], j["data"]["a"], snapshot)
            valid, last = True, j["data"]["seq"]
            if j["ts"] // 3_600_000 != bucket:
                bucket = j["ts"] // 3_600_000
                want.append((r.path, j["ts"], j["ts"] * 1_000_000 + n, *book.top(2)))
                n += 1
        states[r.path] = (book, valid, last, bucket, n)
    assert [tuple(map(str, w)) for w in sorted(want, key=str)] == [tuple(map(str, g)) for g in sorted(got, key=str)] and len(got) > 50


def newton(x, y, w):
    xb, beta = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-xb @ beta))
        beta = beta + np.linalg.lstsq(xb.T @ (xb * (w * p * (1 - p))[:, None]), xb.T @ (w * (y - p)), rcond=None)[0]
    return beta


def pav(p, y):
    """Pooled adjacent violators: points to interpolate between."""
    blocks = []
    for v in sorted(set(p)):
        at = p == v
        blocks.append([v, v, y[at].sum(), at.sum()])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    xs = [v for a, b, *_ in blocks for v in ((a, b) if a != b else (a,))]
    ys = [s / n for a, b, s, n in blocks for _ in range(2 if a != b else 1)]
    return xs, ys


@pytest.mark.parametrize("calibration", [None, "isotonic", "sigmoid"])
def test_meta_scores(spark, calibration):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 2))
    y = (x[:, 0] + draw.normal(size=400) > 0.3).astype(int)
    rows = [(i, float(a), float(b), int(c), float(c) - 0.4) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "event_id long, a double, b double, label int, net_pnl_est double").withColumn("entry_ts", F.timestamp_millis(F.col("event_id") * 60_000).cast("timestamp_ntz"))
    oof, _, report = models.fit_meta(frame, ["a", "b"], [], calibration=calibration)
    got = {r.event_id: r.p_hat for r in oof.collect()}
    assert sorted(got) == list(range(280, 400)) and report["oof_coverage"] == 0.3
    train = x[:280]
    z = lambda v: np.clip((v - train.mean(0)) / train.std(0), -5, 5)
    w = np.where(y[:280] == 1, 280 / (2 * y[:280].sum()), 280 / (2 * (280 - y[:280].sum())))
    beta = newton(z(train), y[:280], w)
    p = lambda v: 1 / (1 + np.exp(-np.c_[np.ones(len(v)), z(v)] @ beta))
    want, fitted = p(x[280:]), p(train)
    if calibration == "isotonic":
        want = np.interp(want, *pav(fitted, y[:280]))
    elif calibration == "sigmoid":
        b = newton(fitted[:, None], y[:280], w)
        want = 1 / (1 + np.exp(-(b[0] + b[1] * want)))
    wrong = [abs(got[280 + i] - v) for i, v in enumerate(want)]
    assert np.mean(np.array(wrong) < 2e-3) > 0.97
    accept = {t["threshold"]: t for t in report["thresholds"]}
    assert accept[0.1]["accept_rate"] >= accept[0.75]["accept_rate"] and len(report["folds"]) == 1 and 0.6 < report["overall"]["auc"] <= 1
    again = models.loaded_models(models.saved_models([models.fitted(frame, ["a", "b"], "label", calibration)]))[0]
    assert models.scored(frame, again).count() == 400
    with pytest.raises(ValueError, match="missing feature"):
        models.scored(frame.drop("a"), again)
