"""Scans that are cut into blocks against plain loops and pandas, whatever the blocks."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import scans
from tickloom.plans.catalogue import QUERIES

from .test_plans import SF, plan

T0 = datetime(2024, 1, 1)


def bars(spark, values: dict[str, list], seconds: int = 3600):
    rows = [(s, T0 + timedelta(seconds=seconds * i), None if x is None or x != x else float(x)) for s, xs in values.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, x double")


def holed(rng, n: int, share: float, level: float = 0.0) -> list:
    x = level + np.cumsum(rng.normal(size=n))
    x[rng.random(n) < share] = np.nan
    return x.tolist()


@pytest.mark.parametrize(("span", "most_rows"), [(1, 64), (7, 5), (300, 40)])
def test_ewm_is_pandas(spark, span, most_rows):
    rng = np.random.default_rng(span)
    values = {"full": holed(rng, 400, 0), "holes": holed(rng, 400, 0.5, 1e3), "rare": [None] * 30 + [x if i % 13 == 0 else None for i, x in enumerate(holed(rng, 370, 0))], "none": [None] * 5, "one": [None, 2.0, None], "flat": [3.0] * 200}
    got = scans.ewm(bars(spark, values), "x", span, most_rows=most_rows).toPandas().sort_values(["symbol", "bar"])
    for s, x in values.items():
        own = got[got.symbol == s]
        want = pd.Series(x, dtype=float).ewm(span=span, adjust=False)
        for column, result in (("ewm_mean", want.mean()), ("ewm_std", want.std())):
            have = own[column].astype(float).to_numpy()
            result = result.to_numpy()
            if column == "ewm_std" and span == 1:
                assert np.isnan(have).all()  # all weight is on one value
                continue
            if column == "ewm_std":  # pandas has 0 by rounding where one value has aged
                result = np.where(pd.Series(x, dtype=float).notna().cumsum() < 2, np.nan, result)
            assert (np.isnan(have) == np.isnan(result)).all(), (s, column)
            assert np.allclose(have, result, rtol=1e-9, atol=1e-9, equal_nan=True), (s, column)


def test_ewm_is_spread(spark):
    """No Python, and no window by symbol alone but over a row for each block or day."""
    text = plan(QUERIES["ewm"](spark, SF))
    assert not re.search("Pandas|Python", text)
    text = plan(scans.ewm(bars(spark, {"a": [1.0] * 10}), "x", 7))
    for window in re.findall(r"\) Window\b.*?Arguments: (.*?)\n\n", text, re.S):
        keys = window.rsplit("], [", 2)[1]
        assert re.search("_block|_chunk", keys) or re.search(r"_known|_before|_maps|_carry|_n#|_state", window), window


def greedy(rows: list[tuple]) -> list:
    """rows: (id, start, end) in order."""
    free, out = None, []
    for i, a, b in rows:
        if free is None or a >= free:
            out.append(i)
            free = b if b is not None else datetime.max
    return out


@pytest.mark.parametrize("block_rows", [16, 1 << 16])
def test_trades_that_overlap(spark, block_rows):
    rng = random.Random(block_rows)
    rows = []
    for s, n, longest in (("a", 200, 20_000), ("b", 80, 300_000), ("c", 1, 10), ("d", 60, 0)):
        at = 0
        for i in range(n):
            at += rng.choice([0, 0, 1, 500, 5_000])
            start = T0 + timedelta(seconds=at)
            rows.append((s, len(rows), start, start + timedelta(seconds=rng.randint(0, longest))))
    rows.append(("e", len(rows), T0, None))
    rows.append(("e", len(rows), T0 + timedelta(days=400), T0 + timedelta(days=401)))
    df = spark.createDataFrame(rows, "symbol string, event_id long, entry_ts timestamp_ntz, exit_ts timestamp_ntz").orderBy(F.rand(1))
    want = [i for s in "abcde" for i in greedy([r[1:] for r in rows if r[0] == s])]
    assert sorted(r.event_id for r in scans.nonoverlapping(df, block_rows=block_rows).collect()) == want


@pytest.mark.parametrize("block_rows", [3, 1 << 16])
def test_cooldown(spark, block_rows):
    rng = random.Random(4)
    rows = [(s, p) for s in "ab" for p in sorted(rng.sample(range(5_000_000), 200)) + list(range(6_000_000, 6_000_050))]
    want = []
    for s in "ab":
        last = None
        for _, p in (r for r in rows if r[0] == s):
            if last is None or p - last >= 40_000 or p < 0:
                want.append((s, p))
                last = p
    df = spark.createDataFrame(rows, "symbol string, position long").orderBy(F.rand(2))
    assert sorted(map(tuple, scans.cooldown(df, 40_000, block_rows=block_rows).collect())) == want
    assert scans.cooldown(df.limit(0), 3).count() == 0


def test_a_million_of_one_symbol(spark):
    """A path over 10^6 places of one key; no task of the blocks gets more than a block."""
    links = spark.range(1_000_000).select(F.lit("s").alias("symbol"), F.col("id").alias("_place"), (F.col("id") + 1 + F.pmod(F.xxhash64("id"), F.lit(9))).alias("_next"))
    to = [r._next for r in links.orderBy("_place").select("_next").collect()]
    want, at = [], 0
    while at < len(to):
        want.append(at)
        at = to[at]
    found = scans.reached(links, "symbol", 1 << 14)
    assert sorted(r._place for r in found.select("_place").collect()) == want
    text = plan(found)
    assert re.findall(r"FlatMapGroupsInPandas\n.*?\nArguments: \[(.*?)\]", text, re.S) and all("_block" in keys for keys in re.findall(r"FlatMapGroupsInPandas\n.*?\nArguments: \[(.*?)\]", text, re.S))


def plain_cusum(rows: list[tuple], k: float) -> list[tuple]:
    up = down = 0.0
    out = []
    for t, r, s in rows:
        if r is None or r != r:
            continue
        h = k * s if s is not None else float("inf")
        up, down = max(0.0, up + r), min(0.0, down + r)
        if up > h or down < -h:
            out.append((t, 1 if up > h else -1))
            up = down = 0.0
    return out


@pytest.mark.parametrize(("seconds", "drift", "k"), [(21_600, 0.0, 3.0), (43_200, 0.02, 40.0), (86_400 * 9, 0.0, 2.0), (43_200, -0.3, 7.0)])
def test_cusum(spark, seconds, drift, k):
    """Blocks of a bar or some; with a drift and a far threshold a block never comes to what it would be from zero."""
    rng = np.random.default_rng(int(k) % 97)
    values = {s: [None if rng.random() < 0.1 else float(drift + rng.normal() * (0.01 if drift else 1)) for _ in range(n)] for s, n in (("a", 72), ("b", 20), ("c", 1))}
    sigma = {(s, i): None if rng.random() < 0.05 else float(rng.choice([0.5, 1.0])) for s, xs in values.items() for i in range(len(xs))}
    rows = [(s, T0 + timedelta(hours=i), x, sigma[s, i]) for s, xs in values.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, ret double, sigma double").orderBy(F.rand(3))
    want = [(s, *e) for s in values for e in plain_cusum([r[1:] for r in rows if r[0] == s], k)]
    got = scans.cusum(df, k, block_seconds=seconds)
    assert sorted(map(tuple, got.select("symbol", "t0", "side").collect())) == sorted(want)
    assert got.columns == ["symbol", "t0", "side", "threshold", "sigma"]
