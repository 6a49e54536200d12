"""Plan shapes: raw rows are never ordered by their key alone, and no window has one group."""

import re

import pytest
from pyspark.sql import functions as F

from tickloom.functions import timeops as T
from tickloom.operators import micro, models
from tickloom.plans import views
from tickloom.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["tick_rule_sign", "ofi_levels", "weighted_ofi_z", "replenishment", "gap_check", "sampling_interval"])
def test_raw_rows_are_ordered_within_a_day(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for window in re.findall(r"\) Window\b.*?Arguments: (.*?)\n\n", text, re.S):
        # the windows by symbol alone place the few rows that days lend each other, or a row a day
        assert "_chunk" in window or re.search(r"_pos|_upto|_known", window), window


@pytest.mark.parametrize("name", ["ic_spearman", "auc_rank", "avg_precision", "lift_decile"])
def test_running_totals_are_by_range(spark, name):
    text = plan(QUERIES[name](spark, SF))
    groups = re.findall(r"\) Window\b.*?Arguments: .*?, \[(.*?)\], \[(.*?)\]", text, re.S)
    assert groups and all("_bucket" in by + order or "symbol" in by for by, order in groups)


def test_days_lend_enough_rows(spark):
    """Whatever the length of a day, windows are those of the whole history."""
    t = views.trades(spark, SF).where("agg_id < 300")
    whole = T.ordered("symbol", "ts", "agg_id")
    want = t.select("agg_id", F.lag("price", 3).over(whole).alias("l"), T.rolling_mean(F.col("price"), 4, whole).alias("m"))
    for seconds in (60, 3600, 86_400, 86_400 * 40):
        got = T.by_day(t, "symbol", "ts", "agg_id", 3, lambda d, w: d.withColumn("l", F.lag("price", 3).over(w)).withColumn("m", T.rolling_mean(F.col("price"), 4, w)), seconds)
        assert sorted(map(tuple, got.select("agg_id", "l", "m").collect())) == sorted(map(tuple, want.collect()))
        filled = T.filled_by_day(t.withColumn("x", F.when(F.col("agg_id") % 7 == 0, F.col("agg_id"))), F.col("x"), "f", "symbol", "ts", "agg_id", seconds)
        plain = t.select("agg_id", T.fill_forward(F.when(F.col("agg_id") % 7 == 0, F.col("agg_id")), whole).alias("f"))
        assert sorted(map(str, filled.select("agg_id", "f").collect())) == sorted(map(str, plain.collect()))


def test_running_totals_and_scores_by_hand(spark):
    rows = spark.createDataFrame([(float(i % 9), i % 2, i) for i in range(40)], "s double, y int, i int")
    c = rows.groupBy("s").agg(F.count("*").alias("n"))
    for buckets in (2, 3, 64):
        got = {r.s: r.cum_n for r in T.running_totals(c, [], "s", ["n"], buckets).collect()}
        assert got == {float(k): sum(1 for i in range(40) if i % 9 <= k) for k in range(9)}
    assert models.auc(rows.where("y = 1"), "s", "y").first()[0] is None and models.lift(rows.limit(0), "s", "y").first()[0] is None
    r = micro.correlation(rows, ["s"], ["y"]).first()
    assert (r.feature, r.target, r.n) == ("s", "y", 40) and abs(r.r - rows.corr("s", "y")) < 1e-12
