import json

import pytest
from pyspark.sql import functions as F

from tickloom import cli
from tickloom.plans import flows, views

SF = "/root/testdata/sf0.001"
CONFIG = dict(bar_seconds=3600, wide_seconds=3600, rv_window=6, ema_fast=6, ema_slow=24, trend_strength=20.0, band_window=10, band_k=1.0, atr_window=8, tolerance=1.0, horizon=6 * 3600, hazard_horizon=2 * 3600, train_days=8, test_days=5, step_days=14, least_coverage=0.0)


def test_a_whole_run(spark, tmp_path):
    c = flows.configured(json.dumps(CONFIG))
    r = flows.run(spark, views.trades(spark, SF), views.book(spark, SF), c)
    out = f"file://{tmp_path}/run"
    flows.write_run(spark, r, out)
    base = spark.read.parquet(out + "/baseline")
    assert base.count() > 0 and r.health["enhanced"] and r.models and spark.read.parquet(out + "/enhanced").count() > 0
    assert base.where(F.abs(F.col("net_pnl") - (F.col("gross_pnl") - F.col("fees") - F.col("slippage"))) > 1e-9).isEmpty()
    for d in (cli.main(["analyze", "--trades", out + "/baseline", "--output", f"{out}/a.md"]), cli.main(["sweep-costs", "--trades", out + "/baseline", "--output", f"{out}/c.md"]), cli.main(["diagnose", "--features", out + "/features", "--columns", "flow_z,lambda_z", "--output", f"{out}/d.md"])):
        assert d is None
    assert "Top IC" in (tmp_path / "run/d.md").read_text() and "# Tail" in (tmp_path / "run/a.md").read_text()
    frame, names = flows.meta.meta_frame(spark.read.parquet(out + "/entries"), r.wide, r.features, ["flow_z", "lambda_z"], 3600)
    assert frame.count() == spark.read.parquet(out + "/entries").count() and "regime_trend" in names and flows.meta.missing_examples(frame, names)[0] == 0


def test_train_and_backtest(spark, tmp_path):
    c = flows.configured(json.dumps(CONFIG))
    r = flows.run(spark, views.trades(spark, SF), views.book(spark, SF), c)
    out = f"file://{tmp_path}"
    held = r.labelled.select("event_id", "symbol", F.col("t0").alias("entry_ts"), F.col("t1").alias("exit_ts"), "side", "entry_price", "sl_price")
    flows.labels.hazard_rows(held, r.narrow, c.hazard_horizon, c.bar_seconds).write.parquet(out + "/rows")
    r.features.write.parquet(out + "/features")
    r.wide.write.parquet(out + "/bars")
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    cli.main(["train", "--rows", out + "/rows", "--features", out + "/features", "--columns", "flow_z,lambda_z", "--config", out + "/c.json", "--output", out + "/20240101_000000_train"])
    report = json.loads((tmp_path / "20240101_000000_train/report.json").read_text())
    saved = flows.models.loaded_models((tmp_path / "20240101_000000_train/models.json").read_text())
    assert report["folds"] == len(saved) - 1 >= 1 and 0 <= report["overall"]["auc"] <= 1 and all("isotonic" in m for m in saved)
    oof = spark.read.parquet(out + "/20240101_000000_train/oof")
    assert 0 < oof.count() == report["overall"]["rows"]
    oof.withColumnRenamed("p_hat", "p").write.parquet(out + "/p")
    args = ["backtest", "--bars", out + "/bars", "--config", out + "/c.json", "--fee-mults", "1.0,2.0", "--probabilities", out + "/p", "--policies", "full_policy,hazard_exit_only", "--output", out + "/20240102_000000_back"]
    cli.main(args)
    run = flows.files.latest_run(spark, out)
    assert run.endswith("20240102_000000_back")
    trades = flows.files.trade_log_of(spark, run, "enhanced", "trades")
    walked = spark.read.parquet(run + "/walk_forward")
    assert trades.count() == spark.read.csv(run + "/trades.csv", header=True).count() > 0 and walked.select("fee_mult").distinct().count() == 2
    folds_ = spark.read.parquet(run + "/fold_trades").groupBy("fold_id").count().collect()
    assert {r.fold_id: r["count"] for r in folds_} == {r.fold_id: r.trade_count for r in walked.where("fee_mult = 1.0").collect()}
    compared = spark.read.parquet(run + "/compared")
    assert {r.mode for r in compared.collect()} == {"full_policy", "hazard_exit_only"} and compared.where("abs(saved - (net_pnl_enh - net_pnl_base)) > 1e-6").isEmpty()
    trend = flows.modes(r.entries, "trend_only")
    assert {x.regime for x in trend.select("regime").distinct().collect()} <= {"TREND"}
    with pytest.raises(ValueError):
        flows.files.trade_log_of(spark, run, "none")
    with pytest.raises(ValueError):
        flows.files.latest_run(spark, run)


def test_no_entries_fall_back_to_cusum(spark):
    c = flows.Config(**{**CONFIG, "band_k": 1e9, "tolerance": 0.0, "cusum_k": 2.0})
    b = views.hourly(spark, SF).withColumn("mid_close", F.coalesce("mid_close", F.lit(100.0)))
    found = flows.entries_or_cusum(flows.regime.classify(b, 6, 0.8, 6, 24, 20.0), c)
    assert found.count() > 0 and {r.reason for r in found.select("reason").distinct().collect()} == {"cusum"}


def test_threshold_lists():
    assert cli.thresholds("0.1,0.5") == [0.1, 0.5] and cli.thresholds("0.1,0.2,...,0.5") == [0.1, 0.2, 0.3, 0.4, 0.5]
    with pytest.raises(ValueError):
        cli.thresholds("0.1,...,0.5")


def test_book_log_gates(spark, tmp_path):
    good = '{"type":"snapshot","ts":1735689600000,"data":{"s":"S","u":1,"seq":7,"b":[["1","2"]],"a":[["2","1"]]}}'
    lines = spark.createDataFrame([(0, good), (1, "broken")], "line long, value string")
    with pytest.raises(ValueError, match="can't be decoded"):
        flows.ingest_book_log(spark, lines, f"file://{tmp_path}/t", "x", "m", "S")
    with pytest.raises(ValueError, match="records"):
        flows.ingest_book_log(spark, lines.where("line = 0"), f"file://{tmp_path}/t", "x", "m", "S", c=flows.Config(large_bytes=10))
    with pytest.raises(ValueError, match="records"):
        flows.ingest_book_log(spark, spark.createDataFrame([(0, '{"topic":"x"}')], "line long, value string"), f"file://{tmp_path}/t", "x", "m", "S")
    with pytest.raises(ValueError, match="no lines"):
        flows.ingest_book_log(spark, lines.where("line > 5"), f"file://{tmp_path}/t", "x", "m", "S")
    assert flows.ingest_book_log(spark, lines.where("line = 0"), f"file://{tmp_path}/t", "x", "m", "S")["rows"] == 1


def test_inspect_book_log(spark, tmp_path):
    rows = ['{"type":"snapshot","ts":1735689600,"data":{"u":1,"seq":7,"b":[],"a":[]}}', '{"type":"delta","ts":1735689600500,"data":{"u":2,"seq":8,"b":[],"a":[]}}', "{broken", '{"type":"delta","ts":1735776000000000,"data":{"u":3,"seq":9,"b":[],"a":[]}}']
    (tmp_path / "log.jsonl").write_text("\n".join(rows))
    report = flows.parsers.book_log_report(flows.files.numbered_lines(spark, f"file://{tmp_path}/log.jsonl"), 1735689600000, 1735776000000).first()
    assert (report.lines, report.decode_errors, report.records, report.in_window, report.snapshots, report.deltas, report.min_ts, report.max_ts) == (4, 1, 3, 2, 1, 2, 1735689600000, 1735776000000)
    assert report.units == {"seconds": 1, "milliseconds": 1, "microseconds": 1, "nanoseconds": 0, "invalid": 0}
    cli.main(["inspect-book-log", "--input", f"file://{tmp_path}/log.jsonl", "--date", "2025-01-01", "--output", f"file://{tmp_path}/r.md"])
    assert "# Book logs, 2025-01-01" in (tmp_path / "r.md").read_text()


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"{i:06d}" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = flows.files.numbered_lines(spark, f"file://{tmp_path}/a.txt")
        assert lines.rdd.getNumPartitions() > 3
        assert [r.value for r in lines.orderBy("line").collect()] == [f"{i:06d}" for i in range(20_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_strict_trades_ask_for_columns(spark):
    raw = spark.createDataFrame([("1764547200000", "BTC", "Buy", "100.0")], "timestamp string, symbol string, side string, price string")
    with pytest.raises(ValueError, match="missing columns size"):
        flows.parsers.strict_trades(raw, "BTC", 0, 10**15)


def test_scores_and_as_of_gates(spark):
    scores = spark.createDataFrame([(i, None if i < 2 else 0.5) for i in range(20)], "event_id long, score double")
    with pytest.raises(ValueError, match="no score"):
        flows.models.gated(scores)
    assert flows.models.gated(scores.where("event_id > 1")).count() == 18
    from tickloom.operators import joins

    t = views.trades(spark, SF)
    late = views.hourly(spark, SF).where("bar > timestamp_ntz'2024-01-10 00:00:00'").select("symbol", "bar", "mid_close")
    with pytest.raises(ValueError, match="no row at or before"):
        joins.asof_required(t, late, "symbol", "ts", "bar")


def test_requests_keep_apart():
    now, slept = [100.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    throttled = flows.files.Throttle(2.0, lambda: now[0], sleep)
    assert [throttled(lambda: 1) for _ in range(3)] == [1, 1, 1] and slept == [2.0, 2.0]
