"""Whole runs: ingest, features and diagnosis, backtest with and without hazard exits, sweeps and attribution."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeops as T
from ..operators import backtest, bars, folds, labels, meta, micro, models, quality_gates, regime
from ..sources import files, parsers, sinks


@dataclass
class Config:
    """All settings of a run; :func:`configured` makes one from JSON or YAML."""

    bar_seconds: int = 60
    wide_seconds: int = 300
    levels: list[int] = field(default_factory=lambda: [1, 2, 3])
    rv_window: int = 12
    hazard_quantile: float = 0.8
    ema_fast: int = 12
    ema_slow: int = 48
    trend_strength: float = 1.0
    band_window: int = 20
    band_k: float = 2.0
    atr_window: int = 14
    tolerance: float = 0.3
    horizon: int = 3600
    pt: float = 1.5
    sl: float = 1.0
    overrides: dict = field(default_factory=dict)
    cusum_k: float = 3.0
    hazard_horizon: int = 300
    exit_at: float = 0.6
    fail_at: float = 0.85
    in_a_row: int = 2
    capital: float = 10_000.0
    leverage: float = 1.0
    share: float = 0.1
    fee_bps: float = 4.0
    slippage_bps: float = 2.0
    latency_ms: int = 0
    train_days: int = 20
    test_days: int = 5
    step_days: int = 5
    embargo_minutes: int = 60
    least_coverage: float = 0.5
    meta_threshold: float | None = None
    calibration: str | None = "isotonic"
    large_bytes: int = 50 << 20
    large_records: int = 10_000

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def configured(text: str, **changes: object) -> Config:
    """From JSON, or YAML where PyYAML is installed; unknown keys are an error."""
    try:
        values = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        values = yaml.safe_load(text)
    return replace(Config(**values), **changes)


def ingest(spark: SparkSession, raw: DataFrame, root: str, dataset: str, exchange: str, market: str, symbol: str) -> dict:
    """Raw rows through the dataset's parser into its table; returns the manifest."""
    parse = {"klines_1m": parsers.klines, "agg_trades": parsers.agg_trades, "book_ticker": parsers.book_ticker, "book_depth": parsers.book_depth, "funding_rate": parsers.funding_rate}[dataset]
    return sinks.upsert(parse(raw, symbol), root, dataset, exchange, market)


def ingest_book_log(spark: SparkSession, lines: DataFrame, root: str, exchange: str, market: str, symbol: str, levels: int = 50, sample_ms: int = 1000, most_errors: float = 0.001, c: Config | None = None) -> dict:
    """Replays a log of snapshots and deltas into book_depth.

    A file with too many undecodable lines, with few records for its size, or with none is an error, and so is a log that
    gives no row.
    """
    c = c or Config()
    named = lines if "path" in lines.columns else lines.withColumn("path", F.lit(symbol))
    found = parsers.book_log_report(named, 0, 1 << 62)
    wrong = (F.col("decode_errors") > most_errors * F.col("lines")) | (F.col("records") == 0) | ((F.col("bytes") >= c.large_bytes) & (F.col("records") < c.large_records))
    if found.isEmpty():
        raise ValueError("the log has no lines")
    if bad := found.where(wrong).orderBy("path").limit(5).collect():
        raise ValueError("; ".join(f"{r['path']}: {r['decode_errors']} of {r['lines']} lines can't be decoded, {r['records']} records in {r['bytes']} bytes" for r in bad))
    rows = folds.replay_book(parsers.book_events(lines, symbol), levels, sample_ms)
    pads = [F.lit(None).cast("double").alias(c) for c in parsers.depth_columns() if c not in rows.columns]
    rows = sinks.staged(rows.select("*", *pads), "book")
    if rows.isEmpty():
        raise ValueError("the log gives no book rows")
    return sinks.upsert(rows, root, "book_depth", exchange, market)


@dataclass
class Run:
    narrow: DataFrame
    wide: DataFrame
    features: DataFrame
    entries: DataFrame
    labelled: DataFrame
    baseline: DataFrame
    enhanced: DataFrame | None
    models: list[dict]
    health: dict


def entries_or_cusum(classified: DataFrame, c: Config) -> DataFrame:
    """Entries by regime; if there are none, CUSUM events with ever lower thresholds until there are."""
    found = regime.entries(classified, c.band_window, c.band_k, c.atr_window, c.tolerance)
    if not found.isEmpty():
        return found
    w = T.ordered("symbol", "bar")
    rows = classified.select("symbol", "bar", "mid_close", T.log_return(F.col("mid_close"), w).alias("ret"), F.coalesce("rv", F.lit(1e-6)).alias("sigma"))
    for share in (1, 0.5, 0.25, 0.1):
        events = folds.cusum(rows, c.cusum_k * share)
        if not events.isEmpty():
            break
    priced = events.join(rows.select("symbol", F.col("bar").alias("t0"), F.col("mid_close").alias("entry_price")), ["symbol", "t0"])
    return priced.select(F.col("t0").alias("entry_ts"), "symbol", "side", "entry_price", F.lit(None).cast("string").alias("regime"), F.lit("cusum").alias("reason")).withColumn("event_id", regime.event_id(F.col("symbol"), F.col("entry_ts"), F.col("side"), F.col("reason")))


def run(spark: SparkSession, trades: DataFrame, book: DataFrame | None, c: Config) -> Run:
    """From trades (and book rows) to trade logs, with and without exits by hazard.

    Features look only back, so they are made once and folds cut them. Hazard models are fitted by fold on purged rows.
    """
    sign = micro.sign_by_maker(F.col("is_buyer_maker"))
    narrow = bars.time_bars(trades, c.bar_seconds)
    w = T.ordered("symbol", "bar")
    for column in ("mid_open", "mid_high", "mid_low", "mid_close"):
        narrow = narrow.withColumn(column, T.fill_forward(F.col(column), w))
    narrow = sinks.staged(narrow, "narrow")
    wide = sinks.staged(bars.resample(narrow, c.wide_seconds), "wide")
    coverage = quality_gates.minute_coverage(trades, "symbol", "ts").agg(F.min("ratio")).first()[0] or 0.0
    classified = sinks.staged(regime.classify(wide, c.rv_window, c.hazard_quantile, c.ema_fast, c.ema_slow, c.trend_strength), "classified")
    entered = sinks.staged(entries_or_cusum(classified, c), "entries")
    events = entered.withColumnRenamed("entry_ts", "t0").select("event_id", "symbol", "t0", "side", "entry_price", "regime", "reason")
    events = backtest.delayed(events, wide, c.latency_ms)
    labelled = sinks.staged(labels.triple_barrier(events, wide, labels.volatility(wide), c.horizon, c.pt, c.sl, overrides=c.overrides), "labelled")
    costs = (c.capital, c.leverage, c.share, c.fee_bps, c.slippage_bps)
    baseline = backtest.trade_log(labelled, wide, *costs)
    features = sinks.staged(meta.feature_frame(narrow, book, micro.signed_flow(trades, c.bar_seconds, sign), c.levels), "features")
    health = {"config": c.digest(), "coverage": coverage, "entries": entered.count(), "bars": narrow.count(), "enhanced": False}
    fitted: list[dict] = []
    enhanced = None
    a, b = narrow.agg(F.min("bar"), F.max("bar")).first()
    if coverage >= c.least_coverage and a is not None:
        held = labelled.select("event_id", "symbol", F.col("t0").alias("entry_ts"), F.col("t1").alias("exit_ts"), "side", "entry_price", "sl_price")
        rows = sinks.staged(labels.hazard_rows(held, narrow, c.hazard_horizon, c.bar_seconds), "hazard-rows")
        names = [n for n in features.columns if n.endswith("_z")]
        frame, names = meta.hazard_frame(rows, features, names)
        frame = sinks.staged(frame, "hazard-frame")
        windows = [r.asDict() for r in backtest.folds(spark, a, b, c.train_days, c.test_days, c.step_days, c.embargo_minutes).collect()]  # a row a fold
        p, fitted = models.walk_forward_fit(frame, windows, names, calibration=c.calibration) if names else (None, [])
        if p is not None:
            context = [n for n in frame.columns if n in ("lambda", "resid_std", "spread_mean") or n.startswith(("ofi_L", "repl_ratio_L")) and not n.endswith("_z")]
            p = p.withColumnRenamed("p_hat", "p").join(frame.select("event_id", "t", *context), ["event_id", "t"], "left")
            exits = regime.first_exits(p, c.exit_at, c.fail_at, c.in_a_row)
            enhanced = backtest.trade_log(backtest.with_exits(labelled, exits, narrow), narrow, *costs)
            health["enhanced"] = True
    return Run(narrow, wide, features, entered, labelled, baseline, enhanced, fitted, health)


def write_run(spark: SparkSession, r: Run, root: str) -> None:
    """Parquet of every frame, models and health as JSON, and a report."""
    for name in ("narrow", "wide", "features", "entries", "labelled", "baseline", "enhanced"):
        if (df := getattr(r, name)) is not None:
            df.write.mode("overwrite").parquet(f"{root}/{name}")
    sinks.write_text(spark, f"{root}/health.json", json.dumps(r.health, indent=1))
    sinks.write_text(spark, f"{root}/models.json", models.saved_models(r.models))
    log = spark.read.parquet(f"{root}/{'enhanced' if r.enhanced is not None else 'baseline'}")
    sinks.write_text(spark, f"{root}/attribution.md", "\n".join(sinks.report(df, title) for title, df in attribution(log).items()))


def train(spark: SparkSession, rows: DataFrame, features: DataFrame, columns: list[str], c: Config, root: str) -> dict:
    """Hazard models by fold and of all rows, from hazard rows and features: models.json, oof (Parquet), report.json."""
    frame, names = meta.hazard_frame(rows, features, columns)
    frame = sinks.staged(frame, "hazard-frame")
    if not names or frame.isEmpty():
        raise ValueError("no hazard rows with features")
    a, b = frame.agg(F.min("t"), F.max("t")).first()
    windows = [f.asDict() for f in backtest.folds(spark, a, b, c.train_days, c.test_days, c.step_days, c.embargo_minutes).collect()]  # a row a fold
    oof, by_fold = models.walk_forward_fit(frame, windows, names, calibration=c.calibration)
    measures = lambda df: {"auc": models.auc(df, "p_hat", "y").first()[0], "pr_auc": models.average_precision(df, "p_hat", "y").first()[0], "brier": models.brier(df, "p_hat", "y").first()[0], "lift_top_decile": models.lift(df, "p_hat", "y").first()[0], "rows": df.count()}
    whole = models.fitted(frame, names, calibration=c.calibration)
    report = {"features": names, "folds": len(by_fold), "overall": None}
    if oof is not None:
        oof = sinks.staged(oof, "oof")
        oof.write.mode("overwrite").parquet(f"{root}/oof")
        report["overall"] = measures(oof)
        report["by_fold"] = [{"fold_id": m["fold_id"], **measures(oof.where(F.col("fold_id") == m["fold_id"]))} for m in by_fold]
    sinks.write_text(spark, f"{root}/models.json", models.saved_models([{"fold_id": None, **whole}, *by_fold]))
    sinks.write_text(spark, f"{root}/report.json", json.dumps(report, indent=1, default=str))
    return report


def modes(entries: DataFrame, mode: str) -> DataFrame:
    """Entries of both kinds of regime, or of one: both, trend_only, range_only."""
    name = {"both": None, "trend_only": "TREND", "range_only": "RANGE"}[mode]
    return entries if name is None else entries.where(F.col("regime") == name)


def backtested(spark: SparkSession, bars_: DataFrame, c: Config, root: str, mode: str = "both", fee_mults: tuple[float, ...] = (), slippage_mults: tuple[float, ...] = (1.0,), probabilities: DataFrame | None = None, policies: tuple[str, ...] = ("full_policy",)) -> dict:
    """Trades of classified bars: trades (Parquet, and CSV beside it), and a report.

    With ``fee_mults``, also the walk-forward summaries (walk_forward) and each fold's trades (fold_trades, by fold); with
    ``probabilities`` (event_id, t, p), each fold's comparison of the exit policies with none (compared).
    """
    classified = sinks.staged(regime.classify(bars_, c.rv_window, c.hazard_quantile, c.ema_fast, c.ema_slow, c.trend_strength), "classified")
    events = modes(entries_or_cusum(classified, c), mode).withColumnRenamed("entry_ts", "t0").select("event_id", "symbol", "t0", "side", "entry_price", "regime", "reason")
    events = backtest.delayed(events, bars_, c.latency_ms)
    labelled = sinks.staged(labels.triple_barrier(events, bars_, labels.volatility(bars_), c.horizon, c.pt, c.sl, overrides=c.overrides), "labelled")
    costs = (c.capital, c.leverage, c.share, c.fee_bps, c.slippage_bps)
    log = sinks.staged(backtest.trade_log(labelled, bars_, *costs), "trades")
    log.write.mode("overwrite").parquet(f"{root}/trades")
    log.write.mode("overwrite").option("header", True).csv(f"{root}/trades.csv")
    one = backtest.trade_summary(log.withColumn("all", F.lit("all")), ["all"], c.capital).first()
    report = {"config": c.digest(), "mode": mode, "summary": one.asDict() if one else {}}
    a, b = bars_.agg(F.min("bar"), F.max("bar")).first()
    fold_rows = backtest.folds(spark, a, b, c.train_days, c.test_days, c.step_days, c.embargo_minutes)
    if fee_mults:
        walked = sinks.staged(backtest.walk_forward(log, fold_rows, list(fee_mults), list(slippage_mults), c.capital), "walk-forward")
        walked.write.mode("overwrite").parquet(f"{root}/walk_forward")
        backtest.by_fold(log, fold_rows, "entry_ts").write.mode("overwrite").partitionBy("fold_id").parquet(f"{root}/fold_trades")
        report["folds"] = walked.select("fold_id").distinct().count()
        report["middles"] = [r.asDict() for r in quality_gates.middles(walked, ["pnl_net", "trade_count", "win_rate"]).collect()]
    if probabilities is not None:
        compared = backtest.walk_forward_compared(labelled, probabilities, bars_, fold_rows, list(policies), c.exit_at, c.fail_at, c.in_a_row, costs)
        compared.write.mode("overwrite").parquet(f"{root}/compared")
    sinks.write_text(spark, f"{root}/report.json", json.dumps(report, indent=1, default=str))
    return report


def attribution(trades: DataFrame) -> dict[str, DataFrame]:
    one = trades.withColumn("all", F.lit("all"))
    parts = {f"Net profit by {k}": backtest.pnl_by(trades, k).orderBy("key") for k in ("day", "week", "regime", "event_type", "exit_reason")}
    return {"Summary": backtest.trade_summary(one, ["all"]), "Tail": backtest.tail(one, ["all"]), "Holding": backtest.holding(one, ["all"]), "Exits": backtest.hazard_exit_counts(one, ["all"]), **parts, "Drivers": backtest.top_drivers(trades, ["regime", "event_type", "exit_reason"])}


def diagnosis(features: DataFrame, columns: list[str], horizons: tuple[int, ...] = (1, 5, 15, 30), top: int = 10) -> dict[str, DataFrame]:
    """Missing values, quantiles, and rank correlations of features with forward returns."""
    w = T.ordered("symbol", "bar")
    ahead = features.select("symbol", "bar", *columns, *(T.forward_return(F.col("mid_close"), h, w).alias(f"fwd_{h}") for h in horizons))
    ic = micro.rank_correlation(ahead, columns, [f"fwd_{h}" for h in horizons])
    values = features.select(F.expr(f"stack({len(columns)}, {', '.join(f'{c!r}, double(`{c}`)' for c in columns)}) AS (feature, x)"))
    quantiles = T.add_quantiles(values.select("feature").distinct(), values, ["feature"], "x", {f"q{round(100 * q)}": q for q in (0.01, 0.05, 0.5, 0.95, 0.99)})
    return {"Missing": quality_gates.missing_share(features.withColumn("all", F.lit("all")), columns, ["all"]), "Missing by day": quality_gates.missing_share(features.withColumn("day", F.to_date("bar")), columns, ["day"]), "Quantiles": quantiles, "IC": ic, "Top IC": micro.top_features(ic, top)}
