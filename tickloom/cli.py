"""Commands: ``python -m tickloom.cli COMMAND ...``; each reads and writes Parquet folders."""

from __future__ import annotations

import argparse

from .operators import backtest
from .plans import flows
from .session import session
from .sources import files, parsers, sinks
from .streaming import paper


def thresholds(text: str) -> list[float]:
    """``0.1,0.2`` or, with dots between, the steps from the first two to the last: ``0.1,0.15,...,0.9``."""
    parts = [p.strip() for p in text.split(",")]
    if "..." not in parts:
        return [float(p) for p in parts]
    if parts.index("...") < 2 or parts[-1] == "...":
        raise ValueError("two values stand before the dots, and one after")
    given, last = [float(p) for p in parts[: parts.index("...")]], float(parts[-1])
    step = given[-1] - given[-2]
    if step <= 0:
        raise ValueError("steps go up")
    return given[:-1] + [round(given[-1] + k * step, 10) for k in range(int((last - given[-1]) / step + 1e-9) + 1)]


#: Options that may be left out.
OPTIONAL = {"--book", "--config", "--timeout", "--mode", "--fee-mults", "--slippage-mults", "--probabilities", "--policies", "--root"}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tickloom")
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [c := commands.add_parser(name), *(c.add_argument(o, required=o not in OPTIONAL) for o in options)]
    add("ingest", "--input", "--root", "--dataset", "--exchange", "--market", "--symbol")
    add("ingest-book-log", "--input", "--root", "--exchange", "--market", "--symbol")
    add("run", "--trades", "--book", "--config", "--output")
    add("diagnose", "--features", "--columns", "--output")
    add("analyze", "--trades", "--output")
    add("sweep-costs", "--trades", "--output")
    add("sweep-thresholds", "--trades", "--thresholds", "--output")
    add("inspect", "--input")
    add("inspect-book-log", "--input", "--date", "--output")
    add("train", "--rows", "--features", "--columns", "--config", "--output")
    add("backtest", "--bars", "--config", "--mode", "--fee-mults", "--slippage-mults", "--probabilities", "--policies", "--output")
    add("live", "--input", "--venue", "--output", "--timeout")
    a = parser.parse_args(arguments)
    spark = session()
    if a.command == "ingest":
        raw = files.zipped_csv(spark, a.input) if a.input.endswith(".zip") else files.table(spark, a.input)
        print(flows.ingest(spark, raw, a.root, a.dataset, a.exchange, a.market, a.symbol)["rows"])
    elif a.command == "ingest-book-log":
        print(flows.ingest_book_log(spark, files.numbered_lines(spark, a.input), a.root, a.exchange, a.market, a.symbol)["rows"])
    elif a.command == "run":
        config = flows.configured(sinks.read_text(spark, a.config)) if a.config else flows.Config()
        flows.write_run(spark, flows.run(spark, spark.read.parquet(a.trades), spark.read.parquet(a.book) if a.book else None, config), a.output)
    elif a.command == "diagnose":
        parts = flows.diagnosis(spark.read.parquet(a.features), a.columns.split(","))
        sinks.write_text(spark, a.output, "\n".join(sinks.report(df, title) for title, df in parts.items()))
    elif a.command == "analyze":
        sinks.write_text(spark, a.output, "\n".join(sinks.report(df, title) for title, df in flows.attribution(spark.read.parquet(a.trades)).items()))
    elif a.command == "sweep-costs":
        sinks.write_text(spark, a.output, sinks.report(backtest.cost_sweep(spark.read.parquet(a.trades), [(k, k) for k in range(5)]).orderBy("fee_bps"), "Cost sweep"))
    elif a.command == "sweep-thresholds":
        trades = spark.read.parquet(a.trades)
        sweep = backtest.threshold_sweep(trades, thresholds(a.thresholds))
        sinks.write_text(spark, a.output, sinks.report(sweep.orderBy("threshold"), "Thresholds") + sinks.report(backtest.recommended(sweep, trades.count()), "Recommended"))
    elif a.command == "inspect":
        files.containers(spark, a.input).show(1000, False)
    elif a.command == "inspect-book-log":
        from datetime import datetime, timezone

        start = int(datetime.fromisoformat(a.date).replace(tzinfo=timezone.utc).timestamp() * 1000)
        found = parsers.book_log_report(files.numbered_lines(spark, a.input), start, start + 86_400_000).orderBy("path")
        sinks.write_text(spark, a.output, sinks.report(found, f"Book logs, {a.date}"))
    elif a.command == "train":
        config = flows.configured(sinks.read_text(spark, a.config)) if a.config else flows.Config()
        print(flows.train(spark, spark.read.parquet(a.rows), spark.read.parquet(a.features), a.columns.split(","), config, a.output)["overall"])
    elif a.command == "backtest":
        config = flows.configured(sinks.read_text(spark, a.config)) if a.config else flows.Config()
        numbers = lambda text: tuple(float(x) for x in text.split(",")) if text else ()
        p = spark.read.parquet(a.probabilities) if a.probabilities else None
        print(flows.backtested(spark, spark.read.parquet(a.bars), config, a.output, a.mode or "both", numbers(a.fee_mults), numbers(a.slippage_mults) or (1.0,), p, tuple((a.policies or "full_policy").split(",")))["summary"])
    elif a.command == "live":
        messages = spark.readStream.schema("seq long, value string").json(a.input)
        q = paper.paper_trades(paper.decoded(messages, a.venue)).writeStream.format("json").option("path", a.output).option("checkpointLocation", f"{a.output}/_checkpoint").start()
        q.awaitTermination(int(a.timeout) if a.timeout else None)


if __name__ == "__main__":
    main()
