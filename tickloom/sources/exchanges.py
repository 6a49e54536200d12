"""Candles and trades of exchanges' REST services, by the paged source, in the canonical schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parsers
from .files import Pages


@dataclass(frozen=True)
class Service:
    """Where an exchange answers: paths with {symbol}, {start}, {end}, {limit} and, for pages by id, {id}; rows a page (0: all
    of a slice), milliseconds a slice, and the columns of a row, by name or, for lists, in their order."""

    base: str
    path: str
    columns: tuple[str, ...]
    ts: str
    limit: int
    slice_ms: int
    ident: str | None = None
    from_path: str | None = None
    seconds: float = 0.0


#: Addresses, parameters and field orders of the services.
CANDLE = ("open_time", "open", "high", "low", "close", "volume")
SERVICES: dict[tuple[str, str], Service] = {
    ("binance", "klines_1m"): Service("https://fapi.binance.com", "/fapi/v1/klines?symbol={symbol}&interval=1m&startTime={start}&endTime={end}&limit={limit}", (*CANDLE, "close_time", "quote_volume", "trade_count", "taker_buy_base", "taker_buy_quote"), "0", 1500, 86_400_000),
    ("binance", "agg_trades"): Service("https://fapi.binance.com", "/fapi/v1/aggTrades?symbol={symbol}&startTime={start}&endTime={end}&limit={limit}", ("a", "T", "p", "q", "m"), "T", 1000, 3_300_000, "a", "/fapi/v1/aggTrades?symbol={symbol}&fromId={id}&limit={limit}"),
    ("deepcoin", "klines_1m"): Service("https://api.deepcoin.com", "/public/market/kline?symbol={symbol}&interval=1m&startTime={start}&endTime={end}", CANDLE, "0", 0, 86_400_000, seconds=1.0),
    ("deepcoin", "agg_trades"): Service("https://api.deepcoin.com", "/public/market/trades?symbol={symbol}&startTime={start}&endTime={end}", ("id", "tradeId", "timestamp", "price", "size", "side"), "timestamp", 0, 3_300_000, seconds=1.0),
}
#: Short names of a trade's fields.
TRADE = {"a": "agg_id", "T": "ts", "p": "price", "q": "qty", "m": "is_buyer_maker", "timestamp": "ts", "size": "qty"}


def fetched(spark: SparkSession, exchange: str, dataset: str, symbol: str, start_ms: int, end_ms: int, base: str | None = None, interval: float | None = None) -> DataFrame:
    """Rows of [start, end) of klines_1m or agg_trades, each key once; ``base`` is another address of the same service.

    A partition is a slice of time, so executors ask side by side; ``interval`` is the least seconds between a task's requests.
    """
    if (exchange, dataset) not in SERVICES:
        raise ValueError(f"no {dataset} of {exchange}")
    s = SERVICES[exchange, dataset]
    spark.dataSource.register(Pages)
    url = lambda path: (base or s.base) + path.replace("{symbol}", symbol)
    options = {"url": url(s.path), "start": start_ms, "end": end_ms, "slice": s.slice_ms, "limit": s.limit, "ts": s.ts, "interval": s.seconds if interval is None else interval}
    if s.from_path:
        options |= {"id": s.ident, "from_url": url(s.from_path)}
    pages = spark.read.format("pages").options(**options).load()
    if dataset == "klines_1m":
        row = F.from_json("row", "array<string>")
        raw = pages.select(*(F.get(row, F.lit(i)).alias(n) for i, n in enumerate(s.columns)))
        return parsers.klines(raw, symbol).dropDuplicates(["symbol", "ts"])
    raw = pages.select(F.from_json("row", ", ".join(f"`{c}` string" for c in s.columns)).alias("r")).select(*(F.col(f"r.{c}").alias(TRADE.get(c, c)) for c in s.columns))
    if "tradeId" in s.columns:
        raw = raw.withColumn("id", F.coalesce("id", "tradeId")).drop("tradeId")
    return parsers.agg_trades(raw, symbol).dropDuplicates(["symbol", "agg_id"])
