"""Raw exchange rows to canonical ones: names, types, times, sides, level lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.timeops import numbered_by_day

LEVELS = 50
LEVEL = "array<struct<price:double,size:double>>"


def _kline() -> S.StructType:
    return S.StructType([S.StructField("ts", S.LongType()), *(S.StructField(n, S.DoubleType()) for n in ("open", "high", "low", "close", "volume")), S.StructField("close_ts", S.LongType()), S.StructField("quote_volume", S.DoubleType()), S.StructField("trade_count", S.LongType()), S.StructField("taker_buy_base", S.DoubleType()), S.StructField("taker_buy_quote", S.DoubleType()), S.StructField("symbol", S.StringType())])


def depth_columns(levels: int = LEVELS) -> list[str]:
    return [f"{side}_{field}_{i}" for i in range(1, levels + 1) for side, field in (("bid", "price"), ("bid", "size"), ("ask", "price"), ("ask", "size"))]


def _depth(levels: int = LEVELS) -> S.StructType:
    return S.StructType([S.StructField("ts", S.LongType()), S.StructField("update_id", S.LongType()), *(S.StructField(c, S.DoubleType()) for c in depth_columns(levels)), S.StructField("symbol", S.StringType())])


def _of(**columns: S.DataType) -> S.StructType:
    return S.StructType([S.StructField(k, v) for k, v in columns.items()])


#: Canonical schemas and primary keys of the datasets.
SCHEMAS: dict[str, tuple[S.StructType, list[str]]] = {
    **{name: (_kline(), ["symbol", "ts"]) for name in ("klines_1m", "premium_kline", "mark_kline")},
    "agg_trades": (_of(agg_id=S.LongType(), ts=S.LongType(), price=S.DoubleType(), qty=S.DoubleType(), is_buyer_maker=S.BooleanType(), symbol=S.StringType()), ["symbol", "agg_id"]),
    "book_ticker": (_of(ts=S.LongType(), update_id=S.LongType(), bid_price=S.DoubleType(), bid_qty=S.DoubleType(), ask_price=S.DoubleType(), ask_qty=S.DoubleType(), symbol=S.StringType()), ["symbol", "update_id"]),
    "book_depth": (_depth(), ["symbol", "update_id"]),
    "funding_rate": (_of(ts=S.LongType(), funding_rate=S.DoubleType(), symbol=S.StringType()), ["symbol", "ts"]),
    "l2_snapshots": (S.StructType([f for f in _depth().fields if f.name != "update_id"]), ["symbol", "ts"]),
}


def enforce(df: DataFrame, dataset: str) -> DataFrame:
    """The dataset's columns in its types and order; ValueError if one is missing, others are left behind."""
    schema = SCHEMAS[dataset][0]
    if missing := [n for n in schema.names if n not in df.columns]:
        raise ValueError(f"{dataset} lacks {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9_]", "", name.strip().lower().replace("-", "_").replace(" ", "_"))


def normalized(df: DataFrame) -> DataFrame:
    return df.toDF(*(plain_name(c) for c in df.columns))


def first_of(df: DataFrame, *names: str) -> Column | None:
    """The first of the columns that is there."""
    return next((F.col(n) for n in names if n in df.columns), None)


def needed(df: DataFrame, *names: str) -> Column:
    found = first_of(df, *names)
    if found is None:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return found


def number(c: Column, kind: str = "double") -> Column:
    """NULL where it is no number."""
    return c.cast("string").try_cast("double").cast(kind) if kind == "double" else c.cast("string").try_cast("double").try_cast(kind)


def truth(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "t")


def in_ms(c: Column) -> Column:
    """Milliseconds from seconds, milliseconds, microseconds or nanoseconds, told apart by size."""
    v = c.cast("string").try_cast("decimal(38,6)")
    return F.when(v < 10**11, v * 1000).when(v < 10**14, v).when(v < 10**17, v / 1000).otherwise(v / 10**6).cast("long")


def maker_of(side: Column) -> Column:
    """Whether the buyer was the maker: the taker sold (an unknown side counts as bought)."""
    return F.coalesce(F.lower(F.trim(side)).isin("sell", "s"), F.lit(False))


def klines(raw: DataFrame, symbol: str, offset_ms: int = 60_000) -> DataFrame:
    """Candles of any of the exchanges' column names; what is missing gets its default; rows without a price go."""
    d = normalized(raw)
    get = lambda default, *names: number(c) if (c := first_of(d, *names)) is not None else F.lit(default).cast("double")
    ts = in_ms(needed(d, "ts", "open_time", "ts_ms", "timestamp", "time", "start"))
    close = first_of(d, "close_ts", "close_time")
    out = d.select(ts.alias("ts"), *(number(needed(d, n)).alias(n) for n in ("open", "high", "low", "close")), get(0.0, "volume", "vol").alias("volume"), (in_ms(close) if close is not None else ts + offset_ms).alias("close_ts"), get(0.0, "quote_volume", "quote_asset_volume", "volccyquote", "volccyq", "turnover").alias("quote_volume"), get(0.0, "trade_count", "count", "number_of_trades").cast("long").alias("trade_count"), get(0.0, "taker_buy_base", "taker_buy_volume", "taker_buy_base_asset_volume").alias("taker_buy_base"), get(0.0, "taker_buy_quote", "taker_buy_quote_volume", "taker_buy_quote_asset_volume").alias("taker_buy_quote"), F.lit(symbol).alias("symbol"))
    return enforce(out.dropna(subset=["ts", "open", "high", "low", "close"]), "klines_1m")


def agg_trades(raw: DataFrame, symbol: str) -> DataFrame:
    """Trades of any of the exchanges' column names. Without an id, a hash of the row is the id."""
    d = normalized(raw)
    ts = in_ms(needed(d, "ts", "transact_time", "timestamp", "ts_ms", "created_time", "time"))
    price, qty = number(needed(d, "price", "px")), number(needed(d, "qty", "quantity", "size", "sz"))
    ident, maker, side = first_of(d, "agg_id", "agg_trade_id", "id"), first_of(d, "is_buyer_maker"), first_of(d, "side")
    sold = truth(maker) if maker is not None else maker_of(side) if side is not None else F.lit(False)
    other = first_of(d, "trade_id", "trdmatchid", "tradeid")
    agg_id = number(ident, "long") if ident is not None else F.xxhash64(ts, F.coalesce(side, F.lit("")) if side is not None else F.lit(""), price, qty, *([other] if other is not None else []))
    return enforce(d.select(agg_id.alias("agg_id"), ts.alias("ts"), price.alias("price"), qty.alias("qty"), sold.alias("is_buyer_maker"), F.lit(symbol).alias("symbol")).dropna(subset=["ts", "price", "qty"]), "agg_trades")


def numbered_trades(raw: DataFrame, symbol: str) -> DataFrame:
    """Trades of a source that gives no ids: they count from 1 in order of time, price, quantity and side, by days of their
    own; a trade that is equal to another in all of these gets another number."""
    plain = agg_trades(raw.drop(*(c for c in raw.columns if c.strip().lower() in ("agg_id", "agg_trade_id", "id"))), symbol).drop("agg_id")
    rank = plain.withColumn("_at", F.timestamp_millis("ts")).withColumn("_tie", F.struct("price", "qty", "is_buyer_maker"))
    return enforce(numbered_by_day(rank, "agg_id", "symbol", "_at", "_tie").withColumn("agg_id", (F.col("agg_id") + 1).cast("long")).drop("_at", "_tie"), "agg_trades")


def side_counts(raw: DataFrame) -> DataFrame:
    """One row: trades, and those whose side is neither a buy nor a sale (all, where there is no such column)."""
    side = first_of(normalized(raw), "side")
    unknown = ~F.coalesce(F.lower(F.trim(side)).isin("buy", "b", "sell", "s"), F.lit(False)) if side is not None else F.lit(True)
    return normalized(raw).agg(F.count("*").alias("n"), F.count_if(unknown).alias("unknown_side"))


def source_depth(raw: DataFrame, rows: int = 10, most: int = LEVELS) -> int:
    """The levels that a book source has: the longest list of its first rows by time, ``most`` at most; 0 without lists."""
    d = normalized(raw)
    if "bids" not in d.columns or "asks" not in d.columns:
        return 0
    size = lambda c: F.size(level_list(F.col(c) if dict(d.dtypes)[c] == "string" else F.to_json(c)))
    ts = in_ms(needed(d, "ts", "ts_ms", "timestamp", "event_time", "transact_time"))
    first = d.select(ts.alias("ts"), F.greatest(size("bids"), size("asks"), F.lit(0)).alias("n")).orderBy("ts", F.desc("n")).limit(rows)
    return min(most, first.agg(F.max("n")).first()[0] or 0)


def _strict(raw: DataFrame, symbol: str) -> DataFrame:
    """A trade file's columns as values, and which of them are bad; ValueError if it lacks a column."""
    d = raw.toDF(*(c.strip().lower() for c in raw.columns))
    if missing := [c for c in ("timestamp", "symbol", "side", "price", "size") if c not in d.columns]:
        raise ValueError(f"trades are missing columns {', '.join(missing)}; there are {', '.join(raw.columns)}")
    t = number(F.col("timestamp"))
    side = F.lower(F.trim("side"))
    side = F.when(side.isin("b", "buy"), "buy").when(side.isin("s", "sell"), "sell")
    trade_id = F.col("trdmatchid") if "trdmatchid" in d.columns else F.lit(None)
    d = d.select(F.when(t >= 10**12, t).otherwise(t * 1000).alias("t"), F.upper("symbol").alias("symbol"), side.alias("side"), number(F.col("price")).alias("price"), number(F.col("size")).alias("size"), trade_id.cast("string").alias("trade_id"))
    bad = lambda c: F.coalesce(F.isnan(c) | (F.col(c) <= 0), F.lit(True))
    return d.select("*", (F.col("t").isNull() | F.isnan("t")).alias("bad_ts"), bad("price").alias("bad_price"), bad("size").alias("bad_size"), F.col("side").isNull().alias("bad_side"), (F.coalesce(F.col("symbol") != symbol.upper(), F.lit(True))).alias("bad_symbol"))


BAD = ["bad_ts", "bad_price", "bad_size", "bad_side", "bad_symbol"]


def strict_trades(raw: DataFrame, symbol: str, start_ms: int, end_ms: int) -> DataFrame:
    """The valid trades of a symbol in [start, end), each once: ts_ms, symbol, side, price, size, trade_id."""
    good = _strict(raw, symbol).where(~(F.col("bad_ts") | F.col("bad_price") | F.col("bad_size") | F.col("bad_side") | F.col("bad_symbol")))
    rows = good.select(F.col("t").cast("long").alias("ts_ms"), "symbol", "side", "price", "size", "trade_id").where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
    return rows.dropDuplicates()


def strict_counts(raw: DataFrame, symbol: str, start_ms: int, end_ms: int) -> DataFrame:
    """One row: rows seen, rows with each fault (a row may have several), rows valid in the window, and the times seen."""
    d = _strict(raw, symbol)
    clean = ~(F.col("bad_ts") | F.col("bad_price") | F.col("bad_size") | F.col("bad_side") | F.col("bad_symbol"))
    t = F.when(~F.col("bad_ts"), F.col("t")).cast("long")
    return d.agg(F.count("*").alias("seen"), *(F.count_if(F.col(c)).alias(c) for c in BAD), F.count_if(clean & (t >= start_ms) & (t < end_ms)).alias("valid"), F.min(t).alias("min_ts"), F.max(t).alias("max_ts"))


def book_ticker(raw: DataFrame, symbol: str) -> DataFrame:
    d = normalized(raw)
    ts = in_ms(needed(d, "ts", "event_time", "transaction_time", "transact_time", "timestamp", "ts_ms"))
    update = first_of(d, "update_id", "u")
    return enforce(d.select(ts.alias("ts"), (number(update, "long") if update is not None else ts).alias("update_id"), *(number(needed(d, *names)).alias(out) for out, names in (("bid_price", ("bid_price", "best_bid_price", "bidpx")), ("bid_qty", ("bid_qty", "best_bid_qty", "bidsz")), ("ask_price", ("ask_price", "best_ask_price", "askpx")), ("ask_qty", ("ask_qty", "best_ask_qty", "asksz")))), F.lit(symbol).alias("symbol")), "book_ticker")


def funding_rate(raw: DataFrame, symbol: str) -> DataFrame:
    d = normalized(raw)
    return enforce(d.select(in_ms(needed(d, "ts", "funding_time", "calc_time", "timestamp")).alias("ts"), number(needed(d, "funding_rate", "last_funding_rate", "rate")).alias("funding_rate"), F.lit(symbol).alias("symbol")), "funding_rate")


def level_list(text: Column) -> Column:
    """A JSON list of [price, size, ...] as structs; items that are no numbers are skipped, bad JSON is NULL."""
    items = F.from_json(text, "array<array<string>>", {"mode": "PERMISSIVE"})
    pairs = F.transform(items, lambda x: F.struct(F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("size")))
    return F.filter(pairs, lambda p: p["price"].isNotNull() & p["size"].isNotNull())


def top_levels(levels: Column, n: int, bids: bool) -> Column:
    """The n best levels: bids from the highest price, asks from the lowest."""
    return F.slice(F.reverse(F.array_sort(levels)) if bids else F.array_sort(levels), 1, n)


def book_depth(raw: DataFrame, symbol: str, levels: int = LEVELS) -> DataFrame:
    """Depth rows from JSON lists (bids, asks) or from a column for each level; levels that are missing are NULL."""
    d = normalized(raw)
    ts = in_ms(needed(d, "ts", "ts_ms", "timestamp", "event_time", "transact_time"))
    update = first_of(d, "update_id", "seqid", "u", "last_update_id")
    columns = []
    if "bids" in d.columns and "asks" in d.columns:
        text = lambda c: F.col(c) if dict(d.dtypes)[c] == "string" else F.to_json(c)
        d = d.withColumn("_bid", top_levels(level_list(text("bids")), levels, True)).withColumn("_ask", top_levels(level_list(text("asks")), levels, False))
        columns = [F.get(f"_{s}", F.lit(i - 1))[f].alias(f"{s}_{f}_{i}") for i in range(1, levels + 1) for s in ("bid", "ask") for f in ("price", "size")]
    else:
        for i in range(1, levels + 1):
            for s in ("bid", "ask"):
                for f, words in (("price", ("price", "px")), ("size", ("size", "qty", "sz"))):
                    c = first_of(d, *(name for w in words for name in (f"{s}_{w}_{i}", f"{s}s_{w}_{i}", f"{s}{w}{i}", f"{s}{i}_{w}", f"{s}_{i}_{w}")))
                    columns.append((number(c) if c is not None else F.lit(None).cast("double")).alias(f"{s}_{f}_{i}"))
    pads = [F.lit(None).cast("double").alias(c) for c in depth_columns() if int(c.rsplit("_", 1)[1]) > levels]
    return enforce(d.select(ts.alias("ts"), (number(update, "long") if update is not None else ts).alias("update_id"), *columns, *pads, F.lit(symbol).alias("symbol")), "book_depth")


def book_events(lines: DataFrame, symbol: str | Column) -> DataFrame:
    """Snapshot and delta rows for a replay from JSON lines (value, line): symbol, ts, line, kind, u, seq, bids, asks.

    ``symbol`` is one for all lines, or a column of them.
    """
    schema = "type string, ts string, topic string, data struct<s:string, u:long, seq:long, b:array<array<string>>, a:array<array<string>>>"
    name = F.lit(symbol) if isinstance(symbol, str) else symbol
    # as a generator's output each line is parsed once; fields of a parsed column would parse it again in every filter
    j = lines.select(name.alias("symbol"), "line", F.inline(F.array(F.from_json("value", schema)))).where("data is not null")
    return j.select("symbol", in_ms(F.col("ts")).alias("ts"), "line", F.col("type").alias("kind"), "data.u", "data.seq", F.col("data.b").alias("bids"), F.col("data.a").alias("asks")).where("ts is not null")


#: What a number of a given size counts as, by the first power of ten that is above it.
SCALES = ((11, "seconds"), (14, "milliseconds"), (17, "microseconds"), (20, "nanoseconds"))


def book_log_report(lines: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """What a book log (path, value) holds, a row for each file: lines, bytes, decode_errors, records, records in
    [start, end), snapshots, deltas, the times seen, and the units that the times are in (a map of counts)."""
    schema = "type string, ts string, data struct<u:long, seq:long>, _corrupt_record string"
    j = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.where("trim(value) <> ''").select("path", F.length("value").alias("n"), j.alias("j"))
    t = F.col("j.ts").try_cast("decimal(38,6)")
    unit = F.lit("invalid")
    for digits, name in reversed(SCALES):
        unit = F.when(t < F.lit("1" + "0" * digits).cast("decimal(38,0)"), name).otherwise(unit)
    rows = rows.select("path", "n", F.col("j._corrupt_record").isNotNull().alias("bad"), F.col("j.type").alias("kind"), in_ms(F.col("j.ts")).alias("ts"), F.coalesce(F.when(t.isNull() | (t <= 0), "invalid"), unit).alias("unit"), F.col("j.data").isNotNull().alias("is_record"))
    record = F.col("is_record") & F.col("ts").isNotNull()
    units = F.map_from_arrays(F.array(*(F.lit(u) for _, u in SCALES), F.lit("invalid")), F.array(*(F.count_if(F.col("is_record") & (F.col("unit") == u)) for u in [u for _, u in SCALES] + ["invalid"])))
    return rows.groupBy("path").agg(F.count("*").alias("lines"), F.sum("n").alias("bytes"), F.count_if("bad").alias("decode_errors"), F.count_if(record).alias("records"), F.count_if(record & (F.col("ts") >= start_ms) & (F.col("ts") < end_ms)).alias("in_window"), F.count_if(record & (F.col("kind") == "snapshot")).alias("snapshots"), F.count_if(record & (F.col("kind") == "delta")).alias("deltas"), F.min(F.when(record, F.col("ts"))).alias("min_ts"), F.max(F.when(record, F.col("ts"))).alias("max_ts"), units.alias("units"))


def decode_errors(lines: DataFrame) -> DataFrame:
    """How many lines there are, and how many are no JSON objects."""
    bad = F.from_json("value", "type string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()
    return lines.agg(F.count("*").alias("lines"), F.count_if(bad).alias("errors"))
