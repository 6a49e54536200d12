"""Folds of a key's rows in order: volume buckets and book replay (scans.py has those that are cut into parts).

Buckets run as applyInPandas per key in a total order. A bucket's size follows from where the one before ended, so a key's
minutes meet in one task. Book logs are cut into sessions, each of which begins with a snapshot; a task streams through its
sessions, of which there may be very many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import staged
from ..functions.timeops import filled_by_day, numbered_by_day, ordered
from .scans import cooldown, cusum, ewm, nonoverlapping  # noqa: F401


def fold(rows: DataFrame, by: str | list[str], order: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def group(frame: pd.DataFrame) -> pd.DataFrame:
        return run(frame.sort_values(order, kind="stable", ignore_index=True))

    return rows.groupBy(by).applyInPandas(group, schema)


def volume_buckets(minutes: DataFrame, multiple: float, window: int, least: float, by: str = "symbol", order: str = "minute") -> DataFrame:
    """VPIN's buckets of equal volume from minute totals: (key, end, place, bucket_volume, imbalance).

    A bucket's size is fixed when it opens: the mean volume of the last ``window`` minutes times ``multiple``, ``least``
    at least. Minutes are shared out in proportion; a last bucket that isn't full is left out.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        mean = f["volume"].rolling(window, min_periods=1).mean().tolist()
        out, size, buy, sell = [], None, 0.0, 0.0
        for t, b, s, m in zip(f[order], f["buy"].tolist(), f["sell"].tolist(), mean, strict=True):
            left = b + s
            if left <= 0:
                continue
            share = b / left
            while left > 1e-12:
                if size is None:
                    size = max(m * multiple, least)
                take = min(left, size - buy - sell)
                buy, sell, left = buy + take * share, sell + take * (1 - share), left - take
                if buy + sell >= size - 1e-9:
                    out.append((f[by].iloc[0], t, len(out), size, abs(buy - sell) / size))
                    size, buy, sell = None, 0.0, 0.0
        return pd.DataFrame(out, columns=[by, "end", "place", "bucket_volume", "imbalance"])

    slim = minutes.select(by, order, "buy", "sell", "volume")
    return fold(slim, by, [order], run, f"{by} {slim.schema[by].dataType.simpleString()}, end {slim.schema[order].dataType.simpleString()}, place long, bucket_volume double, imbalance double")


BOOK_EVENT = "symbol string, ts long, line long, kind string, u long, seq long, bids array<array<string>>, asks array<array<string>>"


class BookState:
    """A book by price; a size of zero or less takes a level away."""

    def __init__(self) -> None:
        self.sides: tuple[dict[float, float], dict[float, float]] = ({}, {})

    def apply(self, bids, asks, snapshot: bool) -> None:
        for side, levels in zip(self.sides, (bids, asks), strict=True):
            if snapshot:
                side.clear()
            for level in levels if levels is not None else ():
                try:
                    price, size = float(level[0]), float(level[1])
                except (TypeError, ValueError, IndexError):
                    continue
                if size > 0:
                    side[price] = size
                else:
                    side.pop(price, None)

    def top(self, n: int) -> list[float | None]:
        bids, asks = sorted(self.sides[0].items(), reverse=True)[:n], sorted(self.sides[1].items())[:n]
        row: list[float | None] = []
        for side in (bids, asks):
            row += [p for p, _ in side] + [None] * (n - len(side)) + [s for _, s in side] + [None] * (n - len(side))
        return row


def replay_book(events: DataFrame, levels: int, sample_ms: int = 1000, every: bool = False) -> DataFrame:
    """Book rows from snapshots and deltas in order of (ts, line): ts, update_id, and price and size of each level.

    A row comes at the first event of each ``sample_ms`` (or at every event), after it has been applied. A delta with
    u = 1 is a snapshot; deltas before the first snapshot, or after one whose number doesn't grow, wait for the next. A
    snapshot makes the book anew, so what follows it, up to the next, is replayed by itself.
    """
    names = [f"{s}_{f}_{i}" for s in ("bid", "ask") for f in ("price", "size") for i in range(1, levels + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sessions one after another, each in order; a session may go on in the next batch."""
        session = state = valid = last = bucket = None
        for batch in batches:
            out = []
            for symbol, at, ts, line, kind, u, seq, bids, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (symbol, at) != session:
                    session, state, valid, last, bucket = (symbol, at), BookState(), False, None, None
                number = seq if seq is not None else u
                snapshot = kind == "snapshot" or u == 1
                if not snapshot:
                    if valid and last is not None and number is not None and number <= last:
                        valid = False
                    if not valid:
                        continue
                state.apply(bids, asks, snapshot)
                valid, last = True, number if number is not None else last
                if every or ts // sample_ms != bucket:
                    bucket = ts // sample_ms
                    out.append((symbol, ts, line, *state.top(levels)))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    # parsed and replayed once each: what follows looks at the rows twice
    at = staged(events.withColumn("_at", F.timestamp_millis("ts")), "book-events")
    snapshot = (F.col("kind") == "snapshot") | (F.col("u") == 1)
    sessions = filled_by_day(at, F.when(snapshot, F.concat_ws("|", "ts", "line")), "_session", "symbol", "_at", "line").where("_session is not null")
    kind = sessions.schema["line"].dataType.simpleString()
    schema = f"symbol string, ts long, line {kind}, " + ", ".join(f"{n} double" for n in names)
    line = pa.string() if kind == "string" else pa.from_numpy_dtype({"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8"}[kind])
    arrow = pa.schema([("symbol", pa.string()), ("ts", pa.int64()), ("line", line), *((n, pa.float64()) for n in names)])
    dealt = sessions.select("symbol", "_session", "ts", "line", "kind", "u", "seq", "bids", "asks").repartition("symbol", "_session")
    rows = dealt.sortWithinPartitions("symbol", "_session", "ts", "line").mapInArrow(run, schema)
    if not every:  # a bucket in which a session ends and another begins has a row of each
        rows = rows.withColumn("_bucket", F.floor(F.col("ts") / sample_ms)).withColumn("_r", F.row_number().over(ordered(["symbol", "_bucket"], "ts", "line")))
        rows = rows.where("_r = 1").drop("_r", "_bucket")
    placed = numbered_by_day(staged(rows.withColumn("_at", F.timestamp_millis("ts")), "book-rows"), "_place", "symbol", "_at", "line")
    return placed.select("symbol", "ts", (F.col("ts") * 1_000_000 + F.col("_place")).alias("update_id"), *names)
