"""The paged source and the exchanges' services: no row is lost or comes twice, wherever pages end."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tickloom.sources import exchanges, files

CROWD, LIMIT = 5_000, 1_000
T0 = 1_699_999_980_000  # a whole minute
#: (time, id): a few times, one with five pages of rows, one with as many as a page.
ROWS = [(t, i) for i, t in enumerate([1, 2, 2, 2, 3] + [10] * CROWD + [11] * LIMIT + [12, 12, 15])]


def page(start, end, limit):
    return [(t, json.dumps({"id": i, "t": t})) for t, i in ROWS if start <= t < end][: limit or None]


def page_from(ident, limit):
    return [(t, json.dumps({"id": i, "t": t})) for t, i in ROWS if i >= ident][:limit]


def twice(start, end, limit):
    """Rows that are equal in all fields, so that only their number tells."""
    return [(t, "x") for t in [1, 1, 1, 2, 2, 2, 2, 3, 3, 9] if start <= t < end][:limit]


def load(spark, **options):
    spark.dataSource.register(files.Pages)
    return spark.read.format("pages").options(**{"start": 0, "end": 20, "slice": 100, **options}).load().collect()


HERE = "tests.test_pages"


@pytest.mark.parametrize("slice_ms", [1, 7, 100])
@pytest.mark.parametrize("limit", [2, 3, 7, LIMIT])
def test_each_row_once(slice_ms, limit):
    """Through the reader itself, as Spark runs it for each slice."""
    reader = files.PagesReader({"fetch": f"{HERE}:page", "from_fetch": f"{HERE}:page_from", "id": "id", "start": "0", "end": "20", "slice": str(slice_ms), "limit": str(limit)})
    if limit < 10 and slice_ms == 100:
        reader.options["end"] = "4"  # else thousands of pages
    got = [json.loads(row)["id"] for part in reader.partitions() if limit >= 10 or part.start < 4 for _, row in reader.read(part)]
    assert sorted(got) == [i for t, i in ROWS if limit >= 10 or t < 4]


def test_a_crowded_millisecond(spark):
    rows = load(spark, fetch=f"{HERE}:page", from_fetch=f"{HERE}:page_from", id="id", limit=LIMIT)
    assert Counter(json.loads(r.row)["id"] for r in rows) == Counter(i for _, i in ROWS)


def test_without_ids_it_raises(spark):
    with pytest.raises(Exception, match="more rows of time 10"):
        load(spark, fetch=f"{HERE}:page", limit=LIMIT)


def test_rows_that_are_equal(spark):
    assert Counter(r.ts for r in load(spark, fetch=f"{HERE}:twice", limit=5)) == Counter({1: 3, 2: 4, 3: 2, 9: 1})
    with pytest.raises(Exception, match="more rows of time 2"):
        load(spark, fetch=f"{HERE}:twice", limit=4)


def test_services(spark):
    """Candles and trades of both exchanges from a server that answers as they do and is busy now and then."""
    asked: list[str] = []
    trades = [{"a": i, "T": T0 + t * 1000, "p": "10.5", "q": str(i), "m": i % 2 == 0} for t, i in ROWS]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url, q = urlparse(self.path), {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(self.path)
            if len(asked) == 2:
                self.send_response(503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            start, end = int(q.get("startTime", 0)), int(q.get("endTime", 1 << 60))
            if url.path == "/fapi/v1/klines":
                body = [[t, "1", "3", "0.5", "2", "10", t + 59_999, "20", 7, "4", "8"] for t in range(-(-start // 60_000) * 60_000, end + 1, 60_000)][: int(q["limit"])]
            elif url.path == "/fapi/v1/aggTrades":
                body = [t for t in trades if (t["a"] >= int(q["fromId"]) if "fromId" in q else start <= t["T"] <= end)][: int(q["limit"])]
            elif url.path == "/public/market/kline":
                body = [[str(t), "1", "3", "0.5", "2", "10"] for t in range(-(-start // 60_000) * 60_000, end, 60_000)]
            else:
                body = [{"tradeId": t["a"], "timestamp": t["T"], "price": t["p"], "size": t["q"], "side": "Sell" if t["m"] else "buy"} for t in trades[:10] if start <= t["T"] < end]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        get = lambda exchange, dataset, end: exchanges.fetched(spark, exchange, dataset, "BTC", T0, T0 + end, base, 0).collect()
        candles = get("binance", "klines_1m", 2 * 86_400_000)
        assert sorted(r.ts for r in candles) == list(range(T0, T0 + 2 * 86_400_000, 60_000))
        assert {(r.close, r.close_ts - r.ts, r.trade_count, r.taker_buy_quote) for r in candles} == {(2.0, 59_999, 7, 8.0)}
        got = get("binance", "agg_trades", 16_000)
        assert sorted((r.ts, r.agg_id, r.is_buyer_maker) for r in got) == [(T0 + t * 1000, i, i % 2 == 0) for t, i in ROWS]
        assert any("fromId" in a for a in asked)
        assert len(get("deepcoin", "klines_1m", 600_000)) == 10
        assert sorted((r.agg_id, r.ts, r.is_buyer_maker) for r in get("deepcoin", "agg_trades", 16_000)) == [(i, T0 + t * 1000, i % 2 == 0) for t, i in ROWS[:10]]
        with pytest.raises(ValueError, match="no klines_1m of nobody"):
            exchanges.fetched(spark, "nobody", "klines_1m", "BTC", 0, 1)
    finally:
        server.shutdown()
