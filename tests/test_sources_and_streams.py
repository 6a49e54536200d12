import gzip
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.sources import files, parsers, sinks
from tickloom.streaming import bars as stream
from tickloom.streaming import paper

T0 = datetime(2025, 1, 1)
MS = 1735689600000


def test_zipped_klines(spark, tmp_path):
    for d in range(2):
        with zipfile.ZipFile(tmp_path / f"k{d}.zip", "w") as z:
            z.writestr(f"k{d}.csv", "open_time,open,high,low,close,volume,quote_volume,count\n" + "\n".join(f"{MS + 60000 * (2 * d + i)},1,2,0.5,1.5,10,15,3" for i in range(2)))
    k = parsers.klines(files.zipped_csv(spark, str(tmp_path)), "BTC").orderBy("ts").collect()
    assert [r.ts for r in k] == [MS + 60000 * i for i in range(4)] and k[0].close_ts == MS + 60000 and k[0].trade_count == 3 and k[0].taker_buy_base == 0.0


def test_trades_gzip_with_seconds(spark, tmp_path):
    with gzip.open(tmp_path / "BTC2025-01-01.csv.gz", "wt") as f:
        f.write("timestamp,symbol,side,price,size,trdMatchID\n1735689600.5,BTC,Sell,100,2,a\n1735689601,BTC,Buy,bad,1,b\n1735689602,BTC,buy,101,1,c\n")
    t = parsers.agg_trades(files.table(spark, str(tmp_path / "BTC2025-01-01.csv.gz")), "BTC").orderBy("ts").collect()
    assert [(r.ts, r.price, r.is_buyer_maker) for r in t] == [(MS + 500, 100.0, True), (MS + 2000, 101.0, False)] and t[0].agg_id != t[1].agg_id


def test_books(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"ts_ms": 1, "bids": [["10", "1"], ["11", "2"], ["x"]], "asks": [["12", "1"]]}\nnot json\n')
    raw = files.json_rows(spark, str(tmp_path / "b.jsonl"), "ts_ms long, bids array<array<string>>, asks array<array<string>>")
    row = parsers.book_depth(raw.where("ts_ms is not null"), "S").first()
    assert (row.bid_price_1, row.bid_size_2, row.ask_price_1, row.ask_price_2, row.update_id) == (11.0, 1.0, 12.0, None, row.ts)
    wide = parsers.book_depth(spark.createDataFrame([(MS, 5, 10.0, 1.0, 11.0, 2.0)], "timestamp long, u long, bid_price_1 double, bid_qty_1 double, ask_price_1 double, ask_qty_1 double"), "S").first()
    assert (wide.update_id, wide.bid_size_1, wide.ask_size_1, wide.bid_price_50) == (5, 1.0, 2.0, None)
    lines = spark.createDataFrame([(0, '{"type":"snapshot","ts":1735689600000,"data":{"s":"S","u":1,"seq":7,"b":[["1","2"]],"a":[]}}'), (1, "broken")], "line long, value string")
    e = parsers.book_events(lines, "S").collect()
    assert len(e) == 1 and (e[0].kind, e[0].ts, e[0].seq) == ("snapshot", MS, 7)
    assert tuple(parsers.decode_errors(lines).first()) == (2, 1)


def test_other_parsers_and_schemas(spark):
    t = spark.createDataFrame([("1", "2", "3", "4", "5", "true")], "transact_time string, best_bid_price string, best_bid_qty string, best_ask_price string, best_ask_qty string, x string")
    assert parsers.book_ticker(t, "S").first().update_id == 1000
    assert parsers.funding_rate(spark.createDataFrame([(MS, 0.1)], "calc_time long, last_funding_rate double"), "S").first().funding_rate == 0.1
    with pytest.raises(ValueError):
        parsers.enforce(t, "agg_trades")
    assert len(parsers.SCHEMAS["book_depth"][0]) == 203


def test_containers_manifests_checksums(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for name, data in (("a.json", b"[1]"), ("b.x", b'{"a":1}\n'), ("c.csv", b"a,b\n"), ("d.gz", gzip.compress(b"x")), ("e", b""), ("logs/f", b"a,b")):
        (tmp_path / name).write_bytes(data)
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in files.containers(spark, str(tmp_path)).collect()}
    assert kinds == {"a.json": "json", "b.x": "jsonl", "c.csv": "csv", "d.gz": "gzip"}
    files.verify(spark, str(tmp_path / "c.csv"), __import__("hashlib").sha256(b"a,b\n").hexdigest())
    with pytest.raises(ValueError):
        files.verify(spark, str(tmp_path / "c.csv"), "0" * 32)
    (tmp_path / "m.json").write_text(json.dumps({"code": "0", "data": [{"details": [{"date": "2025-01-01", "groupDetails": [{"dateTs": "5", "fileName": "f", "url": "u"}]}]}]}, indent=1))
    assert tuple(files.listed_files(spark, str(tmp_path / "m.json")).first()) == ("2025-01-01", 5, "f", "u")
    sized = spark.createDataFrame([("/r/BTC_ob/a", 1), ("/r/BTC_ob/b", 5), ("/r/x/c", 9)], "path string, length long")
    assert [r.path for r in files.largest_of_folder(sized, "btc").collect()] == ["/r/BTC_ob/b"]


def fetch(start, end, limit):
    """A service with a row for each second."""
    return [(t, f"row{t}") for t in range(start + (-start) % 1000, end, 1000)][:limit]


def test_paged_source(spark):
    spark.dataSource.register(files.Pages)
    df = spark.read.format("pages").options(fetch="tests.test_sources_and_streams:fetch", start=0, end=100_000, slice=30_000, limit=7).load()
    assert sorted(r.ts for r in df.collect()) == list(range(0, 100_000, 1000))


def test_retries():
    class Busy(Exception):
        status = 429

    waits, calls = [], []

    def once_more():
        calls.append(1)
        if len(calls) < 3:
            raise Busy
        return "ok"

    assert files.retried(once_more, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        files.retried(lambda: 1 / 0)


def test_upsert_manifest_and_readiness(spark, tmp_path):
    day = 86_400_000
    rows = lambda *r: spark.createDataFrame(list(r), "agg_id long, ts long, price double, qty double, is_buyer_maker boolean, symbol string")
    root = f"file://{tmp_path}/t"
    sinks.upsert(rows((1, MS, 1.0, 1.0, True, "S"), (2, MS + day, 2.0, 1.0, True, "S"), (2, MS + day, 2.5, 1.0, True, "S")), root, "agg_trades", "x", "m")
    m = sinks.upsert(rows((1, MS, 9.0, 1.0, True, "S"), (3, MS, 3.0, 1.0, True, "S")), root, "agg_trades", "x", "m")
    got = {r.agg_id: r.price for r in spark.read.parquet(root + "/agg_trades").collect()}
    assert got[1] == 9.0 and got[3] == 3.0 and len(got) == 3 and [p["rows"] for p in m["partitions"]] == [2, 1]
    assert files.partitioned(spark, root + "/agg_trades", MS, MS + day, ["price"], exchange="x").count() == 2
    sinks.append(rows((4, MS, 3.0, 1.0, True, "S")), root, "agg_trades", "x", "m")
    assert spark.read.parquet(root + "/agg_trades").count() == 4
    assert not sinks.is_ready(spark, root, root + "/agg_trades")
    sinks.mark_ready(spark, root, root + "/agg_trades")
    assert sinks.is_ready(spark, root, root + "/agg_trades")
    sinks.append(rows((5, MS, 3.0, 1.0, True, "S")), root, "agg_trades", "x", "m")
    with pytest.raises(ValueError):
        sinks.is_ready(spark, root, root + "/agg_trades")
    assert "| 3 |" in sinks.report(spark.range(5), "Title")


def scripted(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    book = lambda s, b: ("S", at(s), 0, "book", b - 1.0, b + 1.0, 10.0, 5.0, None, None)
    trade = lambda s, p: ("S", at(s), 1, "trade", None, None, None, None, p, 1.0)
    return [book(10, 100.0), trade(10, 100.0), book(50, 101.0), trade(65, 101.0), book(110, 102.0), trade(125, 102.0), trade(70, 1.0), book(170, 103.0), trade(185, 103.0)]


def run_stream(spark, tmp_path, batches, transform, schema, name):
    source = tmp_path / "in"
    source.mkdir()
    check = str(tmp_path / "check")
    for i, rows in enumerate(batches):  # a new query for each file: state and progress come from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = transform(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("cuts", [(), (3, 6)])
def test_paper_trader_over_restarts(spark, tmp_path, cuts):
    rows, rules = scripted(spark), paper.Rules(return_over=0.005, take_profit=0.005, stop_loss=0.02, hold_minutes=5, share=0.5)
    parts = [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True)]
    got = run_stream(spark, tmp_path, parts, lambda s: paper.paper_trades(s, rules), paper.EVENTS, "paper").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.side, r.exit_reason, r.hold_minutes, r.entry_reasons) == ("long", "take_profit", 1.0, "ret_1m_gt_thr|obi_gt_thr")
    assert r.equity_after == pytest.approx(1000 + r.pnl_net) and r.pnl_gross == pytest.approx(500 / 102)


def test_stream_bars_are_batch_bars(spark, tmp_path):
    rows = [("S", T0 + timedelta(seconds=s), s, 100.0 + s, 1.0) for s in (10, 60, 61, 150, 1000)]
    schema = "symbol string, ts timestamp, agg_id long, price double, qty double"
    got = run_stream(spark, tmp_path, [rows[:3], rows[3:], [("S", T0 + timedelta(seconds=2000), 9, 1.0, 1.0)]], lambda s: stream.stream_bars(s, 60), schema, "bars").orderBy("bar").collect()
    assert [(r.bar, r.mid_open, r.mid_close, r.volume) for r in got[:3]] == [(T0 + timedelta(seconds=60), 110.0, 160.0, 2.0), (T0 + timedelta(seconds=120), 161.0, 161.0, 1.0), (T0 + timedelta(seconds=180), 250.0, 250.0, 1.0)]


def test_messages(spark):
    b = spark.createDataFrame([(1, '{"stream":"x","data":{"e":"trade","s":"S","T":1735689600000,"p":"1.5","q":"2"}}'), (2, '{"stream":"y","data":{"s":"S","E":1735689600000,"b":"1","B":"3","a":"2","A":"4"}}'), (3, "?")], "seq long, value string")
    assert [(r.kind, r.price, r.bid, r.ask_size) for r in paper.decoded(b, "binance").orderBy("seq").collect()] == [("trade", 1.5, None, None), ("book", None, 1.0, 4.0)]
    o = spark.createDataFrame([(1, '{"arg":{"channel":"books5","instId":"S"},"data":[{"ts":"1735689600000","bids":[["1","2","0"]],"asks":[["3","4","0"]]}]}'), (2, '{"arg":{"channel":"trades","instId":"S"},"data":[{"ts":"1735689600000","px":"5","sz":"6"}]}')], "seq long, value string")
    assert [(r.kind, r.bid, r.ask_size, r.qty) for r in paper.decoded(o, "okx").orderBy("seq").collect()] == [("book", 1.0, 4.0, None), ("trade", None, None, 6.0)]
    assert b.select(F.lit(1)).count() == 3


def test_archive_of_days(spark, tmp_path):
    """Days in the window only, checked, parsed, each row once."""
    day = 86_400_000
    for d in range(4):
        name = f"BTC-1m-2025-01-0{d + 1}.zip"
        folder = tmp_path / "data" / "klines" / "BTC" / "1m"
        folder.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(folder / name, "w") as z:
            row = f"{MS + d * day},1,2,0.5,1.5,10"
            z.writestr(name.replace("zip", "csv"), f"open_time,open,high,low,close,volume\n{row}\n{row}\n{MS + d * day + 60000},1,2,0.5,1.5,10\n")
        (folder / f"{name}.CHECKSUM").write_text(__import__("hashlib").sha256((folder / name).read_bytes()).hexdigest() + f"  {name}\n")
    found = files.archive(spark, f"file://{tmp_path}", "klines_1m", "BTC", MS + day, MS + 2 * day + 60000)
    assert sorted(r.ts for r in found.collect()) == [MS + day, MS + day + 60000, MS + 2 * day]
    (folder / "BTC-1m-2025-01-02.zip.CHECKSUM").write_text("0" * 64)
    with pytest.raises(ValueError, match="checksum"):
        files.archive(spark, f"file://{tmp_path}", "klines_1m", "BTC", MS + day, MS + 2 * day)
    assert files.archive(spark, f"file://{tmp_path}", "klines_1m", "BTC", MS, MS + day).count() == 2
    assert files.archive(spark, f"file://{tmp_path}", "agg_trades", "BTC", MS, MS + day).count() == 0
    with pytest.raises(ValueError):
        files.archive(spark, f"file://{tmp_path}", "other", "BTC", MS, MS + day)


def test_paged_service_over_http(spark):
    """Pages of a service on this machine, which is busy at first; klines and a depth snapshot of its answers."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            calls.append(self.path)
            if len(calls) == 1:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            if self.path.startswith("/depth"):
                body = {"lastUpdateId": 7, "bids": [["9", "1"], ["10", "2"]], "asks": [["11", "3"]]}
            else:
                start, end, limit = (int(q[k]) for k in ("startTime", "endTime", "limit"))
                first = -(-start // 60_000) * 60_000
                body = [[t, "1", "2", "0.5", "1.5", "10"] for t in range(first, end, 60_000)][:limit]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        spark.dataSource.register(files.Pages)
        options = {"url": base + "/klines?startTime={start}&endTime={end}&limit={limit}", "start": MS, "end": MS + 600_000, "slice": 300_000, "limit": 2, "interval": 0}
        pages = spark.read.format("pages").options(**options).load()
        row = F.from_json("row", "array<string>")
        raw = pages.select("ts", *(F.get(row, F.lit(i)).alias(n) for i, n in enumerate(("open_time", "open", "high", "low", "close", "volume"))))
        k = parsers.klines(raw.drop("ts"), "S")
        assert sorted(r.ts for r in k.collect()) == [MS + 60_000 * i for i in range(10)] and len(calls) >= 6
        d = files.depth_snapshot(spark, base + "/depth", "S", MS).first()
        assert (d.update_id, d.bid_price_1, d.bid_size_2, d.ask_price_1) == (7, 10.0, 1.0, 11.0)
    finally:
        server.shutdown()


def test_batches_go_to_a_callback(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"x": i}))
    seen = []
    stream_ = spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    for _ in range(2):
        sinks.each_batch(stream_, lambda df, n: seen.append((n, sorted(r.x for r in df.collect()))), f"file://{tmp_path}/c", available_now=True).awaitTermination(120)
    assert [n for n, _ in seen] == [0, 1, 2] and sorted(x for _, xs in seen for x in xs) == [0, 1, 2]


def test_numbers_sides_and_depth_of_sources(spark):
    rows = [("5", "2", "1", "SELL"), ("5", "1", "1", "buy"), ("5", "1", "1", "buy"), ("3", "9", "1", None), ("4", "9", "1", "x")]
    raw = spark.createDataFrame([(str(MS + int(t)), p, q, s) for t, p, q, s in rows], "Timestamp string, Price string, size string, Side string")
    got = [(r.agg_id, r.ts - MS, r.price, r.is_buyer_maker) for r in parsers.numbered_trades(raw, "S").orderBy("agg_id").collect()]
    assert got == [(1, 3, 9.0, False), (2, 4, 9.0, False), (3, 5, 1.0, False), (4, 5, 1.0, False), (5, 5, 2.0, True)]
    assert tuple(parsers.side_counts(raw).first()) == (5, 2) and tuple(parsers.side_counts(raw.drop("Side")).first()) == (5, 5)
    book = spark.createDataFrame([(MS + i, json.dumps([["1", "1"]] * n), "[]") for i, n in enumerate([2, 3, 9])], "ts long, bids string, asks string")
    assert parsers.source_depth(book, 2) == 3 and parsers.source_depth(book) == 9 and parsers.source_depth(book, most=5) == 5
    assert parsers.source_depth(book.drop("bids")) == 0 and parsers.source_depth(book.limit(0)) == 0
