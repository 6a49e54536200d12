"""Scans: partitioned Parquet, CSV and JSON of any container, zipped files, manual folders, paged services."""

from __future__ import annotations

import importlib
import io
import json
import re
import time
import urllib.error
import urllib.request
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import parsers


def partitioned(spark: SparkSession, root: str, start_ms: int, end_ms: int, columns: list[str] | None = None, **keys: str) -> DataFrame:
    """Rows of [start, end) of a table partitioned by date; Spark prunes dates, keys and columns."""
    df = spark.read.parquet(root)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    day = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
    df = df.where((F.col("date") >= day(start_ms)) & (F.col("date") <= day(end_ms - 1)) & (F.col("ts") >= start_ms) & (F.col("ts") < end_ms))
    return df.select(*columns) if columns else df


def table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or text, by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("csv", "gz", "txt"):
        return spark.read.csv(path, header=True)
    raise ValueError(f"unknown kind of file: {path}")


def zipped_lines(spark: SparkSession, path: str | list[str], pattern: str = "*.zip", member: str = ".csv") -> DataFrame:
    """(path, line, value) of the first member with the suffix in each zip; a zip is read whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    inside = next((n for n in z.namelist() if n.lower().endswith(member)), None)
                    lines = z.read(inside).decode("utf-8", "replace").splitlines() if inside else []
                for at in range(0, len(lines), 50_000):
                    part = lines[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())], names=["path", "line", "value"])

    return files.mapInArrow(run, "path string, line long, value string")


def zipped_csv(spark: SparkSession, path: str | list[str], pattern: str = "*.zip") -> DataFrame:
    """The rows of zipped CSV files as strings; files may differ in their headers, which come first."""
    lines = zipped_lines(spark, path, pattern)
    headers = [r["value"] for r in lines.where("line = 0").select("value").distinct().orderBy("value").collect()]  # one for each layout
    out = None
    heads = lines.where("line = 0").select("path", F.col("value").alias("head"))
    for head in headers:
        names = [parsers.plain_name(n) for n in head.split(",")]
        schema = ", ".join(f"`{n}` string" for n in names)
        rows = lines.where("line > 0").join(heads.where(F.col("head") == head).select("path"), "path", "left_semi").select(F.from_csv("value", schema).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no rows under {path}")
    return out


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines, arrays, or objects with a ``data`` list; lines that are no JSON are left out."""
    lines = spark.read.text(path, wholetext=False).where("trim(value) <> ''")
    first = lines.select(F.trim("value").alias("v")).first()
    if first and (first["v"].startswith("[") or first["v"].startswith('{"data"') or first["v"] == "{"):
        whole = spark.read.text(path, wholetext=True)
        kind = f"array<struct<{schema}>>"
        records = F.coalesce(F.from_json("value", kind), F.from_json("value", f"data {kind}")["data"])
        return whole.select(F.explode(records).alias("r")).select("r.*")
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files, plain or gzip; ``line`` is a string in the order of the lines, whatever the splits.

    It is made of the file, of where the split of it begins that has the line, and of the line's place in its task.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value")
    return rows.select("path", F.concat_ws(":", "path", F.lpad(F.col("_start").cast("string"), 15, "0"), F.lpad(F.col("_id").cast("string"), 20, "0")).alias("line"), "value")


def containers(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind): zip, gzip, json, jsonl, csv, binary or unknown, by the first bytes; empty files and log folders are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.lower("path").rlike("/(logs?|__macosx)/"))
    head = F.substring("content", 1, 512)
    text = F.trim(F.try_validate_utf8(head.cast("string"))) if hasattr(F, "try_validate_utf8") else F.trim(head.cast("string"))
    kind = F.when(F.hex(F.substring("content", 1, 2)) == "504B", "zip").when(F.hex(F.substring("content", 1, 2)) == "1F8B", "gzip").when(text.isNull(), "binary").when(text.startswith("["), "json").when(text.startswith("{"), "jsonl").when(text.contains(","), "csv").otherwise("unknown")
    return files.select("path", "length", kind.alias("kind"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, md5) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def verify(spark: SparkSession, path: str, expected: str) -> None:
    """ValueError unless the file has the digest, SHA-256 if it has 64 digits and else MD5."""
    row = checksums(spark, path).first()
    if row is None or row["sha256" if len(expected) == 64 else "md5"] != expected.lower():
        raise ValueError(f"wrong checksum: {path}")


def listed_files(spark: SparkSession, manifest: str) -> DataFrame:
    """(date, date_ts, file_name, url) of a nested download manifest."""
    schema = "code string, data array<struct<dateAggrType:string, ts:string, details:array<struct<date:string, groupDetails:array<struct<dateTs:string, fileName:string, url:string>>>>>>"
    d = spark.read.schema(schema).json(manifest, multiLine=True).select(F.explode("data").alias("d")).select(F.explode("d.details").alias("x")).select("x.date", F.explode("x.groupDetails").alias("g"))
    return d.select("date", F.col("g.dateTs").try_cast("long").alias("date_ts"), F.col("g.fileName").alias("file_name"), F.col("g.url").alias("url"))


def largest_of_folder(files: DataFrame, contains: str) -> DataFrame:
    """Of (path, length), the largest file of each folder whose name holds both the symbol and ``ob``; ties by path."""
    from ..functions.timeops import ordered

    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    name = F.lower(F.regexp_extract("path", "([^/]*)/[^/]*$", 1))
    found = files.withColumn("folder", folder).where(name.contains(contains.lower()) & name.contains("ob"))
    return found.withColumn("_r", F.row_number().over(ordered("folder", F.desc("length"), "path"))).where("_r = 1").drop("_r")


def retried(fetch: Callable[[], object], tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """``fetch()``, again after errors of status 418, 429 and 5xx, waiting twice as long each time or what they ask."""
    for k in range(tries):
        try:
            return fetch()
        except Exception as e:
            status = getattr(e, "status", None)
            if k == tries - 1 or not (status in (418, 429) or status and status >= 500):
                raise
            sleep(getattr(e, "retry_after", None) or wait * 2**k)
    raise RuntimeError("unreachable")


class Throttle:
    """Calls at least ``interval`` seconds apart."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.next = interval, clock, sleep, 0.0

    def __call__(self, fetch: Callable[[], object]) -> object:
        if (wait := self.next - self.clock()) > 0:
            self.sleep(wait)
        self.next = self.clock() + self.interval
        return fetch()


class Pages(DataSource):
    """Rows of a paged service: options start, end, slice (ms), limit, ``interval``, the least seconds between two requests
    of a task, and one of ``fetch`` ("module:function" of start, end, limit, which gives pairs of time and row) and ``url``,
    with {start}, {end} and {limit} in it, whose answer is a JSON list, or an object with one under ``rows``; ``ts`` is the
    name or the place of a row's time. Answers are in order of time, from the start on, at most ``limit`` rows (0: all there are).

    A partition is a slice of time, read page by page. Rows of one time may lie on both sides of a page's edge, so the next page
    begins at the last row's time, and rows that were there already are left out. Where one time fills a page, that leads no
    further: with ``id`` (the name or place of a row's id, which grows with time) and ``from_url`` with {id} and {limit}, or
    ``from_fetch`` of id and limit, pages go on from the last row's id; without, it is a ValueError. No row is lost or comes twice.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "ts long, row string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))


def get(url: str, timeout: float = 30.0) -> bytes:
    """What a GET request gives; an error has its ``status`` and, in seconds, ``retry_after``."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.read()
    except urllib.error.HTTPError as e:
        e.retry_after = float(after) if (after := e.headers.get("Retry-After", "")).isdigit() else None
        raise


def json_page(url: str, rows: str | None, ts: str) -> list[tuple[int, str]]:
    """The rows of one answer, with their times."""
    found = json.loads(get(url))
    found = found[rows] if rows else found
    return [(int(r[int(ts)] if isinstance(r, list) else r[ts]), json.dumps(r)) for r in found or ()]


def depth_snapshot(spark: SparkSession, url: str, symbol: str, ts_ms: int, levels: int = parsers.LEVELS) -> DataFrame:
    """One row of book_depth from a service's answer with ``bids`` and ``asks`` and, where it has one, an update id."""
    j = json.loads(retried(lambda: get(url)))
    j = j.get("data", j)
    update = j.get("lastUpdateId", j.get("u", ts_ms))
    raw = spark.createDataFrame([(ts_ms, int(update), json.dumps(j["bids"]), json.dumps(j["asks"]))], "ts long, update_id long, bids string, asks string")
    return parsers.book_depth(raw, symbol, levels)


#: For each dataset, what the names of daily archive files have between symbol and date.
ARCHIVED = {"klines_1m": "1m", "agg_trades": "aggTrades", "book_ticker": "bookTicker", "book_depth": "bookDepth", "premium_kline": "premiumIndexKline", "mark_kline": "markPriceKline"}
PARSERS = {"klines_1m": parsers.klines, "premium_kline": parsers.klines, "mark_kline": parsers.klines, "agg_trades": parsers.agg_trades, "book_ticker": parsers.book_ticker, "book_depth": parsers.book_depth}


def archive(spark: SparkSession, root: str, dataset: str, symbol: str, start_ms: int, end_ms: int) -> DataFrame:
    """Rows of [start, end) from the daily zips of a dataset anywhere under ``root``, each once.

    Only files of days in the window are read. A file with a .CHECKSUM beside it has to match it, else ValueError.
    """
    if dataset not in ARCHIVED:
        raise ValueError(f"no archives of {dataset}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{symbol}-{ARCHIVED[dataset]}-*").load(root)
    day = F.to_date(F.regexp_extract("path", r"-(\d{4}-\d{2}-\d{2})\.zip(?:\.CHECKSUM)?$", 1))
    dates = [F.to_date(F.timestamp_millis(F.lit(t))) for t in (start_ms, end_ms - 1)]
    files = files.where((day >= dates[0]) & (day <= dates[1]))
    zips = files.where("path like '%.zip'").select("path", F.sha2("content", 256).alias("digest"))
    sums = files.where("path like '%.CHECKSUM'").select(F.regexp_replace("path", r"\.CHECKSUM$", "").alias("path"), F.lower(F.regexp_extract(F.decode("content", "UTF-8"), r"([0-9a-fA-F]{64})", 1)).alias("expected"))
    if wrong := zips.join(sums, "path").where("digest <> expected").select("path").limit(5).collect():
        raise ValueError(f"wrong checksums: {', '.join(r['path'] for r in wrong)}")
    paths = [r["path"] for r in zips.select("path").orderBy("path").collect()]  # a file a day
    if not paths:
        return spark.createDataFrame([], parsers.SCHEMAS[dataset][0])
    rows = PARSERS[dataset](zipped_csv(spark, paths), symbol)
    return parsers.enforce(rows, dataset).where((F.col("ts") >= start_ms) & (F.col("ts") < end_ms)).dropDuplicates()


class Slice(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Slice]:
        start, end, step = (int(self.options[k]) for k in ("start", "end", "slice"))
        return [Slice(a, min(a + step, end)) for a in range(start, end, step)]

    def read(self, partition: Slice) -> Iterator[tuple[int, str]]:
        if "url" in self.options:
            fetch = lambda start, end, limit: json_page(self.options["url"].format(start=start, end=end, limit=limit), self.options.get("rows"), self.options.get("ts", "0"))
        else:
            module, name = self.options["fetch"].split(":")
            fetch = getattr(importlib.import_module(module), name)
        limit, at = int(self.options.get("limit", 1000)), partition.start
        throttled = Throttle(float(self.options.get("interval", 0)))
        ask = lambda f, *args: list(retried(lambda: throttled(lambda: f(*args))))
        after = self.by_id()
        seen: Counter[str] = Counter()  # rows of the time ``at`` that earlier pages had
        while True:
            rows = ask(fetch, at, partition.end, limit)
            before, fresh = seen.copy(), []
            for ts, row in rows:
                if ts == at and before[row] > 0:
                    before[row] -= 1
                elif partition.start <= ts < partition.end:
                    fresh.append((ts, row))
            yield from fresh
            if not limit or len(rows) < limit or rows[-1][0] >= partition.end:
                return
            last = rows[-1][0]
            if last == at:
                break
            at, seen = last, Counter(row for ts, row in rows if ts == last)
        if after is None:
            raise ValueError(f"more rows of time {at} than the {limit} of a page; pages by id need id and from_url or from_fetch")
        known = max(self.id_of(row) for _, row in rows)
        while True:
            rows = ask(after, known + 1, limit)
            yield from ((ts, row) for ts, row in rows if partition.start <= ts < partition.end)
            if len(rows) < limit or rows[-1][0] >= partition.end:
                return
            known = max(self.id_of(row) for _, row in rows)

    def by_id(self) -> Callable[[int, int], list[tuple[int, str]]] | None:
        if "id" in self.options and "from_url" in self.options:
            return lambda ident, limit: json_page(self.options["from_url"].format(id=ident, limit=limit), self.options.get("rows"), self.options.get("ts", "0"))
        if "id" in self.options and "from_fetch" in self.options:
            module, name = self.options["from_fetch"].split(":")
            return getattr(importlib.import_module(module), name)
        return None

    def id_of(self, row: str) -> int:
        r, name = json.loads(row), self.options["id"]
        return int(r[int(name)] if isinstance(r, list) else r[name])


def latest_run(spark: SparkSession, root: str) -> str:
    """The folder of the last run under ``root``, by the stamp (YYYYMMDD_HHMMSS) that its name begins with."""
    from .sinks import files as hadoop

    fs, to_path = hadoop(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(to_path(root)) if f.isDirectory()] if fs.exists(to_path(root)) else []
    stamped = sorted(n for n in names if re.match(r"\d{8}_\d{6}", n))
    if not stamped:
        raise ValueError(f"no runs under {root}")
    return f"{root.rstrip('/')}/{stamped[-1]}"


def trade_log_of(spark: SparkSession, run: str, *names: str) -> DataFrame:
    """The first trade log that a run has, of ``names``: by default the one with early exits, then the plain one."""
    from .sinks import files as hadoop

    fs, to_path = hadoop(spark, run)
    for name in names or ("enhanced", "baseline"):
        if fs.exists(to_path(f"{run}/{name}")):
            return spark.read.parquet(f"{run}/{name}")
    raise ValueError(f"no trade log in {run}")
