"""Sinks: partitioned upserts, manifests, fingerprints, reports."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import scratch, staged  # noqa: F401
from ..operators.quality_gates import keep_last, validate
from . import parsers

PARTITIONS = ["exchange", "market", "date"]


def files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def upsert(df: DataFrame, root: str, dataset: str, exchange: str, market: str, gap_seconds: int | None = None) -> dict:
    """Rows into ``root``/dataset, by key: the last by time wins, and of equal times the row that came now.

    Only the dates that the rows touch are read and written again, here and in the manifest. Rows are staged, as Spark
    can't overwrite what it reads, and replace the partitions of their dates; Spark moves one date after another, so a
    reader in between can see some of them new. Returns the manifest.
    """
    spark, path, (schema, key) = df.sparkSession, f"{root}/{dataset}", parsers.SCHEMAS[dataset]
    new = parsers.enforce(df, dataset).withColumn("date", F.to_date(F.timestamp_millis("ts"))).withColumn("_gen", F.lit(1))
    fs, to_path = files(spark, path)
    if fs.exists(to_path(path)) and any(f.isDirectory() for f in fs.listStatus(to_path(path))):
        dates = F.broadcast(new.select("date").distinct())
        old = spark.read.parquet(path).where((F.col("exchange") == exchange) & (F.col("market") == market)).select(*schema.names, "date").join(dates, "date", "left_semi").withColumn("_gen", F.lit(0))
        new = new.unionByName(old)
    stage = f"{root}/.stage-{uuid.uuid4().hex}"
    try:
        keep_last(new, key, ["ts", "_gen", *(n for n in schema.names if n not in (*key, "ts"))]).drop("_gen").write.parquet(stage)
        rows = spark.read.parquet(stage)
        validate(rows.withColumn("ts", F.timestamp_millis("ts")) if gap_seconds else rows, key, "symbol", "ts", gap_seconds)
        placed = rows.withColumn("exchange", F.lit(exchange)).withColumn("market", F.lit(market))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
        touched = [r["date"] for r in rows.select("date").distinct().collect()]  # days
    finally:
        fs.delete(to_path(stage), True)
    return write_manifest(spark, root, dataset, exchange, market, touched)


def append(df: DataFrame, root: str, dataset: str, exchange: str, market: str) -> None:
    rows = parsers.enforce(df, dataset).withColumn("date", F.to_date(F.timestamp_millis("ts"))).withColumn("exchange", F.lit(exchange)).withColumn("market", F.lit(market))
    rows.write.mode("append").partitionBy(*PARTITIONS).parquet(f"{root}/{dataset}")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Gives each micro-batch of a stream, with its number, to ``write``; the checkpoint makes a restart go on where it was.

    A batch that failed half-way comes again with the same number. Returns the running query.
    """
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def write_manifest(spark: SparkSession, root: str, dataset: str, exchange: str, market: str, touched: list | None = None) -> dict:
    """Rows and range of each date, as JSON beside the data. With ``touched``, only these dates are counted anew."""
    path = f"{root}/_manifests/{dataset}-{exchange}-{market}.json"
    old = read_text(spark, path) if touched is not None else None
    rows = spark.read.parquet(f"{root}/{dataset}").where((F.col("exchange") == exchange) & (F.col("market") == market))
    if old:
        rows = rows.where(F.col("date").isin(*touched)) if touched else rows.limit(0)
    counted = rows.groupBy("date").agg(F.count("*").alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end")).collect()  # a row a day
    days = {d["date"]: d for d in json.loads(old)["partitions"]} if old else {}
    days |= {str(d["date"]): {"date": str(d["date"]), "rows": d["rows"], "start": d["start"], "end": d["end"]} for d in counted}
    manifest = {"dataset": dataset, "exchange": exchange, "market": market, "schema": "v1", "rows": sum(d["rows"] for d in days.values()), "partitions": [days[k] for k in sorted(days)]}
    write_text(spark, path, json.dumps(manifest, indent=1))
    return manifest


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, to_path = files(spark, path)
    out = fs.create(to_path(path), True)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, to_path = files(spark, path)
    if not fs.exists(to_path(path)):
        return None
    stream = fs.open(to_path(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a folder's files: what tells whether a build is still good."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime").orderBy("path").collect()  # metadata
    return hashlib.sha256(json.dumps([[r["path"], r["length"], str(r["modificationTime"])] for r in rows]).encode()).hexdigest()


def is_ready(spark: SparkSession, built: str, source: str) -> bool:
    """Whether ``built`` was marked ready for the source as it is; ValueError if it was for another."""
    mark = read_text(spark, f"{built}/_SOURCE.json")
    if mark is None:
        return False
    if json.loads(mark)["fingerprint"] != fingerprint(spark, source):
        raise ValueError(f"{built} was made from other files than are in {source}")
    return True


def mark_ready(spark: SparkSession, built: str, source: str) -> None:
    write_text(spark, f"{built}/_SOURCE.json", json.dumps({"fingerprint": fingerprint(spark, source)}))


def report(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """Markdown of a small result."""
    found = rows.limit(limit).collect()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in found)]) + "\n"
