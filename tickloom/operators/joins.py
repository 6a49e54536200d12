"""Joins along time: as-of, next row, and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeops import SECOND, micros, ordered, upto_now

DAY = 86_400


def asof(left: DataFrame, right: DataFrame, by: str, left_ts: str = "ts", right_ts: str = "ts", ties: str | None = None, prefix: str = "", chunk_seconds: int = DAY) -> DataFrame:
    """Each left row with the last right row at or before its time (columns but the key, with ``prefix``), or NULLs.

    One shuffle by (key, day) of both sides in a union, and a running last of the right row as one struct. So that a
    single hot key doesn't land in one task, each day gets the last row before it from a summary of one row a day. Of
    right rows at one time the greatest by ``ties`` (else by all columns) wins. Left columns must not clash.
    """
    values = [c for c in right.columns if c != by]
    chunk = lambda ts: F.floor(micros(ts) / (chunk_seconds * SECOND))
    struct = F.struct(*values)
    rank = F.struct(F.col(right_ts), *( [F.col(ties)] if ties else [F.col(c) for c in values]))
    r = right.where(F.col(right_ts).isNotNull()).select(F.col(by).alias("_by"), chunk(F.col(right_ts)).alias("_chunk"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), rank.alias("_rank"), struct.alias("_right"))
    l = left.select(F.col(by).alias("_by"), chunk(F.col(left_ts)).alias("_chunk"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))  # noqa: E741
    last = r.groupBy("_by", "_chunk").agg(F.max_by("_right", "_rank").alias("_right"))
    chunks = last.unionByName(l.select("_by", "_chunk").distinct(), allowMissingColumns=True).groupBy("_by", "_chunk").agg(F.first("_right", ignorenulls=True).alias("_right"))
    before = F.last("_right", ignorenulls=True).over(ordered("_by", "_chunk").rowsBetween(Window.unboundedPreceding, -1))
    carried = chunks.select("_by", "_chunk", before.alias("_right")).where("_right is not null").select("*", F.lit(-1).alias("_side"))
    rows = l.unionByName(r, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    w = upto_now(ordered(["_by", "_chunk"], F.when(F.col("_side") < 0, 0).otherwise(1), F.col("_ts").asc_nulls_first(), "_side", "_rank"))
    matched = rows.withColumn("_match", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return matched.select("_left.*", *(F.col("_match")[c].alias(prefix + c) for c in values))


def asof_required(left: DataFrame, right: DataFrame, by: str, left_ts: str = "ts", right_ts: str = "ts", **options: object) -> DataFrame:
    """asof() where every left row has to have a right row at or before it; ValueError if one has none."""
    out = asof(left, right.withColumn("_is_there", F.lit(True)), by, left_ts, right_ts, **options)
    found = f"{options.get('prefix', '')}_is_there"
    if not (early := out.where(F.col(found).isNull())).isEmpty():
        raise ValueError(f"no row at or before {early.select(F.min(left_ts)).first()[0]}")
    return out.drop(found)


def around(events: DataFrame, rows: DataFrame, by: str, at: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Events with the rows at most ``seconds`` before or after, both ends included."""
    from ..functions.timeops import shifted

    return within(events, rows, by, shifted(F.col(at), -seconds), shifted(F.col(at), seconds), 2 * seconds, ts, include_start=True)


def next_row(df: DataFrame, by: str, ts: str, *columns: str) -> DataFrame:
    """Adds each row's strictly later neighbour: next_ts and next_<column>."""
    w = ordered(by, ts)
    return df.select("*", F.lead(ts).over(w).alias("next_ts"), *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))


def within(events: DataFrame, rows: DataFrame, by: str, start: Column, end: Column, span_seconds: int, ts: str = "ts", include_start: bool = False, how: str = "inner") -> DataFrame:
    """Events with the rows in (start, end], or [start, end]; no interval may be longer than ``span_seconds``.

    An equi-join on the key and a bucket as wide as the span: an event looks in the buckets of its interval, which are
    two at most, and the exact bounds follow. No side is broadcast and nothing is crossed.
    """
    width = span_seconds * SECOND
    bucket = lambda x: F.floor(micros(x) / width)
    e = events.select("*", start.alias("_from"), end.alias("_upto"))
    e = e.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(F.col("_from")), bucket(F.col("_upto"))))))
    r = rows.select(F.col(by).alias("_rby"), F.col(ts).alias("_rts"), *[c for c in rows.columns if c not in (by, ts)]).withColumn("_rbucket", bucket(F.col("_rts")))
    low = F.col("_rts") >= F.col("_from") if include_start else F.col("_rts") > F.col("_from")
    joined = e.join(r, (F.col(by) == F.col("_rby")) & (F.col("_bucket") == F.col("_rbucket")) & low & (F.col("_rts") <= F.col("_upto")), how)
    return joined.withColumnRenamed("_rts", f"row_{ts}").drop("_from", "_upto", "_bucket", "_rby", "_rbucket")


def full_outer(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames side by side on their keys; rows that any of them has."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, keys, "full")
    return out


def on_spine(spine: DataFrame, values: DataFrame, keys: list[str], fill: dict[str, object] | None = None) -> DataFrame:
    """The spine's rows with the values there are, and ``fill`` for the columns that have none."""
    out = spine.join(values, keys, "left")
    return out.fillna(fill) if fill else out
