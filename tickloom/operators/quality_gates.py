"""Keys, gaps, coverage, missing values: the gates that data pass before features are built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import add_quantiles, by_day, exact_sum, micros, ordered


def _one(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(ordered(key, *order))).where("_r = 1").drop("_r")


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; ``order`` has to be total for one result."""
    return _one(df, key, [F.col(c).desc() for c in order])


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return _one(df, key, [F.col(c).asc() for c in order])


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def gaps(df: DataFrame, by: str, ts: str, tie: str, most_seconds: int) -> DataFrame:
    rows = by_day(df.select(*dict.fromkeys((by, ts, tie))), by, ts, tie, 1, lambda d, w: d.withColumn(f"prev_{ts}", F.lag(ts).over(w)))
    found = rows.select(by, ts, f"prev_{ts}").withColumn("gap_us", micros(F.col(ts)) - micros(F.col(f"prev_{ts}")))
    return found.where(F.col("gap_us") > most_seconds * 1_000_000)


def validate(df: DataFrame, key: list[str], by: str, ts: str, most_gap_seconds: int | None = None) -> None:
    """Raises ValueError on a repeated key, or on a gap above the limit."""
    if not key_violations(df, key).isEmpty():
        raise ValueError(f"repeated keys {key}")
    if most_gap_seconds and not gaps(df, by, ts, ts, most_gap_seconds).isEmpty():
        raise ValueError(f"a gap of more than {most_gap_seconds} s")


def sum_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(key), F.lit("UNKNOWN")).alias("key")).agg(exact_sum(F.col(value)).alias("total"))


def minute_coverage(df: DataFrame, by: str, ts: str) -> DataFrame:
    """Distinct minutes with rows against those between the first and the last row."""
    minutes = df.groupBy(by).agg(F.countDistinct(F.floor(micros(F.col(ts)) / 60_000_000)).alias("minutes"), F.ceil((F.max(micros(F.col(ts))) - F.min(micros(F.col(ts))) + 1) / 60_000_000).alias("expected"))
    return minutes.withColumn("ratio", F.col("minutes") / F.col("expected"))


def rows_per_day(df: DataFrame, by: str, ts: str) -> DataFrame:
    return df.groupBy(by, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def median_gap(df: DataFrame, by: str, ts: str, tie: str) -> DataFrame:
    """The exact median, from counts of distinct gaps."""
    rows = by_day(df.select(*dict.fromkeys((by, ts, tie))), by, ts, tie, 1, lambda d, w: d.withColumn("g", micros(F.col(ts)) - micros(F.lag(ts).over(w))))
    gaps = rows.select(by, "g").where("g is not null")
    return add_quantiles(gaps.select(by).distinct(), gaps, [by], "g", {"median": 0.5}).select(by, (F.col("median") / 1_000_000).alias("median_gap_s"))


def missing_share(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))


def enough_values(df: DataFrame, columns: list[str], most_missing: float = 0.8) -> list[str]:
    """The columns with no larger share of missing values."""
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).first()
    return [c for c in columns if shares[c] is not None and shares[c] <= most_missing]


def health(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Mean, deviation, range, share beyond five deviations, and the second half's mean against the first's."""
    totals = df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))
    rows = df.select(by, F.col(value).alias("x"), F.row_number().over(ordered(by, order)).alias("r")).join(totals, by)
    late = F.col("r") > F.floor(F.col("n") / 2)
    halves = rows.groupBy(by).agg(F.avg((F.abs(F.col("x") - F.col("mean")) > 5 * F.col("std")).cast("double")).alias("outlier_share"), (F.avg(F.when(late, F.col("x"))) - F.avg(F.when(~late, F.col("x")))).alias("moved"))
    return totals.join(halves, by).select(by, "mean", "std", "min", "max", "outlier_share", F.try_divide("moved", "std").alias("drift_z"))


def missing_days(df: DataFrame, ts: str) -> DataFrame:
    """The days without rows between the first and the last."""
    days = df.select(F.to_date(ts).alias("day")).distinct()
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days, "day", "left_anti")


def middles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, of an exact sum, and median of number columns: a row for each column."""
    mean = lambda c: F.try_divide(exact_sum(F.col(c)), F.count(c))
    means = df.agg(*(mean(c).alias(f"mean_{i}") for i, c in enumerate(columns)))
    means = means.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"mean_{i}").alias("mean")) for i, c in enumerate(columns)))))
    values = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))))
    return add_quantiles(means, values, ["column"], "x", {"median": 0.5})


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows that a seed picks: those with the least digests of seed and key, whatever the order of the input."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def first_and_last(df: DataFrame, by: str, order: list[str], n: int = 3) -> DataFrame:
    """The first n and the last n rows of each key, with their place and the end it counts from (both, for few rows)."""
    up, down = ordered(by, *order), ordered(by, *(F.col(c).desc() for c in order))
    placed = [df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("from_end", F.lit(end)) for w, end in ((up, False), (down, True))]
    return placed[0].unionByName(placed[1])


def columns_by(df: DataFrame, prefixes: tuple[str, ...] = (), words: tuple[str, ...] = (), first: int | None = None) -> list[str]:
    """The columns that begin with one of the prefixes or hold one of the words, the first so many of them."""
    return [c for c in df.columns if c.startswith(prefixes) or any(w in c for w in words)][:first]
