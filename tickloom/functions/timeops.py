"""Time, ordering and rolling windows. Missing values are NULL; divisions by zero give NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .stage import staged

SECOND = 1_000_000
DAY = 86_400


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, of timestamps with or without a zone (read as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def bar_end(ts: Column, seconds: int) -> Column:
    """The end of the right-closed bar (T - width, T] that holds ``ts``."""
    us = micros(ts)
    return from_micros(us + F.pmod(-us, F.lit(seconds * SECOND)))


def bar_floor(ts: Column, seconds: int) -> Column:
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(seconds * SECOND)))


def shifted(ts: Column, seconds: int) -> Column:
    return from_micros(micros(ts) + seconds * SECOND)


def epoch_to_ts(value: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds, told apart by their size."""
    v = value.cast("decimal(38,9)")
    us = F.when(v < 10**11, v * 10**6).when(v < 10**14, v * 10**3).when(v < 10**17, v).otherwise(v / 1000)
    return from_micros(us.cast("long"))


def epoch_ms(value: Column) -> Column:
    """Milliseconds from a column of seconds or milliseconds, told apart row by row."""
    v = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    return F.when(v >= 1e12, v).otherwise(v * 1000).cast("long")


def ordered(by: str | list[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(by).orderBy(*order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    """The row and the n - 1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def upto_now(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def full(n: int, value: Column, result: Column, w: WindowSpec) -> Column:
    """``result`` where the last n rows all have a value."""
    return F.when(F.count(value).over(last_rows(w, n)) >= n, result)


def rolling_mean(x: Column, n: int, w: WindowSpec) -> Column:
    return full(n, x, F.avg(x).over(last_rows(w, n)), w)


def rolling_std(x: Column, n: int, w: WindowSpec) -> Column:
    """Population standard deviation."""
    return full(n, x, F.stddev_pop(x).over(last_rows(w, n)), w)


def rolling_quantile(x: Column, n: int, q: float, w: WindowSpec) -> Column:
    """Exact, with linear interpolation."""
    return full(n, x, F.percentile(x, q).over(last_rows(w, n)), w)


def rolling_zscore(x: Column, n: int, w: WindowSpec, eps: float = 1e-9) -> Column:
    return (x - rolling_mean(x, n, w)) / (F.nullif(rolling_std(x, n, w), F.lit(0.0)) + eps)


def rolling_cdf(x: Column, n: int, w: WindowSpec) -> Column:
    """The share of the last n values that are no greater than the row's."""
    return full(n, x, F.size(F.filter(F.collect_list(x).over(last_rows(w, n)), lambda z: z <= x)) / F.lit(n), w)


def fill_forward(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(upto_now(w))


def chunk_of(ts: Column, seconds: int = DAY) -> Column:
    return F.floor(micros(ts) / (seconds * SECOND))


def by_day(df: DataFrame, by: str, ts: str, tie: str, n: int, run: Callable[[DataFrame, WindowSpec], DataFrame], seconds: int = DAY) -> DataFrame:
    """``run(rows, window)`` with windows of a key's day instead of its whole history; each day also has the n rows before it.

    The last n rows of each day are all that other days need; of these few rows, those before a day go to it. So the rows
    of a hot key are spread over its days, and a window function that looks back n rows at most gives what it would give
    over the whole history. Rows that were only lent to a day are taken away at the end. Within another by_day(), whose
    n has to suffice, the rows are used as they are.
    """
    if "_chunk" in df.columns:
        return run(df, ordered([by, "_chunk"], ts, tie))
    rows = df.withColumn("_chunk", chunk_of(F.col(ts), seconds))
    tails = rows.withColumn("_r", F.row_number().over(ordered([by, "_chunk"], F.desc(ts), F.desc(tie)))).where(F.col("_r") <= n).drop("_r")
    placed = tails.withColumn("_pos", F.row_number().over(ordered(by, ts, tie)))
    counts = tails.groupBy(by, "_chunk").agg(F.count("*").alias("_n"))
    before = counts.select(by, "_chunk", F.sum("_n").over(ordered(by, "_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_upto")).where("_upto is not null")
    lent = before.select(by, "_chunk", F.explode(F.sequence(F.greatest(F.col("_upto") - n + 1, F.lit(1)), F.col("_upto")).cast("array<int>")).alias("_pos"))
    lent = lent.join(placed.drop("_chunk"), [by, "_pos"]).drop("_pos").withColumn("_lent", F.lit(True))
    both = rows.withColumn("_lent", F.lit(False)).unionByName(lent)
    return run(both, ordered([by, "_chunk"], ts, tie)).where("not _lent").drop("_lent", "_chunk")


def filled_by_day(df: DataFrame, value: Column, out: str, by: str, ts: str, tie: str, seconds: int = DAY) -> DataFrame:
    """Adds the last value there is up to each row; a day starts with the last one of the days before it, a row each."""
    rows = df.withColumn("_chunk", chunk_of(F.col(ts), seconds)).withColumn("_value", value)
    last = rows.groupBy(by, "_chunk").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(ts, tie))).alias("_last"))
    known = F.last("_last", ignorenulls=True).over(ordered(by, "_chunk").rowsBetween(Window.unboundedPreceding, -1))
    days = last.select(by, "_chunk", known.alias("_known"))
    filled = F.coalesce(fill_forward(F.col("_value"), ordered([by, "_chunk"], ts, tie)), F.col("_known"))
    return rows.join(days, [by, "_chunk"], "left").withColumn(out, filled).drop("_chunk", "_value", "_known")


def numbered_by_day(df: DataFrame, out: str, by: str, ts: str, tie: str, seconds: int = DAY) -> DataFrame:
    """Adds each row's place in its key's order of time, from 0; a day counts on from the days before it."""
    rows = df.withColumn("_chunk", chunk_of(F.col(ts), seconds))
    counts = rows.groupBy(by, "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(ordered(by, "_chunk").rowsBetween(Window.unboundedPreceding, -1))
    days = counts.select(by, "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(ordered([by, "_chunk"], ts, tie)) - 1
    return rows.join(days, [by, "_chunk"], "left").withColumn(out, F.coalesce("_before", F.lit(0)) + place).drop("_chunk", "_before")


def running_totals(counts: DataFrame, keys: list[str], order: str, columns: list[str], buckets: int = 64) -> DataFrame:
    """Adds cum_<column> for each column: its sum over a key's rows (all rows, without keys) up to ``order``.

    Rows are cut into buckets of about equal number by ranges of ``order``; a bucket is summed by itself, on top of the
    sum of the buckets before it. ``order`` is a number, distinct within a key.
    """
    names = keys or ["_all"]
    rows = counts if keys else counts.withColumn("_all", F.lit(1))
    # a short row for each key
    bounds = rows.groupBy(*names).agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 1000).alias("_bounds"))
    rows = rows.join(F.broadcast(bounds), names).withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(order)))).drop("_bounds")
    sums = rows.groupBy(*names, "_bucket").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    w = ordered(names, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*names, "_bucket", *(F.sum(f"_{c}").over(w).alias(f"_{c}") for c in columns))
    inside = upto_now(ordered([*names, "_bucket"], order))
    out = rows.join(F.broadcast(before), [*names, "_bucket"]).select("*", *((F.coalesce(F.col(f"_{c}"), F.lit(0)) + F.sum(c).over(inside)).alias(f"cum_{c}") for c in columns))
    return out.drop("_bucket", "_all", *(f"_{c}" for c in columns))


def add_quantiles(groups: DataFrame, df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Adds a column for each of ``shares`` to ``groups`` (a row for each key): that exact quantile of the key's values in ``df``,
    with linear interpolation as percentile() has it; NULL where there are none.

    Percentile() sends every task's distinct values to one task for each key. Here they are counted by value, and their places
    are running totals, so no task holds a key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("_key"), F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("n"))
    c = running_totals(staged(counts, "counts"), ["_key"], "_x", ["n"])
    c = c.join(F.broadcast(c.groupBy("_key").agg(F.max("cum_n").alias("_n"))), "_key")  # a short row for each key
    places = {name: q * (F.col("_n") - 1) for name, q in shares.items()}
    at = lambda place: F.min(F.when(F.col("cum_n") > place, F.col("_x")))
    ends = c.groupBy("_key", "_n").agg(*(at(f(p)).alias(f"_{end}_{name}") for name, p in places.items() for end, f in (("lo", F.floor), ("hi", F.ceil))))

    def between(name: str, p: Column) -> Column:
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(name)

    found = ends.select("_key", *(between(name, p) for name, p in places.items()))
    return groups.join(found, F.struct(*(groups[c] for c in by)) == found["_key"], "left").drop("_key")


def log_return(price: Column, w: WindowSpec) -> Column:
    return F.ln(price) - F.ln(F.lag(price).over(w))


def simple_return(price: Column, k: int, w: WindowSpec) -> Column:
    return F.try_divide(price, F.lag(price, k).over(w)) - 1


def forward_return(price: Column, h: int, w: WindowSpec) -> Column:
    return F.try_divide(F.lead(price, h).over(w), price) - 1


def true_range(high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    before = F.lag(close).over(w)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def debounced(flag: Column, enter: int, leave: int, w: WindowSpec) -> Column:
    """On from the enter-th true in a row, off from the leave-th false in a row; off at first. NULL counts as false."""
    f = F.coalesce(flag.cast("int"), F.lit(0))
    on = (F.count(F.lit(1)).over(last_rows(w, enter)) >= enter) & (F.min(f).over(last_rows(w, enter)) == 1)
    off = (F.count(F.lit(1)).over(last_rows(w, leave)) >= leave) & (F.max(f).over(last_rows(w, leave)) == 0)
    return F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(upto_now(w)), F.lit(False))


def run_length(df: DataFrame, flag: str, by: str | list[str], order: str, out: str) -> DataFrame:
    """Adds the number of true flags in a row that end at each row (0 where it is false)."""
    by = [by] if isinstance(by, str) else by
    island = F.sum((~F.coalesce(F.col(flag), F.lit(False))).cast("int")).over(upto_now(ordered(by, order)))
    marked = df.withColumn("_island", island)
    return marked.withColumn(out, F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(upto_now(ordered([*by, "_island"], order)))).drop("_island")


def ols_slope(y: Column, n: int, w: WindowSpec) -> Column:
    """The slope of the last n values over their place in the row."""
    at = F.row_number().over(w).cast("double")
    return at, lambda place: full(n, y, F.regr_slope(y, place).over(last_rows(w, n)), w)


def exact_sum(x: Column) -> Column:
    """A sum that no order of rows changes: in decimals of nine places, back as double."""
    return F.sum(x.cast("decimal(29,9)")).cast("double")


def spine(df: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """All bar ends between each key's first and last."""
    ends = df.groupBy(by).agg(F.min(micros(F.col(ts))).alias("a"), F.max(micros(F.col(ts))).alias("b"))
    return ends.select(by, F.explode(F.sequence("a", "b", F.lit(seconds * SECOND).cast("long"))).alias("us")).select(by, from_micros(F.col("us")).alias(ts))


def resolve(df: DataFrame, *names: str) -> str:
    """The first of the names that is a column."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {', '.join(names)}")


def require(df: DataFrame, *names: str) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
